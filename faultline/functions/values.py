"""Scalar values: identifiers, timestamps, asset keys, labels, flags. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FALLBACK_ROLES, LOCATION_TYPES, PRIMARY_ROLES

TIME_FORMATS = ("M/d/yyyy H:m", "M/d/yyyy", "yyyy-M-d", "yyyy/M/d", "yyyyMMdd")


def valid_identifier(c: Column, allow_zero: bool = False) -> Column:
    """Neither null nor blank nor a word for missing; ``0`` only if allowed."""
    bad = ["", "null", "none", "nan"] + ([] if allow_zero else ["0"])
    return F.coalesce(~F.lower(F.trim(c)).isin(*bad), F.lit(False))


def parse_timestamp(c: Column, as_of: Column) -> Column:
    """ISO first, then four common forms; null before 1990 and after ``as_of``. Times without a zone are UTC."""
    t = F.trim(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(t))
    out = F.coalesce(iso, *(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS))
    return F.when((out >= F.lit("1990-01-01").cast("timestamp")) & (out <= as_of), out)


def asset_key(kind: Column, uid: Column) -> Column:
    return F.concat_ws(":", F.upper(F.regexp_replace(F.trim(kind), r"\s+", "_")), F.upper(F.trim(uid)))


def asset_class(kind: Column) -> Column:
    return F.when(F.upper(F.trim(F.translate(kind, "_", " "))).isin(*LOCATION_TYPES), "location").otherwise("equipment")


def label(c: Column, upper: bool = False) -> Column:
    """White space collapsed; title case, or upper case for departments."""
    x = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.upper(x) if upper else F.initcap(x)


def tri_state(c: Column) -> Column:
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("true", "1", "yes"), True).when(x.isin("false", "0", "no"), False)


def role_priority(role: Column) -> Column:
    r = F.lower(F.trim(role))
    return F.when(r.isin(*PRIMARY_ROLES), 2).when(r.isin(*FALLBACK_ROLES), 1).otherwise(0)


def source_label(identity: Column) -> Column:
    """The kind of source that an identity's prefix names."""
    return (
        F.when(F.startswith(identity, F.lit("starter:")), "starter")
        .when(F.startswith(identity, F.lit("cityworks:")), "cityworks")
        .when(identity.rlike("^demo:[0-9a-f]{16}:.+"), "demo")
        .otherwise("other")
    )


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def day_span(later: Column, earlier: Column) -> Column:
    """Exact days between two times, with fractions."""
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def floor_days(later: Column, earlier: Column) -> Column:
    return F.floor(day_span(later, earlier)).cast("long")
