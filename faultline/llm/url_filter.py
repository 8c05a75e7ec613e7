"""URL filter by path-template trees (operator 9).

Explicit rules come first. The urls they decide are the labelled examples from which the rest is judged: per
host, paths form a tree of templates. Digits and long hexadecimal runs are variable at once; at each level of the
tree, segments that are rarer than an even share of a wide node become the wildcard ``*``, and branches whose
share of blocked examples is statistically like their parent's are merged into ``*`` too.

The purity of a node is its share of blocked examples, smoothed towards what it inherits: root, domain (the last
two labels), host, and each step of the template in turn. Above the hosts, a host is one example, with the shares of
its urls that are labelled and blocked, so that a large host doesn't speak for the others. A node passes its purity on in so far as its urls have
labels: what a child inherits lies between what the parent inherited and the parent's purity, by the labelled share
of the parent's urls, where one without a label weighs ``UNLABELLED``. So a branch without labels is judged by its siblings where these make up most of the parent. A
template is rejected when its purity is over one half.

Levels are built until no path goes on; a path that is alone under its node leaves at once with the rest of it as it
is. Everything runs on counts per (host, path with variable parts), so a host with a third of all urls costs one row
for each of its distinct generalised paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, table

#: rule -> verdict. A rule is a host (with all its subdomains) and a path prefix; the longest that fits wins.
RULES: dict[str, str] = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Children from which a node counts as wide.
WIDE = 25
#: Standard deviations under which a branch is like its parent.
LIKE = 1.0
#: Blocked share expected without examples, and the number of examples it weighs.
PRIOR, PRIOR_WEIGHT = 0.2, 2.0
#: Weight of a url without a label beside one with a label, against passing a purity on.
UNLABELLED = 0.75
#: Levels of the tree in the SQL below, which can't loop; the operator has no such bound.
SQL_LEVELS = 6
#: Blocked share over which a template is rejected.
PURITY = 0.5


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host in lower-case ASCII, path); both empty for null or without ``://``."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER), F.regexp_extract(u, URL, 2)


def rule_of(host: F.Column, path: F.Column, rules: dict[str, str]) -> F.Column:
    out = F.when(F.lit(False), F.lit(""))
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at, _, start = rule.partition("/")
        out = out.when(((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + start)), F.lit(rule))
    return out.otherwise(F.lit(None))


def verdict_of(rule: F.Column, rules: dict[str, str]) -> F.Column:
    out = F.when(F.lit(False), F.lit(""))
    for r, v in rules.items():
        out = out.when(rule == r, F.lit(v))
    return out.otherwise(F.lit(None))


def generalised(path: F.Column) -> F.Column:
    return F.regexp_replace(F.regexp_replace(path, "[0-9a-f]{16,}", "{h}"), "[0-9]+", "{n}")


def _like_parent(bad: F.Column, seen: F.Column, all_bad: F.Column, all_seen: F.Column) -> F.Column:
    rate = (all_bad + 1.0) / (all_seen + 2.0)
    own = (bad + rate) / (seen + 1.0)
    return (seen > 0) & (F.abs(own - rate) * F.sqrt(seen + 1.0) < F.lit(LIKE) * F.sqrt(rate * (1.0 - rate)))


def domain_of(host: F.Column) -> F.Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def _smoothed(bad: F.Column, seen: F.Column, inherited: F.Column) -> F.Column:
    return (bad + F.lit(PRIOR_WEIGHT) * inherited) / (seen + F.lit(PRIOR_WEIGHT))


def _passed_on(bad: F.Column, seen: F.Column, n: F.Column, inherited: F.Column) -> F.Column:
    return inherited + (_smoothed(bad, seen, inherited) - inherited) * seen / (seen + F.lit(UNLABELLED) * (n - seen))


def path_templates(paths: DataFrame) -> DataFrame:
    """``paths`` (host, gpath, n, bad, seen) with its template and purity: host, gpath, template, purity."""
    n, bad, seen = F.col("n"), F.col("bad"), F.col("seen")
    sums = [F.sum(x).alias(x) for x in ("n", "bad", "seen")]
    hosts = paths.groupBy("host").agg(*sums).withColumn("domain", domain_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.count("*").alias("n"), *(F.sum(F.col(x) / F.col("n")).alias(x) for x in ("bad", "seen")))
    root = domains.agg(*sums).select(_passed_on(bad, seen, n, F.lit(PRIOR)).alias("inherited"))  # one row
    domains = domains.crossJoin(F.broadcast(root)).select("domain", _passed_on(bad, seen, n, F.col("inherited")).alias("inherited"))
    hosts = hosts.join(domains, "domain").select("host", _passed_on(bad, seen, n, F.col("inherited")).alias("inherited"))
    # a path starts with the separator or is empty; an empty one is one empty segment
    live = paths.join(hosts, "host").withColumn("prefix", F.lit("")).withColumn("rest", F.regexp_replace("gpath", "^/", ""))
    done: DataFrame | None = None
    level = 0
    while True:
        level += 1
        live = live.withColumn("segment", F.split_part("rest", F.lit("/"), F.lit(1)))
        child = live.groupBy("host", "prefix", "segment").agg(F.count("*").alias("paths"), *(F.sum(x).alias(f"c_{x}") for x in ("n", "bad", "seen")))
        parent = child.groupBy("host", "prefix").agg(F.count("*").alias("wide"), F.sum("paths").alias("all_paths"), *(F.sum(f"c_{x}").alias(f"p_{x}") for x in ("n", "bad", "seen")))
        rare = (F.col("wide") >= WIDE) & (F.col("c_n") * F.col("wide") < F.col("p_n"))
        like = _like_parent(F.col("c_bad"), F.col("c_seen"), F.col("p_bad"), F.col("p_seen"))
        step = F.when((F.col("segment") != "") & (rare | like), F.lit("*")).otherwise(F.col("segment"))
        named = child.join(parent, ["host", "prefix"]).select("host", "prefix", "segment", F.concat("prefix", F.lit("/"), step).alias("next"), (F.col("all_paths") == 1).alias("alone"))
        # paths without a segment end at their node
        met = live.join(named, ["host", "prefix", "segment"])
        ends = ~F.contains("rest", F.lit("/"))
        template = F.when(F.col("alone"), F.concat("prefix", F.lit("/"), F.col("rest"))).otherwise(F.col("next"))
        met = met.withColumn("template", template).withColumn("last", ends | F.col("alone"))
        met = save(met.select("host", "gpath", "n", "bad", "seen", "inherited", "rest", "template", "last"), f"level{level}")
        leaves = met.filter("last").groupBy("host", "template").agg(*sums, F.first("inherited").alias("inherited"))
        leaves = leaves.select("host", "template", _smoothed(bad, seen, F.col("inherited")).alias("purity"))
        part = met.filter("last").select("host", "gpath", "template").join(leaves, ["host", "template"]).select("host", "gpath", "template", "purity")
        done = part if done is None else done.unionByName(part)
        going = met.filter("NOT last")
        if going.isEmpty():
            return done
        nodes = going.groupBy("host", "template").agg(*sums, F.first("inherited").alias("inherited"))
        nodes = nodes.select("host", "template", _passed_on(bad, seen, n, F.col("inherited")).alias("inherited"))
        live = going.drop("inherited", "last").join(nodes, ["host", "template"]).select(
            "host", "gpath", "n", "bad", "seen", "inherited", F.col("template").alias("prefix"), F.expr("substring(rest, instr(rest, '/') + 1)").alias("rest")
        )


def judge_urls(pages: DataFrame, rules: dict[str, str] | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, template, purity.

    Null urls and urls without ``://`` have an empty host and path and are judged like any other. Repeated rows
    get equal verdicts; of rules that fit equally long only one can. Long paths take a round of joins for each level that
    two paths share. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col(url))
    placed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    placed = placed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of(F.col("rule"), rules)).withColumn("gpath", generalised(F.col("path")))
    counted = placed.groupBy("host", "gpath").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count("ruled").alias("seen"))
    judged = path_templates(save(counted, "paths"))
    out = placed.join(judged, ["host", "gpath"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") > PURITY, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _op9_sql() -> str:
    def fits(rule: str) -> str:
        at, _, start = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{start}')"

    def smoothed(inherited: str) -> str:
        return f"(bad + {PRIOR_WEIGHT} * {inherited}) / (seen + {PRIOR_WEIGHT})"

    def passed(inherited: str) -> str:
        return f"{inherited} + ({smoothed(inherited)} - {inherited}) * seen / (seen + {UNLABELLED} * (n - seen))"

    order = sorted(RULES, key=lambda r: (-len(r), r))
    parts = [
        f"""u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host,
 regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages)""",
        "r AS (SELECT *, CASE " + " ".join(f"WHEN {fits(x)} THEN '{x}'" for x in order) + " END AS rule, regexp_replace(regexp_replace(path, '[0-9a-f]{16,}', '{h}', 'g'), '[0-9]+', '{n}', 'g') AS gpath FROM u)",
        "p AS (SELECT *, CASE rule " + " ".join(f"WHEN '{x}' THEN '{v}'" for x, v in RULES.items()) + " END AS ruled FROM r)",
        "g AS (SELECT host, gpath, count(*) AS n, count(*) FILTER (ruled = 'block') AS bad, count(ruled) AS seen FROM p GROUP BY host, gpath)",
        f"""h AS (SELECT host, regexp_extract(host, '([^.]*\\.)?[^.]*$') AS domain, sum(n) AS n, sum(bad) AS bad, sum(seen) AS seen FROM g GROUP BY ALL),
dm AS (SELECT domain, count(*) AS n, sum(bad / n) AS bad, sum(seen / n) AS seen FROM h GROUP BY ALL),
rt AS (SELECT {passed(str(PRIOR))} AS inherited FROM (SELECT sum(n) AS n, sum(bad) AS bad, sum(seen) AS seen FROM dm)),
dp AS (SELECT domain, {passed("inherited")} AS inherited FROM dm, rt),
hp AS (SELECT host, {passed("inherited")} AS inherited FROM h JOIN dp USING (domain)),
l1 AS (SELECT g.*, inherited, '' AS prefix, regexp_replace(gpath, '^/', '') AS rest FROM g JOIN hp USING (host))""",
    ]
    for k in range(1, SQL_LEVELS + 1):
        rate = "((p_bad + 1.0) / (p_seen + 2.0))"
        parts.append(
            f"""s{k} AS (SELECT *, split_part(rest, '/', 1) AS segment FROM l{k}),
c{k} AS (SELECT host, prefix, segment, count(*) AS paths, sum(n) AS c_n, sum(bad) AS c_bad, sum(seen) AS c_seen FROM s{k} GROUP BY ALL),
q{k} AS (SELECT host, prefix, count(*) AS wide, sum(paths) AS all_paths, sum(c_n) AS p_n, sum(c_bad) AS p_bad, sum(c_seen) AS p_seen FROM c{k} GROUP BY ALL),
n{k} AS (SELECT host, prefix, segment, all_paths = 1 AS alone, prefix || '/' || CASE WHEN segment <> '' AND ((wide >= {WIDE} AND c_n * wide < p_n) OR (c_seen > 0 AND
 abs((c_bad + {rate}) / (c_seen + 1.0) - {rate}) * sqrt(c_seen + 1.0) < {LIKE} * sqrt({rate} * (1.0 - {rate})))) THEN '*' ELSE segment END AS next FROM c{k} JOIN q{k} USING (host, prefix)),
m{k} AS (SELECT s.host, gpath, n, bad, seen, inherited, rest, CASE WHEN alone THEN s.prefix || '/' || rest ELSE next END AS template, alone OR NOT contains(rest, '/') AS last FROM s{k} s JOIN n{k} USING (host, prefix, segment)),
e{k} AS (SELECT host, template, {smoothed("inherited")} AS purity FROM (SELECT host, template, sum(n) AS n, sum(bad) AS bad, sum(seen) AS seen, any_value(inherited) AS inherited FROM m{k} WHERE last GROUP BY ALL)),
d{k} AS (SELECT host, gpath, template, purity FROM m{k} JOIN e{k} USING (host, template) WHERE last),
v{k} AS (SELECT host, template, {passed("inherited")} AS inherited FROM (SELECT host, template, sum(n) AS n, sum(bad) AS bad, sum(seen) AS seen, any_value(inherited) AS inherited FROM m{k} WHERE NOT last GROUP BY ALL)),
l{k + 1} AS (SELECT m.host, gpath, n, bad, seen, v.inherited, m.template AS prefix, substr(rest, instr(rest, '/') + 1) AS rest FROM m{k} m JOIN v{k} v ON m.host = v.host AND m.template = v.template WHERE NOT last)"""
        )
    parts.append("t AS (" + " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(1, SQL_LEVELS + 1)) + ")")
    return "WITH " + ",\n".join(parts) + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN purity > {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(purity, 6) AS purity
FROM p JOIN t ON p.host = t.host AND p.gpath = t.gpath"""


OP9_SQL = _op9_sql()
