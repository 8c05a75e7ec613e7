"""Finding 14 of round 3: every trusted document counts."""

import random

from faultline.llm import quality


def test_f14_every_good_document_is_trusted(spark):
    labels = spark.range(25_000).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 100 = 0 AS INT) AS toxic")
    assert quality.trusted_ids(labels).count() == 24_750


def test_f14_order_statistics(spark):
    r = random.Random(4)
    values = [r.choice((-3.5, 0.25, r.random(), r.random() * 1e-9, 1e6)) for _ in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "score double")
    ranks = [0, 1, 9, 1000, 2499, 2500, 4998, 4999]
    found = quality.order_statistics(rows, "score", ranks, 16)
    assert found == {k: sorted(values)[k] for k in ranks}
