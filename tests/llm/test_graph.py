from collections import Counter

from quakeframe.llm.common import bounded_sample, hash_fraction
from quakeframe.llm.graph import join_frequent


def test_frequent_keys_join_like_the_others(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 500 + [2] * 40 + list(range(3, 60)))], "k long, i long")
    lookup = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 10 AS v")
    for share in (1, 10, 100000):
        out = join_frequent(rows, lookup, "k", share)
        assert out.columns == ["k", "i", "v"]
        assert Counter(map(tuple, out.collect())) == Counter((r.k, r.i, r.k * 10) for r in rows.collect())


def test_samples_are_bounded_and_stable(spark):
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id = 7 THEN NULL ELSE 'hot' END AS g")
    sample = bounded_sample(rows, "g", "id", 300, 5)
    counts = {r.g: r["count"] for r in sample.groupBy("g").count().collect()}
    assert counts["rare"] == 200 and 300 < counts["hot"] < 450 and None not in counts
    assert {r.id for r in sample.collect()} == {r.id for r in bounded_sample(rows.repartition(7), "g", "id", 300, 5).collect()}
    spread = rows.select(hash_fraction(rows.id, 1).alias("h")).selectExpr("min(h) AS a", "max(h) AS z", "avg(h) AS m").first()
    assert 0 <= spread.a < 0.01 and 0.99 < spread.z < 1 and abs(spread.m - 0.5) < 0.02
    assert bounded_sample(rows.limit(0), "g", "id", 10, 5).count() == 0


def test_samples_of_very_many_groups_share_the_bound(spark):
    rows = spark.range(30000).selectExpr("id", "id % 3000 AS g")
    sample = bounded_sample(rows, "g", "id", 8, 5, most=100)
    assert sample.columns == ["id", "g"]
    assert 850 < sample.count() < 1150 and 700 < sample.select("g").distinct().count() < 1000
    assert bounded_sample(rows, "g", "id", 8, 5, most=3000).count() == 30000
