import hashlib
import math

import duckdb
import numpy as np

from quakeframe.llm import clusters


def brute(rows, k=8, rounds=10, width=64, scale=1024):
    """Lloyd's rounds over all rows, in Python integers."""
    kept = [(i, [max(-clusters.HOLD, min(clusters.HOLD, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, sum(e for _, b, e in out if b == c), sum(e for _, _, e in out), digest[c]) for i, c, d in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, q string, n long")


def some(seed, n, width=64):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(size=width)]) for i in range(n)]


def by_row(rows):
    return sorted(map(tuple, rows), key=repr)


def test_rounds_equal_brute_force(spark):
    rows = some(1, 90)
    rows += [(100 + i, rows[3][1]) for i in range(60)]  # copies
    rows += [(7, rows[8][1]), (7, rows[7][1]), (None, rows[9][1])]  # repeated and null ids
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [math.inf] + [1.0] * 63), (206, [math.nan] * 64)]
    rows += bad + [(300, [1e300, -1e300] + [0.0] * 62), (301, [0.0] * 64)]
    got = clusters.weighted_clusters(frame(spark, rows).repartition(5))
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert by_row(got.collect()) == by_row(brute(rows))


def test_few_rows_ties_and_an_empty_table(spark):
    few = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, -1.0]), (4, [0.5, 0.5])]
    for n in (0, 1, 2, 4):
        got = clusters.weighted_clusters(frame(spark, few[:n]), k=3, rounds=2, width=2)
        assert by_row(got.collect()) == by_row(brute(few[:n], k=3, rounds=2, width=2))
    assert clusters.weighted_clusters(frame(spark, [(1, None)])).count() == 0


def test_hot_vector_is_counted_not_expanded(spark):
    rows = [(i, [1.0 if i % 3 else float(i), 0.5]) for i in range(300)]
    got = clusters.weighted_clusters(frame(spark, rows), k=4, width=2).collect()
    assert by_row(got) == by_row(brute(rows, k=4, width=2))


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(clusters.OP13_SQL)
    got = clusters.op13_centroid_clusters(spark, sf_dir)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
