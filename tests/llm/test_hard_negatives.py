import math
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quakeframe.llm import hard_negatives as hn


def brute(rows, every=10, k=5, low=80, high=100, scale=256):
    """All products in Python integers."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, a, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), last(j), j, m == label) for at, (j, b, m) in enumerate(kept) if at != n and len(b) == len(a)]
        scored.sort(key=lambda t: t[:2])
        for p in [t for t in scored if t[3]][:k]:
            window = [t for t in scored if not t[3] and low * -p[0] <= 100 * -t[0] <= high * -p[0]]
            out += [(i, p[2], rank + 1, t[2], -p[0], -t[0]) for rank, t in enumerate(window[:k])]
    return out


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, shard int, x string").repartition(5)
    return hn.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"), **more)


def clustered(seed, n, width, centres, noise=0.3, labels=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    return [(int(i), [float(x) for x in c[rng.integers(centres)] + rng.normal(size=width) * noise], int(rng.integers(labels))) for i in range(n)]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_equal_to_all_products(spark, monkeypatch):
    monkeypatch.setattr(hn, "SHARD", 60)
    monkeypatch.setattr(hn, "LIST", 7)
    for seed, width, centres in ((1, 16, 8), (2, 8, 1), (3, 2, 40)):
        rows = clustered(seed, 400, width, centres)
        same(mined(spark, rows).collect(), brute(rows))


def test_ties_copies_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(hn, "SHARD", 20)
    rows = clustered(4, 60, 4, 5)
    rows += [(100 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(50)]  # a group of copies, all scores equal
    rows += [(10, [1.0, 2.0, 0.0, 0.0], 1), (10, [1.0, 2.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 0), (None, [1.0, 2.0, 0.0, 0.0], 2)]
    rows += [(200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [math.nan] * 4, 1), (203, [math.inf] * 4, 1), (204, [1.0] * 4, None)]
    rows += [(300 + i, [float(i), 1.0], i % 2) for i in range(12)] + [(400, [], 1), (401, [], 1), (402, [], 2), (500, [3.0], 1)]
    rows += [(600, [5000.0, 0.0, 0.0, 0.0], 1), (601, [5000.0, 0.0, 0.0, 1.0], 1), (602, [4999.0, 0.0, 0.0, 0.0], 2), (610, [-1.0] * 4, 7), (611, [1.0] * 4, 7)]
    got = mined(spark, rows)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    same(got.collect(), brute(rows))


def test_other_windows_and_empty_tables(spark):
    rows = clustered(5, 150, 6, 4)
    same(mined(spark, rows, every=7, positives=3, negatives=2, low=50, high=90).collect(), brute_sizes(rows))
    assert mined(spark, []).count() == 0 and mined(spark, [(0, None, 1)]).count() == 0 and mined(spark, [(0, [1.0], 1)]).count() == 0


def brute_sizes(rows):
    found = {}
    for r in brute(rows, every=7, k=150, low=50, high=90):
        found.setdefault(r[0], {}).setdefault(r[1], []).append(r)
    order = lambda p: (-p[1][0][4], p[0])
    return [r for a, pos in found.items() for _, neg in sorted(pos.items(), key=order) if rank_of(rows, a, neg[0]) < 3 for r in neg[:2]]


def rank_of(rows, anchor, hit):
    """How many rows of the anchor's label come before the positive."""
    floor = lambda v: [math.floor(256 * x) for x in v]
    by_id = {i: (floor(v), label) for i, v, label in rows}
    a, label = by_id[anchor]
    scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, (b, m) in by_id.items() if m == label and j != anchor)
    return scores.index((-hit[4], hit[1]))


def test_lists_are_skipped_and_left_early():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 300
    x = np.concatenate([c + rng.normal(size=(50, 16)) * 10 for c in centres]).astype(np.int32)
    lists, _ = hn.Lists.built(np.arange(1000), np.zeros(1000, np.int64), x)
    read = []
    scores = lists.scores
    lists.scores = lambda a, rows: read.append(len(rows)) or scores(a, rows)
    top = hn.positives_in(lists, lists.x[0], 0, 5, -np.inf)
    exact = lists.x.astype(np.int64) @ lists.x[0].astype(np.int64)
    assert top.scores.tolist() == sorted(exact.tolist(), reverse=True)[:5] and sum(read) < 500
    for upper, lower, rows in [(*hn.bounds(lists.x[0].astype(float), lists.centroids, lists.radii), zip(lists.starts, lists.ends, strict=True))]:
        for u, w, (s, e) in zip(upper, lower, rows, strict=True):
            assert w <= exact[s:e].min() and exact[s:e].max() <= u


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql(hn.OP11_SQL)
    got = hn.op11_hard_negatives(spark, sf_dir).collect()
    assert len(got) and sorted(tuple(r[c] for c in want.columns) for r in got) == sorted(want.fetchall())
