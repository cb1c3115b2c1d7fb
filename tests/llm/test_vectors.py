import numpy as np

from quakeframe.llm import vectors


def brute(rows, threshold=0.95):
    """n_links and component by comparing all pairs."""
    units = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            units[k] = x / np.sqrt((x**2).sum())
    keys = list(units)
    near = {k: {j for j in keys if j != k and len(units[j]) == len(units[k]) and units[k] @ units[j] >= threshold} for k in keys}
    root = {k: rows[k][0] for k in range(len(rows))}
    for _ in rows:
        before = dict(root)
        for k in keys:
            root[k] = min([root[k], *(root[j] for j in near[k])])
        if root == before:
            break
    return [(rows[k][0], len(near.get(k, ())), root[k], rows[k][0] == root[k]) for k in range(len(rows))]


def random_rows(seed, n=250, dense=120):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        x = rng.normal(size=64)
        out.append(x)
        for _ in range(rng.integers(0, 4)):
            out.append(x * rng.uniform(0.5, 2) + rng.normal(size=64) * rng.choice([0, 0.1, 0.3, 0.36]))
    centre = rng.normal(size=64)
    out += [centre + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.2, 0.3]) for _ in range(dense)]
    out += [centre] * 30
    order = rng.permutation(len(out))
    return [(int(i), [float(np.float32(v)) for v in out[j]]) for i, j in enumerate(order)]


def test_links_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        rows += [(9000, None), (9001, [0.0] * 64), (9002, [None] + [1.0] * 63), (9003, [float("nan")] + [1.0] * 63), (9004, [float("inf")] + [1.0] * 63), (9005, []), (9006, [1.0, 2.0]), (9010, [2.0, 4.0]), (9011, [2.0, -4.0]), (9012, [1.0, 2.05]), (9013, [3.0]), (9014, [5.0]), (9007, [1e-30] * 64), (9008, [1.0] * 64)]
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, unit string").repartition(5)
        got = sorted(map(tuple, vectors.near_vectors(df).collect()))
        assert got == sorted(brute([(i, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None) for i, v in rows]))


def test_tiles_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 7)
    rows = random_rows(3, 60, 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == sorted(brute(rows))
    twice = df.unionByName(df)
    got = {r.vec_id: r for r in vectors.near_vectors(twice).collect()}
    for i, n, c, k in brute(rows):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (2 * n + 1, c, k)
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert vectors.near_vectors(df.limit(1)).count() == 1


def test_blocks_hold_every_close_pair():
    rng = np.random.default_rng(4)
    g = vectors.Geometry(64, 0.95)
    x = rng.normal(size=(4000, 64))
    y = x + rng.normal(size=x.shape) * 0.34
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    close = (x * y).sum(1) >= 0.95
    assert 200 < close.sum() < 3900
    d = ((x @ g.rotation - y @ g.rotation) ** 2)[close]
    assert np.any([d[:, b].sum(1) <= r * r for b, r in zip(g.blocks, g.reach)], axis=0).all()
    g.pivots = [rng.normal(size=(30, b.stop - b.start)) / 8 for b in g.blocks]
    for b, r in enumerate(g.reach):
        own_y = g.cells(y @ g.rotation, b)[0]
        reached = g.cells(x @ g.rotation, b)[1]
        inside = ((x @ g.rotation - y @ g.rotation)[:, g.blocks[b]] ** 2).sum(1) <= r * r
        assert reached[np.arange(len(x)), own_y][inside].all()
