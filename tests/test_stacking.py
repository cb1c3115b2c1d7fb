"""Distributed stacks against the kernels that hold an ensemble as a matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.functions import signal
from quakeframe.operators import stacking

KIND = "k string, i int, data array<double>, live boolean"


def some(seed, sizes=(9, 25, 4), n=80):
    rng = np.random.default_rng(seed)
    rows = []
    for k, size in zip(["a", None, "c"], sizes, strict=True):
        wave = np.exp(-0.5 * (np.arange(n) - n / 2) ** 2 / 9) * np.sin(np.arange(n) / 3)
        for i in range(size):
            x = np.roll(wave, int(rng.integers(-4, 5))) + rng.normal(size=n) * rng.choice([0.05, 0.5])
            rows.append((k, i, x.tolist(), bool(rng.random() > 0.15 or i == 0)))
    return rows


def matrices(rows):
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        yield k, np.array([r[2] for r in own]), np.array([r[3] for r in own])


def test_robust_stacks(spark, monkeypatch):
    rows = some(1)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    # some ensembles in parts, with beams joined by part and broadcast; all in one part
    for few, part in ((0, 5000), (1 << 25, 5000), (0, 1 << 25)):
        monkeypatch.setattr(stacking, "FEW_BYTES", few)
        monkeypatch.setattr(stacking, "PART_BYTES", part)
        stacks, members = stacking.robust_stacks(df, ["k"], ["i"])
        got = {r.k: r for r in stacks.collect()}
        weights = {(r.k, r.i): r.weight for r in members.collect()}
        assert len(weights) == len(rows)
        for k, x, live in matrices(rows):
            stack, w, rounds = signal.robust_stack(x, live)
            assert np.allclose(got[k].stack, stack) and got[k].rounds == rounds
            assert np.allclose([weights[k, i] for i in range(len(x))], w)
    stacks, members = stacking.robust_stacks(df, ["k"], ["i"], method="median")
    for k, x, live in matrices(rows):
        assert np.allclose({r.k: r for r in stacks.collect()}[k].stack, np.median(x[live], axis=0))
    assert stacking.robust_stacks(df.limit(0), ["k"], ["i"])[0].count() == 0


@pytest.mark.parametrize("part", [5000, 1 << 25])
def test_alignment(spark, monkeypatch, part):
    monkeypatch.setattr(stacking, "PART_BYTES", part)
    rows = some(2)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    first = lambda live: live.groupBy("k").agg(F.min_by("data", "i").alias("beam"))
    stacks, members = stacking.align_and_stack(df, ["k"], ["i"], first, 8, (20, 60))
    got = {r.k: r for r in stacks.collect()}
    found = {(r.k, r.i): (r.lag, r.weight) for r in members.collect()}
    for k, x, live in matrices(rows):
        want = signal.align_and_stack(x, live, x[0], 8, (20, 60))
        assert np.allclose(got[k].stack, want["stack"]) and got[k].converged == want["converged"]
        for i in range(len(x)):
            assert found[k, i][0] == (want["lags"][i] if live[i] else None) and np.isclose(found[k, i][1], want["weights"][i])
