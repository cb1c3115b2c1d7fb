"""Merging of segments against a version that holds a key's segments in a list."""

import numpy as np
from pyspark.sql import functions as F

from quakeframe.operators import merging

SAME_SAMPLE = merging.SAME_SAMPLE


def repaired(pieces: list[tuple[float, np.ndarray]], dt: float) -> list[tuple[float, np.ndarray]]:
    """Sorted segments without overlaps: an earlier one is cut where the later one repeats it, and
    left out where they disagree."""
    out: list[tuple[float, np.ndarray]] = []
    for t0, x in pieces:
        while out:
            start, y = out[-1]
            at = int(np.floor((t0 - start) / dt + 0.5))
            if at >= len(y):
                break
            shared = min(len(y) - at, len(x))
            a, b = y[at : at + shared], x[:shared]
            scale = np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-300)
            same = bool(np.all(np.abs(a - b) / scale <= SAME_SAMPLE))
            out.pop()
            if same and at > 0:
                if at + len(x) < len(y):
                    x = np.concatenate([x, y[at + len(x) :]])
                out.append((start, y[:at]))
                break
            if same and len(y) > len(x):
                x, t0 = y, start
        out.append((t0, x))
    return out


def spliced(pieces: list[tuple[float, np.ndarray]], dt: float, fill_gaps: bool = False) -> tuple[float, np.ndarray, list[tuple[float, float]], str]:
    """One series from sorted segments: t0, samples, gaps, and what is wrong ('' if nothing)."""
    t0 = pieces[0][0]
    total = int(np.floor((pieces[-1][0] - t0) / dt + 0.5)) + len(pieces[-1][1])
    out, gaps, ahead = np.zeros(total), [], t0 - dt
    for start, x in pieces:
        step = (start - dt - ahead) / dt
        if step < -0.5:
            return t0, np.empty(0), gaps, "overlap"
        if step > 0.5:
            gaps.append((ahead + dt, start - dt))
        at = int(np.floor((start - t0) / dt + 0.5))
        out[at : at + len(x)] = x[: total - at]
        ahead = start + (len(x) - 1) * dt
    return t0, out, gaps, "gap" if gaps and not fill_gaps else ""


def brute(rows, fix, fill, start=None, end=None):
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        t0, dt, x, gaps = group[0][1], group[0][2], np.empty(0), []
        if any(abs(r[2] - dt) / dt > 0.001 for r in group):
            why = "sample intervals differ"
        else:
            pieces = [(t, np.asarray(d, float)) for _, t, _, d in group if len(d)]
            pieces = repaired(pieces, dt) if fix else pieces
            if start is not None:
                pieces = [(t, d) for t, d in pieces if t <= end and t + (len(d) - 1) * dt >= start]
            t0, x, gaps, why = spliced(pieces, dt, fill) if pieces else (t0, x, [], "no data")
            if not why and start is not None:
                a, b = (int(np.floor((e - t0) / dt + 0.5)) for e in (start, end))
                x, t0 = x[max(a, 0) : b + 1], t0 + max(a, 0) * dt
        out[key] = (t0, dt, x.tolist() if not why else [], gaps, not why, why)
    return out


def some(rng, keys=12):
    """Segments of one long signal a key: some touch, some overlap (and sometimes disagree), some leave gaps."""
    rows = []
    for k in range(keys):
        signal, at = rng.normal(size=400), 0
        while at < 350:
            n = int(rng.integers(1, 60))
            x = signal[at : at + n].copy()
            if rng.random() < 0.1:
                x[0] += 1
            rows.append((k if k else None, at * 0.5 + float(rng.uniform(-0.1, 0.1)), 0.5, x.tolist()))
            at = max(0, at + int(rng.choice([n, n, n - 5, n // 2, n + 7 if k % 3 == 0 else n, 0 if n > 5 else n])))
    rows += [(100, 5.0, 0.5, []), (101, 0.0, 0.5, [1.0]), (101, 1.0, 0.6, [1.0]), (102, 3.0, 0.5, []), (102, 0.0, 0.5, [1.0, 2.0])]
    rows += [rows[3], rows[3], (103, 0.0, 0.5, [1.0]), (103, 1000.0, 0.5, [2.0])]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_equal_to_lists(spark):
    rng = np.random.default_rng(4)
    for fix, fill, span in ((False, False, None), (True, False, None), (True, True, None), (False, True, None), (True, True, (20.0, 90.0)), (True, False, (400.0, 500.0))):
        rows = some(rng)
        rows = sorted(rows, key=lambda r: repr(r))  # equal times: one order for both
        seen, unique = set(), []
        for r in rows:
            if (r[0], r[1]) not in seen or r == rows[3]:
                seen.add((r[0], r[1]))
                unique.append(r)
        df = spark.createDataFrame(unique, "k int, t0 double, dt double, data array<double>").repartition(5)
        got = merging.merge(df, ["k"], fix, fill, *(span or (None, None)), chunk=32)
        assert [n for n, _ in got.dtypes] == ["k", "t0", "dt", "data", "gaps", "has_gap", "live", "reason"]
        want = brute(unique, fix, fill, *(span or (None, None)))
        rows = got.collect()
        assert len(rows) == len(want)
        for r in rows:
            t0, dt, x, gaps, live, why = want[r.k]
            assert (r.live, r.reason, r.dt, r.has_gap) == (live, why, dt, bool(gaps)) and abs(r.t0 - t0) < 1e-9
            assert r.data == x and np.allclose(np.array([tuple(g) for g in r.gaps]).reshape(-1, 2), np.array(gaps).reshape(-1, 2))


def test_chunks_are_bounded(spark):
    rows = [("a", float(100 * i), 1.0, [float(i)] * 100) for i in range(30)] + [("b", 0.0, 1.0, [1.0]), ("b", 1e6, 1.0, [2.0])]
    df = spark.createDataFrame(rows, "k string, t0 double, dt double, data array<double>")
    chunks, facts = merging.merge_chunks(df, ["k"], zero_gaps=True, chunk=1 << 16)
    found = chunks.groupBy("k").agg(F.count("*").alias("n"), F.max(F.size("data")).alias("most"), F.sum(F.size("data")).alias("total")).collect()
    assert {r.k: (r.n, r.most, r.total) for r in found} == {"a": (1, 3000, 3000), "b": (16, 65536, 1_000_001)}
    assert {r.k: (r.reason, len(r.gaps)) for r in facts.collect()} == {"a": ("", 0), "b": ("", 1)}
    small, _ = merging.merge_chunks(df.filter("k = 'a'"), ["k"], chunk=128)
    rows = small.orderBy("chunk").collect()
    assert [r.t0 for r in rows] == [128.0 * i for i in range(24)] and [x for r in rows for x in r.data] == [float(i // 100) for i in range(3000)]
    assert merging.merge(df.limit(0), ["k"]).count() == 0


def test_splice_and_repair():
    x = np.arange(30.0) + 1
    whole = spliced([(0.0, x[:10]), (10.0, x[10:])], 1.0)
    assert whole[1].tolist() == x.tolist() and whole[3] == ""
    assert spliced([(0.0, x[:10]), (12.0, x[12:])], 1.0)[3] == "gap"
    filled = spliced([(0.0, x[:10]), (12.0, x[12:])], 1.0, True)
    assert filled[2] == [(10.0, 11.0)] and filled[1][10:12].tolist() == [0, 0]
    assert spliced([(0.0, x[:10]), (5.0, x[5:])], 1.0)[3] == "overlap"
    pieces = repaired([(0.0, x[:10]), (5.0, x[5:])], 1.0)
    assert spliced(pieces, 1.0)[1].tolist() == x.tolist()
    assert len(repaired([(0.0, x[:10]), (5.0, -x[5:])], 1.0)) == 1
