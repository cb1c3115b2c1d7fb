"""Robust stacks and alignment of ensembles of any size: rounds of one pass over the members.

A beam is an array for each ensemble. In a round every member meets its ensemble's beam, a task adds
up the weighted members of each ensemble it sees, and these partial sums are added by ensemble. No
task holds an ensemble of more than ``PART_BYTES``: its members are dealt into parts, and beams are
joined by ensemble and part, or broadcast where their bytes are counted to be few. Ensembles that have
settled leave the rounds; each round cuts its lineage in the shared checkpoint folder. Ensembles of one
part need no rounds of jobs: a task does theirs, with the same result.

Defined results: the dead have weight -1; members shorter than the beam count as zero beyond their
end; null keys are a key of their own; an ensemble without live members has no stack.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions import signal
from quakeframe.functions.signal import cross_correlation, shifted, xcorr_max
from quakeframe.operators.merging import joined
from quakeframe.runtime import cut
from quakeframe.state import LIVE, with_state

PART_BYTES = 1 << 25
#: Beams of so many bytes are broadcast.
FEW_BYTES = 1 << 25
#: A task passes its sums on once they have so many bytes.
HELD_BYTES = 1 << 25


def numbered(df: DataFrame, keys: Sequence[str], ident: Sequence[str], data: str) -> tuple[DataFrame, DataFrame]:
    """Ensembles (gid, keys, parts) and their live members (gid, part, ident, data)."""
    live = with_state(df).filter(LIVE)
    groups = live.groupBy(*keys).agg(F.sum(F.size(data).cast("long") * 8 + 64).alias("qf_n"))
    groups = cut(groups.select(F.monotonically_increasing_id().alias("gid"), *keys, F.greatest(F.ceil(F.col("qf_n") / PART_BYTES), F.lit(1)).alias("parts")))
    slim = live.select(*dict.fromkeys([*keys, *ident]), F.col(data).cast("array<double>").alias("qf_data"))
    placed = joined(slim, groups, keys, "inner")
    return groups, cut(placed.select("gid", F.pmod(F.xxhash64(*ident), "parts").alias("part"), F.struct(*ident).alias("ident"), F.col("qf_data").alias("data")))


def met(members: DataFrame, beams: DataFrame, groups: DataFrame) -> DataFrame:
    """Members (gid, part, ident, data) with their ensemble's beam."""
    size = beams.agg(F.sum(F.size("beam").cast("long") * 8)).first()[0] or 0
    if size <= FEW_BYTES:
        return members.join(F.broadcast(beams.select("gid", "beam")), "gid")
    copies = beams.select("gid", "beam").join(groups.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")), "gid")
    return members.join(copies, ["gid", "part"])


def floats(x: pa.ListScalar, n: int) -> np.ndarray:
    out = np.zeros(n)
    if x.is_valid:
        values = x.values.to_numpy(zero_copy_only=False)[:n]
        out[: len(values)] = values
    return out


def weight_against(x: np.ndarray, stack: np.ndarray, floor: float = 1e-16) -> np.ndarray:
    """Weights of the rows of x against a stack: what lies along it over what does not and over the length."""
    unit = stack / max(np.linalg.norm(stack), 1e-300)
    norms = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    along = x @ unit
    rest = np.linalg.norm(x - along[:, None] * unit, axis=1)
    return np.where(norms > 1e-300, np.abs(along) / (np.maximum(rest, floor * norms) * norms), 0.0)


def by_ensemble(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """gid, beam, rows of the batch and their samples for each ensemble of a batch."""
    gids = batch.column("gid").to_numpy(zero_copy_only=False)
    for gid in np.unique(gids).tolist():
        rows = np.flatnonzero(gids == gid)
        beam = batch.column("beam")[int(rows[0])].values.to_numpy(zero_copy_only=False)
        yield gid, beam, rows, np.array([floats(batch.column("data")[int(i)], len(beam)) for i in rows])


SUMS = "gid long, w double, total array<double>"


def sums_batch(held: dict[int, list]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(v[1]) for v in held.values())]).astype(np.int32)
    values = np.concatenate([v[1] for v in held.values()]) if held else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["gid", "w", "total"])


def weighted_sums(members: DataFrame) -> DataFrame:
    """gid, sum of weights, weighted sum of the members."""

    def partial(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for gid, beam, _, x in by_ensemble(batch):
                w = weight_against(x, beam)
                entry = held.setdefault(gid, [0.0, np.zeros(len(beam))])
                entry[0] += w.sum()
                entry[1] += w @ x
            if sum(v[1].nbytes for v in held.values()) > HELD_BYTES:
                yield sums_batch(held)
                held = {}
        yield sums_batch(held)

    def added(batches):
        gid, entry = None, None
        for batch in batches:
            for g, w, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                total = total.values.to_numpy(zero_copy_only=False)
                if g != gid:
                    if entry:
                        yield sums_batch({gid: entry})
                    gid, entry = g, [0.0, np.zeros(len(total))]
                entry[0] += w
                entry[1] = entry[1] + total
        if entry:
            yield sums_batch({gid: entry})

    return members.select("gid", "data", "beam").mapInArrow(partial, SUMS).repartition("gid").sortWithinPartitions("gid").mapInArrow(added, SUMS)


def medians(members: DataFrame) -> DataFrame:
    """gid and beam: the median of the members, sample by sample. By ranks in a sorted window, which
    spills, since an aggregate would hold all values of a large ensemble's sample in memory."""
    own = Window.partitionBy("gid", "i")
    long = members.select("gid", F.posexplode("data").alias("i", "x")).filter("x IS NOT NULL")
    ranked = long.select("gid", "i", "x", F.row_number().over(own.orderBy("x")).alias("k"), F.count("*").over(own).alias("n"))
    middle = ranked.filter("k = (n + 1) DIV 2 OR k = (n + 2) DIV 2").groupBy("gid", "i").agg(F.avg("x").alias("x"))
    return middle.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("beam"))


def length(x):
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def moved(after: str, before: str):
    """How far a beam has moved, of its length before."""
    return length(F.zip_with(after, before, lambda a, b: a - b)) / F.greatest(length(F.col(before)), F.lit(1e-300))


def settled(members: DataFrame, groups: DataFrame, beams: DataFrame, eps: float, most: int) -> DataFrame:
    """gid, beam, before (the beam of the last weights), rounds: weights against the beam until it moves by
    less than eps of its length."""
    state = cut(beams.select("gid", "beam", F.col("beam").alias("before"), F.lit(0).alias("rounds"), F.lit(most < 1).alias("done")))
    for k in range(1, most + 1):
        active = state.filter("NOT done")
        if active.isEmpty():
            break
        sums = weighted_sums(met(members, active, groups))
        after = active.select("gid", F.col("beam").alias("before")).join(sums, "gid")
        new = F.when(F.col("w") > 0, F.transform("total", lambda x: x / F.col("w"))).otherwise(F.col("before"))
        after = after.withColumn("beam", new).select("gid", "beam", "before", F.lit(k).alias("rounds"), (moved("beam", "before") < eps).alias("done"))
        state = cut(state.filter("done").unionByName(after))
    return state.drop("done")


def raw_weights(members: DataFrame, groups: DataFrame, beams: DataFrame) -> DataFrame:
    """gid, ident, weight: at most 1 in an ensemble."""
    kind = members.schema["ident"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            w = np.zeros(len(batch))
            for _, beam, rows, x in by_ensemble(batch):
                w[rows] = weight_against(x, beam)
            yield pa.RecordBatch.from_arrays([batch.column("gid"), batch.column("ident"), pa.array(w)], ["gid", "ident", "w"])

    raw = met(members, beams, groups).select("gid", "ident", "data", "beam").mapInArrow(run, f"gid long, ident {kind}, w double")
    most = raw.groupBy("gid").agg(F.max("w").alias("top"))
    return raw.join(most, "gid").select("gid", "ident", F.when(F.col("top") > 0, F.col("w") / F.col("top")).otherwise(0.0).alias("weight"))


def in_one_task(members: DataFrame, f: Callable[[np.ndarray, np.ndarray | None], dict]) -> DataFrame:
    """gid, ident, lag, weight, and in one row of each ensemble its stack, rounds and converged, from
    ``f(samples, beam)``. The members (with ``beam``, or without) are of ensembles of one part."""
    has_beam = "beam" in members.columns
    kind = f"gid long, ident {members.schema['ident'].dataType.simpleString()}, lag long, weight double, stack array<double>, rounds int, converged boolean"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data = table.column("data").chunk(0)
        beam = table.column("beam")[0].values.to_numpy(zero_copy_only=False) if has_beam else None
        n = len(beam) if has_beam else max(len(x) if x.is_valid else 0 for x in data)
        out, rest = f(np.array([floats(x, n) for x in data]), beam), [None] * (len(table) - 1)
        return pa.table({
            "gid": table.column("gid"), "ident": table.column("ident"), "lag": pa.array(out.get("lags", np.zeros(len(table))), pa.int64()), "weight": pa.array(out["weights"], pa.float64()),
            "stack": pa.array([out["stack"].tolist(), *rest], pa.list_(pa.float64())), "rounds": pa.array([out.get("rounds", 0), *rest], pa.int32()), "converged": pa.array([bool(out.get("converged", True)), *rest], pa.bool_()),
        })

    columns = ["gid", "ident", "data", *(["beam"] if has_beam else [])]
    return cut(members.select(*columns).groupBy("gid").applyInArrow(run, kind))


def parted(members: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of ensembles of one part; members and ensembles of more."""
    large = groups.filter("parts > 1")
    ids = large.select("gid")
    return members.join(ids, "gid", "left_anti"), members.join(ids, "gid", "left_semi"), large


def robust_stacks(df: DataFrame, keys: Sequence[str], ident: Sequence[str], method: str = "dbxcor", eps: float = 1e-3, most: int = 20, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Stacks (keys, stack, rounds) and members (keys, ident, weight): the median, or weights against the
    stack until it moves by less than eps. ``ident`` tells the members of an ensemble apart."""
    groups, members = numbered(df, keys, ident, data)
    small, many, large = parted(members, groups)

    def one(x, _):
        stack, weights, rounds = signal.robust_stack(x, np.ones(len(x), bool), method, eps, most)
        return {"stack": stack, "weights": weights, "rounds": rounds}

    done = in_one_task(small, one)
    stacks, weights = done.filter("stack IS NOT NULL").select("gid", "stack", "rounds"), done.select("gid", "ident", "weight")
    if not large.isEmpty():
        state = settled(many, large, medians(many), eps, 0 if method == "median" else most)
        stacks = stacks.unionByName(state.select("gid", F.col("beam").alias("stack"), "rounds"))
        own = many.select("gid", "ident", F.lit(1.0).alias("weight")) if method == "median" else raw_weights(many, large, state.select("gid", F.col("before").alias("beam")))
        weights = weights.unionByName(own)
    return groups.join(stacks, "gid").select(*keys, "stack", "rounds"), _of_all(df, groups, weights, keys, ident, {"weight": F.coalesce("weight", F.lit(-1.0))})


def _of_all(df: DataFrame, groups: DataFrame, found: DataFrame, keys: Sequence[str], ident: Sequence[str], columns: dict) -> DataFrame:
    """What was found of live members, for all members."""
    named = groups.select("gid", *keys).join(found, "gid").drop("gid")
    extra = [c for c in named.columns if c not in (*keys, "ident")]
    flat = named.select(*keys, *[F.col("ident")[c].alias(c) for c in ident if c not in keys], *extra)
    both = list(dict.fromkeys([*keys, *ident]))
    out = joined(with_state(df).select(*both, LIVE), flat, both, "left")
    clean = {k: F.when(F.col(LIVE), F.col(k)) for k in extra}
    return out.withColumns(clean).withColumns(columns).drop(LIVE)


def aligned_to(members: DataFrame, most_lag: int, window: tuple[int, int]) -> DataFrame:
    """Members with the lag of their best correlation with the beam inside the window, moved by it."""
    kind, (a, b) = members.schema["ident"].dataType.simpleString(), window

    def run(batches):
        for batch in batches:
            lags, out = np.zeros(len(batch), np.int64), [np.empty(0)] * len(batch)
            for _, beam, rows, x in by_ensemble(batch):
                inside = np.r_[np.zeros(a), beam[a : b + 1], np.zeros(max(len(beam) - b - 1, 0))]
                for i, one in zip(rows.tolist(), x, strict=True):
                    lags[i] = np.clip(xcorr_max(cross_correlation(one, inside, most_lag, demean=False), False)[0], -most_lag, most_lag)
                    out[i] = shifted(one, int(lags[i]))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            data = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0), *out])))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("gid", "part", "ident")], data, pa.array(lags)], ["gid", "part", "ident", "data", "lag"])

    return members.select("gid", "part", "ident", "data", "beam").mapInArrow(run, f"gid long, part long, ident {kind}, data array<double>, lag long")


def align_and_stack(
    df: DataFrame, keys: Sequence[str], ident: Sequence[str], first: Callable[[DataFrame], DataFrame], most_lag: int, window: tuple[int, int], eps: float = 1e-3, most: int = 20, remove_mean: bool = True, data: str = "data"
) -> tuple[DataFrame, DataFrame]:
    """Align members to a beam by correlation inside a window (sample numbers, closed), stack them, and
    repeat until the beam stays. ``first(live rows)`` gives keys and ``beam`` to begin with. Stacks (keys, stack,
    converged) and members (keys, ident, lag, weight); lags are clamped to +-most_lag."""
    groups, members = numbered(df, keys, ident, data)
    begin = joined(groups, first(with_state(df).filter(LIVE)).select(*keys, F.col("beam").cast("array<double>").alias("beam")), keys, "inner")
    small, many, large = parted(members, groups)
    done = in_one_task(
        small.join(begin.select("gid", "beam"), "gid"), lambda x, beam: signal.align_and_stack(x, np.ones(len(x), bool), beam, most_lag, window, eps, most, remove_mean)
    )
    stacks, found = done.filter("stack IS NOT NULL").select("gid", "stack", "converged"), done.select("gid", "ident", "lag", "weight")
    if not large.isEmpty():
        more = aligned_in_rounds(many, large, begin.filter("parts > 1"), most_lag, window, eps, most, remove_mean)
        stacks, found = stacks.unionByName(more[0]), found.unionByName(more[1])
    return groups.join(stacks, "gid").select(*keys, "stack", "converged"), _of_all(df, groups, found, keys, ident, {"weight": F.coalesce("weight", F.lit(-1.0))})


def aligned_in_rounds(members: DataFrame, groups: DataFrame, begin: DataFrame, most_lag: int, window: tuple[int, int], eps: float, most: int, remove_mean: bool) -> tuple[DataFrame, DataFrame]:
    """Stacks (gid, stack, converged) and members (gid, ident, lag, weight) of ensembles of several parts."""
    state = cut(begin.select("gid", "beam", F.col("beam").alias("before"), F.lit(False).alias("done")))
    found = []
    for k in range(most):
        active = state.filter("NOT done")
        if active.isEmpty():
            break
        turned = cut(aligned_to(met(members, active, groups), most_lag, window))
        inner = settled(turned, groups, medians(turned), 1e-3, 20)
        after = active.select("gid", F.col("beam").alias("old")).join(inner, "gid").select("gid", "beam", "before", (moved("beam", "old") < eps).alias("done"))
        state = cut(state.filter("done").unionByName(after))
        fresh = (state.filter("done") if k + 1 < most else state).join(active.select("gid"), "gid", "left_semi")
        weights = raw_weights(turned.drop("lag"), groups, fresh.select("gid", F.col("before").alias("beam")))
        found.append(turned.select("gid", "ident", "lag").join(weights, ["gid", "ident"]))
    out = reduce(DataFrame.unionByName, found)
    if remove_mean:
        out = out.join(out.groupBy("gid").agg(F.rint(F.avg("lag")).cast("long").alias("mean")), "gid").withColumn("lag", F.col("lag") - F.col("mean")).drop("mean")
    return state.select("gid", F.col("beam").alias("stack"), F.col("done").alias("converged")), out
