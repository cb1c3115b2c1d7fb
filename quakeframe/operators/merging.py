"""Segments of a channel as one series, or as chunks of it, without a task that holds a whole key.

What is decided about a key (sample interval, gaps, overlaps, length) comes from headers alone. The
samples move once or twice, in pieces: repairs stream through islands of overlapping segments, sorted
by time, and carry the one segment that is still open; then each segment is cut along the chunks of its
key's grid, and a task overlays the parts of one chunk after the other. ``merge_chunks`` gives chunks of
bounded size, whatever the length of the series; ``merge`` puts a key's chunks into one row.

A hot key is spread over its islands and chunks. Only its headers (a few numbers a segment, no
samples) are sorted by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.state import LIVE, with_state

#: Overlapping samples agree up to this relative difference.
SAME_SAMPLE = 10 * 1.1920929e-07
#: Samples of a chunk.
CHUNK = 1 << 18
#: A row holds no more samples than this (the JVM's arrays end there); chunks have no such bound.
ROW_SAMPLES = (1 << 31) - 64


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys that may be null, which keeps the left keys."""
    named, same = right, F.lit(True)
    for i, k in enumerate(keys):
        named, same = named.withColumnRenamed(k, f"qf_r{i}"), same & F.col(k).eqNullSafe(F.col(f"qf_r{i}"))
    return left.join(named, same, how).drop(*[f"qf_r{i}" for i in range(len(keys))])


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that may not broadcast: sizes are guessed from compressed files, and rows that were
    multiplied or packed into structs are many times that, which the driver would have to hold."""
    return df.hint("merge")


def nearest_sample(time: Column, t0: Column, dt: Column) -> Column:
    return F.floor((time - t0) / dt + 0.5).cast("long")


def absorbed(start: float, y: np.ndarray, t0: float, x: np.ndarray, dt: float) -> tuple[list[tuple[float, np.ndarray]], float, np.ndarray]:
    """An open segment and the next one: what is finished, and the segment that stays open. The earlier
    is cut where the later repeats it, and left out where they disagree."""
    at = int(np.floor((t0 - start) / dt + 0.5))
    if at >= len(y):
        return [(start, y)], t0, x
    shared = min(len(y) - at, len(x))
    a, b = y[at : at + shared], x[:shared]
    same = bool(np.all(np.abs(a - b) <= SAME_SAMPLE * np.maximum(np.maximum(np.abs(a), np.abs(b)), 1e-300)))
    if same and at > 0:
        return [(start, y[:at])], t0, np.concatenate([x, y[at + len(x) :]]) if at + len(x) < len(y) else x
    if same and len(y) > len(x):
        return [], start, y
    return [], t0, x


def repaired(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segments (keys, t0, dt, data) without overlaps."""
    own = Window.partitionBy(*keys).orderBy("t0")
    ends = pieces.groupBy(*keys, "t0").agg(F.max(F.col("t0") + (F.size("data") - 0.5) * F.col("dt")).alias("qf_end"), F.max("dt").alias("qf_dt"))
    before = F.max("qf_end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | (F.col("t0") > before + F.col("qf_dt") * 1e-6)  # an island too large does no harm
    marked = ends.withColumn("qf_b", F.when(begins, F.col("t0"))).withColumn("qf_island", F.max("qf_b").over(own))
    placed = joined(pieces, marked.select(*keys, "t0", "qf_island"), [*keys, "t0"], "inner")
    names = [*keys, "qf_island"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where, dt, open_ = [], None, 0.0, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for *key, t0, step, x in zip(*(batch.column(c).to_pylist() for c in [*names, "t0", "dt"]), batch.column("data"), strict=True):
                x = x.values.to_numpy(zero_copy_only=False).astype(float)
                if open_ is not None and key != where:
                    held.append((where, *open_, dt))
                    open_ = None
                if open_ is None:
                    where, dt, open_ = key, step, (t0, x)
                else:
                    done, t0, x = absorbed(*open_, t0, x, dt)
                    held += [(where, *d, dt) for d in done]
                    open_ = (t0, x)
            yield out(held, kinds)
            held = []
        if open_ is not None:
            yield out([(where, *open_, dt)], kinds)

    def out(rows, kinds):
        values = np.concatenate([x for _, _, x, _ in rows]) if rows else np.empty(0)
        ends = np.cumsum([0, *(len(x) for _, _, x, _ in rows)]).astype(np.int32)
        columns = [pa.array([k[i] for k, *_ in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([r[1] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.float64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], [*keys, "t0", "dt", "data"]
        )

    kind = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys)
    return placed.select(*names, "t0", "dt", "data").repartition(*names).sortWithinPartitions(*names, "t0").mapInArrow(run, f"{kind}, t0 double, dt double, data array<double>")


def described(rows: DataFrame, pieces: DataFrame, keys: Sequence[str], zero_gaps: bool, start: float | None, end: float | None) -> DataFrame:
    """Of each key: t0, dt, gaps, reason ('' where it can be merged), and the samples qf_low up to
    qf_length more that are wanted of its grid."""
    basic = rows.groupBy(*keys).agg(F.min("t0").alias("qf_t"), F.min_by("dt", F.struct("t0", "dt")).alias("dt"), F.min("dt").alias("qf_d0"), F.max("dt").alias("qf_d1"))
    own = Window.partitionBy(*keys).orderBy("t0")
    heads = pieces.select(*keys, "t0", "dt", F.size("data").cast("long").alias("n"))
    heads = heads.withColumns({"d": F.first("dt").over(own)}).withColumn("qf_e", F.col("t0") + (F.col("n") - 1) * F.col("d")).withColumn("qf_before", F.lag("qf_e").over(own))
    step = (F.col("t0") - F.col("d") - F.col("qf_before")) / F.col("d")
    gap = F.struct((F.col("qf_before") + F.col("d")).alias("starttime"), (F.col("t0") - F.col("d")).alias("endtime"))
    facts = heads.withColumns({"qf_step": step, "qf_gap": gap}).groupBy(*keys).agg(
        F.min("t0").alias("t0"), F.max_by(F.struct("t0", "n"), F.struct("t0", "n")).alias("qf_last"), F.min(F.when(F.col("qf_step") < -0.5, F.col("t0"))).alias("qf_overlap"),
        F.array_sort(F.collect_list(F.when(F.col("qf_step") > 0.5, F.col("qf_gap")))).alias("gaps"),
    )
    out = joined(basic, facts, keys, "left")
    differ = F.greatest(F.abs(F.col("qf_d0") - F.col("dt")), F.abs(F.col("qf_d1") - F.col("dt"))) / F.col("dt") > 0.001
    total = nearest_sample(F.col("qf_last.t0"), F.col("t0"), F.col("dt")) + F.col("qf_last.n")
    found = F.filter("gaps", lambda g: F.col("qf_overlap").isNull() | (g["endtime"] < F.col("qf_overlap")))
    out = out.withColumns({"qf_total": total, "gaps": F.when(differ | F.col("t0").isNull(), F.array().cast("array<struct<starttime:double,endtime:double>>")).otherwise(found)})
    reason = (
        F.when(differ, "sample intervals differ").when(F.col("t0").isNull(), "no data").when(F.col("qf_overlap").isNotNull(), "overlap")
        .when((F.size("gaps") > 0) & ~F.lit(zero_gaps), "gap").otherwise("")
    )
    low, high = F.lit(0).cast("long"), F.col("qf_total") - 1
    if start is not None and end is not None:
        low = F.greatest(nearest_sample(F.lit(float(start)), F.col("t0"), F.col("dt")), low)
        high = F.least(nearest_sample(F.lit(float(end)), F.col("t0"), F.col("dt")), high)
    out = out.withColumns({"reason": reason, "qf_low": low, "qf_length": F.greatest(high - low + 1, F.lit(0).cast("long"))})
    return out.select(*keys, F.coalesce("t0", "qf_t").alias("t0"), "dt", "gaps", "reason", "qf_low", "qf_length")


def chunked(pieces: DataFrame, facts: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """keys, chunk, t0, dt, data of the keys that can be merged."""
    good = facts.filter("reason = '' AND qf_length > 0").select(*keys, F.col("t0").alias("qf_t0"), F.col("dt").alias("qf_dt"), "qf_low", "qf_length")
    size = F.lit(chunk).cast("long")
    at = nearest_sample(F.col("t0"), F.col("qf_t0"), F.col("qf_dt")) - F.col("qf_low")
    parts = joined(pieces.select(*keys, "t0", "data"), good, keys, "inner").withColumn("qf_at", at).withColumn("qf_z", F.least(F.col("qf_at") + F.size("data"), F.col("qf_length")) - 1)
    parts = parts.filter("qf_z >= 0 AND qf_z >= qf_at").withColumn("chunk", F.explode(F.sequence(F.floor(F.greatest("qf_at", F.lit(0)) / size), F.floor(F.col("qf_z") / size))))
    base = F.col("chunk") * size
    first = F.greatest(F.col("qf_at"), base)
    cut = F.slice("data", (first - F.col("qf_at") + 1).cast("int"), (F.least(F.col("qf_z"), base + size - 1) - first + 1).cast("int"))
    parts = parts.select(*keys, "chunk", "t0", (first - base).cast("int").alias("off"), F.least(size, F.col("qf_length") - base).cast("int").alias("n"), cut.alias("part"))
    names = [*keys, "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, whole, kinds = None, None, None
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in names]
            for *key, off, n, x in zip(*(batch.column(c).to_pylist() for c in [*names, "off", "n"]), batch.column("part"), strict=True):
                if key != where:
                    if whole is not None:
                        yield one(where, whole, kinds)
                    where, whole = key, np.zeros(n)
                x = x.values.to_numpy(zero_copy_only=False)
                whole[off : off + len(x)] = x
        if whole is not None:
            yield one(where, whole, kinds)

    def one(key, whole, kinds):
        data = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), pa.array(whole))
        return pa.RecordBatch.from_arrays([*[pa.array([v], kind) for v, kind in zip(key, kinds, strict=True)], data], [*names, "data"])

    kind = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys)
    laid = parts.repartition(*names).sortWithinPartitions(*names, "t0").mapInArrow(run, f"{kind}, chunk long, data array<double>")
    every = good.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("qf_length") - 1) / size))))
    zeros = F.array_repeat(F.lit(0.0), F.least(size, F.col("qf_length") - base).cast("int"))
    return joined(every, laid, names, "left").select(
        *keys, "chunk", (F.col("qf_t0") + (F.col("qf_low") + base) * F.col("qf_dt")).alias("t0"), F.col("qf_dt").alias("dt"), F.coalesce("data", zeros).alias("data")
    )


def _parts(df: DataFrame, keys: Sequence[str], fix_overlaps: bool, zero_gaps: bool, start: float | None, end: float | None) -> tuple[DataFrame, DataFrame]:
    rows = with_state(df).filter(LIVE).select(*keys, F.col("t0").cast("double").alias("t0"), F.col("dt").cast("double").alias("dt"), F.col("data").cast("array<double>").alias("data"))
    pieces = rows.filter(F.size("data") > 0)
    if fix_overlaps:
        pieces = repaired(pieces, keys)
    if start is not None and end is not None:
        pieces = pieces.filter((F.col("t0") <= end) & (F.col("t0") + (F.size("data") - 1) * F.col("dt") >= start))
    return pieces, described(rows.select(*keys, "t0", "dt"), pieces, keys, zero_gaps, start, end)


def merge_chunks(df: DataFrame, keys: Sequence[str], fix_overlaps: bool = False, zero_gaps: bool = False, start: float | None = None, end: float | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Chunks (keys, chunk, t0, dt, data) of the merged series of each key, and what is known of each key
    (keys, t0, dt, gaps, reason: why it gives no chunks, or '')."""
    pieces, facts = _parts(df, keys, fix_overlaps, zero_gaps, start, end)
    return chunked(pieces, facts, keys, chunk), facts.drop("qf_low", "qf_length")


def merge(df: DataFrame, keys: Sequence[str], fix_overlaps: bool = False, zero_gaps: bool = False, start: float | None = None, end: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """Segments (t0, dt, data) of each key as one series, optionally repaired and cut to a range.

    Gaps kill unless ``zero_gaps``; overlaps kill unless repaired; segments of unequal dt kill. A series
    longer than a row can be (2 ** 31 samples) dies, too: take ``merge_chunks`` for these.
    """
    pieces, facts = _parts(df, keys, fix_overlaps, zero_gaps, start, end)
    long = F.col("qf_length") > ROW_SAMPLES
    facts = facts.withColumn("reason", F.when((F.col("reason") == "") & long, "too long").otherwise(F.col("reason")))
    whole = chunked(pieces, facts, keys, chunk).groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "data"))), lambda c: c["data"])).alias("data"))
    dead = F.col("reason") != ""
    t0 = F.when(dead, F.col("t0")).otherwise(F.col("t0") + F.col("qf_low") * F.col("dt"))
    return joined(facts, whole, keys, "left").select(
        *keys, t0.alias("t0"), "dt", F.coalesce("data", F.array().cast("array<double>")).alias("data"), "gaps", (F.size("gaps") > 0).alias("has_gap"), (~dead).alias(LIVE), "reason"
    )
