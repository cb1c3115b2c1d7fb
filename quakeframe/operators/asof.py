"""As-of joins: the last row at or before a time, the first at or after it, or the nearer of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.merging import joined, shuffled


def beside(rows: DataFrame, points: DataFrame, names: Sequence[str], width: float) -> DataFrame:
    """``points`` (names, qf_t, qf_side) with ``qf_p``, the value of the last of ``rows`` (names, qf_t, qf_v; one a time)
    not later, ``qf_n``, that of the first not earlier, and ``qf_m``, the sum of qf_m (where rows have it) up to the
    point: of side 1 with what is at its time, of side -1 without."""
    if "qf_m" not in rows.columns:
        rows = rows.withColumn("qf_m", F.lit(0).cast("long"))
    both = rows.withColumn("qf_side", F.lit(0)).unionByName(points, allowMissingColumns=True).withColumn("qf_b", F.floor(F.col("qf_t") / width))
    own = [*names, "qf_b"]
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    back = running(Window.partitionBy(*own).orderBy("qf_t", "qf_side"))
    ahead = running(Window.partitionBy(*own).orderBy(F.desc("qf_t"), F.abs("qf_side")))
    inside = both.withColumns({"qf_p": F.last("qf_v", True).over(back), "qf_n": F.last("qf_v", True).over(ahead), "qf_m": F.coalesce(F.sum("qf_m").over(back), F.lit(0))})
    few = both.groupBy(*own).agg(
        F.max_by("qf_v", F.when(F.col("qf_v").isNotNull(), F.col("qf_t"))).alias("qf_l"), F.min_by("qf_v", F.when(F.col("qf_v").isNotNull(), F.col("qf_t"))).alias("qf_f"), F.sum("qf_m").alias("qf_bm")
    )
    row = Window.partitionBy(*names).orderBy("qf_b")
    before = row.rowsBetween(Window.unboundedPreceding, -1)
    around = few.select(
        *own, F.last("qf_l", True).over(before).alias("qf_lp"), F.first("qf_f", True).over(row.rowsBetween(1, Window.unboundedFollowing)).alias("qf_fn"), F.coalesce(F.sum("qf_bm").over(before), F.lit(0)).alias("qf_bm")
    )
    met = joined(shuffled(inside.filter("qf_side <> 0").drop("qf_v")), around, own, "left")
    return met.withColumns({"qf_p": F.coalesce("qf_p", "qf_lp"), "qf_n": F.coalesce("qf_n", "qf_fn"), "qf_m": F.col("qf_m") + F.col("qf_bm")}).drop("qf_b", "qf_lp", "qf_fn", "qf_bm", "qf_side")


def within(points: DataFrame, rows: DataFrame, tolerance: float, width: float = 3600.0) -> DataFrame:
    """``points`` (qf_w, any columns beside) with what ``rows`` (qf_t, qf_v, qf_m; one a time) hold within ``tolerance``
    (closed) of qf_w: ``n``, the sum of qf_m; ``first`` and ``last`` in time, and ``prior`` and ``next``, the last not
    later and the first not earlier than qf_w. All but n are null or count only where n is not 0. Each point is three
    of ``beside``, so that work grows with points and rows, not with their pairs."""
    finite = lambda c: F.abs(c) < F.lit(float("inf"))  # noqa: E731  no nulls and no NaN, too
    w, rows = F.col("qf_w").cast("double"), rows.filter(finite(F.col("qf_t")))
    up = lambda h: h + F.abs(h) * F.lit(1.5 * 2.0**-53)  # noqa: E731  the next double
    edge = lambda h, gap: F.when(gap(h) > tolerance, -up(-h)).when(gap(up(h)) <= tolerance, up(h)).otherwise(h)
    low, high = -edge(tolerance - w, lambda h: w + h), edge(w + tolerance, lambda h: h - w)
    at = F.array(*[F.struct(t.alias("t"), F.lit(side).alias("side")) for t, side in ((low, -1), (w, 1), (high, 1))])
    wanted = points.filter(finite(w)).select(F.col("qf_w"), F.posexplode(at).alias("qf_k", "x")).select("qf_w", "qf_k", F.col("x.t").alias("qf_t"), F.col("x.side").alias("qf_side"))
    met = beside(rows, wanted, [], width)
    of = lambda c, k: F.first(F.when(F.col("qf_k") == k, F.col(c)), True)
    found = met.groupBy("qf_w").agg(
        (of("qf_m", 2) - of("qf_m", 0)).alias("n"), of("qf_n", 0).alias("first"), of("qf_p", 2).alias("last"), of("qf_p", 1).alias("prior"), of("qf_n", 1).alias("next")
    )
    return found.filter("n > 0")


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, columns: Sequence[str], keys: Sequence[str] = (), direction: str = "nearest", tolerance: float | None = None, width: float = 86400.0, order: Sequence[str] = ()) -> DataFrame:
    """``left`` with ``asof_time`` and ``asof_<column>`` of the right row of equal keys that is as of its time
    (numbers): backward (the last one not later), forward (the first one not earlier), or nearest (of equal
    distances the earlier). Of right rows at one time the smallest in ``order`` counts.

    Both sides are put together and sorted in buckets of ``width``, where the last and first non-null row are
    found by a window; what lies in other buckets comes from one row a bucket. So no sort holds a whole
    key, rows are not multiplied, and without keys no task gets all. Null times and null keys match nothing.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    names = {k: f"qf_k{i}" for i, k in enumerate(keys)}
    value = F.struct(F.col(right_time).cast("double").alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*[F.col(c).alias(c) for c in columns]).alias("m"))
    r = right.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(right_time).cast("double").alias("qf_t"), value.alias("qf_v")).dropna(subset=["qf_t", *names.values()])
    least = F.min("qf_v") if order else F.min_by("qf_v", F.to_json("qf_v.m"))
    r = r.groupBy(*names.values(), "qf_t").agg(least.alias("qf_v"))  # one row a time
    wanted = left.select(*[F.col(k).alias(n) for k, n in names.items()], F.col(time).cast("double").alias("qf_t")).dropna().distinct()
    met = beside(r, wanted.withColumn("qf_side", F.lit(1)), list(names.values()), width)
    gap = lambda c: F.abs(F.col(c)["t"] - F.col("qf_t"))
    near = F.when(F.col("qf_p").isNull(), F.col("qf_n")).when(F.col("qf_n").isNull() | (gap("qf_p") <= gap("qf_n")), F.col("qf_p")).otherwise(F.col("qf_n"))
    met = met.withColumn("qf_x", {"backward": F.col("qf_p"), "forward": F.col("qf_n"), "nearest": near}[direction])
    if tolerance is not None:
        met = met.withColumn("qf_x", F.when(gap("qf_x") <= tolerance, F.col("qf_x")))
    same = F.col(time).cast("double") == F.col("qf_t")
    for k, n in names.items():
        same = same & (F.col(k) == F.col(n))
    out = left.join(shuffled(met.select(*names.values(), "qf_t", "qf_x")), same, "left").withColumn("asof_time", F.col("qf_x.t"))
    return out.withColumns({f"asof_{c}": F.col("qf_x.m")[c] for c in columns}).drop(*names.values(), "qf_t", "qf_x")
