"""Ensembles: grouping, ordering, group statistics, stacking of group members.

An ensemble is a set of rows with a key. Statistics are partial aggregates; where rows need their
group's statistic it is joined to them, which leaves the rows (and their samples) in place as long
as the groups' table is small enough to broadcast. Arrays of members are made at boundaries only
(``fold``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quakeframe.operators.edit import MetadataOperatorChain
from quakeframe.state import LIVE, attributes_of, log_if, with_state


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], members: str = "members") -> DataFrame:
    """One row an ensemble: its members as an array of structs in a total order."""
    first = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("m"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["m"]).alias(members))


def unfold(df: DataFrame, members: str = "members") -> DataFrame:
    return df.select(F.explode(members).alias("m")).select("m.*")


class _Member:
    """The part of a DataFrame that editors use, for the member of an ensemble inside a lambda: its
    attributes are expressions, and an edit gives another member."""

    def __init__(self, schema: StructType, fields: dict[str, Column], latest: list, kept: Column | None = None):
        self.schema, self.fields, self.latest, self.kept = schema, fields, latest, kept
        self.columns = list(fields)
        latest[:] = [self]  # what ``attribute`` reads

    def _other(self, fields: dict[str, Column], kept: Column | None = None) -> _Member:
        return _Member(self.schema, fields, self.latest, self.kept if kept is None else kept)

    def withColumns(self, columns: dict[str, Column]) -> _Member:  # noqa: N802
        return self._other(self.fields | columns)

    def withColumn(self, name: str, column: Column) -> _Member:  # noqa: N802
        return self.withColumns({name: column})

    def withColumnRenamed(self, old: str, new: str) -> _Member:  # noqa: N802
        return self._other({new if k == old else k: v for k, v in self.fields.items()})

    def drop(self, *names: str) -> _Member:
        return self._other({k: v for k, v in self.fields.items() if k not in names})

    def filter(self, condition: Column | str) -> _Member:
        holds = F.coalesce(self.fields[condition] if isinstance(condition, str) else condition, F.lit(False))
        return self._other(self.fields, holds if self.kept is None else self.kept & holds)


def _edited(df: DataFrame, edit, members: str) -> DataFrame:
    kind = df.schema[members].dataType.elementType
    live = F.col(LIVE) if LIVE in df.columns else F.lit(True)
    filters = False

    def one(m: Column) -> Column:
        nonlocal filters
        latest: list[_Member] = []
        start = _Member(kind, {f.name: m[f.name] for f in kind.fields}, latest)
        with attributes_of(lambda name: latest[0].fields[name]):
            out = edit(start)
        filters = out.kept is not None
        changed = [F.when(live, v).otherwise(start.fields.get(k, F.lit(None))).alias(k) for k, v in out.fields.items()]
        return F.struct(*changed, *([(~live | out.kept).alias("qf_kept")] if filters else []))

    out = F.transform(members, one)
    if filters:
        out = F.transform(F.filter(out, lambda m: m["qf_kept"]), lambda m: m.dropFields("qf_kept"))
    return df.withColumn(members, out)


def apply_to_members(df: DataFrame, edit, members: str = "members") -> DataFrame:
    """Editors, killers, windows and filters (objects with ``apply``, functions of a DataFrame, or a
    list of these) on the members of live ensembles, in place: the expressions of an edit read the fields of
    the lambda variable of ``transform``, so that nothing is shuffled, equal ensembles stay apart, and
    an ensemble that loses all members stays with none. Members of dead ensembles keep their values.

    An edit may use ``columns``, ``schema``, ``withColumn(s)``, ``withColumnRenamed``, ``drop`` and ``filter``,
    and reads attributes by ``state.attribute``; others (joins, kernels) need ``unfold``.
    """
    edits = list(edit) if isinstance(edit, (list, tuple)) else [edit]
    while edits:
        first = edits.pop(0)
        first = getattr(first, "apply", first)
        owner = getattr(first, "__self__", None)
        if isinstance(owner, MetadataOperatorChain):  # a pass each: expressions do not grow with the chain
            edits = [*owner.editors, *edits]
        else:
            df = _edited(df, first, members)
    return df


def with_statistics(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``df`` with aggregates of each row's group."""
    stats = df.groupBy(*[F.col(k).alias(f"qf_k_{i}") for i, k in enumerate(keys)]).agg(*aggregates)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"qf_k_{i}"))
    return df.join(stats, same, "left").drop(*[f"qf_k_{i}" for i in range(len(keys))])


def with_ensemble_state(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``ensemble_live``: whether any member lives; ``n_live``: how many."""
    return with_statistics(with_state(df), keys, F.sum(F.col(LIVE).cast("long")).alias("n_live"), F.max(LIVE).alias("ensemble_live"))


def number_live(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    df = with_state(df)
    return df.groupBy(*keys).agg(F.count("*").alias("n_members"), F.sum(F.col(LIVE).cast("long")).alias("n_live"), F.max(LIVE).alias("has_live"))


def ensemble_time_range(df: DataFrame, keys: Sequence[str], metric: str = "inner", start="starttime", end="endtime") -> DataFrame:
    """Time range of each ensemble's live members: inner, outer, median or mean."""
    s, e = F.col(start), F.col(end)
    both = {"inner": (F.max(s), F.min(e)), "outer": (F.min(s), F.max(e)), "median": (F.median(s), F.median(e)), "mean": (F.avg(s), F.avg(e))}
    if metric not in both:
        raise ValueError(f"unknown metric {metric}")
    low, high = both[metric]
    return with_state(df).filter(LIVE).groupBy(*keys).agg(low.alias("range_start"), high.alias("range_end"))


def sort_ensemble(df: DataFrame, keys: Sequence[str], by: str, nullvalue=None, ascending: bool = True, tie: Sequence[str] = (), drop_dead: bool = True) -> DataFrame:
    """``ordinal`` of each member in its ensemble; a missing value counts as ``nullvalue``."""
    df = with_state(df)
    df = df.filter(LIVE) if drop_dead else df
    value = F.col(by) if nullvalue is None else F.coalesce(F.col(by), F.lit(nullvalue))
    order = [value.asc() if ascending else value.desc(), *tie]
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def seed_order() -> list[Column]:
    """Station codes from the last to the first; an undefined one ranks below any other."""
    return [F.desc_nulls_last(c) for c in ("net", "sta", "loc", "chan")]


def bundle_triples(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Components of one sensor (net, sta, loc and the first two letters of chan) as one row: live
    only with exactly three channels of equal dt, npts and t0. A channel that comes twice counts by
    its first row."""
    df = with_state(df)
    band = F.substring("chan", 1, 2)
    keys = ["net", "sta", "loc", "band", *extra]
    once = df.filter(LIVE).withColumn("band", band).groupBy(*keys, "chan").agg(F.min(F.struct("t0", "dt", "npts", "data")).alias("x"))
    return once.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("chan", "x"))).alias("c"), F.count("*").alias("n"), F.min("x.t0").alias("t0"), F.max("x.t0").alias("t1"),
        F.min("x.dt").alias("dt"), F.max("x.dt").alias("dt1"), F.min("x.npts").alias("npts"), F.max("x.npts").alias("npts1"),
    ).select(
        *keys, "t0", "dt", "npts", F.transform("c", lambda x: x["chan"]).alias("channels"), F.transform("c", lambda x: x["x"]["data"]).alias("data"),
        ((F.col("n") == 3) & (F.col("t0") == F.col("t1")) & (F.col("dt") == F.col("dt1")) & (F.col("npts") == F.col("npts1"))).alias(LIVE),
    )


def promote(df: DataFrame, keys: Sequence[str], attributes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Attributes of each ensemble's first live member, and whether all live members agree."""
    live = with_state(df).filter(LIVE)
    first = F.min(F.struct(*order, F.struct(*attributes).alias("m"))).alias("f")
    agree = [((F.count(c) == F.count("*")) & (F.min(c) == F.max(c))).alias(f"{c}_agrees") for c in attributes]
    out = live.groupBy(*keys).agg(first, *agree)
    return out.select(*keys, *[F.col(f"f.m.{c}").alias(c) for c in attributes], *[f"{c}_agrees" for c in attributes])


def regularize_sampling(df: DataFrame, keys: Sequence[str], expected: float, npts: int | None = None) -> DataFrame:
    """Kill members whose dt is off by more than half a sample over the ensemble's longest member."""
    df = with_state(df)
    if not npts:
        df = with_statistics(df, keys, F.max("npts").alias("qf_most"))
    n = F.lit(npts) if npts else F.col("qf_most")
    off = F.abs(F.col("dt") - expected) > F.lit(expected) / (2.0 * F.greatest(n - 1, F.lit(1)))
    marked = df.withColumn("qf_off", off)
    return marked.withColumn("elog", log_if(F.col(LIVE) & F.col("qf_off"), "regularize_sampling", "sample interval differs")).withColumn(
        LIVE, F.col(LIVE) & ~F.col("qf_off")
    ).drop("qf_off", "qf_most")


def demean_residuals(df: DataFrame, keys: Sequence[str], measured: str, model: str, center: str = "median", residual="residual", corrected="corrected_time") -> DataFrame:
    """Residual of each live member less the group's median (default) or mean, the centre, and the
    corrected time. Groups of fewer than two residuals are left alone, with a Complaint."""
    df = with_state(df).withColumn("qf_r", F.when(F.col(LIVE), F.col(measured) - F.col(model)))
    middle = {"median": F.median("qf_r"), "mean": F.avg("qf_r")}[center]
    df = with_statistics(df, keys, F.count("qf_r").alias("qf_n"), middle.alias("qf_c"))
    enough = (F.col("qf_n") > 1) & F.col("qf_r").isNotNull()
    df = df.withColumn("elog", log_if(F.col(LIVE) & (F.col("qf_n") <= 1), "demean_residuals", "too few residuals", "Complaint"))
    return df.withColumns(
        {
            residual: F.when(enough, F.col("qf_r") - F.col("qf_c")),
            corrected: F.when(enough, F.col(measured) - F.col("qf_c")),
            "residual_center": F.when(enough, F.col("qf_c")),
        }
    ).drop("qf_r", "qf_n", "qf_c")


def stack_sum(df: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    """Sum over the live members of each ensemble, sample by sample. Samples are added by their number,
    whatever t0 and dt: cut members to one range first (``window.regularize_members``,
    ``regularize_sampling``)."""
    long = with_state(df).filter(LIVE).select(*keys, F.posexplode(data).alias("i", "x"))
    return _gathered(long.groupBy(*keys, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n")), keys)


def stack_median(df: DataFrame, keys: Sequence[str], data: str = "data") -> DataFrame:
    """Median over the live members of each ensemble, sample by sample."""
    long = with_state(df).filter(LIVE).select(*keys, F.posexplode(data).alias("i", "x"))
    return _gathered(long.groupBy(*keys, "i").agg(F.median("x").alias("x"), F.count("*").alias("n")), keys)


def _gathered(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("stack"), F.max("n").alias("fold")
    )


def best_member(df: DataFrame, keys: Sequence[str], metric: str, order: Sequence[str]) -> DataFrame:
    """The live member with the largest metric; a missing one never wins, ties go to the first."""
    live = with_state(df).filter(F.col(LIVE) & F.col(metric).isNotNull())
    top = live.groupBy(*keys).agg(F.max(metric).alias("qf_top"))
    at_top = live.join(top.select(*[F.col(k).alias(f"qf_k_{i}") for i, k in enumerate(keys)], "qf_top"), [F.col(k).eqNullSafe(F.col(f"qf_k_{i}")) for i, k in enumerate(keys)] + [F.col(metric) == F.col("qf_top")], "left_semi")
    return at_top.groupBy(*keys).agg(F.min_by(F.struct(*live.columns), F.struct(*order)).alias("m")).select("m.*")


def ensemble_bandwidth(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """Median band of the live members that have one; zeros without any."""
    has = F.col(LIVE) & F.col(low).isNotNull() & F.col(high).isNotNull()
    return with_state(df).groupBy(*keys).agg(
        F.coalesce(F.median(F.when(has, F.col(low))), F.lit(0.0)).alias("low"), F.coalesce(F.median(F.when(has, F.col(high))), F.lit(0.0)).alias("high"),
        F.count(F.when(has, 1)).alias("n"),
    )


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the last in the order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("m")).select("m.*")


def stations_by_networks(df: DataFrame, sta: str = "sta", net: str = "net") -> DataFrame:
    """Each station's networks, sorted, and their number."""
    return df.groupBy(sta).agg(F.array_sort(F.collect_set(net)).alias("nets"), F.count_distinct(net).alias("n_nets"))


def duplicate_stations(df: DataFrame, sta: str = "sta", net: str = "net") -> DataFrame:
    return stations_by_networks(df, sta, net).filter("n_nets > 1")


def unique_stations(df: DataFrame, sta: str = "sta", net: str = "net") -> DataFrame:
    return stations_by_networks(df, sta, net).filter("n_nets = 1")


def stations_without_network(df: DataFrame, sta: str = "sta", net: str = "net") -> DataFrame:
    return df.filter(F.col(net).isNull()).select(sta).distinct()


def set_network(df: DataFrame, sta: str, net: str, start: float | None = None, end: float | None = None, time: str = "time") -> DataFrame:
    """Set the network code of a station, within a closed time interval if both ends are given."""
    if (start is None) != (end is None):
        raise ValueError("give both ends of the interval or neither")
    hit = F.col("sta") == sta
    if start is not None:
        hit = hit & F.col(time).between(start, end)
    return df.withColumn("net", F.when(hit, F.lit(net)).otherwise(F.col("net")))


def set_network_from_map(df: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Network and station codes from a map (css30_sta, net, sta). Rows without net get all three
    codes, rows with one get css30_sta if they lack it. Also the counts: rows, updated, unmatched."""
    first = stations.groupBy(F.col("css30_sta").alias("m_css")).agg(F.min(F.struct("net", "sta")).alias("m"))  # a repeated station counts once
    known = first.select("m_css", F.col("m.net").alias("m_net"), F.col("m.sta").alias("m_sta"))
    had = F.col("css30_sta") if "css30_sta" in df.columns else F.lit(None).cast("string")
    joined = df.withColumn("css30_sta", had).join(known, F.col("sta") == F.col("m_css"), "left")
    without = F.col("net").isNull()
    full = without & F.col("m_net").isNotNull()
    marked = joined.withColumn("qf_up", full | (~without & F.col("css30_sta").isNull()))
    out = marked.select(
        *[F.col(c) for c in df.columns if c not in ("net", "sta", "css30_sta")],
        F.when(full, F.col("m_net")).otherwise(F.col("net")).alias("net"),
        F.when(full, F.col("m_sta")).otherwise(F.col("sta")).alias("sta"),
        F.when(full | (~without & F.col("css30_sta").isNull()), F.coalesce("m_css", "sta")).otherwise(F.col("css30_sta")).alias("css30_sta"),
    )
    counts = marked.agg(F.count("*").alias("scanned"), F.sum(F.col("qf_up").cast("long")).alias("updated"), F.count_distinct(F.when(without & F.col("m_net").isNull(), F.col("sta"))).alias("unmatched"))
    return out, counts


def set_source_id(df: DataFrame, sources: DataFrame, key: str = "evid") -> tuple[DataFrame, DataFrame]:
    """``source_id`` by equal event ids, and for each event id the rows hit or missed."""
    known = sources.groupBy(F.col(key).alias("qf_k")).agg(F.min("_id").alias("source_id"))  # a repeated id names its first source
    out = df.drop("source_id").join(known, F.col(key) == F.col("qf_k"), "left").drop("qf_k")
    counts = out.groupBy(key).agg(F.count("source_id").alias("hits"), (F.count("*") - F.count("source_id")).alias("misses"))
    return out, counts


def push_metadata(df: DataFrame, ensembles: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Ensemble attributes copied to the members; defined ones replace the members' own."""
    names = [c for c in ensembles.columns if c not in keys and c not in exclude]
    other = ensembles.select(*[F.col(k).alias(f"qf_{k}") for k in keys], *[F.col(c).alias(f"qf_{c}") for c in names])
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"qf_{k}"))
    joined = df.join(other, same, "left")
    own = [F.coalesce(f"qf_{c}", c).alias(c) if c in names else F.col(c) for c in df.columns]
    return joined.select(*own, *[F.col(f"qf_{c}").alias(c) for c in names if c not in df.columns])


def beam_metrics(df: DataFrame, beam: str = "beam", data: str = "data", phase: str | None = None, shift: str | None = None) -> DataFrame:
    """The metrics of each live member against its ensemble's beam, and the corrected phase time."""
    from quakeframe.functions import arrays as a

    live = lambda c, dead: F.when(F.col(LIVE), c).otherwise(F.lit(dead))
    out = with_state(df).withColumns(
        {
            "xcor_coef": live(a.beam_correlation(data, beam), 0.0),
            "coherence": live(a.beam_coherence(data, beam), 0.0),
            "relative_amplitude": live(a.beam_amplitude(data, beam), -1.0),
        }
    )
    return out.withColumn("phase_time", live(a.phase_time(phase, shift), -1.0)) if phase and shift else out
