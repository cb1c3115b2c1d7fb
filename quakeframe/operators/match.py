"""Matchers: joins that attach attributes of a normalizing table, with a rule for several matches.

A matcher is a join condition, the attributes to copy, and an order for "the first". Attributes come
in under ``prefix_name`` (``_id`` under ``prefix + "_id"``). ``find`` returns every match,
``find_one`` the first, ``normalize`` the first and kills rows without one.

``find_one`` never multiplies or sorts the rows themselves, which may carry samples: where equality
keys exist the table is folded to one row a key first (its count and first row), and each row meets
one row of it; otherwise the matching runs on the distinct values of the few columns that the
condition reads, and the result is joined back to the rows by these. Times and intervals meet in the
cells of ``intervals``, whatever the lengths, so that no row carries an array of epochs. Catalyst chooses
the joins; a table that is known to be small may be hinted with ``broadcast=True``, which holds only
up to ``BROADCAST_ROWS`` rows or cells (checked) and falls back to a shuffled join beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.asof import beside, within
from quakeframe.operators.intervals import interval_cells, pieces, point_cells, tick
from quakeframe.operators.merging import shuffled
from quakeframe.state import ELOG, LIVE, log_if, with_state

#: A hinted table is broadcast only if it has at most so many rows.
BROADCAST_ROWS = 1_000_000


def out_name(prefix: str, key: str) -> str:
    return f"{prefix}_id" if key == "_id" else f"{prefix}_{key}"


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count of at most ``most + 1`` rows shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Matcher:
    """left rows join ``table`` rows where ``condition()`` holds. ``order``: columns of the table that
    rank matches, the first wins; they must make the order total."""

    name = "Matcher"
    #: Rows of a table that may be broadcast.
    most = BROADCAST_ROWS

    def __init__(self, table: DataFrame, prefix: str, attributes: Sequence[str], order: Sequence[str], load_if_defined: Sequence[str] = (), broadcast: bool = False):
        self.prefix, self.attributes, self.optional = prefix, list(attributes), list(load_if_defined)
        self.table = small(table, self.most) if broadcast else table
        self.order = list(order)

    def keys(self) -> list[str]:
        """Columns of the table that the condition reads."""
        return []

    def _right(self) -> DataFrame:
        names = dict.fromkeys([*self.keys(), *self.attributes, *self.optional, *self.order])
        return self.table.select(*[F.col(c).alias(f"r_{c}") for c in names], *self._extra())

    def _extra(self) -> list[Column]:
        """Generated columns of the table, for the condition."""
        return []

    def _left_extra(self) -> list[Column]:
        """Generated columns of the rows, for the condition."""
        return []

    def condition(self) -> Column:
        """Between left columns and right columns named ``r_...``."""
        raise NotImplementedError

    def rank(self) -> list[Column]:
        return [F.col(f"r_{c}") for c in self.order]

    def _copied(self, df: DataFrame) -> list[Column]:
        own = [F.col(c) for c in df.columns]
        return own + [F.col(f"r_{c}").alias(out_name(self.prefix, c)) for c in [*self.attributes, *self.optional]]

    def _met(self, rows: DataFrame, right: DataFrame) -> DataFrame:
        """``rows`` with each match."""
        return rows.join(right, self.condition())

    def _pairs(self, df: DataFrame, right: DataFrame) -> DataFrame:
        """The distinct values of what the condition reads, with each match."""
        slim = df.filter(LIVE).select(*dict.fromkeys(self.needs())).distinct()
        return self._met(shuffled(slim.select("*", *self._left_extra())), right)

    def _back(self, df: DataFrame, found: DataFrame, how: str) -> DataFrame:
        """Live rows of ``df`` joined to ``found`` by what the condition reads."""
        named, same = found, F.col(LIVE)
        for i, c in enumerate(dict.fromkeys(self.needs())):
            named, same = named.withColumnRenamed(c, f"k_{i}"), same & (F.col(c) == F.col(f"k_{i}"))
        return df.join(shuffled(named), same, how)

    def find(self, df: DataFrame) -> DataFrame:
        """One row for each match of a live row."""
        df = with_state(df)
        if self._left_extra():  # rows are not multiplied by cells
            joined = self._back(df, self._pairs(df, self._right()), "inner")
        else:
            joined = self._met(df.filter(LIVE), self._right())
        complete = F.lit(True)
        for c in self.attributes:
            complete = complete & F.col(f"r_{c}").isNotNull()
        return joined.filter(complete).select(*self._copied(df))

    def _usable(self) -> DataFrame:
        """Table rows that can be a match: required attributes and the order are defined."""
        table = self.table
        for c in dict.fromkeys([*self.attributes, *self.order]):
            table = table.filter(F.col(c).isNotNull())
        return table

    def _attributes(self, before: str = "") -> Column:
        return F.struct(*[F.col(f"{before}{c}").alias(c) for c in [*self.attributes, *self.optional]])

    def needs(self) -> list[str]:
        """Columns of the left rows that the condition and the rank read."""
        raise NotImplementedError

    def _folded_pairs(self, df: DataFrame) -> DataFrame:
        """What the condition reads of ``df``, with r_first (the attributes of the first match) and r_n (the matches)."""
        right = self._usable().select(*[F.col(c).alias(f"r_{c}") for c in dict.fromkeys([*self.keys(), *self.attributes, *self.optional, *self.order])], *self._extra())
        return self._pairs(df, right).groupBy(*dict.fromkeys(self.needs())).agg(
            F.count("*").alias("r_n"), F.min_by(self._attributes("r_"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.rank())])).alias("r_first")
        )

    def _with_first(self, df: DataFrame) -> DataFrame:
        """``df`` with r_first and r_n."""
        return self._back(df, self._folded_pairs(df), "left")

    def find_one(self, df: DataFrame, key: Sequence[str] = (), require_unique: bool = False) -> DataFrame:
        """Every row with the first match's attributes and ``n_matches``. ``key`` is not needed: rows may
        repeat it. With ``require_unique`` several matches count as none."""
        df = with_state(df)
        joined = self._with_first(df)
        usable = F.col("r_n") == 1 if require_unique else F.lit(True)
        copied = [F.when(usable, F.col("r_first")[c]).alias(out_name(self.prefix, c)) for c in [*self.attributes, *self.optional]]
        return joined.select(*[F.col(c) for c in df.columns], *copied, F.coalesce("r_n", F.lit(0)).cast("long").alias("n_matches"))

    def normalize(self, df: DataFrame, key: Sequence[str] = (), kill_on_failure: bool = True, require_unique: bool = False, severity: str = "Invalid") -> DataFrame:
        """``find_one``; rows without a match are logged and, by default, killed; several matches are
        logged as a Complaint."""
        found = self.find_one(df, key, require_unique)
        none = F.col(LIVE) & (F.col("n_matches") == 0)
        several = F.col(LIVE) & (F.col("n_matches") > 1)
        failed = none | several if require_unique else none
        logged = found.withColumn(ELOG, log_if(none, self.name, "no match", severity)).withColumn(
            ELOG, log_if(several, self.name, "several matches", "Invalid" if require_unique else "Complaint")
        )
        return logged.withColumn(LIVE, F.col(LIVE) & ~failed) if kill_on_failure else logged


class EqualityMatcher(Matcher):
    """Equal values of left attributes and table columns; a missing one matches nothing."""

    name = "EqualityMatcher"

    def __init__(self, table, prefix, equal: Mapping[str, str], attributes, order, **options):
        self.equal = dict(equal)
        super().__init__(table, prefix, attributes, order, **options)

    def keys(self):
        return list(self.equal.values())

    def needs(self):
        return list(self.equal)

    def condition(self):
        result = F.lit(True)
        for left, right in self.equal.items():
            result = result & (F.col(left) == F.col(f"r_{right}"))
        return result

    def _folded(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        """``df`` with aggregates of the table rows of equal keys."""
        right = self._usable().groupBy(*[F.col(c).alias(f"r_{c}") for c in dict.fromkeys(self.equal.values())]).agg(*aggregates)
        return df.join(right, EqualityMatcher.condition(self) & F.col(LIVE), "left")

    def _with_first(self, df):
        return self._folded(df, F.count("*").alias("r_n"), F.min_by(self._attributes(), F.struct(*self.order)).alias("r_first"))


class ObjectIdMatcher(EqualityMatcher):
    """``<prefix>_id`` of the row is ``_id`` of the table."""

    name = "ObjectIdMatcher"

    def __init__(self, table, prefix, attributes, id_key: str | None = None, table_id: str = "_id", **options):
        super().__init__(table, prefix, {id_key or f"{prefix}_id": table_id}, attributes, [table_id], **options)


class _CellMatcher(EqualityMatcher):
    """Equal codes, and a time in an interval; they meet in cells of time of ``unit`` or more."""

    #: An interval has tens of cells, of which each counts as a row.
    most = BROADCAST_ROWS // 256

    def __init__(self, table, prefix, codes: Sequence[str], attributes, order, unit: float = 1.0, **options):
        self.unit = unit
        super().__init__(table, prefix, {c: c for c in codes}, attributes, order, **options)

    def condition(self):
        return super().condition() & (F.col("q_cell") == F.col("r_cell")) & self.inside()

    def inside(self) -> Column:
        raise NotImplementedError

    def _with_first(self, df):
        return Matcher._with_first(self, df)


class MiniseedMatcher(_CellMatcher):
    """Station codes, and the start time inside the table row's epoch (closed)."""

    name = "MiniseedMatcher"

    def __init__(self, table, prefix, codes, attributes, order=("starttime",), time="starttime", endtime: str | None = None, **options):
        self.time, self.endtime = time, endtime
        super().__init__(table, prefix, codes, attributes, order, **options)

    def keys(self):
        return [*super().keys(), "starttime", "endtime"]

    def needs(self):
        return [*self.equal, self.time, *([self.endtime] if self.endtime else [])]

    def inside(self):
        last = F.col(self.endtime) if self.endtime else F.col(self.time)
        return (F.col("r_starttime") <= F.col(self.time)) & (F.col("r_endtime") >= last)

    def _with_first(self, df):
        """By the pieces of time into which a station's epochs fall: each knows its first epoch and their number, and
        a time meets the piece before it by an as-of lookup, so that no row becomes cells. A row that must end in its
        epoch, too, meets cells only where epochs overlap."""
        codes = [f"qf_c{i}" for i in range(len(self.equal))]
        start, end = F.col("starttime").cast("double"), F.nanvl(F.col("endtime").cast("double"), F.lit(float("inf")))
        order = {f"qf_o{i}": F.col(c) for i, c in enumerate(self.order)} | {"qf_s": start, "qf_e": end}
        table = self._usable().select(*[F.col(c).alias(n) for c, n in zip(self.equal.values(), codes, strict=True)], start.alias("qf_a"), *[c.alias(n) for n, c in order.items()], self._attributes().alias("qf_f"))
        table = table.dropna(subset=[*codes, "qf_a", "qf_e"]).filter("NOT isnan(qf_a) AND qf_a <= qf_e")
        parts = pieces(table.withColumn("qf_b", F.col("qf_e")).repartition(*codes), codes, "qf_a", "qf_b", list(order))
        told = shuffled(parts).join(table.groupBy(*codes, *order).agg(F.first("qf_f").alias("qf_f")), [*codes, *order])
        told = told.select(*codes, "qf_t", F.struct(F.col("qf_z").alias("z"), F.col("qf_m").alias("n"), F.col("qf_f").alias("first"), F.col("qf_e").alias("e")).alias("qf_v"))
        needs, time = list(dict.fromkeys(self.needs())), F.col(self.time).cast("double")
        slim = df.filter(LIVE).select(*needs).dropna().distinct()
        wanted = slim.select(*needs, *[F.col(c).alias(n) for c, n in zip(self.equal, codes, strict=True)], time.alias("qf_t"), F.lit(1).alias("qf_side")).filter("NOT isnan(qf_t)")
        met = beside(told, wanted, codes, 86400.0).filter(F.col("qf_p")["z"] >= F.col("qf_t"))
        several = F.col("qf_p")["n"] > 1
        found = met
        if self.endtime:
            found = met.filter(~several & (F.col("qf_p")["e"] >= F.col(self.endtime).cast("double")))
        found = found.select(*needs, F.col("qf_p")["n"].alias("r_n"), F.col("qf_p")["first"].alias("r_first"))
        if self.endtime:
            by_start = Window.partitionBy(*self.equal.values()).orderBy("starttime", "endtime")
            early, late = F.max("endtime").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lead("starttime").over(by_start)
            crowd = copy(self)
            crowd.table = self._usable().filter("starttime <= endtime").withColumns({"qf_early": early, "qf_late": late}).filter("qf_early >= starttime OR qf_late <= endtime")
            found = found.unionByName(crowd._folded_pairs(met.filter(several).select(*needs, F.lit(True).alias(LIVE))))
        return self._back(df, found, "left")

    def _extra(self):
        return [F.explode(interval_cells(F.col("starttime"), F.col("endtime"), self.unit)).alias("r_cell")]

    def _left_extra(self):
        return [F.explode(point_cells(F.col(self.time), self.unit)).alias("q_cell")]


class MiniseedDBMatcher(MiniseedMatcher):
    """As above, and the end time inside the epoch too."""

    name = "MiniseedDBMatcher"

    def __init__(self, table, prefix, codes, attributes, order=("starttime",), time="starttime", endtime="endtime", **options):
        super().__init__(table, prefix, codes, attributes, order, time, endtime, **options)


class ArrivalMatcher(_CellMatcher):
    """Arrivals of the row's station between its start and end time (closed)."""

    name = "ArrivalMatcher"

    def __init__(self, table, prefix, codes, attributes, order=("time",), start="starttime", end="endtime", table_time="time", **options):
        self.start, self.end, self.table_time = start, end, table_time
        super().__init__(table, prefix, codes, attributes, order, **options)

    def keys(self):
        return [*super().keys(), self.table_time]

    def needs(self):
        return [*self.equal, self.start, self.end]

    def inside(self):
        return F.col(f"r_{self.table_time}").between(F.col(self.start), F.col(self.end))

    def _extra(self):
        return [F.explode(point_cells(F.col(self.table_time), self.unit)).alias("r_cell")]

    def _left_extra(self):
        return [F.explode(interval_cells(F.col(self.start), F.col(self.end), self.unit)).alias("q_cell")]


class OriginTimeMatcher(Matcher):
    """Table times within a tolerance (closed) of the row's start time less an offset.

    The band has no equality key: both sides are cut into buckets of ``width`` (the tolerance or
    more), the table is put into its bucket and the two beside it, and the buckets are joined. A bucket
    of more than ``ROWS`` rows is dealt by hashes into blocks of rows times layers of the table, about so
    many rows each: one place does not make one task, and a task holds one layer while rows stream.
    ``nearest``: the smallest difference wins, then the order; else the order alone. The first of the
    nearest is one of two neighbours in time, and counts are differences of running counts, so
    that ``find_one`` makes no pairs; with the order alone it makes them.
    """

    name = "OriginTimeMatcher"
    #: Rows of a block, and of a layer (about).
    ROWS = 8192

    def __init__(self, table, prefix, attributes, order, tolerance: float, offset: float = 0.0, time="starttime", table_time="time", nearest: bool = True, width: float | None = None, **options):
        self.tolerance, self.offset, self.time, self.table_time, self.nearest = tolerance, offset, time, table_time, nearest
        self.width = max(width or tolerance, tolerance, 1e-9)
        super().__init__(table, prefix, attributes, order, **options)

    def keys(self):
        return [self.table_time]

    def needs(self):
        return [self.time]

    def _wanted(self) -> Column:
        return F.col(self.time) - self.offset

    def condition(self):
        return F.abs(F.col(f"r_{self.table_time}") - self._wanted()) <= self.tolerance

    def _met(self, rows, right):
        # the width is 15 cells of 16 in a bucket, so that rounding moves no match out of the buckets beside
        bucket = lambda c: F.shiftright(tick(c, max(self.width / 15, 1e-3)), 4)
        finite = lambda c: F.abs(c.cast("double")) < F.lit(float("inf"))  # noqa: E731  no nulls and no NaN, too
        parts = lambda c: F.coalesce(F.ceil(F.col(c) / self.ROWS), F.lit(1))
        t, one, none = F.col(f"r_{self.table_time}"), F.lit(1).cast("long"), F.lit(0).cast("long")
        rows, table = rows.filter(finite(self._wanted())).withColumn("qf_b", bucket(self._wanted())), right.filter(finite(t)).withColumn("qf_at", bucket(t))

        counts = rows.select("qf_b", one.alias("q"), none.alias("r")).union(table.select("qf_at", none, one)).groupBy("qf_b").agg(F.sum("q").alias("q"), F.sum("r").alias("r"))
        beside = [F.struct((F.col("qf_b") + i).alias("qf_b"), (none if i else F.col("q")).alias("q"), F.col("r").alias("r")) for i in (-1, 0, 1)]
        large = counts.select(F.inline(F.array(*beside))).groupBy("qf_b").agg(F.sum("q").alias("qf_q"), F.sum("r").alias("qf_r"))
        large = F.broadcast(large.filter((F.greatest("qf_q", "qf_r") > self.ROWS) & (F.col("qf_q") > 0) & (F.col("qf_r") > 0)))  # few: a bucket for so many rows

        flat = lambda df: [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
        dealt = lambda df, own, other: df.withColumn("qf_own", F.pmod(F.xxhash64(*flat(df)), parts(own))).withColumn("qf_other", F.explode(F.sequence(none, parts(other) - 1)))
        left = dealt(rows.join(large, "qf_b", "left"), "qf_q", "qf_r")
        table = table.withColumn("qf_t", F.explode(F.array(*[F.col("qf_at") + i for i in (-1, 0, 1)])))
        table = dealt(table.join(large.withColumnRenamed("qf_b", "qf_t"), "qf_t", "left"), "qf_r", "qf_q").select(*right.columns, "qf_t", F.col("qf_other").alias("qf_block"), F.col("qf_own").alias("qf_layer"))

        # a number of partitions of its own: few bytes come in, many rows go out
        spark = rows.sparkSession
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
        left, table = left.repartition(n, "qf_b", "qf_own", "qf_other"), table.repartition(n, "qf_t", "qf_block", "qf_layer")
        same = (F.col("qf_b") == F.col("qf_t")) & (F.col("qf_own") == F.col("qf_block")) & (F.col("qf_other") == F.col("qf_layer"))
        return left.join(shuffled(table), same & self.condition()).drop("qf_b", "qf_q", "qf_r", "qf_own", "qf_other", "qf_t", "qf_block", "qf_layer")

    def _with_first(self, df):
        if not self.nearest:
            return super()._with_first(df)
        time, rank = F.col(self.table_time).cast("double"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)])
        table = self._usable().groupBy(time.alias("qf_t")).agg(F.count("*").alias("qf_m"), F.min(rank).alias("o"), F.min_by(self._attributes(), rank).alias("a"))
        table = table.select("qf_t", "qf_m", F.struct(F.col("qf_t").alias("t"), "o", "a").alias("qf_v"))
        found = within(df.filter(LIVE).select(self._wanted().alias("qf_w")).distinct(), table, self.tolerance)
        place = lambda c: F.struct(F.abs(F.col(c)["t"] - F.col("qf_w")), F.col(c)["o"])
        first = F.when(F.col("prior").isNull() | F.col("next").isNotNull() & (place("next") < place("prior")), F.col("next")).otherwise(F.col("prior"))
        found = found.select(F.col("qf_w").alias("k_0"), F.col("n").alias("r_n"), first["a"].alias("r_first"))
        return df.join(shuffled(found), F.col(LIVE) & (self._wanted() == F.col("k_0")), "left")

    def rank(self):
        near = [F.abs(F.col(f"r_{self.table_time}") - self._wanted())] if self.nearest else []
        return near + super().rank()


def bulk_normalize(df: DataFrame, matchers: Sequence[Matcher], key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the attributes of all matchers, none killed; and the counts: rows, then hits."""
    hits = []
    for i, m in enumerate(matchers):
        df = m.find_one(df, key).withColumnRenamed("n_matches", f"qf_hits_{i}")
        hits.append(F.sum((F.col(f"qf_hits_{i}") > 0).cast("long")).alias(f"hits_{i}"))
    counts = df.agg(F.count("*").alias("n"), *hits)
    return df.drop(*[f"qf_hits_{i}" for i in range(len(matchers))]), counts


#: What a table that is named only gives: its own columns of these.
STANDARD = {
    "channel": ("lat", "lon", "elev", "hang", "vang", "starttime", "endtime"),
    "site": ("lat", "lon", "elev", "starttime", "endtime"),
    "source": ("lat", "lon", "depth", "time"),
}


def normalizers(wanted: Sequence[str | Matcher], tables: Mapping[str, DataFrame]) -> list[Matcher]:
    """Matchers as they are; a name stands for the match of ``<name>_id`` with ``_id`` of that table, with
    its usual attributes (of other tables all). Others raise."""
    out: list[Matcher] = []
    for w in wanted:
        if isinstance(w, Matcher):
            out.append(w)
        elif isinstance(w, str):
            if w not in tables:
                raise ValueError(f"no table {w}")
            usual = STANDARD.get(w, tables[w].columns)
            out.append(ObjectIdMatcher(tables[w], w, [], load_if_defined=[c for c in usual if c in tables[w].columns and c != "_id"]))
        else:
            raise TypeError(f"{w!r} is neither a name nor a matcher")
    return out


def normalize_all(df: DataFrame, matchers: Sequence[Matcher], kill_on_failure: bool = True, require_unique: bool = False, severity: str = "Invalid") -> DataFrame:
    """``normalize`` by each matcher in turn, without the counts. The tables of successive matchers with the
    same equality keys are folded into one of structs, so that the rows are joined once a key set."""
    df, at = with_state(df), 0
    while at < len(matchers):
        run = [matchers[at]]
        foldable = lambda m: type(m)._with_first is EqualityMatcher._with_first
        while foldable(run[0]) and at + len(run) < len(matchers) and foldable(matchers[at + len(run)]) and sorted(matchers[at + len(run)].equal) == sorted(run[0].equal):
            run.append(matchers[at + len(run)])
        at += len(run)
        df = run[0].normalize(df, (), kill_on_failure, require_unique, severity).drop("n_matches") if len(run) == 1 else _normalized_once(df, run, kill_on_failure, require_unique, severity)
    return df


def _normalized_once(df: DataFrame, run: Sequence[EqualityMatcher], kill_on_failure: bool, require_unique: bool, severity: str) -> DataFrame:
    keys, folded = sorted(run[0].equal), None
    for i, m in enumerate(run):
        own = m._usable().groupBy(*[F.col(m.equal[k]).alias(f"qf_k{j}") for j, k in enumerate(keys)])
        part = own.agg(F.struct(F.count("*").alias("n"), F.min_by(m._attributes(), F.struct(*m.order)).alias("first")).alias(f"qf_m{i}"))
        folded = part if folded is None else folded.unionByName(part, allowMissingColumns=True)
    names = [f"qf_k{j}" for j in range(len(keys))]
    folded = folded.groupBy(*names).agg(*[F.first(f"qf_m{i}", ignorenulls=True).alias(f"qf_m{i}") for i in range(len(run))])
    same = F.col(LIVE)
    for j, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"qf_k{j}"))
    out = df.join(folded, same, "left")
    for i, m in enumerate(run):
        n = F.coalesce(F.col(f"qf_m{i}")["n"], F.lit(0))
        none, several = F.col(LIVE) & (n == 0), F.col(LIVE) & (n > 1)
        usable = F.col(LIVE) & ((n == 1) if require_unique else (n > 0))
        failed = none | several if require_unique else none
        out = out.withColumns({out_name(m.prefix, c): F.when(usable, F.col(f"qf_m{i}")["first"][c]) for c in [*m.attributes, *m.optional]})
        logged = {ELOG: log_if(none, m.name, "no match", severity)}
        out = out.withColumns(logged).withColumn(ELOG, log_if(several, m.name, "several matches", "Invalid" if require_unique else "Complaint"))
        out = out.withColumn(LIVE, F.col(LIVE) & ~failed) if kill_on_failure else out
    return out.drop(*names, *[f"qf_m{i}" for i in range(len(run))])


def erase_normalized(df: DataFrame, prefixes: Sequence[str] = ("site", "channel", "source")) -> DataFrame:
    """Without the joined attributes; the ids stay."""
    return df.drop(*[c for c in df.columns if any(c.startswith(f"{p}_") and c != f"{p}_id" for p in prefixes)])


def table_join(left: DataFrame, right: DataFrame, keys: Sequence[str] | Mapping[str, str], how: str = "right", suffix: str = "_right") -> DataFrame:
    """An exact join of two tables; by default every right row stays. Other columns of the right
    table that the left one has get the suffix. Left keys keep their names."""
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    renamed = right.select(*[F.col(c).alias(f"qf_r_{c}") for c in right.columns])
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & (F.col(a) == F.col(f"qf_r_{b}"))
    joined = left.crossJoin(renamed) if how == "cross" else left.join(renamed, condition, how)
    out = [F.coalesce(F.col(c), F.col(f"qf_r_{pairs[c]}")).alias(c) if c in pairs and how != "cross" else F.col(c) for c in left.columns]
    for c in right.columns:
        if c in pairs.values() and how != "cross" and c in left.columns:
            continue
        out.append(F.col(f"qf_r_{c}").alias(c + suffix if c in left.columns else c))
    return joined.select(*out)


