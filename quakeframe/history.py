"""Provenance: algorithm ids by name and parameters, the stages of a datum, and the graph of what was
made from what."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.operators.match import BROADCAST_ROWS, small
from quakeframe.operators.merging import shuffled
from quakeframe.runtime import discard, shared_folder, shuffles_dropped

#: Rows of a partition of a graph's tables, or members of sets.
ROWS = 500_000
#: Members of a set that one row holds. Parquet's reader holds 4,096 rows at a time.
MEMBERS = 4_000
#: Members on their way in a batch.
BATCH = 200_000_000
#: Pairs on their way in a batch.
PAIRS = 50_000_000
#: Ids by which it is guessed how many members a batch has.
SOME = 10_000
HISTORY_TYPE = "array<struct<stage:int,algorithm:string,alg_id:string>>"


def alg_id(name: Column, parameters: Column) -> Column:
    """The same algorithm with the same parameters has the same id, in every job."""
    return F.substring(F.sha2(F.concat_ws("\u0001", name, F.coalesce(parameters, F.lit(""))), 256), 1, 24)


def usage(df: DataFrame, name: str, parameters: str, time: str) -> DataFrame:
    """Log rows (name, parameters, time) with their ids and whether the id was used before."""
    from pyspark.sql import Window

    own = Window.partitionBy("alg_id").orderBy(time)
    return df.select(F.col(name).alias("alg_name"), F.col(parameters).alias("parameters"), F.col(time).alias("time")).withColumn("alg_id", alg_id(F.col("alg_name"), F.col("parameters"))).withColumn(
        "reused", F.row_number().over(own) > 1
    )


def algorithms(log: DataFrame) -> DataFrame:
    """Each id with its name, parameters, first use and number of uses."""
    return log.groupBy("alg_id", "alg_name", "parameters").agg(F.min("time").alias("first_used"), F.count("*").alias("uses"))


def renamed(log: DataFrame, identity: str, name: str, parameters: str) -> DataFrame:
    """The log with another name and other parameters for an id, which stays; an unknown id raises."""
    own = F.col("alg_id") == identity
    if log.filter(own).isEmpty():
        raise ValueError(f"no algorithm with id {identity}")
    return log.withColumns({"alg_name": F.when(own, F.lit(name)).otherwise(F.col("alg_name")), "parameters": F.when(own, F.lit(parameters)).otherwise(F.col("parameters"))})


def stage(df: DataFrame, name: str, parameters: str = "") -> DataFrame:
    """One more stage in each row's history."""
    before = F.col("history") if "history" in df.columns else F.array().cast(HISTORY_TYPE)
    entry = F.struct((F.size(before) + 1).cast("int").alias("stage"), F.lit(name).alias("algorithm"), alg_id(F.lit(name), F.lit(parameters)).alias("alg_id"))
    return df.withColumn("history", F.array_append(before, entry))


def parameter_tree(parameters: Mapping, prefix: str = "") -> dict[str, str]:
    """A nested parameter tree as flat text by dotted path."""
    out: dict[str, str] = {}
    for k, v in parameters.items():
        out |= parameter_tree(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": str(v)}
    return out


def edges(df: DataFrame, parent: str, child: str, algorithm: str, parameters: str = "") -> DataFrame:
    """Which datum (child) was made from which (parent), and by what. Stacks, merges and joins have several
    rows a child; an origin is a child without a parent."""
    return df.select(F.col(parent).alias("parent"), F.col(child).alias("child"), F.lit(algorithm).alias("algorithm"), alg_id(F.lit(algorithm), F.lit(parameters)).alias("alg_id"))


def group_edges(df: DataFrame, keys: Sequence[str], ident: str, child: Column, algorithm: str, parameters: str = "") -> DataFrame:
    """Edges of a reduction by keys: each member is a parent of its group's result, named by ``child``."""
    return edges(df.select(F.col(ident).alias("parent"), child.alias("child")), "parent", "child", algorithm, parameters)


@dataclass(frozen=True)
class _Sets:
    """Sets of ids by id, as a table of rows (id, members) in a folder; a set that may be large has several rows,
    with different members. With the rows, members in all, most of one set, and least and largest id."""

    rows: DataFrame
    folder: str
    ids: int
    size: int
    most: int
    low: object
    high: object


def _written(parts: Iterable[DataFrame], spark: SparkSession, whole: bool = True) -> _Sets:
    """``parts`` (id, members), one after the other, as one table; the files of each part's shuffles go with it.
    ``whole``: each set has one row."""
    folder = shared_folder(spark, "sets")
    with shuffles_dropped(spark):
        for part in parts:
            part.write.mode("append").option("compression", "zstd").parquet(folder)
            kind = part.schema
        rows = spark.read.schema(kind).parquet(folder)
        sizes = rows.select("id", F.size("members").cast("long").alias("n"))
        sizes = sizes if whole else sizes.groupBy("id").agg(F.sum("n").alias("n"))
        ids, size, most, low, high = sizes.agg(F.count("*"), F.sum("n"), F.max("n"), F.min("id"), F.max("id")).first()
    return _Sets(rows, folder, ids, size or 0, most or 0, low, high)


def _batches(rows: DataFrame, n: int) -> Iterator[DataFrame]:
    """``rows`` by their ids in ``n`` batches."""
    for i in range(n):
        yield rows.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == i) if n > 1 else rows


def _united(rows: DataFrame, wide: DataFrame | None, expected: float) -> DataFrame:
    """The union of each id's members. That of an id in ``wide`` (id, parts) is made in so many parts."""
    keys = ["id"]
    if wide is not None:
        one = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.col("members")))
        each = F.transform("members", lambda x: F.struct(F.pmod(F.xxhash64(x), F.col("parts")).alias("part"), F.array(x).alias("members")))
        rows, keys = rows.join(wide, "id", "left").select("id", F.inline(F.when(F.col("parts").isNull(), one).otherwise(each))), ["id", "part"]
    members, rows = F.sort_array(F.array_distinct(F.flatten(F.collect_list("members")))), _dealt(rows, expected, *keys)
    rows = rows if wide is None else rows.distinct()  # one member may be reached in very many ways
    return rows.groupBy(*keys).agg(members.alias("members")).select("id", "members")


def _wide(sizes: Iterable[DataFrame], spark: SparkSession) -> tuple[DataFrame, str] | None:
    """(id, parts) of the ids of which ``sizes`` (id, n) tell more than ``MEMBERS``, and the table's folder."""
    folder = shared_folder(spark, "wide")
    with shuffles_dropped(spark):
        for part in sizes:
            found = part.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") > MEMBERS).select("id", F.ceil(F.col("n") / MEMBERS).alias("parts"))
            found.write.mode("append").parquet(folder)
        wide = spark.read.schema(found.schema).parquet(folder)
    if wide.isEmpty():
        discard(spark, folder)
        return None
    return small(wide), folder


def _steps(rows: DataFrame, jumps: _Sets) -> DataFrame:
    """(id, x) of the members that may have jumps."""
    found = rows.select("id", F.explode("members").alias("x"))
    return found.filter(F.col("x").between(jumps.low, jumps.high)) if isinstance(jumps.low, int | str) else found


def _prolonged(held: _Sets, jumps: _Sets, keep: bool) -> _Sets:
    """What ``jumps`` reach from the members of each set, and with ``keep`` the members, too. Ids are done in
    batches, whose members on their way fill no more than about ``BATCH`` (or as many as ``jumps`` has, which each
    batch reads): pairs of an id and what is reached from it are many times the sets."""
    spark, to, here = held.rows.sparkSession, F.col("a"), F.col("x")
    further, ways = held.size * jumps.size / jumps.ids, jumps.rows.select(F.col("id").alias("a"), "members")
    if held.size + further > BATCH:  # of some ids it is counted what they reach
        every = max(1, held.ids // SOME)
        some = held.rows.filter(F.pmod(F.xxhash64("id", F.lit(every)), F.lit(every)) == 0)
        with shuffles_dropped(spark):
            further = every * (_steps(some, jumps).join(shuffled(ways.select("a", F.size("members").alias("n"))), here == to).agg(F.sum("n")).first()[0] or 0)
    n, wide = ceil((held.size + further) / max(BATCH, jumps.size)) or 1, None
    if held.most * (keep + jumps.most) > MEMBERS:
        sizes = shuffled(ways.groupBy("a").agg(F.sum(F.size("members")).alias("n")))
        own = [rows.select("id", F.size("members").cast("long").alias("n")) for rows in _batches(held.rows, n)]
        wide = _wide((_steps(rows, jumps).join(sizes, here == to).select("id", "n").unionByName(o) for rows, o in zip(_batches(held.rows, n), own, strict=True)), spark)

    def parts() -> Iterator[DataFrame]:
        for rows in _batches(held.rows, n):
            met = _dealt(_steps(rows, jumps), max(held.size / n, jumps.size), "x").join(shuffled(ways), here == to).select("id", "members")
            yield _united(rows.select("id", "members").unionByName(met) if keep else met, wide and wide[0], (held.size * keep + further) / n)

    made = _written(parts(), spark, wide is None)
    if wide:
        discard(spark, wide[1])
    return made


def ancestors(graph: DataFrame, ids: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(id, ancestor) for all that any of ``ids`` (column id; by default each child) was made from, over any
    number of steps. Pointer doubling: jumps of 1, 2, 4, ... steps are squared from round to round, and each
    round prolongs what is known by one such jump, so that rounds grow with the logarithm of the depth. Null
    ends, loops to itself and repeated edges do no harm; a cycle ends the job with an error. What is known are
    sets in rows of at most about ``MEMBERS``, prolonged in batches (``_prolonged``); the tables of a round go with the
    next one, so that the disk holds what was found and one batch."""
    spark = graph.sparkSession
    made = graph.select(F.col("child").alias("id"), F.col("parent").alias("x")).dropna().filter("id <> x").distinct()
    folder = shared_folder(spark, "steps")
    with shuffles_dropped(spark):
        made.write.parquet(folder)
    made = spark.read.schema(made.schema).parquet(folder)
    wide = _wide([made.select("id", F.lit(1).cast("long").alias("n"))], spark)
    jumps = _written([_united(made.select("id", F.array("x").alias("members")), wide and wide[0], made.count())], spark, wide is None)
    start = ids.select("id").distinct() if ids is not None else made.select("id").distinct()
    known = _written([start.select("id", F.array("id").alias("members"))], spark)
    for old in (folder, *([wide[1]] if wide else [])):
        discard(spark, old)
    for _ in range(rounds):
        if not jumps.size:
            discard(spark, jumps.folder)
            return known.rows.select("id", F.explode("members").alias("ancestor")).filter("id <> ancestor")
        more = _prolonged(known, jumps, True)
        discard(spark, known.folder)
        further = _prolonged(jumps, jumps, False)
        discard(spark, jumps.folder)
        known, jumps = more, further
    discard(spark, known.folder)
    discard(spark, jumps.folder)
    raise ValueError("the history has a cycle")


def _dealt(df: DataFrame, rows: float, *keys: str) -> DataFrame:
    """``df`` by ``keys``, in partitions for about ``ROWS`` of so many rows (or members)."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / ROWS)), *keys)


def origins(graph: DataFrame, reached: DataFrame) -> DataFrame:
    """Of the ancestors (in this graph) those that were made from nothing. Few of these are broadcast, so that the pairs
    stay where they are; for many, the pairs are joined in batches of ids, and what is found is written."""
    spark, folder = graph.sparkSession, shared_folder(graph.sparkSession, "origins")
    linked = graph.filter("parent IS NOT NULL")
    made, first = linked.select(F.col("child").alias("ancestor")), linked.select(F.col("parent").alias("ancestor")).distinct()
    with shuffles_dropped(spark):
        first.join(shuffled(made), "ancestor", "left_anti").write.parquet(folder)
        first = spark.read.schema(first.schema).parquet(folder)
        if first.count() <= BROADCAST_ROWS:
            return reached.join(F.broadcast(first), "ancestor", "left_semi").select("id", "ancestor")
        found, n = shared_folder(spark, "found"), ceil(reached.count() / PAIRS) or 1
        for part in _batches(reached, n):
            part = _dealt(part, PAIRS, "ancestor").join(shuffled(first), "ancestor", "left_semi").select("id", "ancestor")
            part.write.mode("append").option("compression", "zstd").parquet(found)
    discard(spark, folder)
    return spark.read.schema(part.schema).parquet(found)
