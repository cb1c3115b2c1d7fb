"""Reading and writing sets of data: header tables with samples as the last column.

A save splits live from dead: live rows go to the waveform table, partitioned by data_tag, dead ones
to the cemetery. Ids are a digest of the row's own keys, so a task that runs twice writes the same.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.operators.match import Matcher, normalize_all
from quakeframe.operators.undertaker import bury
from quakeframe.state import with_state

COMPARISONS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c.isNull() | (c != F.lit(v)),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(*v),
    "$nin": lambda c, v: c.isNull() | ~c.isin(*v),
    "$exists": lambda c, v: c.isNotNull() if v else c.isNull(),
    "$regex": lambda c, v: c.rlike(v),
}


def condition(query: Mapping) -> Column:
    """A document filter as a column: equality, comparisons, $and, $or, $nor, $not."""
    parts = []
    for key, value in query.items():
        if key in ("$and", "$or", "$nor"):
            inner = [condition(q) for q in value]
            joined = reduce(lambda a, b: a & b, inner) if key == "$and" else reduce(lambda a, b: a | b, inner)
            parts.append(~F.coalesce(joined, F.lit(False)) if key == "$nor" else joined)
        elif isinstance(value, Mapping):
            for op, v in value.items():
                if op == "$not":
                    parts.append(~F.coalesce(condition({key: v}), F.lit(False)))
                elif op in COMPARISONS:
                    parts.append(COMPARISONS[op](F.col(key), v))
                else:
                    raise ValueError(f"unknown operator {op}")
        else:
            parts.append(F.col(key).isNull() if value is None else F.col(key) == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def read_data(df: DataFrame, query: Mapping | None = None, data_tag: str | None = None, matchers: Sequence[Matcher] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of a waveform table: filter, then normalize by each matcher in turn (a failure kills)."""
    if data_tag is not None:
        df = df.filter(F.col("data_tag") == data_tag)
    if query:
        df = df.filter(condition(query))
    df = with_state(df.drop(*exclude))
    return normalize_all(df, matchers)


def read_ensembles(df: DataFrame, queries: Sequence[Mapping]) -> DataFrame:
    """One ensemble a query, in column ``ensemble``; a row may be in several. One scan."""
    hits = F.array_compact(F.array(*[F.when(condition(q), F.lit(i)) for i, q in enumerate(queries)]))
    return df.withColumn("ensemble", F.explode(hits))


def row_id(keys: Sequence[str]) -> Column:
    """A 24-digit id from the row's keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 24)


def write_data(df: DataFrame, path: str, cemetery_path: str | None = None, data: str = "data", data_tag: str = "all", mode: str = "append", id_keys: Sequence[str] | None = None, job: str | None = None) -> None:
    """Save live rows under ``path`` by data_tag, dead ones as cemetery records.

    With a ``job`` both tables are partitioned by it, too, and a save replaces what the job of that name wrote
    before: one that died between the two tables, or runs twice, leaves nothing twice. The cemetery comes
    first, so that live rows are there only when the whole save is.
    """
    df = with_state(df)
    if id_keys:
        df = df.withColumn("_id", row_id(id_keys))
    live, dead = bury(df, data, data_tag)
    ordered = [c for c in live.columns if c != data] + ([data] if data in live.columns else [])
    live = live.select(*ordered).withColumn("data_tag", F.lit(data_tag))

    def put(rows: DataFrame, place: str, by: list[str]) -> None:
        if job is not None:
            rows, by = rows.withColumn("job", F.lit(job)), [*by, "job"]
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(place)
        else:
            (rows.write.mode(mode).partitionBy(*by) if by else rows.write.mode(mode)).parquet(place)

    if cemetery_path:
        put(dead, cemetery_path, [])
    put(live, path, ["data_tag"])


def as_documents(df: DataFrame, data: Sequence[str] = ("data", "spectrum"), pretty: bool = False) -> DataFrame:
    """Each row's header as one JSON document (column ``document``), samples left out, nulls too; ``pretty``
    for people to read."""
    head = [c for c in df.columns if c not in data]
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in head]), {"pretty": str(pretty).lower()}).alias("document"))


def from_documents(df: DataFrame, schema: str, document: str = "document") -> DataFrame:
    """Rows of JSON documents by a schema; what a document lacks is null, a broken document gives nulls."""
    return df.select(F.from_json(document, schema).alias("d")).select("d.*")


def read_table(spark: SparkSession, path: str, data_tag: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("data_tag") == data_tag) if data_tag is not None else df


def updated(df: DataFrame, changes: DataFrame, key: str = "_id", readonly: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Upsert of attributes by id: defined changes win, new ids are appended. Readonly attributes
    keep their value, the change goes to READONLYERROR_. Changes of one id count as if they were made one
    after the other in ``order``: of each attribute the last defined value stays. Without an order
    several values for one attribute of an id raise. A null id is not changed, nor joined to another."""
    rest = [c for c in changes.columns if c != key and (c in df.columns or c not in order)]
    if order:
        place = F.struct(*order)
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in rest]
    else:
        several = F.raise_error(F.concat(F.lit("several changes of one attribute need an order: "), F.col(key).cast("string")))
        last = [F.when(F.count(c) > 1, several).otherwise(F.first(c, ignorenulls=True)).alias(c) for c in rest]
    changes = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*last)
    renamed = changes.select(F.col(key).alias("qf_k"), *[F.col(c).alias(f"qf_{c}") for c in changes.columns if c != key])
    joined = df.join(renamed, F.col(key) == F.col("qf_k"), "full")
    out = [F.coalesce(key, "qf_k").alias(key)]
    for c in dict.fromkeys([*df.columns, *changes.columns]):
        if c == key:
            continue
        if c not in changes.columns:
            out.append(F.col(c))
        elif c in readonly:
            out += [F.col(c), F.col(f"qf_{c}").alias(f"READONLYERROR_{c}")]
        else:
            out.append(F.coalesce(f"qf_{c}", c).alias(c) if c in df.columns else F.col(f"qf_{c}").alias(c))
    return joined.select(*out)


def deleted(df: DataFrame, ids: DataFrame, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Without the rows of these ids; and the files (dir, dfile) that no other row names any more."""
    gone = ids.select(key).distinct()
    rest = df.join(gone, key, "left_anti")
    if not {"dir", "dfile"} <= set(df.columns):
        return rest, df.limit(0)
    files = df.join(gone, key, "left_semi").select("dir", "dfile").distinct().join(rest.select("dir", "dfile"), ["dir", "dfile"], "left_anti")
    return rest, files


def flatten_inventory(inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Site and channel rows of nested networks (code, stations (code, channels (...)))."""
    sta = inventory.select(F.col("code").alias("net"), F.explode("stations").alias("s"))
    cha = sta.select("net", F.col("s.code").alias("sta"), F.explode("s.channels").alias("c"))
    channel = cha.select("net", "sta", "c.*")
    site = channel.groupBy("net", "sta", "loc").agg(F.min("starttime").alias("starttime"), F.max("endtime").alias("endtime"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.first("elev").alias("elev"))
    return site, channel


def new_inventory_rows(rows: DataFrame, known: DataFrame, keys: Sequence[str], tolerance: float = 10.0) -> DataFrame:
    """Rows without a known one of equal codes and both times within the tolerance (open)."""
    k = known.select(*[F.col(c).alias(f"k_{c}") for c in [*keys, "starttime", "endtime"]])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys])
    near = (F.abs(F.col("starttime") - F.col("k_starttime")) < tolerance) & (F.abs(F.col("endtime") - F.col("k_endtime")) < tolerance)
    return rows.join(k, same & near, "left_anti")
