"""Verification and repair of tables: links, required attributes, types, renames, deletions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.schema import TableSchema


def check_links(df: DataFrame, key: str, parent: DataFrame, parent_key: str = "_id", limit: int | None = None) -> DataFrame:
    """Rows whose ``key`` is missing (``missing``) or names no parent (``bad``), in column problem.
    ``limit`` bounds the report, as a feature of it."""
    known = parent.select(F.col(parent_key).alias("qf_p")).distinct()
    bad = df.filter(F.col(key).isNotNull()).join(known, F.col(key) == F.col("qf_p"), "left_anti").withColumn("problem", F.lit("bad"))
    none = df.filter(F.col(key).isNull()).withColumn("problem", F.lit("missing"))
    out = bad.unionByName(none)
    return out.limit(limit) if limit else out


def check_required(df: DataFrame, schema: TableSchema, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows with arrays of required attributes that are undefined or of a wrong type."""
    keys = list(keys if keys is not None else schema.required_keys())
    gone = [F.when(F.col(k).isNull() if k in df.columns else F.lit(True), F.lit(k)) for k in keys]
    wrong = [F.when(F.col(k).isNotNull() & F.col(k).try_cast(schema.type(k)).isNull(), F.lit(k)) for k in keys if k in df.columns]
    return df.withColumns({"undefined_keys": _named(gone), "wrong_keys": _named(wrong)}).filter("size(undefined_keys) + size(wrong_keys) > 0")


def check_types(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows with the attributes whose text is not of the schema's type."""
    wrong = [F.when(F.col(k).isNotNull() & F.col(k).try_cast(schema.type(k)).isNull(), F.lit(k)) for k in schema.keys() if k in df.columns]
    return df.withColumn("wrong_keys", _named(wrong)).filter("size(wrong_keys) > 0")


def _named(parts):
    return F.filter(F.array(*parts, F.lit(None).cast("string")), lambda x: x.isNotNull())


def verify(df: DataFrame, schema: TableSchema, parents: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Each row with ``failures``: attribute -> tests that it fails (undefined, type, xref)."""
    parents = parents or {}
    marks = {}
    for k, parent in parents.items():
        known = parent.select(F.col("_id").alias(f"qf_{k}")).distinct()
        df = df.join(known, F.col(k) == F.col(f"qf_{k}"), "left")
        marks[k] = F.col(k).isNotNull() & F.col(f"qf_{k}").isNull()
    entries = []
    for k in schema.keys():
        tests = []
        if k not in df.columns:
            if k in schema.required_keys():
                tests.append(F.lit("undefined"))
        else:
            if k in schema.required_keys():
                tests.append(F.when(F.col(k).isNull(), F.lit("undefined")))
            tests.append(F.when(F.col(k).isNotNull() & F.col(k).try_cast(schema.type(k)).isNull(), F.lit("type")))
            if k in marks:
                tests.append(F.when(marks[k], F.lit("xref")))
        if tests:
            entries += [F.lit(k), _named(tests)]
    failures = F.map_filter(F.create_map(*entries), lambda _, v: F.size(v) > 0) if entries else F.create_map()
    return df.withColumn("failures", failures).drop(*[f"qf_{k}" for k in parents])


def fix_types(df: DataFrame, schema: TableSchema) -> tuple[DataFrame, DataFrame]:
    """Attributes cast to the schema's types (what cannot be cast becomes null), and for each the
    number of values that changed type and that were lost."""
    keys = [k for k in schema.keys() if k in df.columns]
    kinds = dict(df.dtypes)
    wrong = {k: kinds[k] not in (schema.type(k), {"long": "bigint"}.get(schema.type(k), schema.type(k))) for k in keys}
    counts = df.agg(
        *[F.sum((F.lit(wrong[k]) & F.col(k).try_cast(schema.type(k)).isNotNull()).cast("long")).alias(f"{k}_fixed") for k in keys],
        *[F.sum((F.col(k).isNotNull() & F.col(k).try_cast(schema.type(k)).isNull()).cast("long")).alias(f"{k}_lost") for k in keys],
    )
    return df.withColumns({k: F.col(k).try_cast(schema.type(k)) for k in keys}), counts


def delete_attributes(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Without the attributes; and how many rows had each."""
    there = [k for k in keys if k in df.columns]
    return df.drop(*there), _counts(df, there)


def rename_attributes(df: DataFrame, names: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Renamed; and how many rows had each."""
    there = {k: v for k, v in names.items() if k in df.columns}
    return df.withColumnsRenamed(there), _counts(df, list(there))


def _counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row with the number of rows that have each attribute; no columns without attributes."""
    return df.agg(*[F.count(k).alias(k) for k in keys]) if keys else df.sparkSession.range(1).select()


def clean(df: DataFrame, schema: TableSchema, parents: Mapping[str, DataFrame] | None = None, delete_undefined: bool = False, rename: Mapping[str, str] | None = None, required_xref: Sequence[str] = (), delete_missing_xref: bool = False, delete_missing_required: bool = False) -> tuple[DataFrame, DataFrame]:
    """Repair in order: renames and aliases, required attributes, links, types. Rows that cannot be
    repaired leave if so asked. Also the counts of ``fix_types``."""
    df = schema.clear_aliases(df.withColumnsRenamed(rename or {}))
    if delete_missing_required:
        for k in schema.required_keys():
            df = df.filter(F.col(k).isNotNull()) if k in df.columns else df.limit(0)
    for k in required_xref:
        if delete_missing_xref:
            df = df.filter(F.col(k).isNotNull())
        if parents and k in parents:
            df = df.join(parents[k].select(F.col("_id").alias("qf_p")).distinct(), F.col(k) == F.col("qf_p"), "left_semi")
    df, counts = fix_types(df, schema)
    if delete_undefined:
        df = df.select(*[c for c in df.columns if c in schema.attributes])
    return df, counts
