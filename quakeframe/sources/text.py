"""Text sources and sinks: delimited files, white-space tables, fixed-width tables, parameter files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def imported(df: DataFrame, types: Mapping[str, str] | None = None, use: Sequence[str] | None = None, one_to_one: bool = False, rename: Mapping[str, str] | None = None, constants: Mapping[str, object] | None = None, nulls: Mapping[str, object] | None = None) -> DataFrame:
    """The steps of an import, in their order: cast, null sentinels, project, drop repeated rows
    (unless ``one_to_one``), rename, constants."""
    for c, kind in (types or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(kind))
    for c, sentinel in (nulls or {}).items():
        df = df.withColumn(c, F.when(F.col(c) != F.lit(sentinel), F.col(c)))
    if use is not None:
        df = df.select(*use)
    if not one_to_one:
        df = df.dropDuplicates()
    df = df.withColumnsRenamed(dict(rename or {}))
    return df.withColumns({k: F.lit(v) for k, v in (constants or {}).items()}) if constants else df


def read_delimited(spark: SparkSession, path: str, names: Sequence[str] | None = None, separator: str = ",", header: bool = True, **steps) -> DataFrame:
    """A delimited file; columns are text until the import casts them."""
    df = spark.read.csv(path, sep=separator, header=header, inferSchema=False)
    return imported(df.toDF(*names) if names else df, **steps)


def read_whitespace_table(spark: SparkSession, path: str, names: Sequence[str], **steps) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    df = spark.read.text(path).filter(F.trim("value") != "")
    return imported(df.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]), **steps)


@dataclass(frozen=True)
class FixedColumn:
    name: str
    width: int
    offset: int
    type: str = "string"
    null: object = None
    format: str | None = None


def read_fixed_width(spark: SparkSession, path: str, columns: Sequence[FixedColumn], use: Sequence[str] | None = None, keep_nulls: bool = False) -> DataFrame:
    """A fixed-width table; null sentinels become nulls unless kept."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    out = []
    for c in columns:
        if use is None or c.name in use:
            v = F.trim(F.substring("value", c.offset + 1, c.width))
            v = v if c.type == "string" else v.try_cast(c.type)
            out.append((v if keep_nulls or c.null is None else F.when(v != F.lit(c.null), v)).alias(c.name))
    return lines.select(*out)


def fixed_width_lines(df: DataFrame, columns: Sequence[FixedColumn]) -> DataFrame:
    """Lines of a fixed-width table; columns that it lacks, and nulls, are written as the sentinel. A value
    that is wider than its column raises: cut, it would be read as another one."""
    cells = []
    for c in columns:
        v = F.col(c.name) if c.name in df.columns else F.lit(None)
        if c.null is not None:
            v = F.coalesce(v.cast(c.type), F.lit(c.null).cast(c.type))
        fmt = c.format or {"string": f"%-{c.width}s", "long": f"%{c.width}d", "int": f"%{c.width}d"}.get(c.type, f"%{c.width}.3f")
        cell = F.format_string(fmt, v)
        wide = F.raise_error(F.concat(F.lit(f"{c.name} is wider than {c.width}: "), cell)).cast("string")
        cells.append(F.when(F.length(F.rtrim(cell)) > c.width, wide).otherwise(F.substring(cell, 1, c.width)))
    return df.select(F.rtrim(F.concat_ws(" ", *cells)).alias("value"))


def parse_layout(text: str) -> tuple[FixedColumn, ...]:
    """A layout of lines ``name width offset type null``."""
    out = []
    for line in text.strip().splitlines():
        name, width, offset, kind, null = line.split()
        kind = {"int": "long", "float": "double"}.get(kind, kind)
        out.append(FixedColumn(name, int(width), int(offset), kind, null if kind == "string" else float(null) if kind == "double" else int(null)))
    return tuple(out)


def parse_parameters(text: str) -> dict:
    """A parameter file as nested dicts: ``key value`` lines, ``key &Tbl{`` lists of lines and
    ``key &Arr{`` tables of keys, closed by ``}``; # starts a comment. Numbers and booleans are typed."""
    lines = iter([x for x in (line.split("#")[0].rstrip() for line in text.splitlines()) if x.strip()])

    def scalar(v: str):
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(v.lower(), v)

    def block(listed: bool):
        out: dict | list = [] if listed else {}
        for line in lines:
            s = line.strip()
            if s == "}":
                return out
            key, _, value = s.partition(" ")
            value = value.strip()
            if value in ("&Tbl{", "&Arr{"):
                out[key] = block(value == "&Tbl{")
            elif listed:
                out.append(s)
            else:
                out[key] = scalar(value)
        return out

    return block(False)


def saved(df: DataFrame, null_values: Mapping[str, object] | None = None, one_to_one: bool = False) -> DataFrame:
    """What ``save`` writes: repeated rows dropped unless ``one_to_one``, sentinels as nulls."""
    return imported(df, nulls=null_values, one_to_one=one_to_one)


def catalog_chain(event: DataFrame, origin: DataFrame, assoc: DataFrame, arrival: DataFrame, how: str = "right") -> DataFrame:
    """event, origin, assoc and arrival on evid, orid and arid; right joins by default."""
    from quakeframe.operators.match import table_join

    out = table_join(event, origin, ["evid"], how, "_origin")
    out = table_join(out, assoc, ["orid"], how, "_assoc")
    return table_join(out, arrival, ["arid"], how, "_arrival")


def waveform_rows(wfdisc: DataFrame, stations: DataFrame | None = None, default_net: str | None = None, datatypes: Sequence[str] = ("sd", "S1")) -> DataFrame:
    """Waveform rows of an index: supported data types only, net and sta by a station map, chan and
    location code split at the underscore."""
    df = wfdisc.filter(F.col("datatype").isin(*datatypes))
    parts = F.split("chan", "_")
    df = df.withColumns({"chan": F.get(parts, F.lit(0)), "loc": F.get(parts, F.lit(1))})
    if stations is not None:
        m = stations.select(F.col("fsta").alias("qf_f"), F.col("snet").alias("qf_n"), F.col("sta").alias("qf_s"))
        df = df.join(m, F.col("sta") == F.col("qf_f"), "left")
        df = df.withColumns({"net": F.coalesce("qf_n", F.lit(default_net)), "sta": F.coalesce("qf_s", "sta")}).drop("qf_f", "qf_n", "qf_s")
    else:
        df = df.withColumn("net", F.lit(default_net).cast("string"))
    return df
