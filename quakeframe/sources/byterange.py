"""Samples as byte ranges of files: a task seeks and reads what its headers name, and no more.

``save_records`` streams the samples of each file from sorted rows and leaves a header table with
offsets. The data source ``byteranges`` plans its partitions from that table's Parquet footers: row groups
that the filters exclude are left out, the others are cut so that a partition names at most
``maxbytes`` of samples. A task reads its headers, joins neighbouring ranges to runs, opens each
file once and reads the runs. ``read_samples`` does the same for headers that are a DataFrame.
Files are reached through Arrow's file systems, so that a root may be a path or a URI of any of
these. Files that no header names are never opened.

Defined results: a range that is not there (no file, or too short), is null, negative or no whole number of
samples has null samples; a row that is read by ``read_records`` or ``read_samples`` dies then, with a log entry.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quakeframe.state import LIVE, kill_if, with_state

#: Ranges this near are read together, in runs of at most so many bytes.
NEAR, RUN = 1 << 16, 1 << 23
#: Samples of a partition, in bytes.
MOST = 1 << 26
FILTERS = {EqualTo: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
TESTS = {
    "==": pc.equal, ">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal,
    "in": lambda column, values: pc.is_in(column, pa.array(list(values), column.type)),
}
#: Whether values from a to z can pass.
POSSIBLE = {
    "==": lambda a, z, v: a <= v <= z, ">": lambda a, z, v: z > v, ">=": lambda a, z, v: z >= v, "<": lambda a, z, v: a < v, "<=": lambda a, z, v: a <= v,
    "in": lambda a, z, v: any(a <= x <= z for x in v),
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def ranges_read(system: fs.FileSystem, root: str, wanted: Sequence[tuple[str, int, int]]) -> Iterator[bytes | None]:
    """The bytes of each (file, offset, length), in order; ``wanted`` is sorted. None where they are not there."""
    name, handle, size, at = None, None, -1, 0
    while at < len(wanted):
        file, offset, length = wanted[at]
        if file != name:
            if handle:
                handle.close()
            name, info = file, system.get_file_info(f"{root}/{file}")
            handle, size = (system.open_input_file(info.path), info.size) if info.type == fs.FileType.File else (None, -1)
        if offset < 0 or length < 0 or offset + length > size:
            yield None
            at += 1
            continue
        last, end = at + 1, offset + length
        while last < len(wanted) and wanted[last][0] == file and wanted[last][1] <= end + NEAR and size >= wanted[last][1] + wanted[last][2] and wanted[last][2] >= 0 and max(end, wanted[last][1] + wanted[last][2]) - offset <= RUN:
            end = max(end, wanted[last][1] + wanted[last][2])
            last += 1
        content = handle.read_at(end - offset, offset)
        for _, o, n in wanted[at:last]:
            yield content[o - offset : o - offset + n]
        at = last
    if handle:
        handle.close()


def with_samples(rows: pa.Table, system: fs.FileSystem, root: str, dtype: str) -> Iterator[pa.RecordBatch]:
    """``rows`` (dir, dfile, foff, nbytes and more) with ``data``, in the order of their places."""
    places = [
        (f"{d.strip('/')}/{f}" if d else f or "", -1 if o is None or n is None or n % np.dtype(dtype).itemsize else o, n or 0)
        for d, f, o, n in zip(*(rows.column(c).to_pylist() for c in ("dir", "dfile", "foff", "nbytes")), strict=True)
    ]
    order = sorted(range(len(places)), key=places.__getitem__)
    held, first, total = [], 0, 0
    for k, content in enumerate(ranges_read(system, root, [places[i] for i in order])):
        held.append(content)
        total += len(content or b"")
        if total >= RUN or k + 1 == len(order):
            valid = pa.array([c is not None for c in held])
            ends = np.cumsum([0, *(len(c or b"") // np.dtype(dtype).itemsize for c in held)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(c or b"" for c in held), dtype).astype(float))
            offsets = pa.array(ends, pa.int32(), mask=np.r_[~valid.to_numpy(zero_copy_only=False), False])
            part = rows.take(order[first : k + 1]).combine_chunks()
            batch = part.append_column("data", pa.ListArray.from_arrays(offsets, values))
            yield from batch.to_batches()
            held, first, total = [], k + 1, 0


@dataclass
class Slice(InputPartition):
    """Rows of a row group of the header table."""

    path: str
    group: int
    start: int
    rows: int


class ByteRangeReader(DataSourceReader):
    def __init__(self, options):
        self.header, self.root, self.dtype = options["header"], options["root"], options.get("dtype", "<f8")
        self.most = int(options.get("maxbytes", MOST))
        self.tests = [(c, op, v) for c, op, v in json.loads(options.get("where", "[]"))]

    def partitions(self):
        system, path = opened(self.header)
        out = []
        for info in header_files(system, path):
            meta = pq.read_metadata(info.path, filesystem=system)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                stats = {group.column(c).path_in_schema: group.column(c).statistics for c in range(group.num_columns)}
                if any(c in stats and stats[c] is not None and stats[c].has_min_max and not POSSIBLE[op](stats[c].min, stats[c].max, v) for c, op, v in self.tests):
                    continue
                largest = stats["nbytes"].max if stats.get("nbytes") is not None and stats["nbytes"].has_min_max else self.most
                step = max(1, self.most // max(1, largest))
                out += [Slice(info.path, g, a, min(step, group.num_rows - a)) for a in range(0, group.num_rows, step)]
        return out or [Slice("", 0, 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        system, _ = opened(self.header)
        rows = pq.ParquetFile(system.open_input_file(partition.path)).read_row_group(partition.group).slice(partition.start, partition.rows)
        for c, op, v in self.tests:
            rows = rows.filter(TESTS[op](rows.column(c), v))
        yield from with_samples(rows, *opened(self.root), self.dtype)


class FilteringReader(ByteRangeReader):
    """For sessions that push filters; Spark refuses this method in the others."""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if type(f) in FILTERS and len(f.attribute) == 1 and f.attribute[0] != "data":
                self.tests.append((f.attribute[0], FILTERS[type(f)], f.value))
            else:
                yield f


def header_files(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
    return sorted((i for i in found if i.type == fs.FileType.File and i.base_name.endswith(".parquet")), key=lambda i: i.path)


class ByteRanges(DataSource):
    """Options: header (a Parquet table with dir, dfile, foff, nbytes), root, dtype, maxbytes, where
    (JSON list of [column, operator, value]), push (true if the session pushes filters)."""

    @classmethod
    def name(cls):
        return "byteranges"

    def schema(self):
        system, path = opened(self.options["header"])
        files = header_files(system, path)
        if not files:
            raise ValueError(f"no header table at {path}")
        return StructType([*from_arrow_schema(pq.read_schema(files[0].path, filesystem=system)).fields, StructField("data", ArrayType(DoubleType()))])

    def reader(self, schema):
        return (FilteringReader if self.options.get("push") == "true" else ByteRangeReader)(self.options)


def checked(df: DataFrame) -> DataFrame:
    """Rows without samples die."""
    marked = kill_if(with_state(df), F.col("data").isNull(), "read_samples", "the samples are not there")
    return marked.withColumn("data", F.coalesce("data", F.array().cast("array<double>")))


def read_records(spark: SparkSession, header: str, root: str, dtype: str = "<f8", most_bytes: int = MOST, where: Sequence[tuple] = ()) -> DataFrame:
    """The rows of a header table with their samples. ``where`` ((column, operator, value), ...) prunes
    row groups and rows before any sample is read; so do filters, if the session pushes them to
    Python sources (``spark.sql.python.filterPushdown.enabled``)."""
    spark.dataSource.register(ByteRanges)
    options = {"header": header, "root": root, "dtype": dtype, "maxbytes": str(most_bytes), "where": json.dumps(list(where)), "push": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    return checked(spark.read.format("byteranges").options(**options).load())


def read_samples(df: DataFrame, root: str, dtype: str = "<f8", most_bytes: int = MOST) -> DataFrame:
    """``data`` of each live row from ``root/dir/dfile``: ``npts`` samples (or ``nbytes`` bytes) from ``foff``.

    The distinct ranges are dealt by file and stretch of ``most_bytes``, so that a long file is read by
    many tasks and each reads what it needs; rows get their samples by place."""
    clean = with_state(df.drop("data")).withColumn("dir", F.regexp_replace("dir", "^/+|/+$", ""))
    length = F.col("nbytes").cast("long") if "nbytes" in df.columns else F.col("npts").cast("long") * np.dtype(dtype).itemsize
    keys = ["dir", "dfile", "foff", "nbytes"]
    ranges = clean.filter(LIVE).select("dir", "dfile", F.col("foff").cast("long").alias("foff"), length.alias("nbytes")).dropna().distinct()
    total = ranges.agg(F.sum(F.greatest("nbytes", F.lit(0)))).first()[0] or 0
    stretch = F.floor(F.col("foff") / most_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            yield from with_samples(pa.Table.from_batches([batch]), system, base, dtype)

    dealt = ranges.repartition(int(1 + total // most_bytes), "dir", "dfile", stretch).sortWithinPartitions(*keys)
    samples = dealt.mapInArrow(run, "dir string, dfile string, foff long, nbytes long, data array<double>").select(*[F.col(k).alias(f"qf_{k}") for k in keys], "data")
    same = F.col(LIVE) & (F.col("dir") == F.col("qf_dir")) & (F.col("dfile") == F.col("qf_dfile")) & (F.col("foff") == F.col("qf_foff")) & (length == F.col("qf_nbytes"))
    return checked(clean.join(samples, same, "left").drop(*[f"qf_{k}" for k in keys]))


def save_records(df: DataFrame, root: str, header: str, order: Sequence[str], data: str = "data", dtype: str = "<f8") -> None:
    """Write the live rows' samples to ``root/dir/dfile``, in the given order, and their headers with ``foff``
    and ``nbytes`` to a Parquet table. A task streams one file after another; a file appears whole or not
    at all, and a task that runs twice writes the same."""
    live = with_state(df).filter(LIVE)
    names = [c for c in live.columns if c != data]
    kind = StructType([live.schema[c] for c in names] + StructType.fromDDL("foff long, nbytes long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        name, stream, place, at = None, None, "", 0

        def done():
            if stream:
                stream.close()
                system.move(place, f"{base}/{name}")

        for batch in batches:
            offsets, sizes = [], []
            for d, f, x in zip(batch.column("dir").to_pylist(), batch.column("dfile").to_pylist(), batch.column(data), strict=True):
                file = f"{(d or '').strip('/')}/{f}".lstrip("/")
                if file != name:
                    done()
                    name, at = file, 0
                    folder = f"{base}/{file}".rpartition("/")[0]
                    system.create_dir(folder, recursive=True)
                    place = f"{folder}/.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(place)
                content = b"" if not x.is_valid else np.asarray(x.values.to_numpy(zero_copy_only=False)).astype(dtype).tobytes()
                stream.write(content)
                offsets.append(at)
                sizes.append(len(content))
                at += len(content)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64())], [*names, "foff", "nbytes"])
        done()

    sorted_rows = live.repartition("dir", "dfile").sortWithinPartitions("dir", "dfile", *order)
    sorted_rows.mapInArrow(run, kind).write.parquet(header)
