"""A hierarchy of time cells, that turns "this time lies in that interval" into an equality join.

Time is cut into ticks of ``unit``, sixteen ticks make a cell of the next level, and so on up to
``TOP``. An interval is covered by the fewest whole cells (at most 30 a level), a time lies in one cell
of each level; a time inside the interval shares exactly one cell with the cover. So whatever the
lengths, a pair meets once, and a key with very many intervals is spread over its cells. Cells only
find candidates: the caller's own condition, with its open or closed ends, decides.

An interval of more than ``MANY`` top cells (4,000 years at one second) is covered by one cell of
everything, in which every time lies too. Nulls and intervals that end before they start are in no
cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from heapq import heappop, heappush
from math import inf, nextafter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

BITS, TOP, MANY = 4, 7, 512
EVERYWHERE = TOP + 1
#: Ticks are held at plus or minus this number.
FAR = float(1 << 43)


def tick(time: Column, unit: float) -> Column:
    return F.floor(F.greatest(F.least(time.cast("double") / unit, F.lit(FAR)), F.lit(-FAR))).cast("long")


def point_cells(time: Column, unit: float = 1.0) -> Column:
    """The cells of a time, one a level."""
    t = tick(time, unit)
    cells = F.array(*[F.shiftright(t, BITS * level) * 16 + level for level in range(TOP + 1)], F.lit(EVERYWHERE).cast("long"))
    return F.when(time.isNotNull(), cells).otherwise(F.array().cast("array<bigint>"))


def interval_cells(start: Column, end: Column, unit: float = 1.0) -> Column:
    """The cells that cover a closed interval."""
    low, past = tick(start, unit), tick(end, unit) + 1
    first = [-F.shiftright(-low, BITS * level) for level in range(TOP + 1)]  # whole cells of a level: from first
    after = [F.shiftright(past, BITS * level) for level in range(TOP + 1)]  # to before after
    none = F.array().cast("array<bigint>")

    def run(a: Column, b: Column, level: int) -> Column:
        # held to MANY: Spark folds constants in branches that are not taken, too
        return F.when(b > a, F.transform(F.sequence(a, F.least(b - 1, a + MANY)), lambda c: c * 16 + level)).otherwise(none)

    levels = []
    for level in range(TOP):
        a, b = first[level], after[level]
        inner = first[level + 1] < after[level + 1]  # the rest is covered by cells of the next level
        levels.append(F.when(inner, F.concat(run(a, first[level + 1] * 16, level), run(after[level + 1] * 16, b, level))).otherwise(run(a, b, level)))
    levels.append(run(first[TOP], after[TOP], TOP))
    everywhere = F.array(F.lit(EVERYWHERE).cast("long"))
    return F.when(after[TOP] - first[TOP] > MANY, everywhere).when((past > low) & start.isNotNull() & end.isNotNull(), F.concat(*levels)).otherwise(none)


class Sweep:
    """Closed intervals (by start) as pieces of time that do not meet: (start, end, least rank, number of intervals).
    Held are the open intervals only."""

    def __init__(self):
        self.ends: list[float] = []
        self.ranks: list[tuple] = []
        self.at = -inf

    def until(self, t: float, last: bool = False) -> Iterator[tuple]:
        """The pieces before a time; with ``last`` all."""
        while self.ends and (last or self.ends[0] < t):
            end = self.ends[0]
            yield self._piece(end)
            while self.ends and self.ends[0] == end:
                heappop(self.ends)
            self.at = nextafter(end, inf)
        if self.ends and self.at < t:
            yield self._piece(nextafter(t, -inf))

    def _piece(self, end: float) -> tuple:
        while self.ranks[0][1] < self.at:
            heappop(self.ranks)
        return self.at, end, self.ranks[0][0], len(self.ends)

    def add(self, start: float, end: float, rank) -> Iterator[tuple]:
        yield from self.until(start)
        if not self.ends:
            self.ranks = []
        heappush(self.ends, end)
        heappush(self.ranks, (rank, end))
        self.at = start


class _Edge:
    """Sorts before (or after) all else."""

    def __init__(self, last: bool):
        self.last = last

    def __lt__(self, other) -> bool:
        return not self.last and other is not self

    def __gt__(self, other) -> bool:
        return self.last and other is not self


FIRST, LAST = _Edge(False), _Edge(True)


def _sorting(value):
    """Python compares this as Spark does the value: nulls first, NaN last."""
    if isinstance(value, list | dict):
        return [_sorting(v) for v in (value if isinstance(value, list) else value.values())]
    if isinstance(value, datetime) and value.tzinfo:  # of one zone Python compares what clocks show
        return value.astimezone(UTC)
    return FIRST if value is None else LAST if value != value else value


def _listed(column: pa.Array) -> tuple[list, list]:
    """The values of a column (times as numbers), and what they sort by."""
    column = column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column
    floats, nested = pa.types.is_floating(column.type), pa.types.is_nested(column.type)
    plain = column.null_count == 0 and (floats or pa.types.is_integer(column.type))
    values = column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()
    return values, [_sorting(v) for v in values] if column.null_count or floats or nested else values


def pieces(df: DataFrame, keys: Sequence[str], start: str, end: str, rank: Sequence[str]) -> DataFrame:
    """``Sweep`` for each key: keys, qf_t, qf_z, the columns ``rank`` (of any types that Spark sorts) of the first, qf_m; at
    most two rows an interval whatever they overlap. Intervals stream through their key's task in the order of their
    starts; nothing is numbered."""
    own, order = list(keys), list(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sweep, n, kinds = None, Sweep(), 0, {}

        def made(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(out), 10_000):
                columns = zip(*((*k, t, z, *r[2], m) for k, (t, z, r, m) in out[i : i + 10_000]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            out, told = [], {c: _listed(b.column(c)) for c in (*own, start, end, *order)}
            kinds = {c: b.column(c).type for c in own} | {"qf_t": pa.float64(), "qf_z": pa.float64()} | {c: b.column(c).type for c in order} | {"qf_m": pa.int64()}
            ranks = zip(zip(*(told[c][1] for c in order), strict=True), zip(*(told[c][0] for c in order), strict=True), strict=True)
            for k, a, z, (first, values) in zip(zip(*(told[c][0] for c in own), strict=True), told[start][0], told[end][0], ranks, strict=True):
                if k != key:
                    out += [(key, p) for p in sweep.until(inf, True)]
                    key, sweep = k, Sweep()
                n += 1
                out += [(k, p) for p in sweep.add(a, z, (first, n, values))]
            yield from made(out)
        yield from made([(key, p) for p in sweep.until(inf, True)])

    ends = {start: F.col(start).cast("double"), end: F.nanvl(F.col(end).cast("double"), F.lit(inf))}
    rows = df.select(*own, *[c.alias(name) for name, c in ends.items()], *order)
    rows = rows.filter(~F.isnan(start) & (F.col(start) <= F.col(end))).dropna(subset=[*own, start, end]).sortWithinPartitions(*own, start)
    named = {f.name: f for f in rows.schema.fields}
    made = [StructField("qf_t", DoubleType()), StructField("qf_z", DoubleType()), *[named[c] for c in order], StructField("qf_m", LongType())]
    return rows.mapInArrow(run, StructType([*[named[c] for c in own], *made]))
