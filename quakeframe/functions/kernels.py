"""Running numeric functions of one record over a table, in Arrow batches.

``map_records`` adapts f(record) -> dict to a DataFrame: dead rows pass by unseen, an error that is
not fatal becomes a log record and a kill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quakeframe.state import ELOG, LIVE, with_state


class Fatal(Exception):
    """An error that must end the job."""


def map_records(df: DataFrame, f: Callable[..., dict], inputs: list[str], outputs: dict[str, str], name: str | None = None) -> DataFrame:
    """``df`` with the columns of ``outputs`` (name: type) from ``f(*inputs)``; arrays come as numpy
    arrays. A missing input kills. Only the inputs and the state go through Python."""
    name = name or getattr(f, "__name__", "kernel")
    df = with_state(df)
    kept = [c for c in df.columns if c not in outputs and c not in (LIVE, ELOG)]
    types = {k: _parse_datatype_string(v) for k, v in outputs.items()}
    schema = StructType([*[df.schema[c] for c in kept], *[StructField(k, t) for k, t in types.items()], df.schema[LIVE], df.schema[ELOG]])
    arrow = {}
    from pyspark.sql.pandas.types import to_arrow_type

    for k, t in types.items():
        arrow[k] = to_arrow_type(t)
    elog_type = to_arrow_type(df.schema[ELOG].dataType)
    before = [c for c in outputs if c in df.columns]
    order = list(dict.fromkeys([*kept, *before, *inputs, LIVE, ELOG]))
    at = {c: i for i, c in enumerate(order)}

    def record(value):
        if value is None:
            return None
        return np.array(value, float) if isinstance(value, list) and (not value or not isinstance(value[0], (list, dict, str))) else np.array([np.array(v, float) for v in value]) if isinstance(value, list) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {c: b.column(at[c]).to_pylist() for c in dict.fromkeys([*inputs, *before, LIVE, ELOG])}
            results = {k: [] for k in outputs}
            live, logs = [], []
            for i in range(b.num_rows):
                alive, log = columns[LIVE][i], columns[ELOG][i] or []
                out = {k: columns[k][i] if k in columns else None for k in outputs}
                if alive:
                    try:
                        args = [record(columns[c][i]) for c in inputs]
                        if any(a is None for a in args):
                            raise ValueError(f"missing {', '.join(c for c, a in zip(inputs, args, strict=True) if a is None)}")
                        out |= f(*args)
                    except Fatal:
                        raise
                    except Exception as e:
                        alive, log = False, [*log, {"algorithm": name, "badness": "Invalid", "message": str(e)}]
                for k in outputs:
                    results[k].append(plain(out[k]))
                live.append(alive)
                logs.append(log)
            yield pa.RecordBatch.from_arrays(
                [b.column(at[c]) for c in kept] + [pa.array(results[k], arrow[k]) for k in outputs] + [pa.array(live, pa.bool_()), pa.array(logs, elog_type)],
                [*kept, *outputs, LIVE, ELOG],
            )

    return df.select(*[F.col(c) for c in order]).mapInArrow(run, schema)


def plain(value):
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def reduce_groups(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], keys: list[str], order: list[str], data: str = "data", name: str | None = None) -> DataFrame:
    """One row a group: the live members' samples reduced by f(left, right) in order (nulls last). An
    error, or a member without samples, kills the group's result and is logged; the members behind it
    are counted only. Members stream by, sorted by the shuffle: a task holds one pair, not the group."""
    name = name or getattr(f, "__name__", "reduce")
    live = with_state(df).filter(LIVE)
    schema = StructType(
        [*[live.schema[k] for k in keys], *_parse_datatype_string(f"{data} array<double>, n_members long, {LIVE} boolean, {ELOG} array<struct<algorithm:string,badness:string,message:string>>")]
    )
    log_type = pa.list_(pa.struct([("algorithm", pa.string()), ("badness", pa.string()), ("message", pa.string())]))

    class Open:
        """The group that members are being added to."""

        def __init__(self, head: pa.RecordBatch):
            self.head, self.total, self.n, self.error = head, None, 0, None

        def add(self, samples) -> None:
            self.n += 1
            if self.error is not None:
                return
            try:
                if not samples.is_valid:
                    raise ValueError(f"missing {data}")
                x = np.array(samples.values.to_numpy(zero_copy_only=False), float)
                self.total = x if self.n == 1 else f(self.total, x)
            except Fatal:
                raise
            except Exception as e:
                self.error = str(e)

    def rows(done: list[Open]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([g.head.column(i) for g in done]) for i in range(len(keys))]
        totals = pa.array([None if g.total is None else np.asarray(g.total, float) for g in done], pa.list_(pa.float64()))
        logs = pa.array([[] if g.error is None else [{"algorithm": name, "badness": "Invalid", "message": g.error}] for g in done], log_type)
        states = [pa.array([g.n for g in done], pa.int64()), pa.array([g.error is None for g in done], pa.bool_())]
        return pa.RecordBatch.from_arrays([*columns, totals, *states, logs], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, done = None, None, []
        for batch in batches:
            heads = batch.select(list(range(len(keys))))
            named = [repr(h) for h in zip(*[c.to_pylist() for c in heads.columns], strict=True)]
            for i, own in enumerate(named):
                if group is None or own != key:
                    if group is not None:
                        done.append(group)
                    group, key = Open(heads.slice(i, 1)), own
                group.add(batch.column(len(keys))[i])
            if done:
                yield rows(done)
                done = []
        if group is not None:
            yield rows([group])

    sides = [F.col(k) for k in keys]
    ordered = live.repartition(*sides).sortWithinPartitions(*sides, *[F.asc_nulls_last(c) for c in order])
    return ordered.select(*sides, F.col(data).cast("array<double>").alias(data)).mapInArrow(run, schema)


def common_sum(a: np.ndarray, b: np.ndarray, lag: int = 0) -> np.ndarray:
    """a with b added where they overlap; b starts ``lag`` samples after a, whose grid stays."""
    out = a.copy()
    i0, i1 = max(lag, 0), min(lag + len(b), len(a))
    if i1 > i0:
        out[i0:i1] += b[i0 - lag : i1 - lag]
    return out
