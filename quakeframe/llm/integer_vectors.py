"""Vectors of integers: scaled components, floored, and exact products of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integer_rows(column: pa.Array, width: int, scale: int, hold: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors of ``width`` finite components, and the mask of their rows.
    Results beyond plus or minus ``hold`` are held at it."""
    taken = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    bare = column.filter(pa.array(taken)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(int(taken.sum()), width)
    finite = np.isfinite(bare).all(1)
    taken[taken] = finite
    with np.errstate(over="ignore"):
        return np.clip(np.floor(bare[finite] * scale), -hold, hold).astype(np.int32), taken


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integer matrices, exact: in floating point where all sums fit its mantissa."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1]
    if bound < 2.0**53:
        return (x.astype(float) @ y.astype(float).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T
