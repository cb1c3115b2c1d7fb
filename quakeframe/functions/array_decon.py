"""Deconvolution of all members of an ensemble by the ensemble's own wavelet and noise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.decon import colored_noise
from quakeframe.functions.kernels import map_records


def deconvolve_members(df: DataFrame, beams: DataFrame, keys: Sequence[str], damping: float = 1.0, shape: str = "ricker", value: float = 1.0) -> DataFrame:
    """``df`` (data: array of components) with the data deconvolved by the ``wavelet`` and
    ``noise_power`` of its ensemble in ``beams`` (one row an ensemble; of repeated ones the smallest
    by value counts, on every run). Members of ensembles without them die."""
    own = beams.groupBy(*keys).agg(F.min(F.struct("wavelet", "noise_power")).alias("b")).select(*keys, "b.*")

    def deconvolve(data, wavelet, noise_power, dt):
        return {"data": colored_noise(data, wavelet, noise_power, dt, damping, shape, value)}

    out = map_records(df.join(own, list(keys), "left"), deconvolve, ["data", "wavelet", "noise_power", "dt"], {"data": "array<array<double>>"})
    return out.drop("wavelet", "noise_power")
