"""What the operators share: reading tables, cutting lineage, model shipping, samples."""

from __future__ import annotations

import tempfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regular expression for a run of the six ASCII white-space characters.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: A side of a join with at most so many (short) rows is broadcast.
SMALL = 250_000
#: Short rows of a partition.
PACK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the reliable folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may do without it (a
    test): there a folder is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``df``, checkpointed; then the files go that nothing needs any more. Spark deletes shuffles and checkpoints
    only after the driver's JVM has collected what stood for them, which it does when its heap is full; until
    then a job of many rounds holds the files of all of them."""
    df = checkpointed(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def packed(df: DataFrame, rows: int = PACK) -> DataFrame:
    """``df`` (short rows), ``released``, in partitions of about ``rows`` rows, of which there are no more than
    before: what reads it again and again does not start a task, and write files, for each of many almost
    empty ones."""
    df = released(df)
    most, wanted = df.rdd.getNumPartitions(), -(-df.count() // rows)
    return df.coalesce(max(1, wanted)) if wanted < most else df


def text_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, with the session's Arrow batches held to so many rows: texts have no bound on their
    length, and a batch is held several times over on its way to Python and back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def digest_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: the fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def fold_of(key: int, modulus: int) -> int:
    """The same fold in Python, for tests."""
    return zlib.crc32(str(key).encode()) % modulus


def hash_fraction(key: Column, seed: int) -> Column:
    """A seeded uniform number in [0, 1) for each key; the same on every run and cluster."""
    return (F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def bounded_sample(rows: DataFrame, group: str, key: str, per_group: int, seed: int, most: int = 1000) -> DataFrame:
    """About ``per_group`` rows of each group, the ones with the smallest seeded hash of ``key``.

    The bound is ``1.25 * per_group * most`` rows in expectation, whatever the input's size and the
    number of groups: of more than ``most`` groups each gives its share of that. Group sizes are
    counted over all rows; ``rows`` with a null group are left out. No task gets a whole group.
    """
    known = rows.filter(F.col(group).isNotNull())
    counted = checkpointed(known.groupBy(F.col(group).alias("qf_group")).agg(F.count("*").alias("qf_rows")))
    groups = counted.count()
    share = 1.25 * per_group * min(1.0, most / max(groups, 1))
    side = F.broadcast(counted) if groups <= SMALL else counted
    chosen = known.join(side, F.col(group) == F.col("qf_group")).filter(hash_fraction(F.col(key), seed) < F.lit(share) / F.col("qf_rows"))
    return chosen.select(*[F.col(f"`{c}`") for c in rows.columns])


_model: dict[tuple, object] = {}


def worker_model(key: tuple, make):
    """The model of a worker process, built on first use. One is held at a time, so that a worker
    that serves several stages does not gather the models of all."""
    if key not in _model:
        _model.clear()
        _model[key] = make()
    return _model[key]
