"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space became one space
(null counts as empty). Misra-Gries summaries of each partition, merged by digest, name the
candidates for frequent digests. One exact pass counts those; the verified winners, at most
``counters`` rows, are broadcast, and their rows never meet in a shuffle. The remaining digests,
each below about ``2 / counters`` of the rows, are grouped by an ordinary shuffle of
(doc_id, digest) rows. Texts themselves are never shuffled here.

Defined results: null text equals the empty text; an empty table gives an empty result; of rows
that repeat doc_id and text exactly one is kept; a null doc_id counts as the largest; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import WHITE_SPACE, checkpointed, table
from quakeframe.llm.rows import drop_marked, id_bytes, marks


def digest(text):
    """SHA-256 (binary) of the text with each run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ").cast("binary"), 256))


def place() -> Column:
    """The order of rows with equal texts: by doc_id, null ones last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """The summary of a partition: digests with an undercount of at most 2 n / (counters + 1)."""
    held: dict[bytes, int] = {}
    n = 0
    for batch in batches:
        for value in batch.column(0).to_pylist():
            n += 1
            if value in held:
                held[value] += 1
            elif len(held) < counters:
                held[value] = 1
            else:
                held = {k: c - 1 for k, c in held.items() if c > 1}
    kept = [(k, c) for k, c in held.items() if c > n / (counters + 1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in kept], pa.binary()), pa.array([c for _, c in kept], pa.int64())], ["digest", "seen"]
    )


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """Verified heavy digests with their exact count and first row: at most ``counters`` rows."""
    summaries = digests.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, seen long")
    candidates = summaries.groupBy("digest").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "digest").limit(counters)
    return (
        digests.join(F.broadcast(candidates.select("digest")), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(place()).alias("first"))
        .filter("group_size > 1")
    )


def exact_groups(documents: DataFrame, counters: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``documents``."""
    digests = checkpointed(
        documents.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("digest"))
    )
    heavy = checkpointed(frequent(digests, counters))
    from_heavy = digests.join(F.broadcast(heavy), "digest")
    group = Window.partitionBy("digest")
    from_rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "digest",
        "doc_id",
        "row",
        F.count("*").over(group).alias("group_size"),
        F.min(place()).over(group).alias("first"),
    )
    return from_heavy.select(*from_rest.columns).unionByName(from_rest).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(documents: DataFrame, counters: int = 4096) -> DataFrame:
    """``documents`` with one row of each group of equal texts, in their own columns. Texts are not
    shuffled while few rows go; of rows that repeat id and text the one whose JSON has the smallest
    digest stays."""
    several = exact_groups(documents, counters).filter("group_size > 1")
    decided = several.select(F.concat(F.unhex("text_sha256"), id_bytes("doc_id")).alias("key"), "kept")
    return drop_marked(documents, F.concat(digest(F.col("text")), id_bytes("doc_id")), marks(decided))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
