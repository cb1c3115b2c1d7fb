"""Rows told apart by their content, and tables without some of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import SMALL, checkpointed


def id_bytes(doc_id: str) -> Column:
    """A row's id as bytes; a null id is a value of its own."""
    return F.when(F.col(doc_id).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(doc_id).cast("string"))).cast("binary")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Bytes that tell rows apart by id and text (null counts as empty)."""
    return F.concat(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), id_bytes(doc_id))


def small_side(rows: DataFrame) -> DataFrame:
    """``rows``, computed, and broadcast in a join only if a count shows that they are few."""
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def marks(decided: DataFrame) -> DataFrame:
    """key and kept for the keys that lose a row, from ``decided`` (key, kept): one row a document."""
    sums = decided.groupBy("key").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    return sums.filter("NOT kept OR n > 1").select("key", "kept")


def drop_marked(documents: DataFrame, key: Column, marked: DataFrame) -> DataFrame:
    """``documents`` without the rows whose key is marked: with kept = false all of them, with
    kept = true all but the one whose JSON has the smallest digest. Whole rows are shuffled only if the
    marks are too many to broadcast; rows of one key are folded to one before they are."""
    side = small_side(marked)
    doc = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    joined = documents.select(doc, key.alias("key")).join(side, "key", "left")
    rest = joined.filter("kept IS NULL").select("doc.*")
    if side.filter("kept").isEmpty():
        return rest
    return rest.unionByName(joined.filter("kept").groupBy("key").agg(F.min_by("doc", F.sha2(F.to_json("doc"), 256)).alias("doc")).select("doc.*"))
