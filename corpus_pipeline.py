"""The corpus pipeline: stages over ``documents``, each an operator of the llm subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
that they were given, also those that the tables do not have. Each works on all rows that its
predecessor kept; texts of any length are taken whole; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakeframe.llm.bpe import encoded
from quakeframe.llm.common import checkpointed
from quakeframe.llm.exact_dedup import drop_exact_copies
from quakeframe.llm.langid import keep_identified
from quakeframe.llm.mixing import mixed
from quakeframe.llm.near_copies import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: null and letterless texts among them, and random
    letters; a null ``lang`` is filled; rows that repeat are judged each."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays (a null one counts as the largest); of rows that
    repeat both, one; a null text equals the empty one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id stays: linked are texts
    whose sets of five-word shingles have a similarity of 0.8 or more (fewer words: one shingle; a null
    doc_id counts as the largest; of repeated rows one stays)."""
    return drop_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their target weights, within one epoch: no document comes twice. Null languages and
    sources are values of their own; rows that repeat a doc_id stand or fall together."""
    return mixed(docs, max_epochs=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digests of the ids and of what they decode to; a null text has none."""
    return encoded(docs, ids=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixture", mixture),
    ("bpe_encoding", encoding),
]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage reads its input more than once, so what it is given
    is cut off in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, checkpointed(docs) if k else docs, sf_dir)
    return docs
