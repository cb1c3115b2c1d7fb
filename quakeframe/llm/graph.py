"""Connected components of a link table, and joins that spread frequent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import packed


def _towards_least(edges: DataFrame, both: bool) -> DataFrame:
    """One star step over (u, v) with u > v: every neighbour of a node is linked to the node's
    least neighbour instead. ``both``: larger neighbours move; else the smaller ones."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    joined = seen.join(least, "u")
    if both:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return moved.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all are stars: each upper end has one lower end, and none is a lower end, too."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end"))
    seen = ends.groupBy("end.node").agg(F.sum("end.up").alias("ups"), F.count("*").alias("n"))
    return seen.filter("ups > 1 OR ups = 1 AND n > 1").isEmpty()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node of its component.

    Alternating star steps: the number of rounds grows with the logarithm of the number of nodes.
    Each round cuts its lineage in the shared checkpoint folder; it ends when every component is a
    star, that is when no node has both a larger and a smaller neighbour. Loops, repeated links and
    nulls do no harm; an empty table gives none.
    """
    edges = packed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = packed(_towards_least(_towards_least(edges, True), False))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def join_frequent(rows: DataFrame, lookup: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``lookup`` (one row a key, with the key's number of ``rows`` in column
    ``n``). Keys with more than 1/share of all rows are fewer than ``share``: these are broadcast,
    so that no task gets all rows of one of them; the others meet in a shuffle."""
    total = lookup.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(lookup.filter(F.col("n") * share > total))
    spread = rows.join(frequent, key)
    rest = rows.join(frequent.select(key), key, "left_anti").join(lookup.filter(F.col("n") * share <= total), key)
    return spread.unionByName(rest).drop("n")
