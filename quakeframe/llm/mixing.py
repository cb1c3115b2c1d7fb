"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' contents of a tree of domain, language and source. A token budget goes
down the tree: each child gets its weight's share of its parent's budget, but not more than its
tokens times ``max_epochs``; what a child cannot use goes to its siblings by their weights, and
only what all of them cannot use goes to the parent's siblings. Among siblings in the order of
capacity by weight, (budget - capacity before) / (weight from here on) is largest at the level up to
which all of them fill, so a level of the tree is one window over its nodes. A leaf with a budget
takes whole epochs, then a prefix of the next epoch: its documents in a seeded order, up to the
budget.

The order is a digest of doc_id and seed, so the prefix is a threshold on that digest, found from
bucket sums (about the square root of the leaf's rows in number) and the one bucket that holds the
cut. No task gets a whole leaf, no text is shuffled, nothing of the tree reaches the driver, and the
decision of a row follows from the row and its leaf's threshold.

Defined results: null keys are values of their own; null texts have no tokens; rows that repeat a
doc_id stand or fall together; a leaf or a tree without tokens takes its documents while nothing is
exceeded; further columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, table
from quakeframe.llm.graph import join_frequent
from quakeframe.llm.rows import SMALL

#: Weights by path in the tree, such as ("d0", "en"); a path that is not listed weighs 1.
WEIGHTS: dict[tuple, float] = {("d0",): 2.0, ("d0", "en"): 3.0, ("d1", "en"): 3.0, ("d2", "en"): 3.0, ("d3", "en"): 3.0}
BUDGET_SHARE = 0.8
SEED = 4
EPOCHS = 2
#: Hexadecimal digits of a digest that make a row's place, and their range.
DIGITS, PLACES = 13, 16**13


def words(text: Column) -> Column:
    """Tokens of a text for the budget: its words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain(source: Column) -> Column:
    """The domain of a source: one of four, by the number at the end of its name."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.nullif(number, F.lit("")).cast("long") % 4, F.lit(0)).cast("string"))


def levels() -> list[Column]:
    return [domain(F.col("source")), F.col("lang"), F.col("source")]


def placed(documents: DataFrame, by: list[Column], tokens: Column) -> DataFrame:
    """path, leaf (the path as JSON), n_tokens and id for each row, besides ``doc`` if there is one."""
    path = F.array(*[c.cast("string") for c in by])
    return documents.select(
        *(["doc"] if "doc" in documents.columns else []),
        path.alias("path"),
        F.to_json(path).alias("leaf"),
        tokens.alias("n_tokens"),
        F.col("doc_id"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
    )


def budgets(leaves: DataFrame, depth: int, weights: Mapping[tuple, float], share: float, max_epochs: int) -> DataFrame:
    """leaf, tokens, n and amount for each row of ``leaves`` (path, leaf, tokens, n)."""
    spark = leaves.sparkSession
    upto = lambda k: F.to_json(F.slice("path", 1, k))
    named = leaves
    if weights:
        listed = spark.createDataFrame([(list(map(lambda x: x, p)), float(w)) for p, w in weights.items()], "p array<string>, w double")
        given = listed.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.to_json("p"), "w"))).alias("given"))
        named = leaves.crossJoin(F.broadcast(given))  # one row
    weight = lambda k: F.coalesce(F.element_at("given", upto(k)), F.lit(1.0)) if weights else F.lit(1.0)
    named = checkpointed(named.select("leaf", "tokens", "n", *[upto(k).alias(f"key{k}") for k in range(depth + 1)], *[weight(k).alias(f"w{k}") for k in range(1, depth + 1)]))
    total = named.agg((F.lit(float(share)) * F.coalesce(F.sum("tokens"), F.lit(0))).alias("amount"))
    amounts = total.select(F.lit("[]").alias("key0"), "amount")
    for k in range(1, depth + 1):
        usable = F.lit(True)
        for below in range(k + 1, depth + 1):
            usable = usable & (F.col(f"w{below}") > 0)
        nodes = named.groupBy(f"key{k - 1}", f"key{k}").agg(
            F.sum(F.when(usable, F.col("tokens") * max_epochs).otherwise(0)).alias("cap"), F.first(f"w{k}").alias("w")
        ).join(amounts, f"key{k - 1}")
        parent = Window.partitionBy(f"key{k - 1}")
        order = parent.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")), f"key{k}")
        has = F.col("w") > 0
        before = F.sum(F.when(has, F.col("cap")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.when(has, F.col("cap")).otherwise(0)
        ahead = F.sum(F.when(has, F.col("w")).otherwise(0.0)).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        budget = F.least("amount", F.sum(F.when(has, F.col("cap")).otherwise(0)).over(parent).cast("double"))
        leveled = nodes.withColumn("level", F.when(has, (budget - before) / ahead))
        got = F.when(has, F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(parent))).otherwise(0.0)
        amounts = checkpointed(leveled.select(f"key{k}", got.alias("amount")))
    return named.select("leaf", "tokens", "n", f"key{depth}").join(amounts, f"key{depth}").select("leaf", "tokens", "n", F.floor(F.col("amount") + 1e-6).cast("long").alias("amount"))


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their leaf: broadcast while the leaves are few."""
    if plan.count() <= SMALL:
        return rows.join(F.broadcast(plan.drop("n")), "leaf")
    return join_frequent(rows, plan, "leaf")


class Mixture:
    """The decision for a corpus: for each leaf whole epochs, and the threshold of the cut one."""

    def __init__(self, documents: DataFrame, by: list[Column], weights: Mapping[tuple, float], share: float, max_epochs: int, seed: int, tokens: Column | None = None):
        self.by, self.seed, self.tokens = by, seed, tokens if tokens is not None else words(F.col("text"))
        rows = checkpointed(placed(documents, by, self.tokens))
        leaves = rows.groupBy("leaf").agg(F.first("path").alias("path"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        amounts = budgets(leaves, len(by), weights, share, max_epochs)
        epochs = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("amount") / F.greatest("tokens", F.lit(1))), F.lit(max_epochs))).otherwise(max_epochs).cast("long")
        plan = amounts.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") > 0, F.col("amount") - F.col("epochs") * F.col("tokens")).otherwise(0))
        self.plan = checkpointed(plan.select("leaf", "n", "amount", "epochs", "rest", F.ceil(F.sqrt("n")).cast("long").alias("buckets")))
        self.cuts = checkpointed(self._cuts(self.ordered(rows)))

    def ordered(self, rows: DataFrame) -> DataFrame:
        """With the leaf's plan, the row's place in the epoch that is cut, and its bucket."""
        place = F.conv(F.substring(F.md5(F.concat("id", F.lit(f":{self.seed}")).cast("binary")), 1, DIGITS), 16, 10).cast("long")
        joined = with_plan(rows, self.plan.drop("amount")).withColumn("place", place)
        return joined.withColumn("bucket", F.floor(F.col("place") / F.lit(float(PLACES)) * F.col("buckets")))

    def _cuts(self, rows: DataFrame) -> DataFrame:
        """For each leaf: the bucket of the cut, and the last place and id inside it that still fit."""
        sums = rows.groupBy("leaf", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.count("*").alias("m"))
        running = F.sum("tokens").over(Window.partitionBy("leaf").orderBy("bucket"))
        cut = checkpointed(
            sums.withColumn("after", running)
            .groupBy("leaf")
            .agg(F.min(F.when(F.col("after") > F.col("rest"), F.struct("bucket", (F.col("after") - F.col("tokens")).alias("before")))).alias("cut"), F.sum("m").alias("n"))
            .select("leaf", "cut.bucket", "cut.before", "n")
            .filter("bucket IS NOT NULL")
        )
        inside = with_plan(rows.drop("n"), cut.withColumnRenamed("bucket", "at")).filter("bucket = at")
        each = inside.groupBy("leaf", "place", "id").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("before"))  # repeated ids fold first
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("place", "id"))
        last = each.withColumn("upto", upto).filter("upto <= rest").groupBy("leaf").agg(F.max(F.struct("place", "id")).alias("last"))
        return cut.join(last, "leaf", "left").select("leaf", "n", F.col("bucket").alias("cut_bucket"), "last")

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of ``placed``) with copies: how often the mixture takes each."""
        whole = checkpointed(self.plan.select("leaf", "n").join(self.cuts.drop("n"), "leaf", "left"))
        known = with_plan(self.ordered(rows).drop("n"), whole)
        within = (
            F.col("cut_bucket").isNull()
            | (F.col("bucket") < F.col("cut_bucket"))
            | ((F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct("place", "id") <= F.col("last"), F.lit(False)))
        )
        # a leaf whose allotment is whole epochs has nothing of the next one
        taken = F.when((F.col("rest") > 0) & within, 1).otherwise(0)
        return known.withColumn("copies", F.col("epochs") + taken)


def mixture_report(documents: DataFrame, max_epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, leaf, n_tokens, copies for each row: how often the mixture takes it."""
    mix = Mixture(documents, levels(), WEIGHTS, BUDGET_SHARE, max_epochs, seed)
    return mix.copies(placed(documents, mix.by, mix.tokens)).select("doc_id", "leaf", "n_tokens", "copies")


def mixed(documents: DataFrame, max_epochs: int = 1, seed: int = SEED, weights: Mapping[tuple, float] = WEIGHTS, share: float = BUDGET_SHARE) -> DataFrame:
    """The rows of the mixture, in their own columns; a row of several epochs comes several times."""
    mix = Mixture(documents, levels(), weights, share, max_epochs, seed)
    columns = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc")
    marked = placed(documents.select(columns, "doc_id", *[F.col(c) for c in ("text", "lang", "source")]), mix.by, mix.tokens)
    taken = mix.copies(marked).filter("copies > 0")
    if max_epochs > 1:
        taken = taken.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("doc.*")


def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(table(spark, sf_dir, "documents"))


def _level(k: int, parent: str, above: str) -> str:
    """SQL of one level of the tree: the amount of each node of ``above``'s nodes' children."""
    key = f"key{k}"
    usable = " AND ".join([f"w{j} > 0" for j in range(k + 1, 4)] or ["true"])
    return f"""
nodes{k} AS (
  SELECT {parent} AS parent, {key}, sum(CASE WHEN {usable} THEN tokens * {EPOCHS} ELSE 0 END) AS cap, any_value(w{k}) AS w FROM leaves GROUP BY 1, 2
), level{k} AS (
  SELECT n.*, (least(a.amount, CAST(sum(cap) OVER (PARTITION BY n.parent) AS DOUBLE))
    - (sum(cap) OVER (PARTITION BY n.parent ORDER BY cap / w, n.{key} ROWS UNBOUNDED PRECEDING) - cap))
    / sum(w) OVER (PARTITION BY n.parent ORDER BY cap / w, n.{key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM nodes{k} n JOIN {above} a ON a.key = n.parent
), amount{k} AS (
  SELECT {key} AS key, least(CAST(cap AS DOUBLE), w * max(level) OVER (PARTITION BY parent)) AS amount FROM level{k}
)"""


def _case(k: int) -> str:
    names = ["dom", "lang", "source"]
    whens = " ".join(f"WHEN {' AND '.join(f'{c} = {x!r}' for c, x in zip(names, p, strict=False))} THEN {w!r}" for p, w in WEIGHTS.items() if len(p) == k)
    return f"CAST(CASE {whens} ELSE 1.0 END AS DOUBLE)" if whens else "CAST(1.0 AS DOUBLE)"


OP4_SQL = f"""
WITH parts AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, lang, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         'd' || coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0) AS dom
  FROM documents
), docs AS (
  SELECT *, CAST(to_json([dom, lang, source]) AS VARCHAR) AS leaf, CAST(to_json([dom, lang]) AS VARCHAR) AS key2, CAST(to_json([dom]) AS VARCHAR) AS key1,
         CAST('0x' || substr(md5(id || ':{SEED}'), 1, {DIGITS}) AS BIGINT) AS place
  FROM parts
), leaves AS (
  SELECT leaf AS key3, key2, key1, '[]' AS key0, sum(n_tokens) AS tokens, {_case(1)} AS w1, {_case(2)} AS w2, {_case(3)} AS w3
  FROM docs GROUP BY leaf, key2, key1, dom, lang, source
), amount0 AS (
  SELECT '[]' AS key, CAST({BUDGET_SHARE} AS DOUBLE) * coalesce(sum(tokens), 0) AS amount FROM leaves
), {_level(1, "key0", "amount0")}, {_level(2, "key1", "amount1")}, {_level(3, "key2", "amount2")}, plan AS (
  SELECT key3 AS leaf, tokens, CAST(floor(amount + 1e-6) AS BIGINT) AS amount FROM leaves JOIN amount3 ON amount3.key = key3
), cut AS (
  SELECT leaf, CASE WHEN tokens > 0 THEN least(amount // tokens, {EPOCHS}) ELSE {EPOCHS} END AS epochs,
         CASE WHEN tokens > 0 THEN amount - least(amount // tokens, {EPOCHS}) * tokens ELSE 0 END AS rest
  FROM plan
)
SELECT doc_id, leaf, CAST(n_tokens AS BIGINT) AS n_tokens,
       CAST(epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY leaf ORDER BY place, id) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM docs JOIN cut USING (leaf)
"""
