import hashlib
import json
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quakeframe.llm import mixing


def fill(capacity, weight, budget):
    """Shares of a budget by weight, none above its capacity, what one cannot use going to the rest."""
    got, left = [0.0] * len(capacity), min(budget, float(sum(c for c, w in zip(capacity, weight) if w > 0)))
    open_ones = {i for i in range(len(capacity)) if weight[i] > 0}
    while open_ones and left > 1e-9:
        total = sum(weight[i] for i in open_ones)
        full = {i for i in open_ones if capacity[i] <= left * weight[i] / total}
        if not full:
            for i in open_ones:
                got[i] = left * weight[i] / total
            break
        for i in full:
            got[i] = float(capacity[i])
        left -= sum(got[i] for i in full)
        open_ones -= full
    return got


def allotted(leaves, weights, budget, max_epochs=1):
    """Tokens for each leaf (a path) that holds so many tokens, down the tree."""
    result = {}

    def usable(inside, path):
        return sum(t * max_epochs for leaf, t in inside.items() if all(weights.get(leaf[:k], 1.0) > 0 for k in range(len(path) + 1, len(leaf) + 1)))

    def down(path, inside, amount):
        if path in inside:
            result[path] = int(amount + 1e-6)
            return
        children = {}
        for leaf, tokens in inside.items():
            children.setdefault(leaf[: len(path) + 1], {})[leaf] = tokens
        order = sorted(children, key=lambda p: (p[-1] is not None, str(p[-1])))
        for p, share in zip(order, fill([usable(children[p], p) for p in order], [weights.get(p, 1.0) for p in order], amount)):
            down(p, children[p], share)

    if leaves:
        down((), dict(leaves), budget)
    return result


def by_spark(spark, leaves, weights, budget, max_epochs=1):
    rows = [(list(p), json.dumps(p), t, 1) for p, t in leaves.items()]
    df = spark.createDataFrame(rows, "path array<string>, leaf string, tokens long, n long")
    total = sum(leaves.values())
    out = mixing.budgets(df, len(next(iter(leaves))), weights, budget / total if total else 0.0, max_epochs).collect()
    return {tuple(json.loads(r.leaf)): r.amount for r in out}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 1000}
    for weights, budget, epochs, want in (
        ({}, 120, 1, (10, 50, 60)),
        ({}, 400, 1, (10, 100, 290)),
        ({("b",): 3.0}, 120, 1, (10, 20, 90)),
        ({("a", "y"): 0.0}, 5000, 2, (20, 0, 2000)),
        ({("a",): 0.0, ("b",): 0.0}, 100, 1, (0, 0, 0)),
    ):
        assert allotted(leaves, weights, budget, epochs) == dict(zip(leaves, want)) == by_spark(spark, leaves, weights, budget, epochs)


def test_budgets_equal_going_down_the_tree(spark):
    rng = random.Random(7)
    for _ in range(6):
        leaves = {(rng.choice("abc"), rng.choice(["x", "y", None]), f"s{i}"): rng.choice([0, 1, 7, 40, 1000]) for i in range(14)}
        weights = {p: rng.choice([0.0, 1.0, 2.0, 5.0]) for p in [("a",), ("b",), ("a", "x"), ("b", None), ("c", "y"), *rng.sample(sorted(leaves, key=str), 4)]}
        budget = rng.choice([0.1, 0.5, 1.5]) * sum(leaves.values())
        got, want = by_spark(spark, leaves, weights, budget, 2), allotted(leaves, weights, budget, 2)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) <= 1 for p in want), (leaves, weights)


def corpus(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["en", "de", None]), rng.choice(["src0"] * 6 + ["src1", "src2", "other", None]), "x") for i in range(700)]
    rows += [(800, None, "en", "src0", "x"), (801, "", "en", "src0", "x"), (802, "w " * 20000, "de", "src1", "y"), (5, "w w", "en", "src0", "y"), (5, "w w", "en", "src0", "y")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, Leaf string").repartition(5)


@pytest.mark.parametrize("max_epochs", [1, 2])
def test_mixture_equals_brute_force(spark, max_epochs):
    rows, df = corpus(spark)
    mix = mixing.Mixture(df, mixing.levels(), mixing.WEIGHTS, 0.8, max_epochs, 4)
    marked = mixing.placed(df, mix.by, mix.tokens)
    got = mix.copies(marked).select("doc_id", "leaf", "n_tokens", "copies", "place", "epochs").collect()
    assert len(got) == len(rows)
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    by_leaf = defaultdict(list)
    for r in got:
        by_leaf[r.leaf].append(r)
    sums = {tuple(json.loads(leaf)): sum(r.n_tokens for r in own) for leaf, own in by_leaf.items()}
    share = allotted(sums, mixing.WEIGHTS, 0.8 * sum(sums.values()), max_epochs)
    order = lambda r: (int(hashlib.md5(f"{r.doc_id}:4".encode()).hexdigest()[:13], 16), str(r.doc_id))
    for leaf, own in by_leaf.items():
        amount, total = share[tuple(json.loads(leaf))], sum(r.n_tokens for r in own)
        whole = amount // total if total else max_epochs
        rest, ahead = (amount - whole * total if total else 0), 0
        for key in sorted({order(r) for r in own}):
            block = [r for r in own if order(r) == key]
            ahead += sum(r.n_tokens for r in block)
            assert all(r.copies == whole + (rest > 0 and ahead <= rest) for r in block), leaf
    out = mixing.mixed(df, max_epochs)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_many_leaves_string_ids_and_empty(spark, monkeypatch):
    rows, df = corpus(spark)
    assert mixing.mixed(df.limit(0)).count() == 0 and mixing.mixture_report(df.limit(0)).count() == 0
    named = df.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.concat(F.lit("doc "), "doc_id")))
    want = sorted(map(str, mixing.mixture_report(named).collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(mixing, "SMALL", 2)  # more leaves than are broadcast
    assert sorted(map(str, mixing.mixture_report(named).collect())) == want


def test_sql_equals_the_operator(spark, tmp_path):
    _, df = corpus(spark)
    db = duckdb.connect()
    for k, docs in enumerate((df, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))):
        docs.write.parquet(str(tmp_path / f"d{k}"))
        db.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d{k}/*.parquet'")
        want = db.sql(f"SELECT doc_id, leaf, n_tokens, copies FROM ({mixing.OP4_SQL})").fetchall()
        assert Counter(want) == Counter(map(tuple, mixing.mixture_report(docs).collect()))
