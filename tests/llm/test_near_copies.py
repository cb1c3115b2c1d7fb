import random

import numpy as np

import corpus_pipeline
from quakeframe.llm import near_copies


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_by_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_stage_equals_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=30))
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 200))) + (" " + line) * (i % 3 == 0) for i in range(60)]
    for t in texts[:60]:
        texts += [edited(rng, t, n) for n in (1, 2, 3, 5)]
    texts += [texts[0].upper(), None, "", "one", "One", "one two", "x " * 9000]
    chain = texts[1]
    for _ in range(12):  # a path: its ends are not similar
        chain = edited(rng, chain, 1)
        texts.append(chain)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == kept_by_force(rows)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_stage_on_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, docs, "").select("doc_id", "text").collect() if r.text)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == kept_by_force(rows)


def test_rows_that_share_an_id_are_kept_apart(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(8)]
    ids = [1, 1, 2, None, None, None, 3, 3]
    copies = [(9, texts[0].upper()), (0, texts[2].upper()), (8, texts[3].upper()), (None, texts[6].upper()), (1, texts[1])]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), *copies], "doc_id long, text string").repartition(3)
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near_copies.drop_similar(df).collect())
    want = [(1, texts[0]), (1, texts[1]), (0, texts[2].upper()), (8, texts[3].upper()), (None, texts[4]), (None, texts[5]), (3, texts[6]), (3, texts[7])]
    assert kept == sorted((i is None, i or 0, t) for i, t in want)


def test_large_groups_and_many_marks(spark, monkeypatch):
    """Groups above ``DENSE`` are compared once more; marks above ``SMALL`` are not broadcast."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for n in (250, 3):
        base = " ".join(rng.choices(words, k=150))
        texts += [base] + [edited(rng, base, rng.choice((1, 2, 3))) for _ in range(n)]
    texts += [" ".join(rng.choices(words, k=80)) for _ in range(20)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, KEY string")
    want = kept_by_force(rows)
    assert sorted(r.doc_id for r in near_copies.drop_similar(df).collect()) == want
    monkeypatch.setattr("quakeframe.llm.rows.SMALL", 2)
    kept = near_copies.drop_similar(df.unionByName(df.filter("doc_id = 0")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_pairs_at_the_threshold_meet_at_any_width():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**64, (400, 180), np.uint64)
    for rows in (1000, 10**7, 10**8):
        cuts = near_copies.segments(rows)
        met = 0
        for a in values:
            x, y = (near_copies.bits_of(near_copies.fingerprint(np.unique(part))) for part in (a[:162], a[18:]))
            met += bool(((x != y)[0, cuts].sum(1) <= 1).any() and (x != y).sum() <= near_copies.LIMIT)
        assert met >= 0.97 * len(values), rows


def test_files_of_finished_rounds_go(spark):
    import time

    from quakeframe.llm.graph import connected_components

    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext._jvm.System.gc()
        time.sleep(3)
        start = files()
        path = spark.range(200).selectExpr("(id * 37) % 201 AS a", "((id + 1) * 37) % 201 AS b")
        found = connected_components(path)
        for _ in range(20):
            if files() - start <= 64 * 3 * 2:
                break
            time.sleep(0.5)
        assert files() - start <= 64 * 3 * 2  # those of two shuffles; a path takes several rounds of some shuffles each
        assert sorted(map(tuple, found.collect())) == [(i, 0) for i in range(201)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
