"""The registered queries over their whole small tables, against brute force or labels."""

import base64
import hashlib
import math
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from quakeframe.llm import html_extract, registry, simhash
from quakeframe.llm.common import fold_of
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_vectors import brute as brute_vectors


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: registry.QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


def test_every_operator_is_registered():
    assert Counter(re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES) == Counter(map(str, range(1, 14)))


def test_op1(run, tables):
    rows = {r.page_id: r for r in run("op1_html_main_text")}
    field = html_extract.trained()
    for p in tables("pages"):
        article = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want = " ".join(" ".join(" ".join(html_extract.unescape(b).split()) for b in blocks).split())
        assert rows[p.page_id].text == want == field.main_text(p.html) and rows[p.page_id].n_chars == len(want)
        assert rows[p.page_id].url == p.url


def test_op2(run, tables):
    docs = {r.doc_id: r.text for r in tables("documents")}
    fps = {i: simhash.fingerprint(t) for i, t in docs.items()}
    rows = {r.doc_id: r for r in run("op2_simhash_near_dedup")}
    root = {i: i for i in docs}
    for _ in docs:
        before = dict(root)
        for i in docs:
            root[i] = min(root[j] for j in docs if (fps[i] ^ fps[j]).bit_count() <= 3)
        if root == before:
            break
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{fps[i]:016x}", root[i]) for i in docs}


def test_op3(run, tables):
    rows = {r.doc_id: r for r in run("op3_quality")}
    assert len(rows) == len(tables("documents")) and all(r.held_out == (fold_of(i, 3) == 1) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in tables("labels") if rows[x.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_op4(run, tables):
    rows = run("op4_mixture")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in tables("documents"))
    taken, total = sum(r.copies * r.n_tokens for r in rows), sum(r.n_tokens for r in rows)
    assert 0.5 * total < taken <= 0.8 * total + 1 and max(r.copies for r in rows) <= 2


def test_op5(run, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(registry.ORACLE_SQL["op5_exact_dedup"])
    assert sorted(tuple(r[c] for c in want.columns) for r in run("op5_exact_dedup")) == sorted(want.fetchall())


def test_op6(run, tables):
    rows = [(r.vec_id, r.embedding) for r in tables("embeddings")]
    assert sorted(map(tuple, run("op6_embedding_near_dedup"))) == sorted(brute_vectors(rows))


def test_op7(run, tables):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in run("op7_bpe_round_trip")}
    for d in tables("documents"):
        ids = theirs.encode_ordinary(d.text or "")
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_op8(run, tables):
    theirs = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in run("op8_token_counts")}
    for d in tables("documents"):
        n = len(theirs.encode(d.text or "", add_special_tokens=False).ids)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len((d.text or "").encode()), n, n > 1024)


def test_op9(run, tables):
    rows = {r.doc_id: r for r in run("op9_pii")}
    for d in tables("documents"):
        want = brute_pii(d.text)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_op10(run, tables):
    rows = {r.doc_id: r for r in run("op10_language_id")}
    docs = tables("documents")
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows.values())
    assert all(rows[d.doc_id].held_out == (fold_of(d.doc_id, 5) == 0) for d in docs)
    held = [rows[d.doc_id].lang_pred == d.lang for d in docs if rows[d.doc_id].held_out]
    assert np.mean(held) > 0.9


def test_no_other_module_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "quakeframe")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in folder:
                assert "quakeframe.llm" not in open(os.path.join(folder, n)).read()
