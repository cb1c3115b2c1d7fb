import hashlib
import re
from collections import defaultdict

import corpus_pipeline
from quakeframe.llm import langid, mixing
from quakeframe.llm.bpe import BytePairEncoder
from public_tokenizers import path
from tests.llm.test_near_copies import kept_by_force


def test_each_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(10**9)
    more = spark.createDataFrame([(10**6, None, "en", "src1", 0), (10**6 + 1, "12 34", None, None, 5)], docs.schema)
    docs = docs.unionByName(more)
    samples = langid.learned_samples(docs.filter(~langid.held_out(docs.doc_id)))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "bpe_encoding":
            assert docs.columns == columns and all(after[i] == before[i] for i in after)
        if name == "language_id":
            own = langid.Parser(samples)
            assert set(after) == {i for i, r in before.items() if own.judged(r.text)[2]}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, r in before.items():
                groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append(i)
            assert set(after) == {min(g) for g in groups.values()}
        elif name == "simhash_near_dedup":
            assert sorted(after) == kept_by_force(sorted((i, r.text) for i, r in before.items()))
        elif name == "mixture":
            tokens = lambda rows: sum(len(r.text.split()) for r in rows.values())
            assert 0.6 * tokens(before) < tokens(after) <= mixing.BUDGET_SHARE * tokens(before) + 1
        else:
            own = BytePairEncoder.from_ranks(open(path("byte_bpe_50k.tiktoken"), "rb").read())
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.token_ids == own.encode_text(before[i].text) and r.n_tokens == len(r.token_ids)
                assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
