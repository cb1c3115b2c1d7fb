import hashlib
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeframe.llm import exact_dedup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@settings(deadline=None)  # the first call loads libraries
@given(st.lists(st.integers(0, 12), max_size=200), st.integers(1, 6))
def test_summary_bounds(values, counters):
    data = [bytes([v]) for v in values]
    batches = [pa.RecordBatch.from_arrays([pa.array(data[i : i + 7], pa.binary())], ["digest"]) for i in range(0, len(data), 7)]
    (out,) = exact_dedup.misra_gries(iter(batches), counters)
    seen = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    for value, n in Counter(data).items():
        assert seen.get(value, 0) <= n
        if n > 2 * len(data) / (counters + 1):
            assert value in seen


def test_groups_equal_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(["a b", "a  b", "a\t\nb", None, "", " ", "a b ", "ab", "x" * 50000, "x" * 50000, "a\x0bb", "a\x85b"])]
    rows += [(1, "a  b", "y"), (50, "q", "x"), (50, "q", "x"), (None, "n", "x")] + [(100 + i, "hot  text", "z") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, KEY string").repartition(5)
    for counters in (1, 4, 4096):
        out = exact_dedup.exact_groups(df, counters).collect()
        assert len(out) == len(rows)
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(norm(t), []).append(i)
        by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        for sha, ids in by_sha.items():
            own = [r for r in out if r.text_sha256 == sha]
            known = [i for i in ids if i is not None]
            assert len(own) == len(ids) and sum(r.kept for r in own) == 1
            assert all(r.group_size == len(ids) and r.keep_id == (min(known) if known else None) for r in own)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert Counter(norm(r.text) for r in kept.collect()) == Counter(set(groups))
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_rows_without_id_go_before_others_and_repeats_leave_the_same_row(spark):
    rows = [(None, "a b", "p"), (7, "a  b", "q"), (None, "a\tb", "r"), (None, "c", "s"), (3, "d", "u"), (3, "d", "t"), (3, "d", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    out = exact_dedup.exact_groups(df).collect()
    assert {(r.doc_id, r.keep_id) for r in out} == {(None, 7), (7, 7), (None, None), (3, 3)}
    kept = {tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()}
    assert (7, "a  b", "q") in kept and (None, "c", "s") in kept and len(kept) == 3
    for k in (1, 3, 5):
        assert {tuple(r) for r in exact_dedup.drop_exact_copies(df.repartition(k)).collect()} == kept
