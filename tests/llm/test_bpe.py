import base64
import hashlib
import random

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from tokenizers import Tokenizer

from quakeframe.llm.bpe import BytePairEncoder, counted, encoded, fits_budget, truncated

ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'", "'re", "'s", "é", "ß", "日本", "1", "23", "!!", "😀", " ", "　", "\x1c", "\x85", "<|endoftext|>", "ñ", ".", "Ⅷ", "²"]


def texts(n, longest=40, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def by_ranks():
    return BytePairEncoder.from_ranks(open(path("byte_bpe_50k.tiktoken"), "rb").read())


@pytest.fixture(scope="module")
def by_json():
    return BytePairEncoder.from_json(open(path("byte_bpe_50k.json"), "rb").read())


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_round_trips(by_ranks, theirs):
    rng = random.Random(3)
    more = ["".join(rng.choices("abcdeothisn", k=300)) for _ in range(60)] + ["a" * 5000, "thethe" * 500, ""]
    for text in texts(2000) + more:
        ids = by_ranks.encode_text(text)
        assert ids == theirs.encode_ordinary(text), text
        assert by_ranks.decode(ids) == text.encode()


def test_plain_texts_split_alike(by_ranks):
    rng = random.Random(11)
    letters = "aZé'stmdrevl _-.,09\n\t\r\u00a0ñß×÷ªºµ«¿ÿŁǅɏ" + "".join(map(chr, range(0xA0, 0x250)))
    for _ in range(3000):
        text = "".join(rng.choices(letters if rng.random() < 0.5 else letters[:24], k=rng.randint(0, 40)))
        assert by_ranks.pieces(text) == by_ranks.split(text), text
    assert by_ranks.plain


def test_counts_equal_the_library(by_json):
    own = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in texts(2000):
        assert by_json.count(text) == len(own.encode(text, add_special_tokens=False).ids), text
        assert by_json.encode_text(text) == own.encode(text, add_special_tokens=False).ids


def test_prefix_counts_equal_encoding_each_prefix(by_json):
    for text in texts(300, 25):
        assert by_json.prefix_counts(text) == [by_json.count(text[:k]) for k in range(len(text) + 1)], text


def test_fits_budget():
    assert fits_budget([0, 1, 1, 2, 3], 2) == 3
    assert fits_budget([0, 1, 2, 1], 1) == 1
    assert fits_budget([0], 5) == 0


def test_frames(spark):
    rows = [(1, "The thing, done."), (2, None), (3, ""), (1, "The thing, done."), (4, "x" * 20000), (5, "naïve \n\n\n x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "'z' as n_tokens", "'y' as qf")
    out = sorted(map(tuple, encoded(df, ids=True).collect()))
    assert len(out) == 6 and out[0] == out[1]
    by_id = {r[0]: r for r in out}
    assert by_id[2][1] == 0 and by_id[2][3] == hashlib.sha256(b"").hexdigest()
    for i, text in rows:
        assert by_id[i][3] == hashlib.sha256((text or "").encode()).hexdigest()
        assert by_id[i][2] == hashlib.sha256(" ".join(map(str, by_id[i][4])).encode()).hexdigest()
    counts = {r.doc_id: r for r in counted(df).collect()}
    assert counts[4].n_bytes == 20000 and counts[4].over_limit and not counts[2].over_limit
    assert all(counts[i].n_tokens == by_id[i][1] for i, _ in rows)
    cut = {r.doc_id: r for r in truncated(df, 3).collect()}
    assert cut[1].n_tokens == 3 and rows[0][1].startswith(cut[1].text)
    assert encoded(df.limit(0)).count() == 0 and counted(df.limit(0)).count() == 0
