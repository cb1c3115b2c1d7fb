import random

import numpy as np
import pytest

from quakeframe.llm import langid, quality
from quakeframe.llm.common import fold_of


def brute_longest(sample, text, at):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return n


def test_automaton_matches_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        sample = "".join(rng.choices("ab c", k=rng.randint(0, 60)))
        text = "".join(rng.choices("ab cd", k=30))
        own = langid.SuffixAutomaton(sample)
        at = phrases = 0
        while at < len(text):
            n = brute_longest(sample, text, at)
            assert own.longest_match(text, at) == n
            at, phrases = at + max(n, 1), phrases + 1
        assert own.phrases(text) == phrases


LANGUAGES = {"xx": "the thing is there and then that", "yy": "une chose est là pour toujours", "zz": "ein ding ist dort und dann"}


def language_rows():
    rng = random.Random(2)
    rows = []
    for i in range(240):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choices(LANGUAGES[lang].split(), k=12)), lang, "s"))
    return rows


def test_language_frames(spark):
    rows = language_rows() + [(900, None, "xx", None), (901, "", None, "s"), (902, "12 %% 3", "xx", "s"), (903, "the thing " * 9000, None, "s"), (903, "the thing " * 9000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    samples = langid.learned_samples(df.filter(~langid.held_out(df.doc_id)))
    assert set(samples) == set(LANGUAGES) and all(len(s) <= 40_000 for s in samples.values())
    out = langid.identified(df, samples).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i in (900, 901, 902):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[903].lang_pred == "xx"
    held = [(by_id[i].lang_pred, lang) for i, _, lang, _ in rows[:240] if fold_of(i, 5) == 0]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert {r.lang for r in kept.filter("doc_id = 903").collect()} == {"xx"}
    nothing = langid.identified(df, langid.learned_samples(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_coordinate_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(80, 6))
    labels = (dense[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    rows = [(np.arange(6), x) for x in dense]
    w = quality.dual_coordinate_descent(rows, labels, cost=0.5, epochs=2000)
    used, bias = w[:6], w[-1]
    sign = np.where(labels == 1, 1, -1)

    def loss(v, b):
        return (v @ v + b * b) / 2 + 0.5 * np.maximum(0, 1 - sign * (dense @ v + b)).sum()

    best = loss(used, bias)
    assert all(loss(used + d[:6], bias + d[6]) >= best - 1e-3 for d in rng.normal(scale=0.05, size=(500, 7)))


def test_ratios_by_hand():
    rows = [np.array([1, 2]), np.array([1]), np.array([1, 3]), np.array([3])]
    r = quality.log_count_ratios(rows, np.array([1, 1, 0, 0]), least=2)
    d = quality.DIMENSIONS
    assert r[2] == 0 and r[1] == pytest.approx(np.log((3 / (3 + d)) / (2 / (3 + d)))) and r[3] < 0


def test_quality_frames(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Eps", "zeta"]
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.7
        text = " ".join(w if good else w + "%%%" for w in rng.choices(words, k=30))
        docs.append((i, text, "x"))
        labels.append((i, int(good)))
    more = [(900, None, None), (901, "", "x"), (902, "alpha%%% " * 20000, "x"), (902, "alpha%%% " * 20000, "x")]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, score string")
    known = spark.createDataFrame([(i, q) for i, q in labels if fold_of(i, 3) != 1] + [(0, None)], "doc_id long, quality int")
    model = quality.learned_model(df, known)
    out = quality.scored(df, model).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert np.mean([by_id[i].predicted == q for i, q in labels if fold_of(i, 3) == 1]) > 0.95
    assert by_id[900].score == by_id[901].score and by_id[902].predicted == 0
    one = quality.learned_model(df, known.filter("quality = 1"))
    assert {r.score for r in quality.scored(df, one).collect()} == {1.0}
    none = quality.learned_model(df, known.limit(0))
    assert {r.score for r in quality.scored(df, none).collect()} == {0.5}
    assert quality.scored(df.limit(0), model).count() == 0


def test_languages_without_letters_or_with_few_do_not_win(spark):
    rows = language_rows()
    more = [(1000 + i, t, lang) for lang, t in (("aa", "12 34 %%"), ("aa", ""), ("bb", "h"), ("bb", "e t")) for i in range(40)]
    df = spark.createDataFrame([r[:3] for r in rows] + more, "doc_id long, text string, lang string")
    samples = langid.learned_samples(df)
    assert set(samples) == {*LANGUAGES, "bb"}
    for alone in ("h", " h", " h e t"):
        own = langid.Parser({k: v for k, v in samples.items() if k != "bb"} | {"bb": alone})
        assert np.mean([own.predict(text)[0] == lang for _, text, lang, _ in rows]) > 0.95


def test_a_learned_label_und_is_kept(spark):
    rows = [(i, text, "und" if lang == "xx" else lang) for i, text, lang, _ in language_rows()]
    df = spark.createDataFrame(rows + [(900, None, "und"), (901, "1 2", "und")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.keep_identified(df).collect()) == [i for i, _, _ in rows]


def test_shape_of_the_whole_word():
    assert quality.shape("b" * 60 + "9A" + "%" * 50) == "a9A%" and quality.shape("Ab%%%") == "Aa%"


def test_prediction_and_score_by_brute_force(spark):
    """Whole texts, across words: longest matches found by search in the samples."""
    rng = random.Random(8)
    samples = {k: "".join(" " + w for w in rng.choices(v.split(), k=40)) for k, v in LANGUAGES.items()}
    own = langid.Parser(samples)
    alphabet = {c for s in samples.values() for c in s}
    unknown = max([np.log2(len(alphabet))] + [np.log2(len(s)) for s in samples.values()])
    texts = [" ".join(rng.choices(" ".join(LANGUAGES.values()).split() + ["éq", "Thing,", "4x"], k=n)) for n in (1, 2, 5, 20, 300)] + ["qqqq"]
    assert max(own.automata[0].longest_match(samples["xx"], at) for at in range(40)) > 100  # a match crosses words
    for text in texts:
        line = langid.letters_of(text)
        bits = []
        for sample in (samples[k] for k in sorted(samples)):
            at, total = 0, 0.0
            while at < len(line):
                n = brute_longest(sample, line, at)
                total += np.log2(len(sample)) if n else unknown
                at += max(n, 1)
            bits.append(total)
        best = int(np.argmin(bits))
        lang, score = own.predict(text)
        assert lang == sorted(samples)[best] and score == pytest.approx(1 / sum(2.0 ** max(-60, bits[best] - b) for b in bits))


def test_languages_of_long_texts_only_are_learned(spark):
    rows = [(i, LANGUAGES["xx"] + " ", "xx") for i in range(20)] + [(100 + i, (LANGUAGES["zz"] + " ") * 2000, "zz") for i in range(6)]
    rows += [(200, "xkq jzv wqx " * 400, None), (201, "ein ding", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learned_samples(df)
    assert set(samples) == {"xx", "zz"} and all(len(s) <= 40_000 for s in samples.values())
    assert {r.doc_id: r.lang_pred for r in langid.identified(df, samples).collect()}[105] == "zz"
    kept = {r.doc_id: r.lang for r in langid.keep_identified(df).collect()}
    assert 200 not in kept and kept[201] == "zz" and len(kept) == len(rows) - 1  # random letters go


def test_any_number_of_languages_is_learned_within_one_bound(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[(k * 7 + j * (k % 11 + 1)) % 26] for j in range(12))
    rows = [(k * 10 + i, (word(k) + " ") * 5, f"l{k:04d}") for k in range(1200) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learned_samples(df, sample_chars=100, total_chars=30_000)
    assert len(samples) > 300 and sum(map(len, samples.values())) <= 30_000
    whole = langid.learned_samples(df, sample_chars=20, total_chars=30_000)
    assert len(whole) == 1200 and all(len(s) <= 20 for s in whole.values())


def test_quality_scores_by_brute_force():
    """Ratios, weights, margin and score of a small table, each by its definition."""
    rng = random.Random(6)
    texts, labels = [], []
    for i in range(60):
        labels.append(i % 3 != 0 and 1 or 0)
        texts.append(" ".join(rng.choices(["aa bb", "Cc dd", "ee", "ff!"] if labels[-1] else ["bb aa", "dd Cc", "ee", "ff!"], k=6)))
    names = {}

    def grams(text):
        w = text.split()
        found = {("w", *w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        s = [quality.shape(x) for x in w]
        found |= {("s", *s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
        run = best = 1
        for x, y in zip(w, w[1:]):
            run = run + 1 if x == y else 1
            best = max(best, run)
        return found | {("r", n) for n in range(2, min(best, 4) + 1)}

    rows = [quality.features(t) for t in texts]
    for t, r in zip(texts, rows):
        assert len(grams(t)) == len(r)
        names.setdefault(frozenset(grams(t)), set()).add(tuple(r.tolist()))
    assert all(len(v) == 1 for v in names.values())
    y = np.array(labels)
    model = quality.fit(rows, y, {0: 1 / 3, 1: 2 / 3})
    learn = [i for i in range(60) if i % 5]
    total = [sum(len(rows[i]) for i in learn if y[i] == k) for k in (0, 1)]
    for f in {f for r in rows for f in r.tolist()}:
        c = [sum(f in rows[i] for i in learn if y[i] == k) for k in (0, 1)]
        want = np.log((c[1] + 1) / (total[1] + quality.DIMENSIONS) * (total[0] + quality.DIMENSIONS) / (c[0] + 1)) if sum(c) >= 3 else 0.0
        assert model.ratios[f] == pytest.approx(want, abs=1e-5)
    for t, r in zip(texts, rows):
        v = model.ratios[r].astype(float)
        margin = model.bias + (model.weights[r] @ v) / np.sqrt(v @ v)
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))))
    assert np.mean([(model.score(t) >= 0.5) == q for t, q in zip(texts, labels)]) > 0.9
    assert quality.excerpt_of("a b c d", 1, 4) == "a b c d" and len(quality.excerpt_of("a b c d e", 1, 2).split()) == 2
