import random

import pytest

from quakeframe.llm import licenses
from quakeframe.llm.licenses import NOTICES, PHRASES, WORD, Scanner


def least_edits(notice, words):
    """Least edit distance of the notice to any run of whole words, by the full table."""
    best = len(notice)
    for first in range(len(words)):
        row = list(range(len(notice) + 1))
        for k, c in enumerate(" ".join(words[first:])):
            diagonal, row[0] = row[0], k + 1
            for j, d in enumerate(notice):
                diagonal, row[j + 1] = row[j + 1], min(diagonal + (c != d), row[j] + 1, row[j + 1] + 1)
            text = " ".join(words[first:])
            if k + 1 == len(text) or text[k + 1] == " ":
                best = min(best, row[-1])
            if k > 2 * len(notice):
                break
    return best


def base(text):
    """Places of phrases, word by word."""
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for i in range(len(words)) for phrase, label in PHRASES if words[i : i + len(phrase.split())] == phrase.split()]
    return words, places


def spoiled(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rng.randrange(len(text))
        text[at : at + rng.randrange(2)] = rng.choice(["", rng.choice("abcxyz "), rng.choice("abcxyz0")])
    return "".join(text)


def test_matches_are_those_of_the_full_table():
    rng, scanner = random.Random(12), Scanner()
    for _ in range(60):
        text, _ = rng.choice(NOTICES[:19])
        filler = " ".join(rng.choice(["lorem", "the", "license", "mit", "under", "licensed", "é", "4"]) for _ in range(rng.randrange(6)))
        words = WORD.findall(f"{filler} {spoiled(rng, text, rng.randrange(8))} {filler[::-1]}")
        joined = " ".join(words)
        scanner.outdone = lambda *_: False
        got = {}
        for a, b, e, n in scanner.hits(joined)[1]:
            assert (a == 0 or joined[a - 1] == " ") and (b == len(joined) or joined[b] == " ")
            got[n] = min(e, got.get(n, 99))
        for n, (notice, _) in enumerate(NOTICES):
            k = scanner.notices[n].edits
            if abs(len(notice) - len(text)) < 15 or n in got:
                least = least_edits(notice, words)
                assert got.get(n) == (least if least <= k else None), (notice, joined)


def test_pieces_cover_each_notice():
    for notice in Scanner().notices:
        pieces = notice.pieces()
        assert len(pieces) == notice.edits + 1 and "".join(p for _, p in pieces) == notice.text
        assert min(len(p) for _, p in pieces) >= 7


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Relaesed under the MIT Licence.", "mit"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("Licensed under CC BY-ND 4.0.", "cc-by,cc-by-nd"),
        ("Licenced under CC BY-SA 4.0.", "cc-by,cc-by-sa"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3"),
        ("This work is licensed under the GNU Generel Public Licence, version 2.", "gpl,gpl-2"),
        ("licensed under the GNU Lesser General Public License", "lgpl"),
        ("Licensed under the Apache\nLicence, Version 2.0", "apache-2"),
        ("# Licensed under the Apache License,\n# Version 2.0 (the License)", "apache,apache-2"),
        ("PERMISSION IS HEREBY GRANTED, free of charge, to any person obtaining a cpy of this software and asociated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without modifications, are permitted", "bsd"),
        ("omit license; a bit license; released into the wild under the sun", ""),
        ("", ""),
        (None, ""),
        ("gnu general public licensed apache", ""),
    ],
)
def test_labels(text, labels):
    assert Scanner().scan(text)[5] == labels


def test_spans_are_places_in_the_text():
    text = "É. Ünder İ — RELEASED   under the MIT licence!  And Released under the MIT License."
    spans = Scanner().scan(text)[7]
    assert [(text[s["start"] : s["end"]], s["label"], s["edits"]) for s in spans] == [("RELEASED   under the MIT licence", "mit", 1), ("Released under the MIT License", "mit", 0)]


def test_long_and_periodic_texts():
    scanner = Scanner()
    assert scanner.scan("licensed under " * 20000)[1:6] == (0, None, None, "", "")
    n, _, first, last, _, labels, score, spans = scanner.scan("word " * 300000 + "mit license " + "x" * 100000 + " released under teh mit license")
    assert (n, first, last, labels, score, spans[0]["edits"]) == (300008, 300000, 300006, "mit", 1.0, 2)


def test_rows_and_empty_tables(spark):
    docs = [(1, "mit license", 5, "a"), (1, "mit license", 5, "a"), (None, "cc by cc by", 5, "a"), (3, None, None, None), (4, "", 0, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int, labels string")
    rows = licenses.license_scan(df).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.labels, r.score) for r in rows) == [
        (0, 4, 2, 0, 2, "cc-by", 1.0), (1, 2, 1, 0, 0, "mit", 1.0), (1, 2, 1, 0, 0, "mit", 1.0), (3, 0, 0, None, None, "", 0.0), (4, 0, 0, None, None, "", 0.0),
    ]
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_query_over_all_documents(spark, sf_dir):
    rows = {r.doc_id: r for r in licenses.op12_license_scan(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words, places = base(d.text)
        r, at = rows[d.doc_id], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({c for _, c in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert any(r.labels != r.base_labels for r in rows.values())
