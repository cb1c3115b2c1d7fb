"""License scan: exact phrases, and fuzzy search for short notices.

A text is lower-cased (A-Z) and cut into words, which are joined by one space. A notice of n
characters may differ by n // ``PER_EDIT`` edits. It is cut into one piece more than that, so that
of any match at least one piece stands exactly (pigeonhole). One Aho-Corasick pass over the words finds all pieces and
all phrases; around a piece the text can only match near one place, and there, if it shares enough
substrings of three, the regex library's bounded-error search decides, with the fewest edits first. A match starts and ends with a word. It
is dropped where another notice covers at least half of it with fewer edits (version 2 is near to
version 3). Work is one pass over the text and one small window a seed.

Defined results: null and empty texts have no words, no labels and score 0; rows that repeat are
scanned each; a phrase counts at every place; spans are code points of the text as it was given;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import table, text_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Characters of a notice for each edit that it may have.
PER_EDIT = 10
#: Length of the substrings of which a match must share enough.
GRAM = 3

# Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices as the licenses word them, and their labels.
NOTICES = [
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the apache license", "apache"),
    ("licensed under the mit license", "mit"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by nd", "cc-by-nd"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("distributed under the boost software license version 1 0", "boost"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
]


class Notice:
    def __init__(self, text: str, label: str):
        self.text, self.label, self.edits = text, label, len(text) // PER_EDIT
        self.grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]
        self.shared = len(self.grams) - GRAM * self.edits  # an edit spoils GRAM of them at most
        self.pattern = regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(text, literal_spaces=True)}){{e<={self.edits}}}(?![^ ])")

    def pieces(self) -> list[tuple[int, str]]:
        """One piece more than edits, with their places."""
        cuts = [i * len(self.text) // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Phrases and notices, with one automaton for both."""

    def __init__(self, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES):
        self.phrases, self.notices = phrases, [Notice(*n) for n in notices]
        uses: dict[str, list[tuple[int, int]]] = {}  # key -> (notice, place of the piece); -1 - phrase for phrases
        for p, (text, _) in enumerate(phrases):
            uses.setdefault(text, []).append((-1 - p, 0))
        for n, notice in enumerate(self.notices):
            for at, piece in notice.pieces():
                uses.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for key, value in uses.items():
            self.automaton.add_word(key, (len(key), value))
        self.automaton.make_automaton()
        self.best = lru_cache(4096)(self._best)

    def _best(self, n: int, window: str, lead: int) -> tuple[int, int, int] | None:
        """Start, end and edits of the notice's best match in a window, from ``lead`` on."""
        notice = self.notices[n]
        at = window.find(notice.text, lead)
        while at >= 0:
            end = at + len(notice.text)
            if (at == 0 or window[at - 1] == " ") and (end == len(window) or window[end] == " "):
                return at, end, 0
            at = window.find(notice.text, at + 1)
        if sum(g in window for g in notice.grams) < notice.shared:
            return None
        m = notice.pattern.search(window, lead)
        return m and (m.start(), m.end(), sum(m.fuzzy_counts))

    def matches(self, n: int, text: str, start: int, end: int):
        """Non-overlapping matches of a notice in text[start:end], best ones first."""
        room = [(start, end)]
        while room:
            a, b = room.pop()
            if b - a < len(self.notices[n].text) - self.notices[n].edits:
                continue
            lead = int(a > 0)  # one character more on each side tells whether a word goes on
            hit = self.best(n, text[a - lead : b + 1], lead)
            if hit:
                s, e = hit[0] + a - lead, hit[1] + a - lead
                yield s, e, hit[2]
                room += [(a, s), (e, b)]

    def hits(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Of words joined by one space: (start, phrase) places, and (start, end, edits, notice)."""
        exact, seeds = [], {}
        for last, (size, value) in self.automaton.iter(text):
            start = last + 1 - size
            for n, at in value:
                if n >= 0:
                    seeds.setdefault(n, set()).add(start - at)
                elif (start == 0 or text[start - 1] == " ") and (last + 1 == len(text) or text[last + 1] == " "):
                    exact.append((start, -1 - n))
        found = []
        for n, places in seeds.items():
            k, size = self.notices[n].edits, len(self.notices[n].text)
            run = []
            for place in [*sorted(places), None]:
                if run and (place is None or place - run[-1] > 2 * k):  # no match can have both places
                    found += [(*m, n) for m in self.matches(n, text, max(0, run[0] - k), min(len(text), run[-1] + size + k))]
                    run = []
                run.append(place)
        found.sort()
        starts = [f[0] for f in found]
        longest = max((f[1] - f[0] for f in found), default=0)
        near = lambda f: found[bisect_left(starts, f[0] - longest) : bisect_left(starts, f[1])]
        return exact, [f for f in found if not any(self.outdone(f, other) for other in near(f))]

    def outdone(self, one, other) -> bool:
        shared = min(one[1], other[1]) - max(one[0], other[0])
        return other[2] < one[2] and 2 * shared >= one[1] - one[0]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of a text;
        a span is (label, start, end, edits)."""
        lower = (text or "").encode().lower().decode()
        words = WORD.findall(lower)
        joined = " ".join(words)
        exact, fuzzy = self.hits(joined)
        if not exact and not fuzzy:
            return len(words), 0, None, None, "", "", 0.0, []
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        word_at = [bisect_right(starts, at) - 1 for at, _ in exact]
        base = {self.phrases[p][1] for _, p in exact}
        labels = base | {self.notices[n].label for *_, n in fuzzy}
        score = 1.0 if exact else max(1 - e / len(self.notices[n].text) for _, _, e, n in fuzzy)
        spans = []
        if fuzzy:
            places = [m.span() for m in WORD.finditer(lower)]
            spans = sorted({(places[bisect_right(starts, a) - 1][0], places[bisect_right(starts, b - 1) - 1][1], self.notices[n].label, e) for a, b, e, n in fuzzy})
        return (
            len(words), len(exact), min(word_at, default=None), max(word_at, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"label": c, "start": a, "end": b, "edits": e} for a, b, c, e in spans],
        )


KIND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, edits: int>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS]


def license_scan(documents: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id and the results of the scan for each row of ``documents``."""
    names = [field.split(" ")[0] for field in KIND.split(", ", 7)]

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            found = list(zip(*(scanner.scan(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(found, TYPES, strict=True)]], ["doc_id", *names])

    return text_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {KIND}")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    said = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"])))
    return found.withColumn("spans", said)
