"""Language identification by cross-parsing.

Each language has a suffix automaton of labelled text. A text (its runs of letters in lower case,
one space before each) is parsed whole against each automaton into longest matches, across words; a
letter that an automaton lacks is a phrase of its own, at the same cost for all languages. With c
phrases over N characters and a sample of n characters, c * log2(n) / N estimates the bits a
character; the fewest win. The score is the winner's share of 2 ** -bits over the whole text.

Learning: per language, rows by seeded hash, an excerpt of at most ``excerpt`` characters of each,
from a seeded place, up to ``sample_chars`` in all, and ``total_chars`` over all languages, of which
each then has an equal share: bounds that depend neither on the input nor on the number of
languages. All rows are scored, whole.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text
where nothing could be learned; a null label and a text without a letter teach nothing; ties go to
the first label in order; rows that repeat are answered each; further columns are kept (those named
like the answers are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from quakeframe.llm.common import bounded_sample, digest_mod, hash_fraction, table, text_batches, worker_model

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Bits behind the winner beyond which a language's share of the score does not fall.
LOST = 60.0
#: Characters that tell which language is parsed first.
PROBE = 200


def letters_of(text: str) -> str:
    """The runs of letters of a text in lower case, a space before each."""
    return "".join([" " + run for run in LETTERS.findall(text.lower())])


class SuffixAutomaton:
    """All substrings of a text, as the states that end them."""

    def __init__(self, text: str):
        self.size = max(2, len(text))
        start: dict = {None: 0}  # a state is the dict of its steps to other states; under None its number
        link: list[dict | None] = [None]
        length = [0]
        last = start
        for c in text:
            new: dict = {None: len(link)}
            length.append(length[last[None]] + 1)
            link.append(start)
            p = last
            while p is not None and c not in p:
                p[c] = new
                p = link[p[None]]
            if p is not None:
                q = p[c]
                if length[p[None]] + 1 == length[q[None]]:
                    link[new[None]] = q
                else:
                    twin = q | {None: len(link)}
                    length.append(length[p[None]] + 1)
                    link.append(link[q[None]])
                    while p is not None and p.get(c) is q:
                        p[c] = twin
                        p = link[p[None]]
                    link[q[None]] = link[new[None]] = twin
            last = new
        for state in self._all(start):  # without their numbers, and no larger than they need be
            steps = [(c, k) for c, k in state.items() if c is not None]
            state.clear()
            state.update(steps)
        self.start = start
        self.letters = set(start)

    @staticmethod
    def _all(start: dict) -> list[dict]:
        found, seen = [start], {id(start)}
        for state in found:
            for c, k in state.items():
                if c is not None and id(k) not in seen:
                    seen.add(id(k))
                    found.append(k)
        return found

    def longest_match(self, text: str, at: int) -> int:
        """Length of the longest prefix of text[at:] that occurs."""
        state, end = self.start, at
        while end < len(text) and (state := state.get(text[end])) is not None:
            end += 1
        return end - at

    def phrases(self, text: str, most: float = float("inf")) -> int:
        """Longest matches, one after the other, that cover the text; beyond ``most`` no more are counted."""
        start, nowhere = self.start, {}
        here, count = nowhere, 0
        for c in text:
            here = here.get(c)
            if here is None:
                count += 1
                if count > most:
                    break
                here = start.get(c, nowhere)
        return count


class Parser:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [SuffixAutomaton(samples[n]) for n in self.names]
        self.weights = [log2(a.size) for a in self.automata]
        alphabet = {c for a in self.automata for c in a.letters}
        self.common = {c for c in alphabet if all(c in a.letters for a in self.automata)}
        #: Bits of a letter from the alphabet of all samples.
        self.letter = log2(max(2, len(alphabet)))
        #: Bits of a letter that a sample lacks, the same for all languages: no sample is cheap because it is short.
        self.unknown = max([self.letter, *self.weights])

    def bits(self, text: str) -> tuple[list[float], int]:
        """Estimated bits of the text for each language, and the number of characters parsed. The
        language that leads over the first characters is parsed first; one that is ``LOST`` bits
        behind it, at which the score ends, is not parsed to the end: its bits are infinite."""
        line = letters_of(text)
        gone = [0] * len(self.automata)
        if rare := set(line) - self.common:
            seen = {c: line.count(c) for c in rare}
            gone = [sum(k for c, k in seen.items() if c not in a.letters) for a in self.automata]
        begun = line[:PROBE]
        order = sorted(range(len(self.automata)), key=lambda i: self.automata[i].phrases(begun) * self.weights[i])
        found, least = [float("inf")] * len(order), float("inf")
        for i in order:
            w, extra = self.weights[i], gone[i] * (self.unknown - self.weights[i])
            most = (least + LOST - extra) / w
            if (count := self.automata[i].phrases(line, most)) <= most:
                found[i] = count * w + extra
                least = min(least, found[i])
        return found, len(line)

    def judged(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the language tells the text in fewer bits than its letters
        one by one do (but for the phrase that the text's end breaks off)."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        bits, n = self.bits(text)
        best = min(range(len(bits)), key=bits.__getitem__)
        share = sum(2.0 ** max(-LOST, bits[best] - b) for b in bits)
        return self.names[best], 1.0 / share, bits[best] <= n * self.letter + self.weights[best]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged(text)[:2]


def parser(samples: dict[str, str]) -> Parser:
    """The parser of these samples, built once in each worker."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    return worker_model(("parser", key), lambda: Parser(samples))


def learned_samples(
    labelled: DataFrame, sample_chars: int = 40_000, rows: int = 60, excerpt: int = 4_000, seed: int = 10, total_chars: int = 1_000_000
) -> dict[str, str]:
    """Text of each language: at most ``sample_chars`` characters from about ``rows`` rows, and at
    most ``total_chars`` of all. Beyond ``total_chars / sample_chars`` languages each has fewer rows
    and characters; of more languages than rows (1.25 * ``rows`` times that number) those without
    one are not learned."""
    usable = labelled.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    place = F.floor(hash_fraction(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed + 1) * F.greatest(F.length("text") - excerpt + 1, F.lit(1))).cast("int") + 1
    found = bounded_sample(usable, "lang", "doc_id", rows, seed, max(1, total_chars // sample_chars)).select("lang", "doc_id", F.substring("text", place, F.lit(excerpt)).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    share = max(1, min(sample_chars, total_chars // max(1, len({r[0] for r in found}))))
    for lang, _, text in sorted(found, key=lambda r: (r[0], r[1] is None, r[1], r[2])):
        line = letters_of(text)[:share]
        if line and held.get(lang, 0) + len(line) <= share:
            samples.setdefault(lang, []).append(line)
            held[lang] = held.get(lang, 0) + len(line)
    return {k: "".join(v) for k, v in samples.items()}


def predicted(documents: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The columns of ``documents`` as c0, c1, ..., then pred, score and known (whether the text is
    in that language at all). The text travels once."""
    content = documents.sparkSession.sparkContext.broadcast(samples)
    bare = text_batches(documents).select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)])
    at = documents.columns.index("text")

    def run(batches):
        own = parser(content.value)
        for batch in batches:
            found = [own.judged(text.as_py()) for text in batch.column(at)]
            told = [pa.array([x for x, _, _ in found], pa.string()), pa.array([y for _, y, _ in found], pa.float64()), pa.array([z for _, _, z in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "pred", "score", "known"])

    schema = StructType([*bare.schema.fields, StructField("pred", StringType()), StructField("score", DoubleType()), StructField("known", BooleanType())])
    return bare.mapInArrow(run, schema)


def identified(documents: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``documents`` with lang_pred and score; the columns of these names are replaced."""
    kept = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in ("lang_pred", "score")])
    return predicted(kept, samples).drop("known").toDF(*kept.columns, "lang_pred", "score")


def held_out(key):
    """The fold that nothing is learned from; a null key is not in it."""
    return F.coalesce(digest_mod(key, 5) == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    samples = learned_samples(documents.filter(~held_out(F.col("doc_id"))))
    return identified(documents.select("doc_id", "text"), samples).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(documents: DataFrame) -> DataFrame:
    """Pipeline stage: ``documents`` in which a language was recognised, in their own columns. A text
    without letters goes, and one that no language tells in fewer bits than its letters one by one
    (random letters). A null ``lang`` becomes the language found; a given one stays."""
    samples = learned_samples(documents.filter(~held_out(F.col("doc_id"))))
    found = predicted(documents, samples).filter("known")
    at = documents.columns.index("lang")
    return found.withColumn(f"c{at}", F.coalesce(F.col(f"c{at}"), "pred")).drop("pred", "score", "known").toDF(*documents.columns)
