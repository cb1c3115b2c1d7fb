"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear
hinge-loss model fitted by dual coordinate descent.

Features of a text, each present or not: the n-grams (1 to 3) of its words and of its word shapes
(``Ab%%%`` is ``Aa%``), and word repetitions (``w w``, ``w w w``, ``w w w w``), hashed to
``DIMENSIONS`` slots. The vector of a text is scaled to length one, the fitted weights are drawn
towards their mean magnitude (``shrink``), and margins become probabilities by a logistic fit on a
part of the sample that the weights did not see, moved to the class shares of all labelled rows.

Learning uses at most about ``1.25 * rows`` labelled rows of each class, by seeded hash, and of each
at most ``excerpt`` words from a seeded place, so that what reaches the driver is bounded. All rows
are scored, whole.

Defined results: null and empty texts get the score of a text without features; if fewer than two
classes are labelled the score is their share (0.5 with no label); a null label teaches nothing; a
score of 0.5 predicts 1; a null doc_id is not held out; rows that repeat are answered each; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.bpe import Memo
from quakeframe.llm.common import bounded_sample, digest_mod, table, text_batches

DIMENSIONS = 1 << 20
REPEATED = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters by case, digits as 9, other signs as they are; runs count once."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return REPEATED.sub(r"\1", kinds)


def slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) % DIMENSIONS


#: Hashes by word, in each worker.
_word = Memo(lambda w: zlib.crc32(w.encode()))
_shape = Memo(lambda w: zlib.crc32(shape(w).encode()))


def features(text: str | None) -> np.ndarray:
    """Distinct slots of the text's features, ascending."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(_word.__getitem__, words), np.uint64, len(words))
    s = np.fromiter(map(_shape.__getitem__, words), np.uint64, len(words))
    found = [w % DIMENSIONS, (s * 2654435761 + 1) % 4294967291 % DIMENSIONS]
    for x, salt in ((w, 4), (s, 2)):
        if len(x) > 1:
            two = (x[:-1] * 40503 + x[1:] * 69069 + salt) % 4294967291
            found.append(two % DIMENSIONS)
        if len(x) > 2:
            found.append((two[:-1] * 40503 + x[2:] * 16807 + salt + 1) % 4294967291 % DIMENSIONS)
    same = w[:-1] == w[1:]
    for n in (2, 3, 4):
        if not same.any():
            break
        found.append(np.array([slot("repeat", str(n))], np.uint64))
        same = same[:-1] & same[1:]
    return np.unique(np.concatenate(found)).astype(np.int64)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, least: int = 3) -> np.ndarray:
    """log of each feature's share among label 1 over its share among label 0, smoothed by one;
    zero for features of fewer than ``least`` rows."""
    counts = [np.bincount(np.concatenate([x for x, y in zip(rows, labels, strict=True) if y == k] or [np.empty(0, np.int64)]), minlength=DIMENSIONS) for k in (0, 1)]
    smooth = [(c + 1.0) / (c.sum() + DIMENSIONS) for c in counts]
    return np.where(counts[0] + counts[1] >= least, np.log(smooth[1] / smooth[0]), 0.0)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, seed: int = 3):
    """Weights (the last one the bias) that minimise |w|^2 / 2 + cost * sum of hinge losses."""
    sign = np.where(labels == 1, 1.0, -1.0)
    w, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    norm = np.array([x @ x + 1.0 for _, x in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            gradient = sign[i] * (w[at] @ x + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                w[at] += step * x
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def logistic_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the probability of label 1, by Newton's method."""
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-6), float(b)


class Model:
    """Ratios, weights, and the logistic map. ``weights`` is None if the score is constant."""

    def __init__(self, ratios=None, weights=None, bias=0.0, slope=1.0, offset=0.0, constant=0.5):
        self.ratios, self.weights, self.bias, self.slope, self.offset, self.constant = ratios, weights, bias, slope, offset, constant

    def margin(self, found: np.ndarray) -> float:
        r = self.ratios[found]
        length = float(np.sqrt(r @ r))
        return self.bias + (float(self.weights[found] @ r) / length if length else 0.0)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, shares: dict[int, float], shrink: float = 0.75) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels[0]) if len(labels) else 0.5)
    learn = np.arange(len(rows)) % 5 != 0
    if len(set(labels[learn].tolist())) < 2 or len(set(labels[~learn].tolist())) < 2:
        learn[:] = True
    ratios = log_count_ratios([x for x, t in zip(rows, learn, strict=True) if t], labels[learn])
    scaled = []
    for x in rows:
        x = x[ratios[x] != 0]
        r = ratios[x]
        scaled.append((x, r / max(float(np.sqrt(r @ r)), 1e-12)))
    w = dual_coordinate_descent([s for s, t in zip(scaled, learn, strict=True) if t], labels[learn])
    bias, w = float(w[-1]), w[:-1]
    used = ratios != 0
    weights = np.where(used, (1 - shrink) * np.abs(w[used]).mean() + shrink * w, 0.0) if used.any() else w
    model = Model(ratios.astype(np.float32), weights.astype(np.float32), bias)
    rest = ~learn if (~learn).any() else learn
    margins = np.array([model.margin(x) for x, t in zip(rows, rest, strict=True) if t])
    model.slope, model.offset = logistic_fit(margins, labels[rest])
    ones = labels[rest].mean()
    model.offset += float(np.log(shares[1] / shares[0]) - np.log(ones / (1 - ones)))
    return model


def excerpt_of(text: str | None, key, words: int) -> str | None:
    """At most so many words of a text, from a place that the key seeds."""
    found = (text or "").split()
    if len(found) <= words:
        return text
    at = zlib.crc32(f"place {key}".encode()) % (len(found) - words + 1)
    return " ".join(found[at : at + words])


def learned_model(documents: DataFrame, labels: DataFrame, rows: int = 2500, excerpt: int = 4000, seed: int = 3) -> Model:
    """The model of (doc_id, quality) ``labels`` over the texts of ``documents``."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    sample = bounded_sample(known, "quality", "doc_id", rows, seed)
    texts = text_batches(documents).select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")

    def run(batches):
        for batch in batches:
            found = [features(excerpt_of(text.as_py(), key.as_py(), excerpt)).astype(np.int32).tobytes() for key, text in zip(batch.column(0), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "quality", "slots"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    found = texts.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, slots binary").collect()
    found.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[1], r[2]))
    total = sum(counts.values())
    shares = {k: counts.get(k, 0) / total if total else 0.5 for k in (0, 1)}
    return fit([np.frombuffer(r[2], np.int32).astype(np.int64) for r in found], np.array([r[1] for r in found], np.int64), shares)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for each row."""
    content = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = content.value
        for batch in batches:
            scores = np.array([own.score(text.as_py()) for text in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return text_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(digest_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = learned_model(documents, labels.filter(~held))
    return scored(documents, model).select("doc_id", held.alias("held_out"), "score", "predicted")
