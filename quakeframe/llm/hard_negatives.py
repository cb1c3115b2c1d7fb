"""Hard negatives by k-means inverted lists with stored radii.

Vectors become integers, so that every score (inner product) is exact. A bounded sample gives the
centroids of coarse cells; a cell's rows are dealt into shards of about ``SHARD`` rows, and a task
cuts each shard into k-means lists and stores each list's centroid and radius. The number of lists
thus grows with the rows; only the coarse cells (at most ``CELLS``) reach the driver.

For an anchor a and a list with centroid c and radius r, |<a, x> - <a, c>| <= |a| r (Cauchy-Schwarz).
Inside a shard the lists are visited by falling upper bound; lists whose bounds lie outside the
window of scores are skipped, and the visit stops once the bound is strictly below the k-th score
(equal scores can still win by their id). Two searches use the index: positives (an anchor's own
shard is searched when the shard is built, and gives the least score that the other cells must be
able to reach), then negatives in the windows of the positives. Results are merged by a window
over (anchor) that Spark limits before the shuffle.

Defined results: rows with a null label, or whose vector is null or has null or non-finite
components, take no part; vectors are compared with those of their length (empty ones score 0);
components are held at the size beyond which a hundredfold score might leave a long (over 100,000
for 64 components); rows that repeat a vec_id are rows of their own, and so are equal vectors; a null
vec_id is never an anchor, comes last among equal scores and is returned as null; negative positives
have an empty window; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, table
from quakeframe.llm.integer_vectors import exact_products, integer_rows
from quakeframe.llm.vectors import binary

#: Rows of a shard, rows of one of its lists, coarse cells at most, sampled rows for each cell.
SHARD, LIST, CELLS, SAMPLE = 2048, 64, 1024, 32
SEED = 11
#: Stands for a null vec_id, which comes last.
NO_ID = (1 << 63) - 1


def stacked(column: pa.Array, width: int, dtype="<i4") -> np.ndarray:
    """Packed vectors as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def packed_rows(embeddings: DataFrame, label: Column, anchor: Column, scale: int) -> DataFrame:
    """id, label, anchor, width, q of the rows that take part."""

    def run(batches):
        for batch in batches:
            vectors, rest = batch.column(3), batch.select(["id", "label", "anchor"])
            for width in np.unique(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).tolist():
                rows, taken = integer_rows(vectors, width, scale, min(isqrt((1 << 62) // (100 * max(width, 1))), (1 << 31) - 1))
                kept = rest.filter(pa.array(taken))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.full(len(rows), width), pa.int32()), binary(rows) if width else pa.array([b""] * len(rows), pa.binary())], ["id", "label", "anchor", "width", "q"])

    slim = embeddings.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), "embedding"
    )
    return slim.filter("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "id long, label long, anchor boolean, width int, q binary")


def lloyd(x: np.ndarray, k: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """k centroids of the rows of x, and each row's own: k-means from seeded rows."""
    centroids = x[np.sort(np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(rounds):
        own = nearest(x, centroids)
        count = np.bincount(own, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    return centroids, nearest(x, centroids)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centroids.T).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def spread_of(x: np.ndarray, centroid: np.ndarray) -> float:
    """Largest distance of a row to the centroid, never too small."""
    return float(np.sqrt(((x - centroid) ** 2).sum(1).max(initial=0.0))) * (1 + 1e-9)


def bounds(a: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bound of the scores of a with the rows of each list."""
    middle, length = centroids @ a, np.sqrt(a @ a)
    slack = length * (radii + np.sqrt((centroids**2).sum(1)) * 1e-9) * (1 + 1e-9) + 1e-6
    return middle + slack, middle - slack


class Cells:
    """Coarse cells of all lengths: centroids, then radii and shards."""

    def __init__(self, centroids: dict[int, np.ndarray]):
        self.centroids, self.first, n = centroids, {}, 0
        for width, c in sorted(centroids.items()):
            self.first[width], n = n, n + len(c)
        self.radii, self.parts, self.shard = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def place(self, x: np.ndarray, width: int) -> np.ndarray:
        return self.first[width] + nearest(x, self.centroids[width])

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows to tasks by shard: a few shards a task at most while they are few, 64 when they are many."""
        shards, usual = int(self.parts.sum()), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(max(1, min(4 * shards, usual), shards // 64), "shard")

    def reached(self, a: np.ndarray, least: float, most: float = np.inf) -> np.ndarray:
        """Shards of the cells that may hold a score between least and most."""
        own = slice(self.first[len(a)], self.first[len(a)] + len(self.centroids[len(a)]))
        upper, lower = bounds(a, self.centroids[len(a)], self.radii[own])
        cells = np.flatnonzero((upper >= least) & (lower <= most)) + own.start
        return np.concatenate([self.shard[c] + np.arange(self.parts[c]) for c in cells] or [np.empty(0, np.int64)])


def learned_cells(rows: DataFrame) -> Cells:
    """Cells from at most about ``SAMPLE * CELLS`` rows, sized over all rows."""
    counts = {r["width"]: r["count"] for r in rows.groupBy("width").count().collect()}
    total = sum(counts.values())
    wanted = {w: max(1, min(ceil(n / SHARD), CELLS * n // total)) for w, n in counts.items()}
    found: dict[int, list] = {w: [] for w in counts}
    if counts:
        chance = F.create_map(*[x for w, n in counts.items() for x in (F.lit(w), F.lit(min(1.0, SAMPLE * wanted[w] / n)))])
        for r in rows.filter(F.rand(SEED) < chance[F.col("width")]).select("width", "q").collect():
            found[r.width].append(np.frombuffer(r.q, "<i4"))
    cells = Cells({w: lloyd(np.array(x, float).reshape(len(x), w), wanted[w])[0] if x else np.zeros((1, w)) for w, x in found.items()})

    def sizes(batches):
        for batch, width, x in by_width(batches):
            own = cells.place(x, width)
            names = np.unique(own)
            far = [spread_of(x[own == c], cells.centroids[width][c - cells.first[width]]) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(np.bincount(own)[names], pa.int64()), pa.array(far, pa.float64())], ["cell", "n", "far"])

    at = 0
    for cell, n, far in sorted(map(tuple, rows.mapInArrow(sizes, "cell int, n long, far double").groupBy("cell").agg(F.sum("n"), F.max("far")).collect())):
        cells.radii[cell], cells.parts[cell], cells.shard[cell] = far, ceil(n / SHARD), at
        at += ceil(n / SHARD)
    return cells


def by_width(batches, column: str = "q"):
    """Each batch's rows of one length, with the length and the vectors in floating point."""
    for batch in batches:
        widths = batch.column("width").to_numpy(zero_copy_only=False)
        for width in np.unique(widths).tolist():
            part = batch.filter(pa.array(widths == width))
            yield part, width, stacked(part.column(column), width).astype(float)


class Lists:
    """The inverted lists of one shard, rows in the order of the lists."""

    def __init__(self, centroids, radii, sizes, ids, labels, x):
        self.centroids, self.radii, self.ids, self.labels, self.x = centroids, radii, ids, labels, x
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.most, self.real = int(np.abs(x).max(initial=0)), x.astype(float)

    @classmethod
    def built(cls, ids, labels, x):
        centroids, own = lloyd(x.astype(float), ceil(len(x) / LIST))
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=len(centroids))
        x, ids, labels = x[order], ids[order], labels[order]
        cuts = np.cumsum(sizes)[:-1]
        radii = np.array([spread_of(part, c) for part, c in zip(np.split(x.astype(float), cuts), centroids, strict=True)])
        used = sizes > 0
        return cls(centroids[used], radii[used], sizes[used], ids, labels, x), order

    def scores(self, a: np.ndarray, rows) -> np.ndarray:
        if self.most * int(np.abs(a).max(initial=0)) * max(len(a), 1) < 1 << 53:
            return (self.real[rows] @ a.astype(float)).astype(np.int64)
        return exact_products(self.x[rows], a[None])[:, 0]

    def visited(self, a: np.ndarray, wanted):
        """Row numbers and scores, in chunks of lists by falling upper bound. ``wanted`` gives the
        least and the largest score of interest, as they stand."""
        upper, lower = bounds(a.astype(float), self.centroids, self.radii)
        order = np.argsort(-upper, kind="stable")
        at, step = 0, 4
        while at < len(order):
            least, most = wanted()
            if upper[order[at]] < least:
                return
            take = order[at : at + step]
            at, step = at + step, 2 * step
            take = take[(upper[take] >= least) & (lower[take] <= most)]
            if len(take):
                rows = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in take])
                yield rows, self.scores(a, rows)


class Top:
    """The first k of what is offered: higher scores, then smaller ids."""

    def __init__(self, k: int, least: float, most: float = np.inf):
        self.k, self.least, self.most = k, least, most
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores, ids):
        good = (scores >= self.least) & (scores <= self.most)
        if good.any():
            s, i = np.r_[self.scores, scores[good]], np.r_[self.ids, ids[good]]
            order = np.lexsort((i, -s))[: self.k]
            self.scores, self.ids = s[order], i[order]
            if len(order) == self.k:
                self.least = max(self.least, int(self.scores[-1]))


def positives_in(lists: Lists, a, label: int, k: int, least: float, own: int = -1) -> Top:
    """The first rows of the same label; ``own`` is the anchor's row, if it is here."""
    top = Top(k, least)
    for rows, scores in lists.visited(a, lambda: (top.least, np.inf)):
        same = (lists.labels[rows] == label) & (rows != own)
        top.offer(scores[same], lists.ids[rows[same]])
    return top


def negatives_in(lists: Lists, a, label: int, k: int, windows: list[tuple[int, int]]) -> list[Top]:
    """The first rows of other labels in each window of scores."""
    tops = [Top(k, low, high) for low, high in windows]
    for rows, scores in lists.visited(a, lambda: (min(t.least for t in tops), max(t.most for t in tops))):
        other = lists.labels[rows] != label
        for top in tops:
            top.offer(scores[other], lists.ids[rows[other]])
    return tops


INDEX = "shard int, role byte, width int, id long, label long, x binary, centroid binary, radius double, ids binary, labels binary, anchor long"


def built_index(rows: DataFrame, cells: Cells, k: int) -> DataFrame:
    """Role 0: lists (centroid, radius, members). Role 1: anchors, with the first positives of their
    own shard (ids, and their scores in labels)."""

    def deal(batches):
        for batch, width, x in by_width(batches):
            cell = cells.place(x, width)
            mixed = (batch.column("row").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shard = cells.shard[cell] + (mixed % cells.parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    def build(batches):
        for shard, parts in by_shard(batches):
            whole = pa.Table.from_batches(parts).combine_chunks()
            width, n = whole.column("width")[0].as_py(), len(whole)
            ids, labels, anchor = (whole.column(c).to_numpy() for c in ("id", "label", "anchor"))
            x = stacked(whole.column("q").combine_chunks(), width)
            lists, order = Lists.built(ids, labels, x)
            kind = "<i2" if lists.most < 1 << 15 else "<i4"
            out = [
                (shard, 0, width, None, None, lists.x[s:e].astype(kind).tobytes(), lists.centroids[j].tobytes(), float(lists.radii[j]), lists.ids[s:e].astype("<i8").tobytes(), lists.labels[s:e].astype("<i8").tobytes(), None)
                for j, (s, e) in enumerate(zip(lists.starts.tolist(), lists.ends.tolist(), strict=True))
            ]
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            for i in np.flatnonzero(anchor):
                top = positives_in(lists, x[i], labels[i], k, -np.inf, place[i])
                out.append((shard, 1, width, int(ids[i]), int(labels[i]), x[i].tobytes(), None, None, top.ids.astype("<i8").tobytes(), top.scores.astype("<i8").tobytes(), int(whole.column("row")[int(i)].as_py())))
            yield from listed(out, INDEX)

    dealt = rows.mapInArrow(deal, "shard int, row long, id long, label long, anchor boolean, width int, q binary")
    return checkpointed(cells.dealt(dealt).sortWithinPartitions("shard").mapInArrow(build, INDEX))


KINDS = {"int": pa.int32(), "long": pa.int64(), "byte": pa.int8(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def listed(out: list[tuple], kind: str):
    fields = [f.split() for f in kind.split(", ")]
    for at in range(0, len(out), 1000):
        columns = list(zip(*out[at : at + 1000], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def by_shard(batches):
    """(shard, batches) for each run of one shard in rows sorted by it."""
    held, at = [], None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)] if len(shards) else np.zeros(1, int)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and shards[a] != at:
                yield at, held
                held = []
            at = int(shards[a])
            held.append(batch.slice(a, z - a))
    if held:
        yield at, held


def loaded(parts: list[tuple], width: int) -> Lists:
    """Lists from their rows (centroid, radius, ids, labels, x)."""
    sizes = np.array([len(p[2]) // 8 for p in parts])
    x = [np.frombuffer(p[4], "<i2" if len(p[4]) == 2 * width * n else "<i4").reshape(n, width) for p, n in zip(parts, sizes, strict=True)]
    longs = [np.frombuffer(b"".join(p[i] for p in parts), "<i8") for i in (2, 3)]
    return Lists(np.array([np.frombuffer(p[0]) for p in parts]).reshape(len(parts), width), np.array([p[1] for p in parts]), sizes, *longs, np.concatenate(x).astype(np.int32))


def searched(index: DataFrame, visits: DataFrame, cells: Cells, look, kind: str) -> DataFrame:
    """``look(lists, visit)`` for each visit (shard, role, then whatever ``look`` reads) of a shard. A task
    holds the lists of one shard and meets its visitors batch by batch."""
    lists = index.filter("role = 0").select("shard", "role", "width", "centroid", "radius", "ids", "labels", "x")
    both = lists.unionByName(visits, allowMissingColumns=True)

    def run(batches):
        at, parts, held = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != at:
                    at, parts, held = row["shard"], [], None
                if row["role"] == 0:
                    parts.append((row["centroid"], row["radius"], row["ids"], row["labels"], row["x"]))
                elif parts:
                    held = held or loaded(parts, row["width"])
                    out += look(held, row)
            yield from listed(out, kind)

    return cells.dealt(both).sortWithinPartitions("shard", "role").mapInArrow(run, kind)


def routed(anchors: DataFrame, cells: Cells, shards_of, extra: list[str], kind: str) -> DataFrame:
    """A visit for each shard that an anchor has to see."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                shards = shards_of(cells, {k: v[0] for k, v in row.to_pydict().items()})
                again = row.take(pa.array(np.zeros(len(shards), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(np.ones(len(shards), np.int8)), *[again.column(c) for c in extra]], ["shard", "role", *extra])

    return anchors.mapInArrow(run, kind)


def first_by_score(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows (id, score) of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and largest negative score for each distinct positive score, in whole numbers."""
    return [(-(-low * s // 100), high * s // 100) for s in sorted(set(scores))]


def hard_negatives(
    embeddings: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor row and
    each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is from ``low`` to ``high`` percent of the positive's."""
    rows = checkpointed(packed_rows(embeddings, label, anchor, scale).select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "width", "q"))
    cells = learned_cells(rows)
    index = built_index(rows, cells, positives)
    anchors = index.filter("role = 1").select("anchor", "id", "label", "width", "x", "shard", "ids", "labels")

    def beyond_home(cells, row):
        scores = np.frombuffer(row["labels"], "<i8")
        reached = cells.reached(np.frombuffer(row["x"], "<i4").astype(float), scores[-1] if len(scores) == positives else -np.inf)
        return reached[reached != row["shard"]]

    def look_positive(lists, row):
        known = np.frombuffer(row["labels"], "<i8")
        top = positives_in(lists, np.frombuffer(row["x"], "<i4"), row["label"], positives, known[-1] if len(known) == positives else -np.inf)
        return [(row["anchor"], i, s) for i, s in zip(top.ids.tolist(), top.scores.tolist(), strict=True)]

    def at_home(batches):
        for batch in batches:
            out = [
                (who, i, s)
                for who, ids, scores in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ids", "labels")), strict=True)
                for i, s in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(scores, "<i8").tolist(), strict=True)
            ]
            yield from listed(out, "anchor long, id long, score long")

    found = "anchor long, id long, score long"
    visit = "shard int, role byte, anchor long, label long, width int, x binary"
    away = searched(index, routed(anchors, cells, beyond_home, ["anchor", "label", "width", "x", "labels"], visit + ", labels binary"), cells, look_positive, found)
    best = checkpointed(first_by_score(anchors.mapInArrow(at_home, found).unionByName(away), ["anchor"], positives).select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")))

    asked = best.groupBy("anchor").agg(F.collect_set("positive_score").alias("wanted"))  # at most ``positives`` scores
    asked = anchors.select("anchor", "label", "width", "x").join(asked, "anchor")

    def in_windows(cells, row):
        windows = [w for w in windows_of(row["wanted"], low, high) if w[0] <= w[1]]
        if not windows:
            return np.empty(0, np.int64)
        return cells.reached(np.frombuffer(row["x"], "<i4").astype(float), min(a for a, _ in windows), max(b for _, b in windows))

    def look_negative(lists, row):
        scores = sorted(set(row["wanted"]))
        pairs = [(s, w) for s, w in zip(scores, windows_of(scores, low, high), strict=True) if w[0] <= w[1]]
        tops = negatives_in(lists, np.frombuffer(row["x"], "<i4"), row["label"], negatives, [w for _, w in pairs])
        return [(row["anchor"], s, i, x) for (s, _), top in zip(pairs, tops, strict=True) for i, x in zip(top.ids.tolist(), top.scores.tolist(), strict=True)]

    seen = searched(index, routed(asked, cells, in_windows, ["anchor", "label", "width", "x", "wanted"], visit + ", wanted array<long>"), cells, look_negative, "anchor long, positive_score long, id long, score long")
    ranked = first_by_score(seen, ["anchor", "positive_score"], negatives)
    named = best.join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    no_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return ranked.join(named, ["anchor", "positive_score"]).select(
        "anchor_id", no_id("positive").alias("positive_id"), "rank", no_id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


OP11_SQL = """
WITH part AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF isfinite(x)]) = len(embedding)),
scored AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM part a JOIN part b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negative AS (
    SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = (F.col("label").cast("long") + 1) % 10
    return hard_negatives(
        table(spark, sf_dir, "embeddings"),
        anchor=F.col("vec_id") % 100 == 0,
        label=F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("long")),
    )
