"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a fixed orthogonal matrix and split into blocks of about ``BLOCK``
dimensions. Two vectors within squared distance t are, in one block at least, within that block's
proportional part of t. In each block a range join finds such pairs: a vector lives in the cell of
its nearest pivot and visits the cells that its range can reach (a half-space bound, exact for any
pivots); a pair meets once a block, in the later of its two cells. Cells are cut into tiles of
bounded size, which a task streams through. The union of the candidates is verified by the cosine
in double precision.

Equal vectors are one class with a weight. Dense groups (classes within half the angle of a common
centre) are linked throughout by the triangle inequality of angles, so their members are counted
and never paired with each other. The number of centres is bounded by the number of signatures
(2 ** ``SIGNATURE_BITS``), that of pivots and tiles by parameters of the plan, and only these reach
the driver.

Defined results: vectors that are null, zero, or with null or non-finite components link with nothing
and are their own component; vectors of different lengths do not link, those of each length are
compared with each other; rows that repeat a vec_id are vectors of their own; a cosine equal to the
threshold links; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import acos, ceil, cos, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, hash_fraction, table
from quakeframe.llm.graph import connected_components, join_frequent

BLOCK = 16
SIGNATURE_BITS = 12
TILE = 4096
LEAST_DENSE = 16
SEED = 6


def unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    n = len(column)
    good = np.array([len(x) == width if x is not None else False for x in (v.values if v.is_valid else None for v in column)], bool)
    rows = np.zeros((n, width))
    if good.any():
        kept = column.filter(pa.array(good)).flatten()
        bare = np.asarray(kept.to_numpy(zero_copy_only=False), float).reshape(-1, width)
        rows[good] = bare
    with np.errstate(all="ignore"):
        good &= np.isfinite(rows).all(1)
        rows[~good] = 0.0
        scale = np.abs(rows).max(1, initial=0.0)
        good &= scale > 0
        rows[good] /= scale[good, None]
        rows[good] /= np.sqrt((rows[good] ** 2).sum(1))[:, None]
    return rows, good


def binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    if len(rows) == 0:
        return pa.array([], pa.binary())
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


class Geometry:
    """Rotation, blocks, their ranges, and what is learned about the data: pivots and centres."""

    def __init__(self, width: int, threshold: float):
        self.width, self.threshold = width, threshold
        q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
        self.rotation = q * np.sign(np.diag(r))
        k = max(1, round(width / BLOCK))
        cuts = [round(i * width / k) for i in range(k + 1)]
        self.blocks = [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        budget = 2 - 2 * threshold
        self.reach = [sqrt(budget * (b.stop - b.start) / width) * (1 + 1e-6) + 1e-6 for b in self.blocks]
        self.half = cos(acos(threshold) / 2) + 1e-9  # least cosine to the centre of a dense group
        self.dense_chord = sqrt(2 - 2 * self.half)
        self.centres = np.empty((0, width))
        self.pivots: list[np.ndarray] = []
        self.tiles: dict[tuple[int, int], list[tuple[int, int, int]]] = {}  # (block, cell) -> (group, parts, first tile)

    def signatures(self, rows: np.ndarray) -> np.ndarray:
        bits = min(SIGNATURE_BITS, self.width)
        return ((rows @ self.rotation[:, :bits]) > 0) @ (1 << np.arange(bits))

    def dense_group(self, rows: np.ndarray, least: float) -> np.ndarray:
        """Index of the nearest centre if it is near enough, else -1."""
        if not len(self.centres) or not len(rows):
            return np.full(len(rows), -1)
        near = rows @ self.centres.T
        best = near.argmax(1)
        return np.where(near[np.arange(len(rows)), best] >= least, best, -1)

    def cells(self, rotated: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Own cell of each row, and the matrix of cells that its range can reach."""
        p, x = self.pivots[block], rotated[:, self.blocks[block]]
        d2 = (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)
        own = d2.argmin(1)
        gap = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2), 0))
        reached = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * self.reach[block] * gap[own] + 1e-9
        return own, reached


def _summed(rows: DataFrame, context, label) -> list[tuple[int, int, np.ndarray]]:
    """(label, count, vector sum) over the classes, by ``label(geometry, rows)``; -1 is left out."""

    def partial(batches):
        own = context.value
        held: dict[int, list] = {}
        for batch in batches:
            units = matrix(batch.column(1), np.float64, own.width)
            for name, x in zip(label(own, units).tolist(), units, strict=True):
                if name >= 0:
                    entry = held.setdefault(name, [0, np.zeros(own.width)])
                    entry[0] += 1
                    entry[1] += x
        yield from packed(held, own.width)

    def merge(batches):
        held: dict[int, list] = {}
        width = context.value.width
        for batch in batches:
            for name, n, total in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), matrix(batch.column(2), np.float64, width), strict=True):
                entry = held.setdefault(name, [0, np.zeros(width)])
                entry[0] += n
                entry[1] += total
        yield from packed({k: v for k, v in held.items() if v[0] >= LEAST_DENSE}, width)

    def packed(held, width):
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), binary(np.array([v[1] for v in held.values()]).reshape(-1, width))],
            ["name", "n", "total"],
        )

    kind = "name int, n long, total binary"
    found = rows.select("cid", "unit").mapInArrow(partial, kind).repartition("name").mapInArrow(merge, kind).collect()
    return sorted((r.name, r.n, np.frombuffer(r.total)) for r in found)


def learn(classes: DataFrame, geometry: Geometry, n: int) -> Geometry:
    """Centres of dense groups, and pivots from a sample of at most about 3 * sqrt(n) classes."""
    sc = classes.sparkSession.sparkContext
    first = _summed(classes, sc.broadcast(geometry), lambda own, x: own.signatures(x))
    loud = sorted(((c, s / np.linalg.norm(s)) for _, c, s in first if np.linalg.norm(s) >= 0.5 * c), key=lambda t: -t[0])
    for _, centre in loud:
        if not len(geometry.centres) or (geometry.centres @ centre).max() < geometry.threshold:
            geometry.centres = np.vstack([geometry.centres, centre])
    if len(geometry.centres):
        again = _summed(classes, sc.broadcast(geometry), lambda own, x: own.dense_group(x, 0.9))
        geometry.centres = np.array([s / np.linalg.norm(s) for _, _, s in again]).reshape(-1, geometry.width)
    wanted = min(1024, max(8, ceil(sqrt(n) / 2)))
    chance = min(1.0, 4.0 * wanted / max(n, 1))
    sample = classes.filter(hash_fraction(F.col("cid"), SEED) < chance).select("cid", "unit").collect()
    points = np.array([np.frombuffer(r.unit) for r in sorted(sample)]).reshape(-1, geometry.width)
    free = points[geometry.dense_group(points, geometry.half) < 0] if len(points) else points
    points = (free if len(free) else points)[:wanted] @ geometry.rotation
    geometry.pivots = [points[:, b] for b in geometry.blocks]
    return geometry


def plan_tiles(classes: DataFrame, geometry: Geometry) -> Geometry:
    """Number the tiles: parts of at most about ``TILE`` rows of each block, cell and dense group."""
    context = classes.sparkSession.sparkContext.broadcast(geometry)

    def count(batches):
        own, held = context.value, {}
        for batch in batches:
            units = matrix(batch.column(1), np.float64, own.width)
            group, rotated = own.dense_group(units, own.half), units @ own.rotation
            for b in range(len(own.blocks)):
                for cell, g in zip(own.cells(rotated, b)[0].tolist(), group.tolist(), strict=True):
                    held[b, cell, g] = held.get((b, cell, g), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in held], pa.int32()) for i in range(3)] + [pa.array(list(held.values()), pa.int64())], ["b", "cell", "g", "n"])

    sums = classes.select("cid", "unit").mapInArrow(count, "b int, cell int, g int, n long").groupBy("b", "cell", "g").agg(F.sum("n").alias("n")).collect()
    at = 0
    for b, cell, g, n in sorted(map(tuple, sums)):
        parts = ceil(n / TILE)
        geometry.tiles.setdefault((b, cell), []).append((g, parts, at))
        at += parts
    return geometry


def dealt(classes: DataFrame, geometry: Geometry) -> DataFrame:
    """tile, role (0 lives there, 1 visits), cid, g, block, x: the rows of the range join."""
    context = classes.sparkSession.sparkContext.broadcast(geometry)

    def run(batches):
        own = context.value
        for whole in batches:
            for start in range(0, len(whole), 2000):
                batch = whole.slice(start, 2000)
                cid = batch.column(0).to_numpy(zero_copy_only=False)
                units = matrix(batch.column(1), np.float64, own.width)
                group, rotated = own.dense_group(units, own.half), units @ own.rotation
                for b, part in enumerate(own.blocks):
                    yield from block_rows(own, b, cid, group, rotated, rotated[:, part])

    def block_rows(own, b, cid, group, rotated, x):
        cell, reached = own.cells(rotated, b)
        spread = (cid.astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(16)
        home = np.zeros(len(cid), np.int64)
        for i, (c, g) in enumerate(zip(cell.tolist(), group.tolist(), strict=True)):
            _, parts, first = next(t for t in own.tiles[b, c] if t[0] == g)
            home[i] = first + int(spread[i]) % parts
        tile, who, role = [home], [np.arange(len(cid))], [np.zeros(len(cid), np.int8)]
        centres = own.centres @ own.rotation[:, own.blocks[b]] if len(own.centres) else None
        for c in range(len(own.pivots[b])):
            near = np.flatnonzero(reached[:, c])
            for g, parts, first in own.tiles.get((b, c), ()) if len(near) else ():
                rows = near
                if g >= 0:
                    rows = rows[group[rows] != g]
                    rows = rows[np.sqrt(((x[rows] - centres[g]) ** 2).sum(1)) <= own.reach[b] + own.dense_chord + 1e-9]
                for t in range(first, first + parts):
                    later = rows[home[rows] < t]
                    if len(later):
                        tile.append(np.full(len(later), t))
                        who.append(later)
                        role.append(np.ones(len(later), np.int8))
        who = np.concatenate(who)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tile), pa.int32()), pa.array(np.concatenate(role), pa.int8()), pa.array(cid[who], pa.int64()), pa.array(group[who], pa.int32()), pa.array(np.full(len(who), b), pa.int8()), binary(x[who].astype(np.float32))],
            ["tile", "role", "cid", "g", "block", "x"],
        )

    return classes.select("cid", "unit").mapInArrow(run, "tile int, role byte, cid long, g int, block byte, x binary")


def close_pairs(rows: DataFrame, geometry: Geometry) -> DataFrame:
    """Candidate pairs (a, b), a < b: within the range of some block. A task streams through its
    tiles: it holds the rows that live in one, and meets the visitors batch by batch."""
    reach, widths = geometry.reach, [b.stop - b.start for b in geometry.blocks]

    def run(batches):
        tile, block, cid, group, x = -1, 0, np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            tiles = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(np.diff(tiles)) + 1, len(tiles)] if len(tiles) else [0]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, z - a)
                if tiles[a] != tile:
                    tile, block = int(tiles[a]), part.column(4)[0].as_py()
                    cid, group, x = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, widths[block]), np.float32)
                own, g = part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                y = matrix(part.column(5), np.float32, widths[block])
                lives = part.column(1).to_numpy(zero_copy_only=False) == 0
                if lives.any():
                    inside = y[lives]
                    if g[lives][0] < 0:  # a dense group's own pairs are known
                        yield from met(inside, own[lives], g[lives], x, cid, group, block)
                        yield from met(inside, own[lives], g[lives], inside, own[lives], g[lives], block, True)
                    cid, group, x = np.r_[cid, own[lives]], np.r_[group, g[lives]], np.vstack([x, inside])
                if not lives.all():
                    yield from met(y[~lives], own[~lives], g[~lives], x, cid, group, block)

    def met(y, own, g, x, cid, group, block, same=False):
        limit, length = np.float32(reach[block] ** 2 + 2e-6), (x**2).sum(1)
        for at in range(0, len(y) if len(x) else 0, 1024):
            rows = y[at : at + 1024]
            i, j = np.nonzero((rows**2).sum(1)[:, None] - 2 * rows @ x.T + length <= limit)
            i += at
            keep = (g[i] < 0) | (g[i] != group[j])
            if same:
                keep &= i < j
            if keep.any():
                a, b = own[i[keep]], cid[j[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, geometry: Geometry) -> DataFrame:
    """The pairs whose cosine in double precision reaches the threshold."""
    width, threshold = geometry.width, geometry.threshold
    units = classes.select("cid", "unit")
    joined = pairs.join(units.toDF("a", "u"), "a").join(units.toDF("b", "v"), "b").select("a", "b", "u", "v")

    def run(batches):
        for batch in batches:
            u, v = matrix(batch.column(2), np.float64, width), matrix(batch.column(3), np.float64, width)
            yield batch.select(["a", "b"]).filter(pa.array((u * v).sum(1) >= threshold))

    return joined.mapInArrow(run, "a long, b long")


def near_vectors(embeddings: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings``: a join for each length."""
    sizes = sorted(r[0] for r in embeddings.select(F.size("embedding")).filter("embedding IS NOT NULL").distinct().collect() if r[0] > 0)
    found = embeddings.filter("embedding IS NULL OR size(embedding) = 0").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    for width in sizes:
        found = found.unionByName(near_of_length(embeddings.filter(F.size("embedding") == width), width, threshold))
    return found


def near_of_length(embeddings: DataFrame, width: int, threshold: float) -> DataFrame:
    """The same for vectors of one length."""
    spark, geometry = embeddings.sparkSession, Geometry(width, threshold)

    def units(batches):
        for batch in batches:
            rows, good = unit_rows(batch.column(1), width)
            packed = binary(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.as_py() if g else None for x, g in zip(packed, good, strict=True)], pa.binary())], ["vec_id", "unit"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    bare = embeddings.select("vec_id", "embedding").mapInArrow(units, f"vec_id {kind}, unit binary")
    rows = checkpointed(bare.select("vec_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("unit", 256)).alias("digest"), "unit"))
    valid = rows.filter("unit IS NOT NULL")
    classes = checkpointed(
        valid.groupBy("digest").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min(F.struct("row", "unit")).alias("first"))
        .select("digest", "n", "least", F.col("first.row").alias("cid"), F.col("first.unit").alias("unit"))
    )
    geometry = plan_tiles(classes, learn(classes, geometry, classes.count()))
    links = checkpointed(verified(close_pairs(dealt(classes, geometry), geometry), classes, geometry))

    context = spark.sparkContext.broadcast(geometry)

    def grouped(batches):
        own = context.value
        for batch in batches:
            g = own.dense_group(matrix(batch.column(1), np.float64, own.width), own.half)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(g, pa.int32())], ["cid", "g"])

    dense = checkpointed(classes.select("cid", "unit").mapInArrow(grouped, "cid long, g int").filter("g >= 0"))
    slim = classes.select("cid", "digest", "n", "least").join(dense, "cid", "left")
    totals = F.broadcast(checkpointed(slim.filter("g IS NOT NULL").groupBy("g").agg(F.sum("n").alias("in_group"), F.min("cid").alias("lead"))))  # at most 2 ** SIGNATURE_BITS rows
    known = checkpointed(slim.join(totals, "g", "left").select("cid", "digest", "n", "least", F.coalesce("lead", "cid").alias("node"), F.coalesce("in_group", "n").alias("in_group")))
    node = known.select("cid", "node", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(node.select(F.col("cid").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("outside"))
    ends = links.join(node.select(F.col("cid").alias("a"), F.col("node").alias("x")), "a").join(node.select(F.col("cid").alias("b"), F.col("node").alias("y")), "b")
    roots = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("node", "root")
    least = known.groupBy("node").agg(F.min("least").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = checkpointed(least)
    parts = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_frequent(least.select("node", "root"), checkpointed(parts), "root").select("node", "component_id")
    sizes = checkpointed(known.groupBy("node").agg(F.count("*").alias("n")).join(named, "node"))
    placed = join_frequent(known.withColumnRenamed("n", "weight"), sizes, "node")
    lookup = checkpointed(
        placed.join(outside.toDF("cid", "outside"), "cid", "left").select(
            "digest", F.col("weight").alias("n"), "component_id", (F.col("in_group") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links")
        )
    )
    found = join_frequent(valid.select("vec_id", "digest"), lookup, "digest").select("vec_id", "n_links", "component_id")
    alone = rows.filter("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
