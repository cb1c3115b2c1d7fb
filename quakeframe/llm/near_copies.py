"""SimHash near-dedup of texts whose sets of five-word shingles have a similarity of 0.8 or more.

The signatures are those of op2 at a larger radius. A fingerprint has 128 bits over the distinct
shingles. It is cut into segments, in several orders of its bits where one order has too few; each
segment is indexed under its variants with one bit wiped, and equal variants at the same bit meet by
an equality join. The segments are as wide as keeps a bucket near ``BUCKET`` fingerprints, and as
many as let a pair at the threshold meet with probability ``RECALL``: of its 128 bits about 19
differ, too many for a guarantee by counting. What meets within ``LIMIT`` bits is a candidate, in the
first bucket that both share only, and every link is checked on the whole sets of shingles.

Fingerprints of a bucket that hang together in more than ``DENSE`` are candidates with their middle
one only. What hangs together by candidates with such stars is a family. Its members are compared
with its middle one, and those that are not similar to that with all of the family, in blocks of
bounded bytes: first by fingerprints of ``WIDE`` words, then on the sets; only links that join
components leave a block.

Defined results: a text of fewer words is one shingle; null and empty texts have no shingle and are
copies of each other; rows that repeat are copies; further columns are kept; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import acos, ceil, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, released, text_batches
from quakeframe.llm.graph import connected_components, join_frequent
from quakeframe.llm.rows import drop_marked, marks, row_key, small_side
from quakeframe.llm.vectors import binary

WIDTH = 5
SEED = 42
THRESHOLD = 0.8
BITS = 128
LIMIT = 32
RECALL = 0.99
BUCKET = 1024
DENSE = 8
NARROWEST = 12
WIDE = 16
#: Bits of 64 * WIDE in which sets at the threshold differ: the mean and 3.2 deviations.
WIDE_LIMIT = 192
BLOCK_BYTES = 4 << 20


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    found = map(b" ".join, zip(*[words[i:] for i in range(WIDTH)], strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64))


def fingerprint(found: np.ndarray, words: int = 2) -> np.ndarray:
    """The SimHash of a set of hashes: so many words of 64 bits; zero for the empty set."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), 4096):
        z = found[at : at + 4096, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(found), bitorder="little").view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= threshold


def segments(rows: int) -> np.ndarray:
    """Bit numbers of each segment (one row each) for an index of so many fingerprints."""
    width = min(BITS // 2, max(NARROWEST, ceil(log2(max(rows, 2) / BUCKET))))
    differs = acos(2 * THRESHOLD / (1 + THRESHOLD)) / pi  # of a bit, for equal sizes at the threshold
    apart = [comb(BITS, d) * differs**d * (1 - differs) ** (BITS - d) for d in range(LIMIT + 1)]
    meets = [(comb(BITS - d, width) + d * comb(BITS - d, width - 1)) / comb(BITS, width) for d in range(LIMIT + 1)]
    wanted, rng, found = 1, np.random.default_rng(SEED), []
    while sum(p * (1 - (1 - m) ** wanted) for p, m in zip(apart, meets, strict=True)) < RECALL:
        wanted += 1
    order = np.arange(BITS)
    while len(found) < wanted:
        found += list(order[: BITS // width * width].reshape(-1, width))
        order = rng.permutation(BITS)
    return np.array(found[:wanted])


def bits_of(words: np.ndarray) -> np.ndarray:
    """Rows of two words as rows of 128 bits."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")


def fingerprints(documents: DataFrame) -> DataFrame:
    """row (null ids last, then by id and text) and fp for each row of ``documents``."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(shingles(text.as_py())) for text in batch.column(1)], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(prints)], ["row", "fp"])

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row_key().alias("key"))
    rows = text_batches(documents).select(order.alias("row"), "text")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp binary")


def variants(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """key, x, y for each segment of a fingerprint and each bit wiped in it; other columns follow."""
    width = cuts.shape[1]
    values = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for batch in batches:
        words = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
        bits = bits_of(words).astype(np.uint64)
        ends = [pa.array(np.tile(words[:, i].view(np.int64), width)) for i in (0, 1)]
        rest = [pa.concat_arrays([c] * width) for c in batch.columns[1:]]
        for s, cut in enumerate(cuts):
            value = bits[:, cut] @ values
            keys = [(value & ~one) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s * width + j) for j, one in enumerate(values)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *ends, *rest], ["key", "x", "y", *batch.schema.names[1:]])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of one key after the other, from rows sorted by ``key``, the first column."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        whole = [np.concatenate(pair) for pair in zip(held, own, strict=True)] if held else own
        keys = whole[0]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        many = np.flatnonzero(np.diff(starts) > 1)  # a row alone has no partner
        for at, end in zip(starts[many].tolist(), starts[many + 1].tolist(), strict=True):
            yield [c[at:end] for c in whole]
        held = [c[starts[-1] :] for c in whole]  # the last key may go on in the next batch
    if held and len(held[0]) > 1:
        yield held


def apart(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (x, y) and (u, v)."""
    return np.bitwise_count(x ^ u) + np.bitwise_count(y ^ v)


def near_pairs(x: np.ndarray, y: np.ndarray, most: int = 200_000) -> tuple[np.ndarray, np.ndarray] | None:
    """Index pairs i < j of fingerprints at most ``LIMIT`` bits apart; None if there are very many."""
    left, right, rows = [], [], max(1, (1 << 21) // len(x))
    for at in range(0, len(x), rows):
        i, j = np.nonzero(apart(x[at : at + rows, None], y[at : at + rows, None], x[at:], y[at:]) <= LIMIT)
        up = i < j
        left.append(i[up] + at)
        right.append(j[up] + at)
        most -= len(left[-1])
        if most < 0:
            return None
    return np.concatenate(left), np.concatenate(right)


def families(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Indices of fingerprints that hang together by steps of at most ``LIMIT`` bits."""
    left, found = np.arange(len(x)), []
    while len(left):
        own, left, at = [left[:1]], left[1:], 0
        while at < len(own) and len(left):
            for k in own[at]:
                near = apart(x[left], y[left], x[k], y[k]) <= LIMIT
                if near.any():
                    own.append(left[near])
                    left = left[~near]
                    if not len(left):
                        break
            at += 1
        found.append(np.concatenate(own))
    return found


def middle(words: np.ndarray) -> int:
    """The row next to the majority of each bit."""
    majority = np.packbits(bits_of(words[:: max(1, len(words) // 4096)]).mean(0) > 0.5, bitorder="little").view(np.uint64)
    return int(np.bitwise_count(words ^ majority).sum(1).argmin())


def first_met(apart: np.ndarray, key: int, value_key, cuts: np.ndarray) -> np.ndarray:
    """Whether the bucket of ``key`` is the first that both ends of a pair share; ``apart`` has the
    bits in which they differ. Equal segments meet under each wiped bit, the first of which counts."""
    differ = bits_of(apart)
    counts = np.stack([differ[:, cut].sum(1) for cut in cuts], 1)
    first = (counts <= 1).argmax(1)
    at = np.where(counts[np.arange(len(first)), first] == 1, differ[np.arange(len(first))[:, None], cuts[first]].argmax(1), 0)
    return value_key(first, at) == key


def met_pairs(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b, star) from (key, x, y) sorted by key; star: b is the middle of a family."""
    width = cuts.shape[1]
    values = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for key, x, y in buckets(batches):
        x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
        met = near_pairs(x, y)
        if met is not None and not len(met[0]):
            continue
        words, stars = np.stack([x, y], 1), []
        if met is None or len(met[0]) > DENSE:
            left, right = [], []
            for own in families(x, y):
                if len(own) > DENSE:
                    centre = own[middle(words[own])]
                    rest = own[own != centre]
                    stars.append((rest, np.full(len(rest), centre), True))
                elif len(own) > 1:
                    i, j = near_pairs(x[own], y[own])
                    left.append(own[i])
                    right.append(own[j])
            met = tuple(np.concatenate(part) if part else np.empty(0, np.int64) for part in (left, right))
        for i, j, star in ((*met, False), *stars):
            if not len(i):
                continue
            bits = bits_of(words[i]).astype(np.uint64)

            def value_key(s, at, bits=bits):
                value = (bits[np.arange(len(s))[:, None], cuts[s]] * values).sum(1)
                return ((value & ~values[at]) * np.uint64(0x9E3779B97F4A7C15) + (s * width + at).astype(np.uint64)).view(np.int64)

            here = first_met(words[i] ^ words[j], key[0], value_key, cuts)
            if star:  # a link over more bits may meet elsewhere, but not hang together there
                here |= np.bitwise_count(words[i] ^ words[j]).sum(1) > LIMIT
            if here.any():
                yield from candidate_rows(words[i[here]], words[j[here]], star)


def candidate_rows(a: np.ndarray, b: np.ndarray, star: bool) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([binary(a), binary(b), pa.array(np.full(len(a), star))], ["a", "b", "star"])


def candidates(prints: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(a, b, star, centre) from a table of fingerprints."""
    entries = prints.mapInArrow(lambda it: variants(it, cuts), "key long, x long, y long")
    met = entries.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: met_pairs(it, cuts), "a binary, b binary, star boolean")
    centre = F.when(F.col("star"), F.col("b")).alias("centre")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "star", centre).groupBy("a", "b").agg(F.max("star").alias("star"), F.max("centre").alias("centre"))


def sets_of(nodes: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, set) for the fingerprints in ``nodes``: only their texts are read again whole."""
    firsts = small_side(classes.join(nodes, "fp", "left_semi").select("fp", F.col("least.key").alias("key")))
    texts = documents.select(row_key().alias("key"), "text").join(firsts, "key").select("fp", "text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["fp", "set"])

    return released(texts.mapInArrow(run, "fp binary, set binary").dropDuplicates(["fp"]))


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    rows = pairs.select("a", "b")
    for end in ("a", "b"):  # one text may have many partners
        lookup = pairs.groupBy(end).agg(F.count("*").alias("n")).join(held.toDF(end, f"set_{end}"), end)
        rows = join_frequent(rows, checkpointed(lookup), end)

    def check(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(i)] for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return released(rows.select("a", "b", "set_a", "set_b").mapInArrow(check, "a binary, b binary"))


class Roots(dict):
    """Roots that were joined, by the root that they went to."""

    def __missing__(self, root):
        return root

    def top(self, root: int) -> int:
        while (above := self[root]) != root:
            root = above
        return root


def joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between roots, from (key, side, fp, root, set) sorted by key and side: the rows of
    side 0 of a key are held, those of side 1 are compared with them one by one."""
    key, fps, roots, sets, prints, up = None, [], np.empty(0, np.int64), [], None, Roots()
    for batch in batches:
        links = []
        for at, side, fp, root, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != key:
                key, fps, roots, sets, prints, up = at, [], [], [], None, Roots()
            found = np.frombuffer(found, np.uint64)
            if side == 0:
                fps.append(fp)
                roots.append(root)
                sets.append(found)
                continue
            if prints is None:
                prints = np.array([fingerprint(s, WIDE) for s in sets], np.uint64).reshape(-1, WIDE)
                roots = np.array(roots, np.int64)
            top = up.top(root)
            if not (open_ones := np.flatnonzero(roots != top)).size:
                continue
            far = np.bitwise_count(prints[open_ones] ^ fingerprint(found, WIDE)).sum(1)
            for k in open_ones[np.argsort(far, kind="stable")][: int((far <= WIDE_LIMIT).sum())].tolist():
                if roots[k] != top and similar(sets[k], found):
                    links.append((fps[k], fp))
                    up[top] = int(roots[k])
                    roots[roots == top] = roots[k]
                    top = int(roots[k])
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])


def family_links(named: DataFrame, met: DataFrame, held: DataFrame) -> DataFrame:
    """The links that join the members of each family (fp, family): first each is compared with the
    family's middle one, then those that it does not link with all of the family."""
    number = lambda c: F.xxhash64(c)
    parts = lambda c: F.ceil(F.greatest(c, F.lit(1)) / F.lit(BLOCK_BYTES)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = lambda key, side, root: [key.alias("key"), F.lit(side).alias("side"), "fp", root.alias("root"), "set"]
    compared = lambda outer, inner: released(outer.union(inner).repartition("key").sortWithinPartitions("key", "side").mapInArrow(joining, "a binary, b binary"))

    rows = checkpointed(named.join(held, "fp").select("fp", number("family").alias("family"), "set", F.abs(F.xxhash64("fp", F.lit(7)) % 1_000_003).alias("at")))
    centres = met.filter("star").groupBy(F.col("centre").alias("fp")).agg(F.count("*").alias("stars"))
    middles = rows.select("fp", "family").join(centres, "fp").groupBy("family").agg(F.max(F.struct("stars", "fp")).alias("m"))
    plan = rows.groupBy("family").agg(F.count("*").alias("n"), parts(F.sum(F.length("set"))).alias("h"))
    dealt = checkpointed(join_frequent(rows, checkpointed(plan.join(middles, "family").select("family", "n", "h", F.col("m.fp").alias("middle"))), "family"))
    outer = dealt.filter("fp = middle").withColumn("part", each("h")).select(*columns(number(F.struct("family", "part")), 0, number("fp")))
    inner = dealt.filter("fp <> middle").select(*columns(number(F.struct("family", (F.col("at") % F.col("h")).cast("int"))), 1, number("fp")))
    first = compared(outer, inner)

    reached = first.select(F.col("b").alias("fp"), F.lit(True).alias("reached"))
    marked = checkpointed(dealt.join(reached, "fp", "left").withColumn("inside", F.coalesce("reached", F.expr("fp = middle"))))
    sizes = marked.filter("NOT inside").groupBy("family").agg(F.count("*").alias("n"), parts(F.sum(F.length("set"))).alias("g"))
    whole = checkpointed(marked.groupBy("family").agg(F.count("*").alias("n")).join(sizes.drop("n"), "family"))
    blocks = join_frequent(marked, whole, "family")
    root = number(F.when(F.col("inside"), F.col("middle")).otherwise(F.col("fp")))
    outer = blocks.filter("NOT inside").withColumn("part", each("h")).select(*columns(number(F.struct("family", (F.col("at") % F.col("g")).cast("int"), "part")), 0, root))
    inner = blocks.withColumn("part", each("g")).select(*columns(number(F.struct("family", "part", (F.col("at") % F.col("h")).cast("int"))), 1, root))
    return first.unionByName(compared(outer, inner))


def similar_roots(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint that is linked to another one."""
    met = released(candidates(classes.select("fp"), segments(classes.count())))
    held = sets_of(met.select(F.col("a").alias("fp")).union(met.select("b")).distinct(), documents, classes)
    if met.filter("star").isEmpty():
        return checkpointed(connected_components(verified(met, held)).withColumnRenamed("node", "fp"))
    named = checkpointed(connected_components(met).toDF("fp", "family"))
    dense = named.join(met.filter("star").select(F.col("a").alias("fp")), "fp", "left_semi").select("family").distinct()
    named = checkpointed(named.join(dense, "family", "left_semi").select("fp", "family"))
    loose = verified(checkpointed(met.join(named.select(F.col("fp").alias("a")), "a", "left_anti")), held)
    links = loose.unionByName(family_links(named, met, held))
    return released(connected_components(links).withColumnRenamed("node", "fp"))


def drop_similar(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id, of rows that
    repeat it the one with the smallest key. Texts are not shuffled while few rows go."""
    prints = checkpointed(fingerprints(documents))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("n")))
    roots = similar_roots(documents, classes)
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    components = linked.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("rows"), F.count("*").alias("n")).filter("rows > 1")
    several = join_frequent(linked.select("root", "fp", F.col("n").alias("copies")), checkpointed(components), "root")
    lookup = released(several.select("fp", F.col("copies").alias("n"), F.col("first.key").alias("first")))
    decided = join_frequent(prints, lookup, "fp").select("row.key", F.expr("row.key = first").alias("kept"))
    return drop_marked(documents, row_key(), marks(decided))
