"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits: of two fingerprints that differ in at
most three bits, one segment differs in at most one. Each segment is indexed under its 32 variants
with one bit wiped; equal variants at the same bit meet by an equality join (a shuffle by key), and
the pairs are verified by their true distance. Only distinct fingerprints are indexed, and of a
bucket only a spanning forest of its verified links leaves, not its pairs; a large bucket is cut
once more by variants of the other segment's halves. Components come from the links.

Defined results: null or empty text has fingerprint zero, linked like any other; copies share a
fingerprint and so a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, table, text_batches
from quakeframe.llm.graph import connected_components, join_frequent

WIDTH = 3
SEED = 42
BITS = 3
#: Buckets of more distinct fingerprints are cut once more before pairs are compared.
LARGE = 2048


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the word shingles of a text, unsigned."""
    words = (text or "").encode().lower().split()  # on bytes: only A-Z and ASCII white space
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(WIDTH)], strict=False)) if len(words) >= WIDTH else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for each row."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return text_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


def variants(fp: str):
    """The 64 keys of a fingerprint column: bit number, and the segment of that bit without it."""
    segment = f"CASE WHEN i < 32 THEN {fp} & 4294967295L ELSE shiftrightunsigned({fp}, 32) END"
    return F.expr(f"transform(sequence(0, 63), i -> shiftleft(CAST(i AS BIGINT), 32) | (({segment}) & ~shiftleft(1L, i % 32)))")


def forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of fingerprints at most ``limit`` bits apart."""
    links, left = [], fps
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= limit
        if near.any():
            queue.extend(left[near])
            links.extend((int(at), int(x)) for x in left[near])
            left = left[~near]
    return links


def bucket_links(fps: np.ndarray, key: int, limit: int = BITS, large: int = LARGE) -> list[tuple[int, int]]:
    """Links inside the bucket of one key. A large one is cut by wiped variants of the halves of the
    other segment, of which one differs in at most one bit."""
    if len(fps) <= large:
        return forest(fps, limit)
    links = []
    base = 32 if key >> 32 < 32 else 0
    for start in (base, base + 16):
        half = (fps >> np.uint64(start)) & np.uint64(0xFFFF)
        for bit in range(16):
            kept = half & np.uint64(0xFFFF ^ (1 << bit))
            order = np.argsort(kept, kind="stable")
            cuts = np.flatnonzero(np.diff(kept[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    links.extend(forest(fps[part], limit))
    return links


def linked_pairs(batches: Iterator[pa.RecordBatch], limit: int = BITS) -> Iterator[pa.RecordBatch]:
    """From (key, fp) rows sorted by key: verified links, a forest for each key."""
    held_keys, held_fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def flush(keys, fps):
        out = []
        if len(keys):
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= limit]
            out += list(zip(fps[near].tolist(), fps[near + 1].tolist(), strict=True))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                out += bucket_links(fps[s : s + n], int(keys[s]), limit)
        ends = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
        held_keys, held_fps = keys[cut:], fps[cut:]
        yield flush(keys[:cut], fps[:cut])
    yield flush(held_keys, held_fps)


def fingerprint_roots(classes: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint that is linked to another one."""
    keys = classes.select(F.explode(variants("fp")).alias("key"), "fp")
    links = keys.repartition("key").sortWithinPartitions("key").mapInArrow(linked_pairs, "a long, b long")
    return checkpointed(connected_components(links).withColumnRenamed("node", "fp"))


def near_groups(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``documents``."""
    prints = checkpointed(fingerprints(documents))
    classes = checkpointed(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    roots = fingerprint_roots(classes)
    joined = classes.join(roots, "fp").select("fp", "root", "n", "least")
    components = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = join_frequent(roots, checkpointed(components), "root").select("fp", "component_id")
    lookup = classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return join_frequent(prints, checkpointed(lookup), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
