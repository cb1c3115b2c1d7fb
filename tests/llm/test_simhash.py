import random

import numpy as np
import xxhash

from quakeframe.llm import simhash
from quakeframe.llm.graph import connected_components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_by_hand():
    rng = random.Random(5)
    for text in [None, "", "One", "A b", "a B c", "Été à la\x85mer x", *(" ".join(rng.choices("a B cc\td".split(" "), k=40)) for _ in range(20)), "w " * 9000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_every_close_pair_shares_a_key_and_links(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for x in base:
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    keys = df.select(simhash.F.explode(simhash.variants("fp")).alias("key"), "fp").repartition(3, "key").sortWithinPartitions("key")
    links = keys.mapInArrow(simhash.linked_pairs, "a long, b long")
    got = {r.node: r.root for r in connected_components(links).collect()}
    order = sorted(signed)
    at = {x: i for i, x in enumerate(order)}
    true = [(at[a], at[b]) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    want = components(len(order), true)
    assert [order[w] for w in want] == [got.get(x, x) for x in order]


def test_large_buckets_are_cut_without_loss():
    rng = np.random.default_rng(1)
    low = np.unique(rng.integers(0, 2**32, 400, dtype=np.uint64))
    near = np.unique(np.concatenate([low, *(low ^ (np.uint64(1) << rng.integers(0, 32, len(low), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, len(low), dtype=np.uint64)) for _ in range(3))]))
    for key, fps in ((40 << 32, near), (3 << 32, near << np.uint64(32))):
        sets = []
        for large in (10, 10**6):
            links = simhash.bucket_links(fps, key, large=large)
            at = {int(x): i for i, x in enumerate(fps)}
            sets.append(components(len(fps), [(at[a], at[b]) for a, b in links]))
        assert sets[0] == sets[1]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (900, 901), (901, 900)]
    links += [(1000 + rng.randint(0, 80), 1000 + rng.randint(0, 80)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = sorted({x for p in links for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    want = components(len(nodes), [(at[a], at[b]) for a, b in links])
    assert all(got.get(x, x) == nodes[want[i]] for i, x in enumerate(nodes))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_frames_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 200))) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "new"
            texts.append(" ".join(v))
    texts += [None, "", "one", "One", "one two", "x " * 30000] + ["same text again and again"] * 40
    rows = [(i * 3, t, "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    out = {r.doc_id: r for r in simhash.near_groups(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    assert len(out) == len(rows)
    for i, (d, _, _) in enumerate(rows):
        assert out[d].fingerprint == f"{fps[i]:016x}" and out[d].component_id == want[i] * 3
    assert simhash.near_groups(df.limit(0)).count() == 0
