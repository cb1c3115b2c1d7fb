import hashlib
import random
import re

from quakeframe.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if passes(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x-y", ".", "1", "25", "256", "4111", "1111", " ", "-", "+", "(", ")", "é", "😀", "_", "%", "\n", "+1 (626) 555-5759", "4012888888881881", "me@mail.example.com", "10.0.0.1", "00010.0.0.1", "999999999999999999999.1.1.1"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "1" * 30000, "a" * 30000, "a." * 15000, "1." * 15000, "1 " * 20000, "+1" + " " * 30000, "a@b.c_d@e.f", ",".join(["4012888888881881"] * 2500), "+1-" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text or "")[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in PLAIN]
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(4)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet"]
    fill = lambda n: " ".join(rng.choices(filler, k=n))
    texts = [f"{fill(5)} telephone: +1 ({200 + i}) 555-{1000 + i} {fill(4)}" for i in range(30)]
    texts += [f"{fill(5)} ordered {10**8 + i * 7} {fill(3)}" for i in range(30)]
    texts += [f"{fill(3)} telephone: 0{170 + i} 555 {2000 + i} {fill(2)}" for i in range(5)]
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i in range(30):
        assert got[i].n_phone == 1 and got[i].spans.count("phone") == 1
        assert got[30 + i].spans == ""
    for i in range(60, 65):
        start = texts[i].index("telephone: ") + len("telephone: ")
        end = re.search(r"[0-9](?= [a-z])", texts[i]).end()
        assert got[i].n_phone == 0 and got[i].spans == f"phone:{start}:{end}"


def test_planted_identifiers_precision_and_recall(spark):
    """Right and left patterns, whole contexts (long words, many blanks), unseen forms of each kind."""
    rng = random.Random(12)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    fill = lambda n: " ".join(rng.choices(filler, k=n))
    texts, want = [], []

    def plant(before, mention, after, kind):
        left = f"{fill(6)} {before}"
        texts.append(f"{left}{mention}{after} {fill(5)}")
        want.append({f"{kind}:{len(left)}:{len(left) + len(mention)}"} if kind else set())

    long_word = "x" * 90
    for i in range(40):
        plant("write to ", f"user{i}@mail{i}.example.com", "", "email")
        plant("", f"10.0.{i}.7", " is the host", "ip")
        plant(f"{long_word}:" + " " * 60, f"+49 30 {555000 + i}", "", "phone")
        plant("number ", str(20_000_000 + i * 37), "", None)
        plant("batch ", f"{i}000000{i}", " items", None)
    for i in range(10):
        plant("write to ", f"name{i} (at) host{i} (dot) org", "", "email")
        plant("", f"fe80:0:0:{i}::1", " is the host", "ip")
        plant(f"{long_word}:" + " " * 60, f"(030) 55{i} 1234", "", "phone")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(df).collect()}
    right = sum(len(got[i] & w) for i, w in enumerate(want))
    assert right / sum(map(len, got.values())) > 0.98 and right / sum(map(len, want)) > 0.98
    assert all(got[i] == w for i, w in enumerate(want) if i >= 200)


def scored(edges, weights=None, rounds=3, prior=2.0, confidence=0.8):
    """The rounds in plain Python, over (pattern, instance, kind, found)."""
    strings, seeds, fits = {}, {}, {}
    for p, i, kind, found in edges:
        strings.setdefault(p, set()).add(i)
        for k in pii.KINDS:
            if kind == k:
                seeds.setdefault((p, k), set()).add(i)
            elif kind is None and re.search(pii.FORM[k], found):
                fits.setdefault((p, k), set()).add(i)
    known, out = {}, {}
    for _ in range(rounds):
        out = {}
        for p, k in {*seeds, *fits}:
            own, unknown = len(seeds.get((p, k), ())), fits.get((p, k), ())
            told = sum(known.get((i, k), 0.0) for i in unknown)
            against = len(strings[p]) - own - len(unknown)
            score = (own + told) / (own + told + against + prior + (weights[p] if weights else pii.UNKNOWN) * (len(unknown) - told))
            if score >= confidence:
                out[p, k] = score
        known = {}
        for (p, k), score in out.items():
            for i in fits.get((p, k), ()):
                known[i, k] = max(score, known.get((i, k), 0.0))
    return out


def test_rounds_equal_plain_python(spark):
    rng = random.Random(9)
    made = {"email": lambda i: f"u{i}@h.org", "ip": lambda i: f"fe80:0:{i}::1", "card": lambda i: f"{10**12 + i}", "phone": lambda i: f"+49 30 {10**6 + i}", None: lambda i: f"{10**7 + i * 13}"}
    edges = set()
    for p in range(60):
        likely = rng.choice(list(made))
        for _ in range(rng.choice([2, 10, 40])):
            kind = likely if rng.random() < 0.9 else rng.choice(list(made))
            i = rng.randrange(400)
            edges.add((f"w{p} _", made[kind](i), kind if rng.random() < 0.6 else None))
    rows = [(p, i, k, i) for p, i, k in edges]
    df = spark.createDataFrame(rows, "pattern string, instance string, kind string, found string").repartition(3)
    got = {(r.pattern, r.kind): r.score for r in pii.promoted_patterns(df).collect()}
    want = scored(rows)
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    weights = {p: rng.choice([0.05, 0.5, 1.0]) for p in {e[0] for e in edges}}
    got = {(r.pattern, r.kind): r.score for r in pii.promoted_patterns(df, spark.createDataFrame(list(weights.items()), "pattern string, weight double")).collect()}
    want = scored(rows, weights)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_weights_are_shares_of_empty_contexts(spark):
    texts = ["call 12345678 now", "Call: 12345679 now", "call me", "now now", "ring 1234567", None, "", "id 7654321, and so on", "now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = pii.mentions(pii.located(docs))
    got = {r.pattern: round(r.weight, 3) for r in pii.unknown_weights(docs, seen, seen.select("pattern").distinct()).collect()}
    assert got == {"call _": 0.333, "_ now": 0.6, "call _ now": 0.333, "ring _": 0.05, "id _": 0.05, "_ and": 0.05, "id _ and": 0.05}


def test_frequent_unseen_forms_are_found(spark):
    """Unseen forms at 0.3, 1 and 3 times the seeds, among decoys in contexts of their own and in common words."""
    rng = random.Random(10)
    filler = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    fill = lambda n: " ".join(rng.choices(filler, k=n))
    texts, want = [], []

    def plant(before, mention, after, kind):
        left = f"{fill(4)} {before}"
        texts.append(f"{left}{mention}{after} {fill(4)}")
        want.append({f"{kind}:{len(left)}:{len(left) + len(mention)}"} if kind else set())

    for name, seeds, unseen in (("ring", 100, 30), ("call", 100, 100), ("dial", 100, 300)):
        for i in range(seeds):
            plant(f"{name} me at ", f"+49 30 {500000 + i}", " thanks", "phone")
        for i in range(unseen):
            plant(f"{name} me at ", f"(0{200 + i}) 44{i:03d} 12", " thanks", "phone")
    for i in range(300):
        plant("", f"u{i}@mail{i}.org", "", "email")  # between common words
        plant("", f"+1 212 {600000 + i}", "", "phone")
        plant("", str(30_000_000 + i * 41), "", None)
        plant("order number ", str(20_000_000 + i * 37), " shipped", None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.personal_data(df).collect()}
    right = sum(len(got[i] & w) for i, w in enumerate(want))
    assert right / sum(map(len, got.values())) > 0.98 and right / sum(map(len, want)) > 0.98


def test_many_spans_in_one_text(spark):
    """Others clear of base spans: as many as by comparing all, in a text of thousands."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["1.2.3.4", "a@b.cd", "12345678", "+1 555 123 4567", "a@localhost", "4012888888881881 77"]) for _ in range(6000))
    row = pii.located(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base = [(b.start, b.end) for b in row.base]
    covered = set()
    for s, e in base:
        covered.update(range(s, e))
    every = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])[(+]?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?![A-Za-z0-9])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", text)]
    assert [(x.start, x.end) for x in row.other] == [(s, e) for s, e in every if not covered & set(range(s, e))]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "me@mail.example.com"), (1, "me@mail.example.com"), (None, None)], "doc_id long, text string")
    out = pii.personal_data(df).collect()
    assert sorted(r.spans for r in out) == ["", "email:0:19", "email:0:19"]
    assert pii.personal_data(df.limit(0)).count() == 0
    plan = pii.personal_data(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
