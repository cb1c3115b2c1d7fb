"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Base entities (email, ip, card, phone) are found by patterns and checks; they are the seeds.
Each mention of a seed, and of an identifier-like string that is no base entity, has lexical
patterns: words around a slot (``w _``, ``v w _``, ``_ x``, ``w _ x``). Patterns and strings form a
bipartite graph, which is scored round by round: a pattern by its evidence for a kind against the
evidence for others, a string by the best of its patterns. A string of the kind's form of which
nothing is known speaks against a pattern by the share of its context that holds no identifier. Strings that fit the kind's form, in patterns that reach
``confidence``, are added as spans of that kind. Base spans always stay.

Regular expressions are possessive and anchored to the start of a run, so that a long text costs
linear time and no deep recursion. Counts n_* are those of base spans.

Defined results: null and empty texts have no spans (the digest of nothing); rows that repeat are
answered each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import checkpointed, table
from quakeframe.llm.rows import small_side

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
_FIRST_OF = {"email": rf"(?:\G|(?<![{_LOCAL}]))", "ip": r"(?:\G|(?<![0-9]))"}

#: Equal in what they find to the plain patterns, but linear: runs are taken whole.
BASE = {
    "email": _FIRST_OF["email"] + rf"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _FIRST_OF["ip"] + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9])++",
}
#: SQL conditions without which a text has no match.
NEEDS = {"email": "contains(text, '@')", "ip": "contains(text, '.') AND text RLIKE '[0-9]'", "card": "text RLIKE '[0-9]'", "phone": "contains(text, '+')"}
#: What may be an identifier without being a base entity: digit groups, addresses, hex groups.
CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:[(+]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+)(?![A-Za-z0-9])"
    rf"|(?<![{_LOCAL}])[{_LOCAL}]++@[A-Za-z0-9.-]++"
    rf"|(?<![{_LOCAL}])[{_LOCAL}]++\x20?[(\[][Aa][Tt][)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[][Dd][Oo][Tt][)\]])\x20?[A-Za-z0-9-]++)*+"
    r"|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}+"
)
#: A string that the context calls of a kind must have this form.
FORM = {
    "email": r"@|[(\[][Aa][Tt][)\]]",
    "ip": r"^[0-9A-Fa-f]*:.*:|^[0-9]+\.[0-9]+\.[0-9.]+$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$",
}
#: The least that an unknown string of the kind's form counts against a pattern; a known one of another kind counts 1.
UNKNOWN = 0.05
CHUNK = 1000
#: The (reversed) two words before a mention and the word after it, past separators; linear.
_BEFORE = r"^[\s\x22\x27(<=:#-]*+(\S++(?:\s++\S++)?)"
_AFTER = r"^[\s\x22\x27)>,;.:]*+(\S++)"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans_of(pattern: str, needs: str) -> str:
    """SQL for the matches of a pattern in column ``text``, left to right: array of (start, end,
    found, before, after), code points; none without the condition ``needs``. Starts are running
    sums, made by chunks so that the cost is linear."""
    p = _quoted(pattern)
    empty = "CAST(array() AS array<struct<start: bigint, end: bigint, found: string, before: string, after: string>>)"
    zipped = "transform(found, (b, i) -> struct(pieces[i] AS a, b AS b, pieces[i + 1] AS z))"
    inner = (
        f"aggregate(slice(z, c * {CHUNK} + 1, {CHUNK}), struct(0L AS at, {empty} AS out), (s, x) -> struct("
        "s.at + length(x.a) + length(x.b) AS at, "
        "array_append(s.out, struct(s.at + length(x.a) AS start, s.at + length(x.a) + length(x.b) AS end, x.b AS found, "
        f"reverse(regexp_extract(reverse(x.a), {_quoted(_BEFORE)}, 1)) AS before, regexp_extract(x.z, {_quoted(_AFTER)}, 1) AS after)) AS out))"
    )
    offsets = "aggregate(parts, struct(0L AS at, CAST(array() AS array<bigint>) AS out), (s, x) -> struct(s.at + x.at AS at, array_append(s.out, s.at) AS out)).out"
    moved = f"flatten(zip_with(parts, {offsets}, (x, o) -> transform(x.out, y -> struct(y.start + o AS start, y.end + o AS end, y.found AS found, y.before AS before, y.after AS after))))"
    chunks = f"transform(array(transform(sequence(0, (size(z) - 1) DIV {CHUNK}), c -> {inner})), parts -> {moved})[0]"
    placed = f"transform(array(split(text, {p}, -1)), pieces -> transform(array({zipped}), z -> {chunks})[0])[0]"
    found = f"transform(array(regexp_extract_all(text, {p}, 0)), found -> CASE WHEN size(found) = 0 THEN {empty} ELSE {placed} END)[0]"
    return f"CASE WHEN {needs} THEN {found} ELSE {empty} END"


def _digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the check; every second one from the right counts double."""
    n = f"CAST(substring({digits}, -i, 1) AS INT)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {n} WHEN {n} > 4 THEN 2 * {n} - 9 ELSE 2 * {n} END) % 10 = 0"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CHECKS = {
    "email": "true",
    "ip": rf"x.found RLIKE r'^{_PART}(?:\.{_PART}){{3}}$'",
    "card": f"CASE WHEN length({_digits('x.found')}) BETWEEN 12 AND 19 THEN {_luhn(_digits('x.found'))} ELSE false END",
    "phone": f"length({_digits('x.found')}) BETWEEN 9 AND 15",
}


def base_spans() -> str:
    """SQL for all base spans of column ``text``: array of (start, rank, end, kind, found, before, after), in order."""
    each = [
        f"transform(filter({spans_of(BASE[kind], NEEDS[kind])}, x -> {CHECKS[kind]}), x -> "
        f"struct(x.start AS start, {rank} AS rank, x.end AS end, '{kind}' AS kind, x.found AS found, x.before AS before, x.after AS after))"
        for rank, kind in enumerate(KINDS)
    ]
    return f"array_sort(concat({', '.join(each)}))"


def clear_ones() -> str:
    """SQL for the elements of ``other`` that overlap no element of ``base`` (ordered by start): the
    furthest end so far, by chunks, and a binary search for the last one that starts before the end."""
    part = (
        f"aggregate(slice(base, c * {CHUNK} + 1, {CHUNK}), struct(0L AS m, CAST(array() AS array<bigint>) AS out), "
        "(s, x) -> struct(greatest(s.m, x.end) AS m, array_append(s.out, greatest(s.m, x.end)) AS out))"
    )
    before = "aggregate(parts, struct(0L AS m, CAST(array() AS array<bigint>) AS out), (s, x) -> struct(greatest(s.m, x.m) AS m, array_append(s.out, s.m) AS out)).out"
    reach = f"transform(array(transform(sequence(0, (size(base) - 1) DIV {CHUNK}), c -> {part})), parts -> flatten(zip_with(parts, {before}, (x, o) -> transform(x.out, e -> greatest(e, o)))))[0]"
    middle = "CAST((s.lo + s.hi) DIV 2 AS INT)"
    count = (
        "aggregate(sequence(0, CAST(ceil(log2(size(base) + 1)) AS INT)), struct(0 AS lo, size(base) AS hi), (s, i) -> CASE WHEN s.lo >= s.hi THEN s "
        f"WHEN base[{middle}].start < x.end THEN struct({middle} + 1 AS lo, s.hi AS hi) ELSE struct(s.lo AS lo, {middle} AS hi) END).lo"
    )
    searched = f"transform(array({reach}), reach -> filter(other, x -> transform(array({count}), k -> k = 0 OR reach[k - 1] <= x.start)[0]))[0]"
    return f"CASE WHEN size(base) = 0 OR size(other) = 0 THEN other ELSE {searched} END"


def located(documents: DataFrame) -> DataFrame:
    """doc_id, row, base and other (identifier-like strings clear of base spans) for each row."""
    text = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = text.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.expr(base_spans()).alias("base"),
        F.expr(spans_of(CANDIDATE, "text RLIKE '[0-9@]'")).alias("other"),
    )
    return found.select("doc_id", "row", "base", F.expr(clear_ones()).alias("other"))


def _word(s: str) -> str:
    """SQL: a context word in lower case, digits as 0; a very long one by its digest; null if it has no letter."""
    plain = rf"regexp_replace(lower({s}), '[0-9]', '0')"
    return rf"CASE WHEN {s} RLIKE r'\p{{L}}' THEN CASE WHEN length({s}) > 64 THEN md5({s}) ELSE {plain} END END"


#: The lexical patterns of a mention, with a slot for it: one or two words to the left, one to the right.
PATTERNS = (
    "transform(array(struct(w1, w2, w3)), x -> array_compact(array(concat(x.w1, ' _'), concat(x.w2, ' ', x.w1, ' _'), "
    "concat('_ ', x.w3), concat(x.w1, ' _ ', x.w3))))[0]"
)
INSTANCE = r"lower(regexp_replace(x.found, '[ ().-]', ''))"


def mentions(found: DataFrame) -> DataFrame:
    """row, start, end, kind (null for no base entity), pattern, instance, found: a row for each
    pattern of a mention."""
    words = r"split(x.before, r'\s+')"
    columns = [
        "row", "x.start", "x.end", "kind", F.expr(INSTANCE).alias("instance"), "x.found",
        F.expr(_word(f"element_at({words}, -1)")).alias("w1"),
        F.expr(_word(f"CASE WHEN size({words}) = 2 THEN {words}[0] END")).alias("w2"),
        F.expr(_word("x.after")).alias("w3"),
    ]
    seeds = found.select("row", F.explode("base").alias("x")).select("row", "x", "x.kind").select(*columns)
    others = found.select("row", F.explode("other").alias("x"), F.lit(None).cast("string").alias("kind")).select(*columns)
    return seeds.unionByName(others).select("row", "start", "end", "kind", F.explode(F.expr(PATTERNS)).alias("pattern"), "instance", "found")


def promoted_patterns(edges: DataFrame, weights: DataFrame | None = None, rounds: int = 3, prior: float = 2.0, confidence: float = 0.8) -> DataFrame:
    """(pattern, kind, score) of the contexts that reach ``confidence`` after some rounds.

    ``edges``: distinct (pattern, instance, kind, found). A pattern's score is the evidence for a kind
    (seeds of it, and the scores of unknown strings) over that and the evidence against it: seeds of
    other kinds, strings that have not the kind's form, ``prior`` strings, and a part of what is unknown:
    by ``weights`` (pattern, weight), else ``UNKNOWN``. Patterns that reach ``confidence`` give their score
    to their unknown strings (the best of several counts, as patterns of one mention are not
    independent); weaker ones do not, so that they cannot feed on themselves, and frequent words leave
    the joins.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("found").rlike(FORM[k]).alias("fits")) for k in KINDS])).alias("k")
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "instance", "kind", F.lit(1.0).alias("score"))
    open_ones = edges.filter("kind IS NULL").select("pattern", "instance", kinds).filter("k.fits").select("pattern", "instance", "k.kind")
    totals = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("n"))
    if weights is not None:
        totals = totals.join(small_side(weights.select("pattern", "weight")), "pattern")  # others cannot reach it
    weight = F.lit(UNKNOWN) if weights is None else F.col("weight")
    scores = None
    for _ in range(rounds):
        known = open_ones.withColumn("score", F.lit(0.0)) if scores is None else open_ones.join(scores, ["instance", "kind"], "left").fillna(0.0, "score")
        now = seeds.withColumn("doubt", F.lit(0.0)).unionByName(known.withColumn("doubt", 1 - F.col("score")))
        sums = now.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.sum("doubt").alias("doubt"))
        share = F.col("mass") / (F.col("n") + prior - (1 - weight) * F.col("doubt"))
        patterns = checkpointed(sums.join(totals, "pattern").select("pattern", "kind", share.alias("score")).filter(F.col("score") >= confidence))
        scores = open_ones.join(small_side(patterns), ["pattern", "kind"]).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    return patterns


_EDGE = r"^[\x22\x27()<>=:#,;.-]+|[\x22\x27()<>=:#,;.-]+$"


def _key(s: str) -> str:
    return f"regexp_replace({s}, r'{_EDGE}', '')"


def unknown_weights(documents: DataFrame, seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, weight): what an unknown string counts against each of the patterns, the share of the
    context's occurrences in all texts that hold no identifier-like string (``UNKNOWN`` at least). In a
    context of identifiers an unseen form is no surprise; in one of ordinary words it is chance.

    The contexts (words, and pairs of words) are counted in one pass over all texts.
    """
    wanted = patterns.select("pattern").distinct()
    sides = F.split("pattern", " ?_ ?")  # before and after the slot
    contexts = wanted.select("pattern", F.explode(F.filter(sides, lambda c: c != "")).alias("context"))
    contexts = contexts.select("pattern", F.array_join(F.transform(F.split("context", " "), lambda w: F.regexp_replace(w, _EDGE, "")), " ").alias("context"))
    contexts = checkpointed(contexts)
    words = F.transform(F.split(F.regexp_replace(F.lower("text"), "[0-9]", "0"), r"\s+"), lambda w: F.regexp_replace(w, _EDGE, ""))
    both = "concat(words, transform(sequence(1, size(words) - 1), i -> concat(words[i - 1], ' ', words[i])))"
    told = documents.filter("text IS NOT NULL").select(words.alias("words")).select(F.explode(F.expr(f"CASE WHEN size(words) > 1 THEN {both} ELSE words END")).alias("context"))
    counted = told.join(small_side(contexts.select("context").distinct()), "context").groupBy("context").agg(F.count("*").alias("n"))
    rarest = contexts.join(counted, "context", "left").groupBy("pattern").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    mentioned = seen.join(small_side(wanted), "pattern").groupBy("pattern").agg(F.count("*").alias("m"))
    share = F.least(F.col("m") / F.greatest("n", F.lit(1)), F.lit(1.0))
    return rarest.join(mentioned, "pattern").select("pattern", F.greatest(1 - share, F.lit(UNKNOWN)).alias("weight"))


def personal_data(documents: DataFrame) -> DataFrame:
    """The digest columns of the contract for each row of ``documents``."""
    found = checkpointed(located(documents))
    seen = mentions(found)
    edges = checkpointed(seen.groupBy("pattern", "instance", "kind").agg(F.min("found").alias("found")))
    likely = promoted_patterns(edges)  # as if every context were one of identifiers
    patterns = promoted_patterns(edges, checkpointed(unknown_weights(documents, seen, likely)))
    hits = (
        seen.filter("kind IS NULL")
        .drop("kind")
        .join(small_side(patterns.select("pattern", "kind")), "pattern")
        .filter(F.coalesce(*[F.when(F.col("kind") == k, F.col("found").rlike(FORM[k])) for k in KINDS]))
    )
    added = hits.groupBy("row").agg(
        F.collect_set(F.expr(f"struct(start, array_position(array{KINDS}, kind) - 1 AS rank, end, kind)")).alias("added")
    )
    joined = found.join(added, "row", "left")
    told = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    slim = "transform(base, x -> struct(x.start, CAST(x.rank AS BIGINT) AS rank, x.end, x.kind))"
    every = f"CASE WHEN added IS NULL THEN {slim} ELSE array_sort(concat({slim}, transform(added, x -> struct(x.start, CAST(x.rank AS BIGINT) AS rank, x.end, x.kind)))) END"
    return joined.select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({told('base')}, 256)").alias("base_sha256"),
        F.expr(told(every)).alias("spans"),
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
