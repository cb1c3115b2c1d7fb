"""Byte-level byte-pair encoding by backtracking, and exact token counts of every prefix.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary
finds every token inside a piece. ``encode`` walks from the longest match at each position; a
token may follow another only if merging would have left that boundary alone, which depends on the
two tokens only and is memoised; a dead end falls back to the longest shorter token or takes the
last token back. Each position can die once, so the work is linear in the piece. The result equals
that of applying the merges in rank order.

``prefix_counts`` fills a table from the left: of the tokens that end at a byte, exactly one may
follow the last token of the prefix before it, so counts of every prefix come from one pass.

Defined results: null and empty texts have no tokens (the digests are those of nothing); rows that repeat
are encoded each; very long texts are encoded whole; further columns are kept or ignored as the function
says; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm.common import table, text_batches, worker_model

#: Entries of a worker's memo tables; a full table is emptied and filled again.
MEMO = 200_000
#: Texts of these letters only (Latin, without superscript digits and fractions) split in the same way
#: by the standard library's word classes, at half the time.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]*")
PLAIN_SPLIT = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = regex.compile(r"\s+")
CONTRACTED = regex.compile(r"'(?:re|ve|ll)")


class Memo(dict):
    """A bounded table of results by key."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


def byte_letters() -> dict[str, int]:
    """The printable letter that JSON vocabularies write for each byte, by letter.

    Printable Latin-1 bytes stand for themselves; the others, in order, for U+0100 and up.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Vocabulary, merges, automaton and memo tables of one encoder.

    ``order`` lists the tokens as bytes, single bytes first, then by merge priority; ``ids`` has
    the id of each. ``special`` are strings with one id that are matched before anything else.
    """

    def __init__(self, order: list[bytes], ids: list[int], special: dict[str, int] | None = None):
        self.ids = ids
        self.bytes_of = dict(zip(ids, order, strict=True))
        self.special = special or {}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile(PATTERN).findall
        self.plain = PATTERN == KNOWN_PATTERN
        self.names = [t.decode("latin-1") for t in order]
        self.rank = {t: i for i, t in enumerate(self.names)}
        self.length = [len(t) for t in self.names]
        self.left, self.right, self.merged = self._splits()
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.names):
            self.automaton.add_word(t, (i, len(t) - 1))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.piece_ids = Memo(lambda piece: tuple(ids[t] for t in self.encode(piece.encode())))
        self.piece_count = Memo(lambda piece: len(self.encode(piece.encode())))
        self.decimal = {i: str(i) for i in self.bytes_of}

    @classmethod
    def from_ranks(cls, data: bytes) -> BytePairEncoder:
        """From a rank file: lines of a base64 token and its rank, which is its id."""
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines()))
        return cls([t for _, t in pairs], [i for i, _ in pairs])

    @classmethod
    def from_json(cls, data: bytes) -> BytePairEncoder:
        """From a JSON file with a byte-level BPE model."""
        spec = json.loads(data)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda word: bytes(letters[c] for c in word)
        base = [w for w in model["vocab"] if len(w) == 1]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        words = base + [a + b for a, b in merges]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return cls([to_bytes(w) for w in words], [model["vocab"][w] for w in words], special)

    def _splits(self) -> tuple[list[int], list[int], dict[int, int]]:
        """For each token the two tokens that its last merge joins (a byte: itself twice)."""
        rank, left, right, merged = self.rank, [], [], {}
        for i, name in enumerate(self.names):
            parts = list(name)
            while len(parts) > 2:
                found = [(r, k) for k in range(len(parts) - 1) if (r := rank.get(parts[k] + parts[k + 1], i)) < i]
                if not found:
                    break
                k = min(found)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            a, b = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (i, i)
            left.append(a)
            right.append(b)
            if a != i:
                merged[a << 20 | b] = i
        return left, right, merged

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` side by side: no merge across the boundary comes
        before the merges that made the two, taken back one by one from the latest."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(a, b)
            if len(self.fits) >= 2 * MEMO:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, merged = self.left, self.right, self.merged
        before = len(self.names) + 1
        while True:
            across = merged.get(a << 20 | b)
            if across is not None and across < before:
                return False
            undo_a, undo_b = right[a] != a, left[b] != b
            if not undo_a and not undo_b:
                return True
            if undo_a and (a > b or not undo_b):  # at equal ranks the merge on the left came first
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``; -1 if none."""
        found = self.shorter.get(token)
        if found is None:
            name, found = self.names[token], -1
            for n in range(len(name) - 1, 0, -1):
                if (found := self.rank.get(name[:n], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Tokens (as positions in ``order``) of one piece, as merging by rank would leave them."""
        text = piece.decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        n, length, known = len(text), self.length, self.fits.get
        longest = [0] * n
        for end, (token, back) in self.automaton.iter(text):
            longest[end - back] = token  # ends rise, so the last match from a start is its longest
        alive = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            end = at + length[token]
            fits = alive[end]
            if fits and last >= 0:
                fits = known(last << 20 | token)
                if fits is None:
                    fits = self.compatible(last, token)
            if fits:
                tokens.append(token)
                at, last = end, token
                if at < n:
                    token = longest[at]
            else:
                token = self._shorter(token)
                while token < 0:
                    alive[at] = 0
                    token = tokens.pop()
                    last = tokens[-1] if tokens else -1
                    at -= length[token]
                    token = self._shorter(token)
        return tokens

    def piece_prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of the first 0, 1, ... bytes of one piece."""
        text, compatible = piece.decode("latin-1"), self.compatible
        last, counts = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for end, (token, back) in self.automaton.iter(text):
            start = end - back
            if last[end + 1] < 0 and (start == 0 or compatible(last[start], token)):
                last[end + 1], counts[end + 1] = token, counts[start] + 1
        return counts

    def pieces(self, text: str) -> list[str]:
        if self.plain and PLAIN.fullmatch(text):
            return PLAIN_SPLIT.findall(text)
        return self.split(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings; True marks one."""
        if not any(s in text for s in self.special):
            yield text, False
            return
        at = 0
        for found in regex.finditer("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), text):
            yield text[at : found.start()], False
            yield found[0], True
            at = found.end()
        yield text[at:], False

    def encode_text(self, text: str) -> list[int]:
        """Token ids of a text."""
        get = self.piece_ids.__getitem__
        if not self.special:
            return list(chain.from_iterable(map(get, self.pieces(text))))
        ids: list[int] = []
        for part, special in self.parts(text):
            if special:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(get, self.pieces(part))))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def count(self, text: str) -> int:
        get = self.piece_count.__getitem__
        return sum(1 if special else sum(map(get, self.pieces(part))) for part, special in self.parts(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Exact token counts of the first 0, 1, ... characters of the text, each as a text of its
        own. One pass: within a piece its own table counts; where a prefix splits into other pieces
        than the text does (inside white space or a contraction) the short tail is counted anew."""
        counts, at, total = [0] * (len(text) + 1), 0, 0
        plain, before = "", 0
        for part, special in self.parts(text):
            if special:  # short of its last character it is ordinary text after what stands before
                table = self.prefix_counts_plain(plain + part[:-1], before)
                counts[at + 1 : at + len(part)] = table[len(plain) + 1 :]
                total += 1
                counts[at + len(part)] = total
            else:
                table = self.prefix_counts_plain(part, total)
                counts[at + 1 : at + 1 + len(part)] = table[1:]
                plain, before, total = part, total, table[-1]
            at += len(part)
        return counts

    def prefix_counts_plain(self, text: str, total: int = 0) -> list[int]:
        counts, at = [total] * (len(text) + 1), 0
        for piece in self.pieces(text):
            data = piece.encode()
            table = self.piece_prefix_counts(data)
            if data.isascii():
                own = table
            else:
                ends, own = 0, [0]
                for c in piece:
                    ends += len(c.encode())
                    own.append(table[ends])
            counts[at : at + len(piece) + 1] = [total + c for c in own]
            if CONTRACTED.fullmatch(piece):  # its first letter alone would be a piece of its own
                counts[at + 2] = total + self.count(piece[:2])
            total, at = total + own[-1], at + len(piece)
        for run in WHITE.finditer(text):  # a prefix that ends in white space keeps the run whole
            before = counts[run.start()]
            own = self.piece_prefix_counts(run[0].encode())
            ends = 0
            for k, c in enumerate(run[0], 1):
                ends += len(c.encode())
                if run.start() + k < len(text) or run.end() == len(text):
                    counts[run.start() + k] = before + own[ends]
        return counts


def fits_budget(counts: list[int], budget: int) -> int:
    """The longest prefix, in characters, such that it and all shorter ones keep to the budget."""
    running, most = [], 0
    for c in counts:
        most = max(most, c)
        running.append(most)
    return bisect.bisect_right(running, budget) - 1


def encoder(kind: str, data: bytes) -> BytePairEncoder:
    """The encoder of a vocabulary file's content, built once in each worker."""
    make = BytePairEncoder.from_json if kind == "json" else BytePairEncoder.from_ranks
    return worker_model((kind, hashlib.sha256(data).hexdigest()), lambda: make(data))


def shipped(spark: SparkSession, path: str):
    """(kind, broadcast content) of a vocabulary file, 2 MB at most for the public ones."""
    with open(path, "rb") as f:
        return path.rpartition(".")[2], spark.sparkContext.broadcast(f.read())


def encoded(documents: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) for each row of ``documents``.

    Null text counts as empty: no tokens. Rows are independent; nothing is shuffled.
    """
    kind, content = shipped(documents.sparkSession, path or tokenizer_path("byte_bpe_50k.tiktoken"))

    def run(batches):
        own = encoder(kind, content.value)
        for batch in batches:
            n_tokens, id_sha, text_sha, lists = [], [], [], []
            for text in batch.column(1):
                found = own.encode_text(text.as_py() or "")
                n_tokens.append(len(found))
                id_sha.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, found)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(found)).hexdigest())
                if ids:
                    lists.append(pa.array(found, pa.int32()))
            columns = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(id_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                flat = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                ends = [0]
                for x in lists:
                    ends.append(ends[-1] + len(x))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return text_batches(documents).select("doc_id", "text").mapInArrow(run, schema + (", token_ids array<int>" if ids else ""))


def counted(documents: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``documents``; null text is empty.

    The text's count is the last entry of its prefix table; the tables of its pieces are memoised.
    """
    kind, content = shipped(documents.sparkSession, path or tokenizer_path("byte_bpe_50k.json"))

    def run(batches):
        own = encoder(kind, content.value)
        own.piece_count.make = lambda piece: own.piece_prefix_counts(piece.encode())[-1]
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column(1)]
            counts = [own.count(text) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind_of_id = documents.schema["doc_id"].dataType.simpleString()
    return text_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(documents: DataFrame, budget: int, path: str | None = None) -> DataFrame:
    """doc_id, text cut to the longest prefix within ``budget`` tokens, n_tokens of that prefix."""
    kind, content = shipped(documents.sparkSession, path or tokenizer_path("byte_bpe_50k.json"))

    def run(batches):
        own = encoder(kind, content.value)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                table = own.prefix_counts(text)
                cut = fits_budget(table, budget)
                texts.append(text[:cut])
                counts.append(table[cut])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_tokens"])

    kind_of_id = documents.schema["doc_id"].dataType.simpleString()
    return text_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of_id}, text string, n_tokens long")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
