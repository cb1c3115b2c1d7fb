"""miniSEED files: record headers, segment index, and samples.

A file is read whole by one task as a binary row (files are of a day or less of one station); its
records become packets, and the index follows them in their order in the file. Version 2 records
of the public format: a 48-byte header, blockettes 1000 (encoding, byte order, record length) and
100 (exact rate), data as 16- or 32-bit integers, floats, doubles, Steim-1 or Steim-2.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PACKET = "path string, net string, sta string, loc string, chan string, starttime double, endtime double, npts long, rate double, encoding int, foff long, nbytes long"
#: Bytes of header, and where the data of a record that has one blockette starts.
HEADER, FIRST_DATA = 48, 64


def year_start(year: int) -> float:
    return datetime(year, 1, 1, tzinfo=timezone.utc).timestamp()


def nominal_rate(factor: int, multiplier: int) -> float:
    """Samples a second from the two fields: positive ones multiply, negative ones divide."""
    if not factor or not multiplier:
        return 0.0
    f = float(factor) if factor > 0 else -1.0 / factor
    return f * multiplier if multiplier > 0 else -f / multiplier


def record_header(data: bytes, at: int) -> dict | None:
    """The header of the record at an offset; None if there is none."""
    if len(data) - at < HEADER or data[at + 6 : at + 7] not in (b"D", b"R", b"Q", b"M"):
        return None
    order = ">" if 1900 <= struct.unpack_from(">H", data, at + 20)[0] <= 2100 else "<"
    sta, loc, chan, net = (data[at + a : at + b].decode("ascii", "replace").strip() for a, b in ((8, 13), (13, 15), (15, 18), (18, 20)))
    year, day, hour, minute, second, _, fract = struct.unpack_from(order + "HHBBBBH", data, at + 20)
    npts, factor, multiplier, activity = struct.unpack_from(order + "HhhB", data, at + 30)
    correction, data_at, block = struct.unpack_from(order + "iHH", data, at + 40)
    rate, encoding, length, swapped = nominal_rate(factor, multiplier), 11, 512, order
    micro, seen = 0, 0
    while block and seen < 16 and at + block + 8 <= len(data):
        kind, following = struct.unpack_from(order + "HH", data, at + block)
        if kind == 1000:
            encoding, word, power = data[at + block + 4], data[at + block + 5], data[at + block + 6]
            length, swapped = 1 << power, ">" if word else "<"
        elif kind == 100:
            rate = struct.unpack_from(order + "f", data, at + block + 4)[0]
        elif kind == 1001:
            micro = struct.unpack_from(order + "b", data, at + block + 5)[0]
        block, seen = following, seen + 1
    start = year_start(year) + (day - 1) * 86400 + hour * 3600 + minute * 60 + second + fract / 1e4 + micro / 1e6
    if not activity & 2:
        start += correction / 1e4
    return {
        "net": net, "sta": sta, "loc": loc, "chan": chan, "starttime": start, "endtime": start + (npts - 1) / rate if rate and npts else start,
        "npts": npts, "rate": rate, "encoding": encoding, "foff": at, "nbytes": length, "data_at": data_at or FIRST_DATA, "order": swapped,
    }


def record_headers(data: bytes) -> Iterator[dict]:
    at = 0
    while (h := record_header(data, at)) is not None:
        yield h
        at += max(h["nbytes"], 64)


def steim(words: np.ndarray, npts: int, version: int) -> np.ndarray:
    """Samples from 64-byte frames of 32-bit words (unsigned, in native order)."""
    frames = words[: len(words) // 16 * 16].reshape(-1, 16)
    first, last = (np.int32(np.uint32(frames[0, k]).astype(np.uint32)) if len(frames) else 0 for k in (1, 2))
    diffs: list[int] = []

    def signed(value: int, bits: int, n: int) -> list[int]:
        mask, half = (1 << bits) - 1, 1 << bits - 1
        parts = [value >> bits * (n - 1 - i) & mask for i in range(n)]
        return [p - (1 << bits) if p >= half else p for p in parts]

    for f, frame in enumerate(frames):
        control = int(frame[0])
        for k in range(1, 16):
            code = control >> 2 * (15 - k) & 3
            if code == 0 or f == 0 and k < 3:
                continue
            w = int(frame[k])
            if code == 1:
                diffs += signed(w, 8, 4)
            elif version == 1:
                diffs += signed(w, 16, 2) if code == 2 else signed(w, 32, 1)
            else:
                pair = w >> 30
                plan = {2: {1: (30, 1), 2: (15, 2), 3: (10, 3)}, 3: {0: (6, 5), 1: (5, 6), 2: (4, 7)}}[code].get(pair)
                if plan is None:
                    raise ValueError("a frame that no encoder writes")
                diffs += signed(w & 0x3FFFFFFF, *plan)
    if len(diffs) < npts:
        raise ValueError("too few differences")
    d = np.array(diffs[:npts], np.int64)
    d[0] = first
    out = np.cumsum(d)
    if npts and out[-1] != last:
        raise ValueError("the last sample differs from the header's")
    return out.astype(float)


def record_samples(data: bytes, h: dict) -> np.ndarray:
    body = data[h["foff"] + h["data_at"] : h["foff"] + h["nbytes"]]
    kinds = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
    if h["encoding"] in kinds:
        return np.frombuffer(body, h["order"] + kinds[h["encoding"]], h["npts"]).astype(float)
    if h["encoding"] in (10, 11):
        return steim(np.frombuffer(body, h["order"] + "u4").astype(np.uint32), h["npts"], h["encoding"] - 9)
    raise ValueError(f"encoding {h['encoding']} is not supported")


def write_records(net: str, sta: str, loc: str, chan: str, start: float, rate: int, samples: np.ndarray, power: int = 9) -> bytes:
    """Records of 32-bit integers of a series whose rate is a whole number."""
    length = 1 << power
    per, out = (length - FIRST_DATA) // 4, []
    x = np.asarray(samples, ">i4")
    for k, at in enumerate(range(0, len(x), per)):
        part, t = x[at : at + per], start + at / rate
        when = datetime.fromtimestamp(t, timezone.utc)
        fract = round((t - np.floor(t)) * 1e4)
        head = f"{k + 1:06d}D {sta:<5}{loc:<2}{chan:<3}{net:<2}".encode()
        head += struct.pack(">HHBBBBH", when.year, when.timetuple().tm_yday, when.hour, when.minute, when.second, 0, min(fract, 9999))
        head += struct.pack(">HhhBBBBiHH", len(part), rate, 1, 0, 0, 0, 1, 0, FIRST_DATA, HEADER)
        head += struct.pack(">HHBBBB", 1000, 0, 3, 1, power, 0)
        out.append(head.ljust(FIRST_DATA, b"\0") + part.tobytes().ljust(length - FIRST_DATA, b"\0"))
    return b"".join(out)


def packets(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the files under a path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = [{"path": name, **{k: v for k, v in h.items() if k not in ("data_at", "order")}} for h in record_headers(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, PACKET)


SEGMENT = "net string, sta string, loc string, chan string, rate double, starttime double, endtime double, last_packet_time double, npts long, npackets long, foff long, nbytes long"


class Segments:
    """Segments of records in their order in the file: a segment ends where codes or the rate change,
    where records are not adjacent, and where a record starts more than ``tolerance`` samples off what
    the last record, or the samples since the segment's start, let expect. Only the open one is held."""

    def __init__(self, tolerance: float = 0.5, rate_tolerance: float = 0.0, codes: Sequence[str] = ("net", "sta", "loc", "chan")):
        self.tolerance, self.rate_tolerance, self.codes = tolerance, rate_tolerance, codes
        self.own = self.last = None

    def add(self, r: dict) -> dict | None:
        """The segment that the record ends, if it does."""
        own, last, done = self.own, self.last, None
        apart = own is None or any(r[k] != own[k] for k in self.codes)
        apart = apart or abs(r["rate"] - own["rate"]) > self.rate_tolerance * abs(r["rate"]) or r["foff"] != own["foff"] + own["nbytes"]
        if not apart:
            by_last = (r["starttime"] - last["starttime"]) * last["rate"] - last["npts"]
            by_start = (r["starttime"] - own["starttime"]) * own["rate"] - own["npts"]
            apart = max(abs(by_last), abs(by_start)) > self.tolerance
        if apart:
            done, own = own, {k: r[k] for k in (*self.codes, "rate", "starttime", "foff")} | {"npts": 0, "npackets": 0, "nbytes": 0}
        own["npts"] += r["npts"]
        own["npackets"] += 1
        own["nbytes"] += r["nbytes"]
        own["last_packet_time"] = r["starttime"]
        own["endtime"] = own["starttime"] + (own["npts"] - 1) / own["rate"]
        self.own, self.last = own, r
        return done


def file_segments(records: Iterator[dict], tolerance: float = 0.5, rate_tolerance: float = 0.0) -> Iterator[dict]:
    """Segments of one file's records."""
    open_ = Segments(tolerance, rate_tolerance)
    for r in records:
        if (done := open_.add(r)) is not None:
            yield done
    if open_.own is not None:
        yield open_.own


def index_files(spark: SparkSession, path: str, tolerance: float = 0.5, rate_tolerance: float = 0.0) -> DataFrame:
    """One row a segment of the files under a path: codes, times, samples, offset and length in bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                usable = (h for h in record_headers(bytes(content)) if h["rate"] > 0 and h["npts"] > 0)
                if rows := [{"path": name} | s for s in file_segments(usable, tolerance, rate_tolerance)]:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, "path string, " + SEGMENT)


def index_packets(df: DataFrame, tolerance: float = 0.5, rate_tolerance: float = 0.0) -> DataFrame:
    """The same from rows of ``packets``. Records stream through their task in the order of path and offset, so
    that Python holds a batch and the open segment, however long a file is."""
    columns = ["path", "net", "sta", "loc", "chan", "starttime", "npts", "rate", "foff", "nbytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = Segments(tolerance, rate_tolerance, ("path", "net", "sta", "loc", "chan"))
        for b in batches:
            values = zip(*[b[c].tolist() for c in columns], strict=True)
            if rows := [s for v in values if (s := open_.add(dict(zip(columns, v, strict=True)))) is not None]:
                yield pd.DataFrame(rows)
        if open_.own is not None:
            yield pd.DataFrame([open_.own])

    rows = df.filter("rate > 0 AND npts > 0").select(*columns).repartition("path").sortWithinPartitions("path", "foff")
    return rows.mapInPandas(run, "path string, " + SEGMENT)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: codes, t0, dt, npts and data; ``merge`` makes series of them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                content = bytes(content)
                rows = []
                for h in record_headers(content):
                    if h["rate"] and h["npts"]:
                        rows.append({"net": h["net"], "sta": h["sta"], "loc": h["loc"], "chan": h["chan"], "t0": h["starttime"], "dt": 1 / h["rate"], "npts": h["npts"], "data": record_samples(content, h).tolist()})
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, "net string, sta string, loc string, chan string, t0 double, dt double, npts long, data array<double>")
