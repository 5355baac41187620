"""Media columns: content-defined chunks, deduplicated by digest, that rebuild stored media.

Each payload is stored as a sound file of unsigned 8-bit samples: a 44-byte RIFF/WAVE header with
the payload as its data. A rolling gear hash cuts the stored bytes into chunks where the top bits
of the hash over the last 32 bytes are zero, so equal passages of at least a few chunks give equal
chunks wherever they lie. Digests of chunks meet in a Spark aggregation that keeps one copy of
each; a medium is an ordered list of digests, and is rebuilt by joining that list with the kept
chunks and checking the medium's own digest.

Equal media share one list: lists are made distinct by media digest before chunks are joined, and
features return to documents by that digest. Chunks are deduplicated and joined under one shuffle
by digest; most media have one chunk and need no regrouping.

Defined results
    null or empty text: a payload of 576 bytes 255 (n_bytes 0).
    equal texts: equal values. Repeated rows are each returned. Empty table: empty result.
    very long texts: chunked and rebuilt whole. Extra columns: `store` keeps the id only, `restore`
    returns ids with features. Rows of one id with different texts are told apart by media digest.
    a chunk or list that fails its digest raises an error rather than give a wrong medium.

What is shuffled is compressed chunk bytes (zstd), each distinct chunk of a task once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.session import lean, materialize, ship_package

FRAME = 576
RATE = 8_000
#: Bytes of a chunk: at least, about (a power of 2) and at most.
LEAST, AVERAGE, MOST = 4_096, 16_384, 65_536
_LEVEL = 3


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled up with 255 to a positive multiple of 576, and their count before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def to_wave(data: bytes) -> bytes:
    """A mono sound file of unsigned 8-bit samples."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(data))
    return b"RIFF" + struct.pack("<I", len(head) + len(data)) + head + data


def from_wave(stored: bytes) -> bytes:
    """The samples of a sound file as `to_wave` writes it."""
    if stored[:4] != b"RIFF" or stored[8:16] != b"WAVEfmt ":
        raise ValueError("not a sound file")
    at = 12
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], int.from_bytes(stored[at + 4 : at + 8], "little")
        if name == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("a sound file without samples")


def gear_table(seed: int = 0x5EED) -> np.ndarray:
    """A random 32-bit number for each byte, from the xorshift rule."""
    out, x = np.empty(256, np.uint32), seed
    for i in range(256):
        for _ in range(4):
            x ^= (x << 13) & 0xFFFFFFFF
            x ^= x >> 17
            x ^= (x << 5) & 0xFFFFFFFF
        out[i] = x
    return out


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum of table values shifted by their distance, over 32 bytes.

    32 shifts of a 32-bit number are done in 5 doublings instead of a loop over bytes.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            nxt = h.copy()
            nxt[k:] += h[:-k] << np.uint32(k)
            h = nxt
    return h


def cuts(stored: bytes, least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> list[int]:
    """Ends of the chunks of stored bytes."""
    n = len(stored)
    if n <= least:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(stored, np.uint8))
    marks = np.flatnonzero(h < np.uint32((1 << 32) // average)) + 1
    ends, start = [], 0
    while n - start > least:
        k = int(np.searchsorted(marks, start + least))
        end = min(int(marks[k]) if k < len(marks) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def feature(samples: bytes) -> str:
    """Of the samples: mean, deviation, sign changes about 128 a thousand, and energy of four quarters."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    turns = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    quarters = [float((q * q).mean()) for q in np.array_split(x, 4)]
    return f"{x.mean():.4f};{x.std():.4f};{1000 * turns / len(x):.2f};" + ",".join(f"{q:.1f}" for q in quarters)


def _media(least: int, average: int, most: int):
    """(id, n_bytes, media digest, chunk digests): the list only where this task has not given it."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            size, wholes, lists = [], [], []
            for t in texts:
                data, n = payload(t)
                stored = to_wave(data)
                whole = hashlib.sha256(stored).digest()
                names = None
                if whole not in seen:
                    if len(seen) < 100_000:
                        seen.add(whole)
                    ends = cuts(stored, least, average, most)
                    names = [hashlib.sha256(stored[a:z]).digest() for a, z in zip([0, *ends], ends, strict=False)]
                size.append(n), wholes.append(whole), lists.append(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(wholes, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["id", "n_bytes", "digest", "names"])

    return lean(run)


def _chunks(least: int, average: int, most: int):
    """(digest, compressed chunk): each distinct chunk of this task once."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=_LEVEL)
        seen: set[bytes] = set()
        for b in batches:
            names, parts = [], []
            for t in b.column(0).to_pylist():
                stored = to_wave(payload(t)[0])
                a = 0
                for z in cuts(stored, least, average, most):
                    name = hashlib.sha256(stored[a:z]).digest()
                    if name not in seen:
                        if len(seen) < 100_000:
                            seen.add(name)
                        names.append(name), parts.append(pack.compress(stored[a:z]))
                    a = z
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(parts, pa.binary())], ["digest", "chunk"])

    return lean(run)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, average: int = AVERAGE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(media, chunks).

    media, written in the shared folder: a row for each document: id, n_bytes, media digest, and the
    ordered chunk digests (null where an equal medium of the same task has them). chunks: each
    distinct chunk once, compressed; a plan, which may be written as a table or joined as it is, so
    that its bytes are shuffled once.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    media = materialize(spark, rows.mapInArrow(_media(least, average, most), "id long, n_bytes long, digest binary, names array<binary>"), "media")
    parts = rows.select("text").mapInArrow(_chunks(least, average, most), "digest binary, chunk binary")
    return media, parts.dropDuplicates(["digest"])


def _read(single: bool):
    """Rebuild each medium from its chunks in order, verify it, and compute its columns."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def described(whole: bytes, stored: bytes):
        if hashlib.sha256(stored).digest() != whole:
            raise ValueError(f"medium {whole.hex()} is not what was stored")
        data = from_wave(stored)
        return whole, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), whole.hex(), feature(data)

    def out(rows):
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        whole, held = None, []
        for b in batches:
            rows = []
            for w, s, n, chunk in zip(*(b.column(c).to_pylist() for c in ("whole", "seq", "n", "chunk")), strict=True):
                if single:
                    rows.append(described(w, unpack(chunk)))
                    continue
                if w != whole:
                    whole, held = w, []
                if s != len(held):
                    raise ValueError(f"medium {w.hex()} lacks chunk {len(held)}")
                held.append(unpack(chunk))
                if len(held) == n:
                    rows.append(described(w, b"".join(held)))
            yield out(rows)

    return lean(run)


_READ = "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def restore(media: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, n_bytes and the columns of `_READ` of every medium, from its chunks; a lost chunk raises an error."""
    lists = media.filter("names is not null").dropDuplicates(["digest"]).select(F.col("digest").alias("whole"), "names")
    lists = materialize(media.sparkSession, lists, "media_lists")
    users = lists.select("whole", F.size("names").alias("n"), F.posexplode("names").alias("seq", "digest"))
    joined = lambda few: users.filter("n = 1" if few else "n > 1").join(chunks, "digest").select("whole", "seq", "n", "chunk")
    one = joined(True).mapInArrow(_read(True), _READ)
    # media of several chunks: dealt by medium and put in order, so that one medium at a time is in memory
    more = joined(False).repartition("whole").sortWithinPartitions("whole", "seq").mapInArrow(_read(False), _READ)
    made = materialize(media.sparkSession, one.unionByName(more), "media_read")
    lost = media.select("digest").distinct().join(made, "digest", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a medium's chunks are not all in the store")
    return media.select("id", "n_bytes", "digest").join(made, "digest").drop("digest")
