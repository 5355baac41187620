"""Repeated passages by sparse suffix arrays.

A position is retained where the hash of its next `K` words is the least of a run of `length - K + 1`
positions, a choice that depends on content alone, so every passage of `length` words holds a
retained position, and equal passages hold equal ones. Each retained position is a suffix; what is
kept of it is the words from `length - K` before it to `length` after it, as 32-bit hashes.

1. Seeds (the K words at retained positions) are counted; only suffixes whose seed occurs again
   go on. Two Bloom filters of a fixed size tell the second pass which those are.
2. Suffixes with equal kept words are one entry. Entries are dealt by seed and sorted by their
   following words: a sparse suffix array. Neighbours are compared word by word, which gives for
   every r the runs of entries that share r following words; within a run of `length - o`, entries
   that also share the o words before them share a passage of `length` words that begins o words
   before the position. All o are tried, so a match is found whichever neighbours it lies between.
3. The passages of all positions of a document unite to maximal repeated spans.

A seed with more than `HOT` suffixes is not gathered in one task: each of its passages of `length`
words is hashed, and equal hashes are counted in a shuffle by hash.

Defined results
    null or empty text, or fewer than `length` words: n_words as counted, no spans.
    repeated rows and equal texts repeat each other: all their passages are spans, the first one's too.
    rows of one id with different texts are told apart by a hash of the text; null ids are kept.
    a passage repeated within one document counts as well. Empty table: empty result.
    very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import bloom, shingles
from strataform.session import lean, materialize, ship_package

LENGTH, K = 50, 16
#: Suffixes of one seed that one task compares; about 7 MB.
HOT = 20_000


def _slide(x: np.ndarray, width: int, back: bool, best) -> np.ndarray:
    """best() over x[i : i + width], or over x[i - width + 1 : i + 1] if back; edges use what there is."""
    out, have = x, 1
    while have < width:
        by = min(have, width - have)
        moved = out.copy()
        if back:
            moved[by:] = best(out[by:], out[:-by]) if by < len(out) else out[by:]
        elif by < len(out):
            moved[:-by] = best(out[:-by], out[by:])
        out, have = moved, have + by
    return out


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Retained positions of texts laid end to end, and their seeds."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * shingles._P + h[j : j + n]
    g = shingles.mix(g)
    w = length - k + 1
    low = _slide(g, w, False, np.minimum)
    start = np.arange(n)
    stop = np.repeat(bounds[1:], np.diff(bounds))[:n]
    low[start + length > stop] = 0  # no passage of `length` words begins here
    top = _slide(low, w, True, np.maximum)
    at = np.flatnonzero((top == g) & (g != 0))
    return at, g[at]


def _pieces(batches, limit: int = 1_000_000):
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("id", "th", "text")]
        for x, y in shingles.pieces(cols[2], limit):
            yield [c[x:y] for c in cols]


def _seeds(length: int, k: int):
    def run(batches):
        for _, _, texts in _pieces(batches):
            _, seed = anchors(*shingles.word_hashes(texts), length, k)
            s, n = np.unique(seed, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["seed", "n"])

    return lean(run)


_ROWS = "kind int, id long, th long, at long, hi long, lo long, n long, words binary"
_DOC, _ENTRY, _PLACE, _PASSAGE = 0, 1, 2, 3


def _row(kind: int, count: int, **cols) -> pa.RecordBatch:
    names = ("id", "th", "at", "hi", "lo", "n", "words")
    kinds = {"words": pa.binary()}
    made = [pa.array(cols[c], kinds.get(c, pa.int64())) if c in cols else pa.nulls(count, kinds.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(np.full(count, kind, np.int32)), *made], ["kind", *names])


def _entries(again, hot, length: int, k: int):
    """Word counts, suffix entries with their places, and passages of hot seeds."""
    before = length - k

    def run(batches):
        for ids, ths, texts in _pieces(batches):
            h, bounds = shingles.word_hashes(texts)
            ids_, th_ = np.array([-1 if i is None else i for i in ids], np.int64), np.array(ths, np.int64)
            yield _row(_DOC, len(ids), id=ids, th=ths, n=np.diff(bounds))
            at, seed = anchors(h, bounds, length, k)
            keep = bloom.among(again.value, seed)
            at, seed = at[keep], seed[keep]
            if not len(at):
                continue
            doc = np.searchsorted(bounds, at, side="right") - 1
            some = bloom.among(hot.value, seed)
            if some.any():
                yield from _passages(h, bounds, at[some], doc[some], ids_, th_, length, before)
            at, seed, doc = at[~some], seed[~some], doc[~some]
            if not len(at):
                continue
            place = at[:, None] + np.arange(-before, length)
            inside = (place >= bounds[doc][:, None]) & (place < bounds[doc + 1][:, None])
            w = (h[np.clip(place, 0, len(h) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            w[~inside] = 0  # a word hash is odd, so no word is 0
            hi, lo = np.full(len(at), 1, np.uint64), np.full(len(at), 2, np.uint64)
            for j in range(w.shape[1]):
                hi, lo = hi * shingles._P + w[:, j], (lo ^ w[:, j]) * shingles._STEP + np.uint64(j)
                lo ^= lo >> np.uint64(29)
            hi, lo = shingles.mix(hi).view(np.int64), shingles.mix(lo).view(np.int64)
            yield _row(_PLACE, len(at), id=ids_[doc], th=th_[doc], at=at - bounds[doc], hi=hi, lo=lo)
            _, first, n = np.unique(hi, return_index=True, return_counts=True)
            yield _row(_ENTRY, len(first), id=seed[first].view(np.int64), hi=hi[first], lo=lo[first], n=n, words=[w[i].tobytes() for i in first])

    return lean(run)


def _passages(h, bounds, at, doc, ids, ths, length, before):
    start = (at[:, None] - np.arange(before + 1)).ravel()
    doc = np.repeat(doc, before + 1)
    ok = (start >= bounds[doc]) & (start + length <= bounds[doc + 1])
    start, first = np.unique(start[ok], return_index=True)
    doc = doc[ok][first]
    hi, lo = np.full(len(start), 3, np.uint64), np.full(len(start), 4, np.uint64)
    for j in range(length):
        x = h[start + j]
        hi, lo = hi * shingles._P + x, shingles.mix(lo ^ x)
    yield _row(_PASSAGE, len(start), id=ids[doc], th=ths[doc], at=start - bounds[doc], hi=shingles.mix(hi).view(np.int64), lo=lo.view(np.int64))


def common_starts(seed: np.ndarray, words: np.ndarray, n: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each entry the o (as bits) at which a passage of `length` words that begins o words before it occurs again."""
    before = length - k
    right = np.ascontiguousarray(words[:, before:])
    text = np.ascontiguousarray(right.astype(">u4")).view(f"S{4 * length}")[:, 0]
    order = np.lexsort((text, seed))
    seed, words, right, n = seed[order], words[order], right[order], n[order]
    same = right[1:] == right[:-1]
    common = np.where(same.all(axis=1), length, same.argmin(axis=1))
    common[seed[1:] != seed[:-1]] = 0
    common = np.r_[0, common]
    r_len, l_len = (right != 0).sum(axis=1), (words[:, :before] != 0).sum(axis=1)
    bits, left = np.zeros(len(seed), np.int64), np.full(len(seed), 7, np.uint64)
    for o in range(before + 1):
        if o:
            left = shingles.mix(left ^ words[:, before - o])
        run = np.cumsum(common < length - o).astype(np.uint64)
        rows = np.flatnonzero((l_len >= o) & (r_len >= length - o))
        key = shingles.mix(run[rows] * shingles._STEP ^ left[rows])
        _, group = np.unique(key, return_inverse=True)
        total = np.bincount(group, weights=n[rows])
        bits[rows[total[group] > 1]] |= 1 << o
    out = np.zeros(len(seed), np.int64)
    out[order] = bits
    return out


def _sorted_entries(length: int, k: int):
    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        seed, hi, lo, n = (t.column(c).to_numpy() for c in ("id", "hi", "lo", "n"))
        words = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint32).reshape(len(seed), -1)
        bits = common_starts(seed, words, n, length, k)
        keep = bits != 0
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (hi, lo, bits)], ["hi", "lo", "bits"])

    return lean(run)


def _united(length: int):
    """Each document's spans, from its rows in order of position."""

    def run(batches):
        for b in batches:
            spans = []
            for starts in b.column("starts").to_pylist():
                s = np.unique(np.array(starts, np.int64))
                cut = np.flatnonzero(np.diff(s) > length)
                spans.append([{"start": int(a), "stop": int(z) + length} for a, z in zip(s[np.r_[0, cut + 1]], s[np.r_[cut, len(s) - 1]], strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(spans, kind)], ["id", "th", "spans"])

    return lean(run)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT) -> DataFrame:
    """`id_col`, n_words, spans (of words, start and stop, in order) of repeated passages of at least `length` words."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    seeds = rows.mapInArrow(_seeds(length, k), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).filter("n > 1")
    seeds = materialize(spark, seeds, "seeds")
    again = spark.sparkContext.broadcast(bloom.bits(seeds, "seed"))
    busy = spark.sparkContext.broadcast(bloom.bits(seeds.filter(F.col("n") > hot), "seed"))
    made = materialize(spark, rows.mapInArrow(_entries(again, busy, length, k), _ROWS), "suffixes")
    kind = lambda x: made.filter(F.col("kind") == x)

    entries = kind(_ENTRY).select("id", "hi", "lo", "n", "words")
    found = entries.repartition("id").mapInArrow(_sorted_entries(length, k), "hi long, lo long, bits long")
    found = materialize(spark, found.groupBy("hi", "lo").agg(F.bit_or("bits").alias("bits")), "matches")
    places = kind(_PLACE).select("id", "th", "at", "hi", "lo").join(found, ["hi", "lo"])
    offsets = F.filter(F.sequence(F.lit(0), F.lit(length - k)), lambda o: F.getbit("bits", o) == 1)
    starts = places.select("id", "th", F.transform(offsets, lambda o: F.col("at") - o).alias("starts"))

    passages = kind(_PASSAGE).select("id", "th", "at", "hi", "lo")
    equal = materialize(spark, passages.groupBy("hi", "lo").count().filter("count > 1").select("hi", "lo"), "equal_passages")
    more = passages.join(equal, ["hi", "lo"]).select("id", "th", F.array("at").alias("starts"))
    grouped = starts.unionByName(more).groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    spans = materialize(spark, grouped.mapInArrow(_united(length), "id long, th long, spans array<struct<start:long,stop:long>>"), "spans")
    words = kind(_DOC).select("id", "th", F.col("n").alias("n_words"))
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return words.join(spans, ["id", "th"], "left").select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", none).alias("spans"))
