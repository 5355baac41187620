"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are reduced to the same form: A-Z lower-cased, words of
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, one space before, between and after them. A pattern is a
window of `window` consecutive words of an item in that form (an item of fewer words, but at
least one, is one pattern), so a pattern occurs in a text exactly where its words do.

The search keeps, for blocks of B bytes, how far the end of the search window may move without
missing a pattern (the shift table). Where the shift is 0 the hash of that last block selects a
bucket of patterns, whose first bytes and then whole bytes are compared with the text. Many
cursors move over a batch of texts in step, so each step is a few array operations.

Defined results
    null text, or text without words: n_words 0, n_hit 0, no items, not contaminated.
    null item text, or item without words: never occurs.
    empty benchmark: nothing is contaminated; empty documents: empty result.
    repeated rows: each row is judged by itself; an item id given twice counts once.
    other columns are kept unless an output column has the same name.

The document side is only mapped, never shuffled. Patterns go to the workers in blocks of at
most `block_patterns`; a larger benchmark is searched by a chain of passes over each batch, so
what one pass broadcasts is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm.names import unused
from strataform.session import lean, materialize, ship_package

WINDOW = 10
#: Patterns that one pass searches for: at 10 words about 4 MB of patterns and 20 MB of tables.
BLOCK_PATTERNS = 50_000
#: Blocks that one task searches before what it found is written; each has a Python worker of its own.
CHAIN = 4
#: Bytes of text searched at once.
BATCH_BYTES = 16_000_000

_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Shortest pattern of each table; patterns of about one length share a table so that short ones do not shrink all shifts.
_CLASSES = (1, 4, 12)


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The distinct patterns of one item."""
    w = words(text)
    if not w:
        return []
    n = max(1, len(w) - window + 1)
    return list(dict.fromkeys(b" " + b" ".join(w[i : i + window]) + b" " for i in range(n)))


class _Table:
    """Shift table and suffix-hash buckets for patterns of at least `m` bytes."""

    def __init__(self, patterns: list[bytes], ids: np.ndarray):
        self.patterns, self.ids = patterns, ids
        self.m = m = min(map(len, patterns))
        self.block = block = max(1, min(8, m // 2))
        self.mask = np.uint64((1 << (8 * block)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), np.uint8)
        self.bits = min(22, max(10, int(np.ceil(np.log2(8 * len(patterns) * (m - block + 1))))))
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        base = np.arange(len(patterns)) * m
        for end in range(block - 1, m):
            np.minimum.at(self.shift, self.hash(self.values(heads, base + end - block + 1)), m - 1 - end)
        last = self.hash(self.values(heads, base + m - block))
        self.order = np.argsort(last, kind="stable")
        self.bucket = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1))
        self.first = self.values(heads, base)
        self.size = np.array([len(p) for p in patterns])
        tails = np.frombuffer(b"".join(p[-block:] for p in patterns) + bytes(8), np.uint8)
        self.tail = self.values(tails, np.arange(len(patterns)) * block)

    def values(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The block of bytes that starts at each position, as one number; `data` has 8 spare bytes."""
        view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        return view[at] & self.mask

    def hash(self, value: np.ndarray) -> np.ndarray:
        return (value * _ODD >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, data: np.ndarray, n: int, stride: int = 2048) -> np.ndarray:
        """Ends of search windows whose shift is 0."""
        m, block = self.m, self.block
        at = np.arange(m - 1, n, stride)
        stop = np.minimum(at + stride, n)
        found = []
        while len(at):
            step = self.shift[self.hash(self.values(data, at - block + 1))]
            hit = step == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            inside = at < stop
            if not inside.all():
                at, stop = at[inside], stop[inside]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def search(self, raw: bytes, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences: start positions and pattern ids."""
        start = self.candidates(data, n) - self.m + 1
        code = self.hash(self.values(data, start + self.m - self.block))
        count = self.bucket[code + 1] - self.bucket[code]
        which = np.repeat(np.arange(len(start)), count)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        pattern = self.order[self.bucket[code][which] + offset]
        start = start[which]
        ok = (self.values(data, start) == self.first[pattern]) & (start + self.size[pattern] <= n)
        start, pattern = start[ok], pattern[ok]
        ok = self.values(data, start + self.size[pattern] - self.block) == self.tail[pattern]
        start, pattern = start[ok], pattern[ok]
        same = np.array([raw.startswith(self.patterns[p], s) for s, p in zip(start.tolist(), pattern.tolist(), strict=True)], bool)
        return start[same], self.ids[pattern[same]] if len(same) else self.ids[:0]


class WuManber:
    """Finds every occurrence of many byte patterns in a byte string."""

    def __init__(self, patterns: list[bytes]):
        self.tables = []
        for low, high in zip(_CLASSES, (*_CLASSES[1:], 1 << 62), strict=True):
            ids = [i for i, p in enumerate(patterns) if low <= len(p) < high]
            if ids:
                self.tables.append(_Table([patterns[i] for i in ids], np.array(ids)))

    def search(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(raw + bytes(8), np.uint8)
        found = [t.search(raw, data, len(raw)) for t in self.tables if len(raw) >= t.m]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Searcher:
    """One block of patterns with the items and word counts behind them."""

    def __init__(self, patterns: list[bytes], items: list[list[int]]):
        self.search = WuManber(patterns).search
        self.items = items
        self.size = np.array([p.count(b" ") - 1 for p in patterns], np.int64)

    def batch(self, texts: list[str | None]) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[int]]]:
        """Word count of each text; for texts with occurrences the hit word numbers and the item ids."""
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        raw = b"".join(b" " + b" ".join(w) + b" " for w in split if w)
        hits: dict[int, np.ndarray] = {}
        found: dict[int, set[int]] = {}
        if not raw:
            return counts.tolist(), hits, found
        start, pattern = self.search(raw)
        if len(start):
            spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
            slots = np.where(counts > 0, counts + 1, 0)  # a text of n words has n + 1 spaces
            first = np.cumsum(slots) - slots
            word = np.searchsorted(spaces, start)
            doc = np.searchsorted(first + slots, word, side="right")
            size = self.size[pattern]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            covered = np.unique(np.repeat(word, size) + inside)
            owner = np.searchsorted(first + slots, covered, side="right")
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for part, d in zip(np.split(covered, cuts), owner[np.r_[0, cuts]].tolist(), strict=True):
                hits[d] = part - first[d]
            for d, p in zip(doc.tolist(), pattern.tolist(), strict=True):
                found.setdefault(d, set()).update(self.items[p])
        return counts.tolist(), hits, found


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_patterns: int) -> Iterator[list[tuple[bytes, list[int]]]]:
    """The distinct patterns with their items, in blocks of at most `block_patterns`; at least one block."""
    ship_package(benchmark.sparkSession)

    def cut(batches):
        for b in batches:
            rows = [(p, i) for i, t in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True) if i is not None for p in windows(t, window)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([i for _, i in rows], pa.int64())], ["pattern", "item"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, "pattern binary, item long")
    grouped = rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))
    block: list[tuple[bytes, list[int]]] = []
    for row in grouped.toLocalIterator():  # one block in the driver's memory at a time
        if len(block) == block_patterns:
            yield block
            block = []
        block.append((bytes(row.pattern), list(row["items"])))
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """Adds n_words, n_hit (words inside occurrences), items (sorted ids, array of long) and contaminated."""
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "items", "contaminated"]
    kept = [c for c in docs.columns if c not in made]
    fields = [docs.schema[c] for c in kept]
    text = text_col if text_col in kept else unused(kept, "text_read")
    hit_name, item_name = unused(kept, "hits_so_far"), unused(kept, "items_so_far")
    own = text != text_col
    state = [T.StructField(text, T.StringType())] * own + [T.StructField(hit_name, T.BinaryType()), T.StructField(item_name, T.ArrayType(T.LongType())), T.StructField("n_words", T.LongType())]
    df = docs.select(*(F.col(f"`{c}`") for c in kept), *([F.col(f"`{text_col}`").alias(text)] if own else []), F.lit(None).cast("binary").alias(hit_name), F.lit(None).cast("array<bigint>").alias(item_name), F.lit(0).cast("long").alias("n_words"))
    middle = T.StructType([*fields, *state])
    final = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("contaminated", T.BooleanType())])
    sent = [spark.sparkContext.broadcast(b) for b in pattern_blocks(benchmark, item_col, item_text_col, window, block_patterns)]
    for k, block in enumerate(sent):
        last = k == len(sent) - 1
        df = df.mapInArrow(_pass(block, kept, text, own, hit_name, item_name, last), final if last else middle)
        if k % CHAIN == CHAIN - 1 and not last:
            df = materialize(spark, df, "scanned")  # so many blocks at once in a task, however many there are
    return df


def _pass(sent, kept: list[str], text: str, add_text: bool, hit_name: str, item_name: str, last: bool):
    """Search one block of patterns and merge what earlier blocks have found."""

    def run(batches):
        searcher = Searcher([p for p, _ in sent.value], [i for _, i in sent.value])
        for batch in batches:
            texts = batch.column(text).to_pylist()
            a = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size < BATCH_BYTES and i + 1 < len(texts):
                    continue
                part, size = batch.slice(a, i + 1 - a), 0
                counts, hits, found = searcher.batch(texts[a : i + 1])
                a = i + 1
                hit_col, item_col = part.column(hit_name).to_pylist(), part.column(item_name).to_pylist()
                for d in hits:
                    before = np.frombuffer(hit_col[d], np.int64) if hit_col[d] else hits[d][:0]
                    hit_col[d] = np.union1d(before, hits[d]).astype(np.int64).tobytes()
                    item_col[d] = sorted({*(item_col[d] or ()), *found[d]})
                rows = [part.column(c) for c in kept]
                if last:
                    n_hit = [len(h or b"") // 8 for h in hit_col]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([x or [] for x in item_col], pa.list_(pa.int64())), pa.array([n > 0 for n in n_hit], pa.bool_())], [*kept, "n_words", "n_hit", "items", "contaminated"])
                else:
                    own = [part.column(text)] if add_text else []
                    yield pa.RecordBatch.from_arrays([*rows, *own, pa.array(hit_col, pa.binary()), pa.array(item_col, pa.list_(pa.int64())), pa.array(counts, pa.int64())], [*kept, *([text] if own else []), hit_name, item_name, "n_words"])

    return lean(run)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with their own columns."""
    seen = scan(docs, benchmark, **options).filter(~F.col("contaminated"))
    return seen.select(*(F.col(f"`{c}`") for c in docs.columns if c in seen.columns))


def item_digest(items) -> F.Column:
    """Lower-case hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return F.sha2(F.concat_ws(",", F.array_sort(F.transform(items, lambda x: x.cast("string")))), 256)


def digest_of(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
