"""Fuzzy line dedup: MinHash bands over character shingles, exact verification, union-find.

Lines are compared in a normal form (A-Z lower-cased, runs of ASCII white space as one blank). A line's set
holds its distinct shingles of `k` characters; a line of fewer characters is one shingle. Lines
of equal normal form are one class. Classes whose signatures agree on all `rows` values of one of
`bands` bands are compared exactly, and link when 100 * |intersection| >= percent * |union|. At
that similarity 11 bands of 3 find a pair with probability 0.998, and more the more alike it is.
Of each component of links the first line stays, in order of (doc_id, line number).

Large bands do not give all their pairs. A task that meets more than `small` lines of a band
pairs them with one leader and their neighbours, sends on two of them, marked as such, and sets
all aside; so does the task that gathers a band, whatever its rows, if any of them is marked. What was set aside and lies in different components after the
first links is compared in blocks on the spot, and only links leave those tasks.

Defined results
    null text stays null, empty text stays empty: no lines. Blank lines are never removed.
    repeated rows: rows of one id and equal text count as one document and stay alike; its first
    line occurrence stays in each.
    a document that loses every line keeps its row with an empty text and n_removed = n_lines.
    very long lines are compared whole. Empty table: empty result.
    rows with a null id stay untouched.
    other columns are kept; output columns replace columns of their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm import bloom, shingles
from strataform.llm.components import components
from strataform.llm.names import unused
from strataform.session import lean, materialize, ship_package

K, BANDS, ROWS, PERCENT = 8, 11, 3, 75
SMALL, BLOCK = 16, 256
_BATCH = 1_000_000
#: Line keys that a task remembers so as not to emit a line's bands twice.
_SEEN = 100_000


#: What a text whose lines are all in normal form, but for case, does not have.
_ODD = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def normal_lines(text: str | None) -> list[bytes]:
    """The normal form of every line of a text, as UTF-8."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if raw[0] != 32 and raw[-1] != 32 and not any(x in raw for x in _ODD):
        return raw.split(b"\n")
    return [b" ".join(x.split()) for x in raw.split(b"\n")]


def normal(line: str) -> str:
    return b" ".join(line.encode("utf-8", "surrogatepass").lower().split()).decode("utf-8", "surrogatepass")


def key(line: bytes) -> bytes:
    """128 bits of a normal form."""
    return hashlib.blake2b(line, digest_size=16).digest()


def key_numbers(keys: list[bytes]) -> np.ndarray:
    """Keys as rows of two signed numbers."""
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


def text_of(lines: list[bytes]) -> list[str]:
    return [x.decode("utf-8", "surrogatepass") for x in lines]


def _windows(c: np.ndarray, k: int) -> np.ndarray:
    """The polynomial hash of every k numbers in a row, by doubling window sizes."""
    width, h, done, out = 1, c, 0, None
    power = [int(shingles._P)]
    while True:
        if k & width:  # the next `width` numbers after those already hashed
            part = h[done : len(c) - k + done + 1]
            out = part if out is None else out * np.uint64(pow(power[0], width, 1 << 64)) + part
            done += width
        if width * 2 > k:
            return out
        h = h[:-width] * np.uint64(pow(power[0], width, 1 << 64)) + h[width:]
        width *= 2


def grams(lines: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the lines, repeats included, and where each line's begin (one entry more)."""
    size = np.array([len(x) for x in lines], np.int64)
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    c += np.uint64(1)
    first = np.cumsum(size) - size
    bounds = np.r_[0, np.cumsum(np.maximum(size - k + 1, 1))]
    start = np.arange(len(c)) < np.repeat(np.maximum(first + size - k + 1, first + 1), size)
    h = np.zeros(len(c), np.uint64)
    if len(c) >= k:
        h[: len(c) - k + 1] = _windows(c, k)
    for i in np.flatnonzero(size < k).tolist():  # the whole line is one shingle
        x = int(size[i])
        for v in c[first[i] : first[i] + size[i]].tolist():
            x = (x * int(shingles._STEP) + v) & 0xFFFFFFFFFFFFFFFF
        h[first[i]] = x
    h = h[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h, bounds


def line_set(line: str, k: int) -> np.ndarray:
    return _distinct(grams([line], k)[0])


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = np.sort(np.concatenate([s, t]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


#: Shingles of a column and columns of a tile in the signature's layout: a tile stays in the cache.
_ROWS, _COLUMNS = 32, 1024


def signatures(lines: list[str], k: int, hashes: int, limit: int = 60_000) -> np.ndarray:
    """(hashes, lines): `_signatures` of runs of lines of about `limit` characters, which stay in the cache."""
    parts = [_signatures(lines[a:b], k, hashes) for a, b in shingles.pieces(lines, limit)]
    return np.concatenate(parts, axis=1) if parts else np.empty((hashes, 0), np.uint32)


def _signatures(lines: list[str], k: int, hashes: int) -> np.ndarray:
    """(hashes, lines): the least value of each hash function over a line's shingles.

    Shingles are laid out in columns of 32, a line's last column filled with its last shingle, so
    that a minimum runs over whole rows at once; few columns are left to reduce by line.
    """
    g, bounds = grams(lines, k)
    g = (g >> np.uint64(32)).astype(np.uint32)
    count = np.diff(bounds)
    columns = -(-count // _ROWS)
    first = np.cumsum(columns) - columns
    owner = np.repeat(np.arange(len(lines)), columns)
    start = bounds[owner] + (np.arange(len(owner)) - first[owner]) * _ROWS
    end = bounds[owner + 1] - 1
    seeds = shingles.mix(np.arange(1, hashes + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    low = np.empty((hashes, len(owner)), np.uint32)
    for a in range(0, len(owner), _COLUMNS):
        tile = g[np.minimum(start[a : a + _COLUMNS] + np.arange(_ROWS)[:, None], end[a : a + _COLUMNS])]
        room = np.empty_like(tile)
        for r in range(hashes):
            np.multiply(tile, seeds[r], out=room)
            np.minimum.reduce(room, axis=0, out=low[r, a : a + _COLUMNS])
    return np.minimum.reduceat(low, first, axis=1) if len(lines) else low


def band_keys(lines: list[str], k: int, bands: int, rows: int) -> np.ndarray:
    """(lines, bands) keys; lines that agree on a band's values have its key in common."""
    lows = signatures(lines, k, bands * rows)
    out = np.empty((len(lines), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(lines), b + 1, np.uint64)
        for r in range(rows):
            h = shingles.mix(h ^ lows[b * rows + r])
        out[:, b] = h
    return out


def _batches(batches, limit: int = _BATCH):
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for x, y in shingles.pieces(texts, limit):
            yield ids[x:y], texts[x:y]


def star(band: np.ndarray, line: np.ndarray, small: int):
    """Of rows sorted by band: pairs to compare, and which rows lie in a band of more than `small` rows.

    Small bands give all their pairs; larger ones give pairs of neighbours and pairs with their first row.
    """
    new = np.r_[True, band[1:] != band[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(band)])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for g in range(2, small + 1):
        of = start[size == g]
        if len(of):
            x, y = np.triu_indices(g, 1)
            left.append(line[(of[:, None] + x).ravel()])
            right.append(line[(of[:, None] + y).ravel()])
    large = np.repeat(size > small, size)
    rows = np.flatnonzero(large & ~new)
    lead = np.repeat(start, size)[rows]
    left += [line[lead], line[rows - 1]]
    right += [line[rows], line[rows]]
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]], axis=1), axis=0)
    return pairs, large, start, size


#: Kinds of rows: pairs of lines (a, b); a line b set aside for band a; rows (band a, line b) to
#: gather; occurrences of the line (hi a, lo b) in document c at line d; rows to gather of a band
#: that its task has set aside. In the shuffle rows are packed, column after column, by a bucket of
#: what they are dealt by.
_PACKED = "bucket int, kind int, data binary"
_KINDS = "kind int, a long, b long, c long, d long"
_PAIR, _ASIDE, _ROW, _LINE, _MARKED = 0, 1, 2, 3, 4
_WIDTH = {_PAIR: 2, _ASIDE: 2, _ROW: 2, _LINE: 4, _MARKED: 2}
_BUCKETS = 512
_FLUSH = 600_000


class _Packer:
    """Gathers rows by kind and gives them out as packed buckets."""

    def __init__(self):
        self.held = {k: [] for k in _WIDTH}
        self.size = 0

    def add(self, kind: int, deal: np.ndarray, *cols: np.ndarray) -> None:
        if len(deal):
            self.held[kind].append(np.stack([deal, *cols]))
            self.size += len(deal)

    def give(self):
        buckets, kinds, data = [], [], []
        for kind, parts in self.held.items():
            if not parts:
                continue
            rows = np.concatenate(parts, axis=1)
            bucket = (shingles.mix(rows[0].view(np.uint64)) % np.uint64(_BUCKETS)).astype(np.int16)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[1:, order], bucket[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            for x, y in itertools.pairwise(cuts.tolist()):
                buckets.append(int(bucket[x]))
                kinds.append(kind)
                data.append(rows[:, x:y].tobytes())
            self.held[kind] = []
        self.size = 0
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


def _emit(kind, *cols):
    for k in range(0, len(cols[0]), 100_000):
        part = [pa.array(np.ascontiguousarray(x[k : k + 100_000])) for x in cols]
        none = pa.nulls(len(part[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part, *[none] * (4 - len(part))], ["kind", "a", "b", "c", "d"])


def _starred(band, line, small, distinct: bool):
    """Rows sorted by band, their pairs, which lie in large bands, and which to send on: all of small bands, two of a large one.

    `distinct`: no row occurs twice. Else only rows of bands with several rows are returned, each once.
    """
    order = np.argsort(band)
    band, line = band[order], line[order]
    if not distinct and len(band):
        same = band[1:] == band[:-1]
        several = np.r_[False, same] | np.r_[same, False]
        band, line = band[several], line[several]
        order = np.lexsort((line, band))
        band, line = band[order], line[order]
        fresh = np.r_[True, (band[1:] != band[:-1]) | (line[1:] != line[:-1])] if len(band) else several[:0]
        band, line = band[fresh], line[fresh]
    if not len(band):
        return band, line, np.empty((0, 2), np.int64), np.zeros(0, bool), np.zeros(0, bool)
    pairs, large, start, size = star(band, line, small)
    on = ~large
    ends = start[size > small]
    on[ends] = True
    on[ends + size[size > small] - 1] = True
    return band, line, pairs, large, on


def _band_rows(k: int, bands: int, rows: int, small: int):
    """Line occurrences, rows of distinct lines' bands, and what large bands of this batch give at once."""

    def run(batches):
        seen: set[bytes] = set()
        packer = _Packer()
        for ids, texts in _batches(batches):
            keys: dict[bytes, bytes] = {}
            owner, doc, number = [], [], []
            for i, t in zip(ids, texts, strict=True):
                for n, x in enumerate(normal_lines(t) if i is not None else ()):
                    if x:
                        own = keys.get(x)
                        if own is None:
                            own = keys[x] = key(x)
                        owner.append(own), doc.append(i), number.append(n)
            if not owner:
                continue
            hi, lo = key_numbers(owner).T
            doc, number = np.array(doc, np.int64), np.array(number, np.int64)
            packer.add(_LINE, hi ^ doc, hi, lo, doc, number)  # dealt by line and document: a very common line goes to many tasks
            fresh = [x for x, own in keys.items() if own not in seen]
            if len(seen) < _SEEN:
                seen.update(keys[x] for x in fresh)
            if fresh:
                name = key_numbers([keys[x] for x in fresh])[:, 0]
                band = band_keys(text_of(fresh), k, bands, rows).ravel().view(np.int64)
                band, line, pairs, large, on = _starred(band, np.repeat(name, bands), small, True)
                for kind, rows_on in ((_ROW, on & ~large), (_MARKED, on & large)):
                    packer.add(kind, band[rows_on], band[rows_on], line[rows_on])
                if large.any():  # pairs of small bands come from the task that gathers the band
                    a, b = pairs[np.isin(pairs[:, 0], line[large]) & np.isin(pairs[:, 1], line[large])].T
                    packer.add(_PAIR, a ^ b, a, b)
                    packer.add(_ASIDE, line[large] ^ band[large], band[large], line[large])
            if packer.size > _FLUSH:
                yield from packer.give()
        yield from packer.give()

    return lean(run)


def _gather(small: int):
    def run(batches):
        held: dict[int, list[np.ndarray]] = {k: [] for k in _WIDTH}
        for b in batches:
            for kind, data in zip(b.column("kind").to_pylist(), b.column("data").to_pylist(), strict=True):
                rows = np.frombuffer(data, np.int64).reshape(_WIDTH[kind], -1)
                if kind in (_LINE, _ASIDE):
                    yield from _emit(kind, *rows)
                else:
                    held[kind].append(rows)
        none = np.empty((2, 0), np.int64)
        marked = np.concatenate([none, *held[_MARKED]], axis=1)
        band, line, pairs, large, _ = _starred(*np.concatenate([none, *held[_ROW], marked], axis=1), small, False)
        large = large | np.isin(band, marked[0])  # the rest of such a band's rows is known only to the task that set it aside
        pairs = np.concatenate([pairs.T, *held[_PAIR]], axis=1)
        if pairs.shape[1]:
            pairs = np.unique(pairs, axis=1)
            yield from _emit(_PAIR, *pairs)
        if large.any():
            yield from _emit(_ASIDE, band[large], line[large])

    return lean(run)


def _lines_in(sent):
    """(hi, lo, line) of lines whose key's bit is on, once a batch."""

    def run(batches):
        bits = sent.value
        for _, texts in _batches(batches):
            lines = list({x for t in texts for x in normal_lines(t) if x})
            if not lines:
                continue
            names = key_numbers([key(x) for x in lines])
            on = np.flatnonzero(bloom.among(bits, names[:, 0].copy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(names[on, 0]), pa.array(names[on, 1]), pa.array(text_of([lines[i] for i in on]), pa.string())], ["hi", "lo", "line"])

    return lean(run)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]]


def _verify(k: int, percent: int, at_once: int = 1000):
    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                b = whole.slice(i, at_once)
                number = _Numbers()  # a line is in several pairs, and rows come in order of one side
                x, y = ([number[t] for t in b.column(c).to_pylist()] for c in ("line_a", "line_b"))
                g, at = grams(list(number), k)
                sets = [_distinct(g[p:q]) for p, q in itertools.pairwise(at.tolist())]
                part = b.filter(pa.array([similar(sets[p], sets[q], percent) for p, q in zip(x, y, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("a", "a_lo", "b", "b_lo")], ["a", "a_lo", "b", "b_lo"])

    return lean(run)


class _Numbers(dict):
    def __missing__(self, name: str) -> int:
        n = self[name] = len(self)
        return n


def _block_links(k: int, percent: int):
    """Links between the lines of two blocks of one band that are not connected yet."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        band, bi, bj, own, node, comp = (t.column(c).to_numpy() for c in ("band", "bi", "bj", "block", "node", "comp"))
        text = t.column("line")
        order = np.lexsort((node, bj, bi, band))
        keys = np.stack([band, bi, bj])[:, order]
        start = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        found = []
        for a, z in itertools.pairwise([*start.tolist(), len(order)]):
            rows = order[a:z]
            g, at = grams([text[int(r)].as_py() for r in rows], k)
            sets = [_distinct(g[x:y]) for x, y in itertools.pairwise(at.tolist())]
            size, group, home = np.array([len(x) for x in sets]), comp[rows].copy(), own[rows]
            sketch = np.stack([np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256), 65535) for x in sets]).astype(np.uint16)
            cross = bi[rows[0]] != bj[rows[0]]
            for i in range(len(rows) - 1):
                # of the rows after this one: not connected yet, of a size that allows the similarity, in the other block
                later = (group[i + 1 :] != group[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
                if cross:
                    later &= home[i + 1 :] != home[i]
                later = np.flatnonzero(later) + i + 1
                # shingles of each of 256 hash ranges bound the overlap from above
                bound = np.minimum(sketch[later], sketch[i]).sum(axis=1, dtype=np.int64)
                full = (sketch[i] == 65535).any()
                for j in later[(bound * (100 + percent) >= percent * (size[later] + size[i])) | full].tolist():
                    if group[j] != group[i] and similar(sets[i], sets[j], percent):
                        found.append((int(node[rows[i]]), int(node[rows[j]])))
                        group[group == group[j]] = group[i]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return lean(run)


def _classes(docs: DataFrame, found: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """(hi, lo, root): every class that links to another, with a number for its component."""
    spark = docs.sparkSession
    pairs = found.filter(F.col("kind") == _PAIR).select("a", "b").distinct()
    aside = found.filter(F.col("kind") == _ASIDE).select(F.col("a").alias("band"), F.col("b").alias("hi")).distinct()
    named = F.when(F.col("kind") == _PAIR, F.array("a", "b")).otherwise(F.array("b"))
    bits = bloom.bits(found.filter(F.col("kind").isin(_PAIR, _ASIDE)).select(F.explode(named).alias("hi")), "hi")
    lines = docs.mapInArrow(_lines_in(spark.sparkContext.broadcast(bits)), "hi long, lo long, line string")
    lines = materialize(spark, lines.dropDuplicates(["hi", "lo"]).withColumn("node", F.monotonically_increasing_id()), "lines")
    of = lambda c: lines.select(F.col("hi").alias(c), F.col("node").alias(f"{c}_lo"), F.col("line").alias(f"line_{c}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b").filter("a_lo <> b_lo")
    links = materialize(spark, full.mapInArrow(_verify(k, percent), "a long, a_lo long, b long, b_lo long").select(F.col("a_lo").alias("a"), F.col("b_lo").alias("b")), "links")
    comp = components(spark, links, "a", "b")
    if not aside.isEmpty():
        held = aside.join(lines, "hi").join(comp, "node", "left").select("band", "node", "line", F.coalesce("component", "node").alias("comp"))
        held = materialize(spark, held, "aside")
        open_ = held.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("g")).filter("low < high")
        open_ = open_.select("band", F.ceil(F.col("g") / block).cast("int").alias("blocks"))
        dealt = held.join(open_, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("band", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "comp", "line")
        rest = materialize(spark, dealt.repartition("band", "bi", "bj").mapInArrow(_block_links(k, percent), "a long, b long"), "rest")
        if not rest.isEmpty():
            comp = components(spark, comp.toDF("a", "b").union(rest), "a", "b")
    comp = comp.union(comp.select(F.col("component").alias("node"), "component").distinct())
    return lines.join(comp, "node").select("hi", "lo", F.col("component").alias("root"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, lines): for each document that loses lines, their (line_no, hi)."""
    spark = docs.sparkSession
    ship_package(spark)
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    packed = plain.mapInArrow(_band_rows(k, bands, rows, small), _PACKED).repartition("bucket")
    found = materialize(spark, packed.select("kind", "data").mapInArrow(_gather(small), _KINDS), "bands")
    occ = found.filter(F.col("kind") == _LINE).select(F.col("a").alias("hi"), F.col("b").alias("lo"), F.col("c").alias("doc_id"), F.col("d").alias("line_no"))
    roots = _classes(plain, found, k, percent, block)
    several = occ.groupBy("hi", "lo").agg(F.count("*").alias("n")).filter("n > 1").select("hi", "lo")
    classes = materialize(spark, several.join(roots, ["hi", "lo"], "full").select("hi", "lo", "root"), "line_classes")
    rows_of = materialize(spark, occ.join(classes, ["hi", "lo"]), "line_rows")
    # the first line of each component, or of each class that links with nothing; written, so that joins with very common lines can be split
    low = F.min(F.struct("doc_id", "line_no")).alias("keep")
    keep = [(rows, by, materialize(spark, rows.groupBy(*by).agg(low), name)) for rows, by, name in ((rows_of.filter("root is not null"), ["root"], "best"), (rows_of.filter("root is null"), ["hi", "lo"], "first"))]
    gone = functools.reduce(DataFrame.union, (rows.join(first, by).select("hi", "doc_id", "line_no", "keep") for rows, by, first in keep)).filter("doc_id <> keep.doc_id or line_no <> keep.line_no")
    return materialize(spark, gone.groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "hi")).alias("lines")), "removals")


_BLANK = " \t\n\r\x0b\x0c"


def _rebuild(names: list[str], text_col: str, lines_col: str):
    """Documents without the lines listed for them."""

    def run(batches):
        for b in batches:
            out, total, lost = [], [], []
            for t, gone in zip(b.column(text_col).to_pylist(), b.column(lines_col).to_pylist(), strict=True):
                lines = t.split("\n") if t else []
                total.append(sum(x.strip(_BLANK) != "" for x in lines))
                if not gone or not t:
                    out.append(t), lost.append(0)
                    continue
                meant = {(g["line_no"], g["hi"]) for g in gone}
                # rows of one id may have several texts: a line goes only if it is the one that was meant
                drop = {n for n in {n for n, _ in meant if n < len(lines)} if (n, int.from_bytes(key(normal(lines[n]).encode("utf-8", "surrogatepass"))[:8], "little", signed=True)) in meant}
                left = [x for n, x in enumerate(lines) if n not in drop]
                out.append("\n".join(left) if any(map(normal, left)) else "")
                lost.append(len(drop))
            cols = {text_col: pa.array(out, pa.string()), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[c] if c in cols else b.column(c) for c in names], names)

    return lean(run)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the lines that repeat others; adds n_lines (not blank) and n_removed."""
    gone = removals(docs, id_col, text_col, **options)
    made = ["n_lines", "n_removed"]
    filled = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    base = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made))
    names = [*base.columns, *made]
    schema = T.StructType([*base.schema.fields, *(T.StructField(c, T.LongType()) for c in made)])
    own_id, own_lines = unused(base.columns, "removal_id"), unused(base.columns, "removal_lines")
    clear, maybe = bloom.split(base, id_col, bloom.build(gone, "doc_id", "line_bloom"))
    hit = maybe.join(gone.select(F.col("doc_id").alias(own_id), F.col("lines").alias(own_lines)), F.col(f"`{id_col}`").cast("long") == F.col(own_id), "left").drop(own_id)
    whole = clear.withColumn("n_lines", F.size(filled).cast("long")).withColumn("n_removed", F.lit(0).cast("long"))
    return whole.unionByName(hit.mapInArrow(_rebuild(names, text_col, own_lines), schema))
