"""Similarity self-join of documents on word n-grams: rare-first prefix filtering.

A document's set holds its distinct shingles of `width` words. Two documents link when
100 * |intersection| >= percent * |union|. The steps, each a pass or a shuffle of its own:

1. Every task counts the shingles it meets at least twice; the counts are summed, and the most
   frequent shingles (at most `frequent`, a fixed bound) are sent to the workers. A set is then
   ordered by (that count, hash): any total order gives complete prefixes, this one puts rare
   shingles first.
2. Documents with equal sets become one class (a 128-bit signature). A set of n shingles has a
   prefix of n - ceil(n * percent / 100) + 1; each task emits a class's prefix once.
3. Prefix rows are dealt by shingle; a frequent shingle's rows are dealt further by a salt that
   follows its count. Rows that share a shingle make a candidate pair when the length and
   positional filters pass. Pairs with the group's leaders come first. The other pairs of groups
   of up to `small` rows, and the rows of larger groups and of salted shingles, are set aside for
   step 6.
4. Pairs are made distinct and pass the suffix filter: the number of shingles of each of 256 hash
   ranges bounds the overlap from above.
5. Each remaining pair is verified once on the two whole sets.
6. Links make components. What was set aside and lies in different components is compared, large
   groups in blocks, with the same filters; what passes is verified, so no link between
   components is lost, and copies are never expanded into all pairs.

Defined results
    null or empty text, or white space only: n_shingles 0, linked with nothing.
    fewer than `width` words: one shingle, the whole sequence; equal sequences link.
    repeated rows and equal texts: one class; each row is returned.
    equal ids on several rows: each row is returned; the id stands for all of them.
    empty table: empty result. Rows with a null id are returned with a null component.
    extra columns are ignored by `link`; `keep_one` keeps them.

Shuffled: prefix rows (24 bytes for a quarter of the shingles), candidate pairs, and the sets of
candidates. A Bloom filter of a fixed size keeps other documents from being read again.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm import bloom, shingles
from strataform.llm.components import components
from strataform.llm.names import unused
from strataform.session import lean, materialize, ship_package

WIDTH, PERCENT = 5, 75
#: Most frequent shingles that are ordered by count; 16 bytes each are sent to every worker.
FREQUENT = 1 << 18
#: Rows that one salt of a frequent shingle holds, about.
SALT_ROWS = 2_000
#: Groups of at most so many rows give all their pairs.
SMALL = 16
#: Rows of a block in the comparison of large groups.
BLOCK = 512
#: Hash ranges of the suffix filter.
RANGES = 256
#: Rows of a shingle that every other row of it is paired with first.
LEADERS = 3
_FLUSH = 4_000_000


def prefix_size(n: np.ndarray | int, percent: int):
    return n - (n * percent + 99) // 100 + 1


def sketch(s: np.ndarray) -> bytes:
    """Shingles in each hash range, as bytes; a full counter lifts the bound."""
    count = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


def _texts(batches, limit: int = 2_000_000):
    """(ids, texts) of a few million characters at a time."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for x, y in shingles.pieces(texts, limit):
            yield ids[x:y], texts[x:y]


def frequent_shingles(docs: DataFrame, width: int, frequent: int) -> dict[str, np.ndarray]:
    """The most frequent shingles, at most `frequent`, with their counts; sorted by shingle."""

    def count(batches):
        held, size, seen = [], 0, set()

        def flush():
            s = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            n = np.diff(np.r_[at, len(s)])
            at, n = at[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(s[at].view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])

        for _, texts in _texts(batches):
            for s in shingles.shingle_sets(texts, width):
                if len(s) and (key := shingles.signature(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if size > _FLUSH:
                yield flush()
                held, size, seen = [], 0, set()
        if held:
            yield flush()

    totals = materialize(docs.sparkSession, docs.mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "shingle_counts")
    # the least count above which at most `frequent` shingles lie, from a histogram over count's binary digits
    level = F.least(F.floor(F.log2("n") * 8), F.lit(511)).cast("int")
    sizes = {r.level: r.rows for r in totals.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    total, low = 0, 512
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > frequent:
            break
        total, low = total + sizes[k], k
    rows = totals.filter(level >= low).toArrow()
    s, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(s)
    return {"shingle": s[order], "n": n[order]}


def _counts(freq: dict[str, np.ndarray], s: np.ndarray) -> np.ndarray:
    known = freq["shingle"]
    if not len(known):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, freq["n"][at], 0)


def _profiles(sent, width: int, percent: int):
    """Per document: set size, signature, sketch and prefix in rare-first order."""

    def run(batches):
        for ids, texts in _texts(batches):
            out = []
            sets = shingles.shingle_sets(texts, width)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)])
            count = _counts(sent.value, flat)
            at = 0
            for i, s in zip(ids, sets, strict=True):
                n = len(s)
                if n:
                    c = count[at : at + n]
                    p = prefix_size(n, percent)
                    rare = np.flatnonzero(c == 0)[:p]  # the hashes are sorted already
                    if len(rare) < p:
                        common = np.flatnonzero(c)
                        rare = np.r_[rare, common[np.argsort(c[common], kind="stable")][: p - len(rare)]]
                    hi, lo = shingles.signature(s)
                    out.append((i, n, hi, lo, sketch(s), s[rare].tobytes()))
                    at += n
                else:
                    out.append((i, 0, 0, 0, None, None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "n", "hi", "lo", "sketch", "prefix"])

    return lean(run)


def _prefix_rows(sent):
    """One row for each class and prefix shingle of a task: shingle, salt, class, and n and position in one number."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            hi, lo, n, prefix = (b.column(k).to_pylist() for k in ("hi", "lo", "n", "prefix"))
            made = []
            for k in range(len(hi)):
                if n[k] and (key := (hi[k], lo[k])) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    p = np.frombuffer(prefix[k], np.uint64)
                    made.append((p, np.full(len(p), hi[k]), (n[k] << 32) + np.arange(len(p))))
                if made and (k + 1 == len(hi) or k % 2000 == 1999):
                    s, c, at = (np.concatenate(x) for x in zip(*made, strict=True))
                    made = []
                    salts = (_counts(sent.value, s) // SALT_ROWS + 1).astype(np.uint64)
                    # salts count from 1, and a shingle of one salt has 0, so every row tells whether its shingle is salted
                    salt = np.where(salts > 1, shingles.mix(c.view(np.uint64)) % salts + np.uint64(1), np.uint64(0)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(salt), pa.array(c), pa.array(at)], ["shingle", "salt", "cid", "at"])

    return lean(run)


def passes(n1, i1, n2, i2, percent: int):
    """Length and positional filters for rows that share a shingle at positions i1 and i2, if it is the first they share."""
    bound = 1 + np.minimum(n1 - i1 - 1, n2 - i2 - 1)
    return (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)) & (bound * (100 + percent) >= percent * (n1 + n2))


def _groups(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys."""
    n = len(cols[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, n])


def _pair_candidates(percent: int, small: int):
    """From each shingle's rows: pairs with a leader (kind 0), the other pairs of small groups (2), rows of large groups (1).

    The leaders are the rows in whose prefix the shingle comes first. In a group of near copies
    the original has no rare shingles of its own, so it leads, and most copies link to it.
    """

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        s, salt, c, at = (t.column(k).to_numpy() for k in ("shingle", "salt", "cid", "at"))
        order = np.lexsort((c, at >> 32, at & 0xFFFFFFFF, salt, s))
        s, salt, c, at = s[order], salt[order], c[order], at[order]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]) | (at[1:] != at[:-1])]  # several tasks may have emitted a class
        s, salt, c, at = s[fresh], salt[fresh], c[fresh], at[fresh]
        n, i = at >> 32, at & 0xFFFFFFFF
        start, size = _groups([s, salt])
        found: dict[int, list[np.ndarray]] = {0: [], 2: []}

        def pair(kind, x, y):
            ok = passes(n[x], i[x], n[y], i[y], percent) & (c[x] != c[y])
            x, y = c[x[ok]], c[y[ok]]
            found[kind].append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))

        first = np.repeat(start, size)
        for lead in range(LEADERS):
            rows = np.flatnonzero((np.arange(len(s)) - first > lead) & (np.repeat(size, size) > 1))
            pair(0, first[rows] + lead, rows)
        for g in range(LEADERS + 2, small + 1):
            of = start[size == g]
            if len(of):
                x, y = np.triu_indices(g, 1)
                x, y = x[x >= LEADERS], y[x >= LEADERS]
                pair(2, (of[:, None] + x).ravel(), (of[:, None] + y).ravel())
        done = np.empty((0, 2), np.int64)
        for kind, parts in found.items():
            both = np.unique(np.concatenate(parts or [done]), axis=0)
            for k in range(0, len(both), 100_000):
                part = both[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(np.ascontiguousarray(part[:, 0])), pa.array(np.ascontiguousarray(part[:, 1])), pa.array(np.zeros(len(part), np.int64))], ["kind", "a", "b", "at"])
        # a salted shingle is one group in truth, so its parts, of which this task may have one, are set aside whatever their size
        keep = np.flatnonzero(np.repeat(size > small, size) | (salt > 0))
        for k in range(0, len(keep), 100_000):
            x = keep[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array(s[x]), pa.array(c[x]), pa.array(at[x])], ["kind", "a", "b", "at"])

    return lean(run)


def _suffix_filter(percent: int):
    """Pairs whose sketches leave room for enough common shingles."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("sketch_a").to_pylist()), np.uint8).reshape(-1, RANGES)
            y = np.frombuffer(b"".join(b.column("sketch_b").to_pylist()), np.uint8).reshape(-1, RANGES)
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            full = ((x == 255) | (y == 255)).any(axis=1)
            keep = full | (np.minimum(x, y).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * n)
            part = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column("rep_a"), part.column("rep_b")], ["a", "b"])

    return lean(run)


def _sets(width: int):
    """(id, signature, set) of whole documents."""

    def run(batches):
        for ids, texts in _texts(batches):
            sets = shingles.shingle_sets(texts, width)
            keys = [shingles.signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "hi", "lo", "set"])

    return lean(run)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            part = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"])

    return lean(run)


def _block_pairs(percent: int):
    """Pairs of one shingle between two blocks of its rows that are in different components and pass all filters."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        s, bi, bj, own, rep, comp, at = (t.column(k).to_numpy() for k in ("shingle", "bi", "bj", "block", "rep", "comp", "at"))
        sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, RANGES)
        order = np.lexsort((rep, bj, bi, s))
        start, size = _groups([s[order], bi[order], bj[order]])
        found = []
        for a, g in zip(start.tolist(), size.tolist(), strict=True):
            rows = order[a : a + g]
            first, second = rows[own[rows] == bi[rows[0]]], rows[own[rows] == bj[rows[0]]]
            n2, i2 = at[second] >> 32, at[second] & 0xFFFFFFFF
            for k, x in enumerate(first.tolist()):
                y = second[k + 1 :] if bi[x] == bj[x] else second
                m, j = (n2[k + 1 :], i2[k + 1 :]) if bi[x] == bj[x] else (n2, i2)
                n, i = at[x] >> 32, at[x] & 0xFFFFFFFF
                y = y[passes(n, i, m, j, percent) & (comp[y] != comp[x])]
                if len(y):
                    full = (sk[y] == 255).any(axis=1) | (sk[x] == 255).any()
                    y = y[full | (np.minimum(sk[y], sk[x]).sum(axis=1, dtype=np.int64) * (100 + percent) >= percent * (n + (at[y] >> 32)))]
                    found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])], axis=1))
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    return lean(run)


class _Join:
    """The steps of one join; `profiles` has a row for each document, `classes` one for each set."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, frequent: int, small: int, block: int):
        self.spark = docs.sparkSession
        ship_package(self.spark)
        self.docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        self.width, self.percent, self.small, self.block = width, percent, small, block
        self.freq = self.spark.sparkContext.broadcast(frequent_shingles(self.docs.select("id", "text"), width, frequent))
        self.profiles = materialize(self.spark, self.docs.mapInArrow(_profiles(self.freq, width, percent), "id long, n long, hi long, lo long, sketch binary, prefix binary"), "profiles")
        real = self.profiles.filter("n > 0 and id is not null")
        self.classes = materialize(self.spark, real.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    def candidates(self) -> DataFrame:
        rows = self.profiles.filter("n > 0 and id is not null").select("hi", "lo", "n", "prefix").mapInArrow(_prefix_rows(self.freq), "shingle long, salt int, cid long, at long")
        found = rows.repartition("shingle", "salt").mapInArrow(_pair_candidates(self.percent, self.small), "kind int, a long, b long, at long")
        return materialize(self.spark, found, "candidates")

    def verified(self, near: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) of class representatives in, those that link out."""
        ids = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        _, maybe = bloom.split(self.docs, "id", bloom.build(ids, "id", f"{name}_bloom"))
        own = self.classes.select(F.col("rep").alias("id"), "hi", "lo")
        sets = maybe.mapInArrow(_sets(self.width), "id long, hi long, lo long, set binary").join(own.join(ids, "id", "left_semi"), ["id", "hi", "lo"], "left_semi")
        sets = materialize(self.spark, sets.dropDuplicates(["id", "hi", "lo"]).select("id", "set"), f"{name}_sets")
        of = lambda k: sets.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}"))
        full = near.join(of("a"), "a").join(of("b"), "b")
        return materialize(self.spark, full.mapInArrow(_verify(self.percent), "a long, b long").distinct(), f"{name}_links")

    def residue(self, large: DataFrame, first: DataFrame) -> DataFrame:
        """Pairs of large groups that are not connected by the links found so far and pass all filters."""
        own = self.classes.select(F.col("hi").alias("cid"), "rep")
        comp = F.coalesce("component", "rep").alias("comp")
        rows = large.select(F.col("a").alias("shingle"), F.col("b").alias("cid"), "at").distinct().join(own, "cid").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("shingle", "at", "cid", "rep", comp)
        rows = materialize(self.spark, rows, "large")
        open_ = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("g")).filter("low < high")
        open_ = open_.select("shingle", F.ceil(F.col("g") / self.block).cast("int").alias("blocks"))
        # sketches, the wide column, only go with rows of groups that are compared
        dealt = rows.join(open_, "shingle").join(self.classes.select(F.col("hi").alias("cid"), "sketch"), "cid")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("shingle", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "comp", "at", "sketch")
        return dealt.repartition("shingle", "bi", "bj").mapInArrow(_block_pairs(self.percent), "a long, b long").distinct()

    def near(self, pairs: DataFrame, name: str, comp: DataFrame | None = None) -> DataFrame:
        """Pairs of classes (by `hi`) as pairs of representatives, where the suffix filter passes and `comp` does not connect them yet."""

        def side(k, *cols):
            return self.classes.select(F.col("hi").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))

        if comp is None:
            joined = pairs.join(side("a", "rep", "n", "sketch"), "a").join(side("b", "rep", "n", "sketch"), "b").filter("rep_a <> rep_b")
        else:  # most pairs are connected by now: sketches, the wide columns, only join the others
            joined = pairs
            for k in "ab":
                own = comp.select(F.col("node").alias(f"rep_{k}"), F.col("component").alias(f"comp_{k}"))
                joined = joined.join(side(k, "rep").join(own, f"rep_{k}", "left").withColumn(f"comp_{k}", F.coalesce(f"comp_{k}", f"rep_{k}")), k)
            joined = joined.filter("comp_a <> comp_b").join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
        return materialize(self.spark, joined.mapInArrow(_suffix_filter(self.percent), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)

    def connected(self) -> DataFrame:
        """(node, component) of class representatives, from enough verified links to connect all that any links connect."""
        found = self.candidates()
        kind = lambda k: found.filter(F.col("kind") == k)
        comp = components(self.spark, self.verified(self.near(kind(0).select("a", "b").distinct(), "near"), "first"), "a", "b")
        others, large = not kind(2).isEmpty(), not kind(1).isEmpty()
        rest = []
        if others:
            rest.append(self.near(kind(2).select("a", "b").distinct(), "others", comp))
        if large:
            rest.append(self.residue(kind(1), comp))
        if rest:
            rest = materialize(self.spark, functools.reduce(DataFrame.union, rest).distinct(), "rest")
            if not rest.isEmpty():
                comp = components(self.spark, comp.toDF("a", "b").union(self.verified(rest, "second")), "a", "b")
        return comp

    def link(self) -> DataFrame:
        grouped = self.classes.join(self.connected().withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", F.coalesce("component", "rep").alias("root"))
        grouped = materialize(self.spark, grouped, "grouped")
        rows = self.profiles.select("id", "n", "hi", "lo").join(grouped, ["hi", "lo"], "left")
        return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, frequent: int = FREQUENT, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row for each document: `id_col`, n_shingles, component_id (the smallest id that links reach)."""
    rows = _Join(docs, id_col, text_col, width, percent, frequent, small, block).link()
    return rows.withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each group, the one with the smallest id. Rows of one id stay or go together."""
    rows = link(docs, id_col, text_col, **options)
    name = unused(docs.columns, "gone")
    gone = materialize(docs.sparkSession, rows.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct(), "gone")
    clear, maybe = bloom.split(docs, id_col, bloom.build(gone, name, "gone_bloom"))
    kept = maybe.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
    return clear.unionByName(kept)
