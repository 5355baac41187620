"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words are read in overlapping windows of `WINDOW` words, `STRIDE` apart, which together
cover the whole text. A word's input joins a word embedding (hashed) and the embeddings of its
character n-grams (hashed; their sum over the root of their number), so spellings never seen in training still carry their parts. The two
directions' states are pooled by learned attention into one score for each window; a document
scores as its highest window does.

Training is in NumPy, by backpropagation through time, from random tables, on a sample of whole
texts that is bounded in rows. As labels are for documents, not windows, the first steps learn from
random windows and the rest from each document's highest window and one random one of documents
without the label. Half the word embeddings are hidden in every step, so that the character n-grams
learn as well, and the parameters are the mean over the last steps.

Defined results
    null or empty text, or text without a word: score 0.0, predicted 0.
    no labelled row of one of the two kinds: every score is 0.0.
    equal texts get equal scores; repeated rows are each returned; an empty table is empty.
    very long texts are scored whole, window by window.
    other columns are kept unless an output column has the same name.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm import gru, shingles
from strataform.llm.names import unused
from strataform.session import lean, release_memory, ship_package

WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 12, 8, 16, 8
#: Rows of the two hashed embedding tables.
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5)
#: Labelled documents of each kind that training reads at most, whole.
SAMPLE_ROWS = 1_500
WARM_STEPS, STEPS, BATCH = 60, 440, 48
#: Share of the words of a step whose own embedding is hidden.
HIDE = 0.5
#: Share of the steps at the full learning rate; over the rest it is lower, and parameters are averaged.
FULL_RATE = 0.6
#: Words whose n-grams are hashed at a time.
_AT_ONCE = 20_000
#: Distinct words a worker keeps with their gate inputs before it starts afresh.
CACHE_WORDS = 50_000
_TOGETHER = 512
_WORD = re.compile(r"\w+").findall


def words(text: str | None) -> list[str]:
    return _WORD(text.lower()) if text else []


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        return code


def features(vocab: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row of the word table, and flat rows of the character table with bounds."""
    parts = [_features(vocab[a : a + _AT_ONCE]) for a in range(0, len(vocab), _AT_ONCE)]
    whole, rows, counts = (np.concatenate([p[k] for p in parts] or [np.empty(0, np.int32)]) for k in range(3))
    return whole, rows, np.r_[0, np.cumsum(counts)]


def _features(vocab: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shown = [f"<{w}>" for w in vocab]
    size = np.array([len(w) for w in shown], np.int64)
    data = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    first = np.cumsum(size) - size
    rows, owner = [], []
    for n in GRAMS:
        count = np.maximum(size - n + 1, 1 if n == GRAMS[0] else 0)
        of = np.repeat(np.arange(len(shown)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        h = np.full(len(start), n, np.uint64)
        for k in range(n):
            at = start + k
            h = shingles.mix(h ^ np.where(at < first[of] + size[of], data[np.minimum(at, len(data) - 1)], np.uint64(0)))
        rows.append((h % np.uint64(CHAR_ROWS)).astype(np.int32))
        owner.append(of)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    whole = (shingles.span_hashes(np.frombuffer("".join(shown).encode("utf-8", "surrogatepass") + b"\0", np.uint8), *_spans(shown)) % np.uint64(WORD_ROWS)).astype(np.int32)
    return whole, np.concatenate(rows)[order], np.bincount(owner, minlength=len(shown))


def _spans(shown: list[str]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in shown])
    return np.r_[0, end[:-1]], end


def inputs(params: dict, whole: np.ndarray, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    chars = np.add.reduceat(params["chars"][grams], bounds[:-1], axis=0) / np.sqrt(np.diff(bounds))[:, None]
    return np.concatenate([params["words"][whole], chars], axis=1).astype(np.float32)


def starts(n: int) -> range:
    """Where the windows of a text of n words begin: the last one reaches its end."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)


def _pool(params: dict, h: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Window logits from states (steps, batch, 2 * hidden) by attention over the real positions."""
    q = np.tanh(h @ params["wa"])
    e = q @ params["va"]
    e[~real] = -30.0
    w = np.exp(e - e.max(axis=0))
    w *= real
    w /= w.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", w, h)
    return pooled @ params["wo"] + params["bo"][0], (q, w, pooled)


class _Trainer:
    def __init__(self, texts: list[str], labels: list[int], hidden: int, seed: int):
        self.rng, self.hidden = np.random.default_rng(seed), hidden
        rng, size = self.rng, WORD_DIM + CHAR_DIM
        self.params = {
            "words": rng.normal(0, 0.1, (WORD_ROWS, WORD_DIM)).astype(np.float32),
            "chars": rng.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM)).astype(np.float32),
            "wf": rng.normal(0, 0.3, (size, 3 * hidden)).astype(np.float32),
            "wb": rng.normal(0, 0.3, (size, 3 * hidden)).astype(np.float32),
            "uf": gru.orthogonal(rng, hidden),
            "ub": gru.orthogonal(rng, hidden),
            "wa": rng.normal(0, 0.3, (2 * hidden, ATTENTION)).astype(np.float32),
            "va": rng.normal(0, 0.3, ATTENTION).astype(np.float32),
            "wo": rng.normal(0, 0.3, 2 * hidden).astype(np.float32),
            "bo": np.zeros(1, np.float32),
        }
        self.opt = gru.Adam(self.params, 0.01)
        codes = _Codes()
        self.docs = [np.array([codes[w] for w in words(t)], np.int64) for t in texts]
        self.whole, self.grams, self.bounds = features(list(codes))
        self.of = [[k for k, y in enumerate(labels) if y == c and len(self.docs[k])] for c in (0, 1)]

    def window(self, k: int, at: int) -> np.ndarray:
        return self.docs[k][at : at + WINDOW]

    def learn(self, parts: list[np.ndarray], label: np.ndarray, scale: float) -> None:
        p, hidden = self.params, self.hidden
        used, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        x = np.full((WINDOW, len(parts)), len(used))
        at = 0
        for j, part in enumerate(parts):
            x[: len(part), j] = inverse[at : at + len(part)]
            at += len(part)
        real = x < len(used)
        lengths = np.diff(self.bounds)[used]
        flat = np.concatenate([self.grams[a:b] for a, b in zip(self.bounds[used], self.bounds[used + 1], strict=True)])
        cuts = np.r_[0, np.cumsum(lengths)]
        v = inputs(p, self.whole[used], flat, cuts)
        open_ = (self.rng.random((len(used), 1)) >= HIDE).astype(np.float32)
        v[:, :WORD_DIM] *= open_
        pad = gru.pad_row(hidden)
        gf, gb = (np.concatenate([v @ p[k], pad[None]])[x] for k in ("wf", "wb"))
        hf, kf = gru.trace(gf, p["uf"], False)
        hb, kb = gru.trace(gb, p["ub"], True)
        h = np.concatenate([hf, hb], axis=2)
        logit, (q, w, pooled) = _pool(p, h, real)
        d = ((1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
        dpool = d[:, None] * p["wo"]
        dw = np.einsum("bh,tbh->tb", dpool, h)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * p["va"] * (1 - q * q)
        dh = w[:, :, None] * dpool + dq @ p["wa"].T
        grads = {"wo": pooled.T @ d, "bo": d.sum(keepdims=True), "va": np.einsum("tb,tba->a", de, q), "wa": np.einsum("tbh,tba->ha", h, dq)}
        dv = np.zeros_like(v)
        for key, u, part, kept, back in (("wf", "uf", dh[:, :, :hidden], kf, False), ("wb", "ub", dh[:, :, hidden:], kb, True)):
            dg, grads[u] = gru.gradient(np.ascontiguousarray(part), p[u], kept, back)
            total = np.zeros((len(used), 3 * hidden), np.float32)
            np.add.at(total, x[real], dg[real])
            grads[key] = v.T @ total
            dv += total @ p[key].T
        rows = {}
        for key, at_rows, g in (("words", self.whole[used], dv[:, :WORD_DIM] * open_), ("chars", flat, np.repeat(dv[:, WORD_DIM:] / np.sqrt(lengths)[:, None], lengths, axis=0))):
            rows[key], back = np.unique(at_rows, return_inverse=True)
            grads[key] = np.zeros((len(rows[key]), g.shape[1]), np.float32)
            np.add.at(grads[key], back, g)
        self.opt.step(grads, rows, scale)

    def best_windows(self, picked: list[int]) -> list[int]:
        """Each document's highest window."""
        used, inverse = np.unique(np.concatenate([self.docs[k] for k in picked]), return_inverse=True)
        flat = np.concatenate([self.grams[a:b] for a, b in zip(self.bounds[used], self.bounds[used + 1], strict=True)])
        v = inputs(self.params, self.whole[used], flat, np.r_[0, np.cumsum(np.diff(self.bounds)[used])])
        table = Tables(self.params, v)
        own = np.split(inverse, np.cumsum([len(self.docs[k]) for k in picked])[:-1])
        logits, owner, begin = table.windows(own)
        out = [0] * len(picked)
        order = np.lexsort((logits, owner))
        last = np.r_[owner[order][1:] != owner[order][:-1], True]
        for i in order[last].tolist():
            out[owner[i]] = int(begin[i])
        return out

    def fit(self, warm: int, steps: int) -> dict:
        rng = self.rng
        if not self.of[0] or not self.of[1]:
            return {}
        mean, n = {k: x.astype(np.float64) for k, x in self.params.items()}, 0
        for step in range(warm + steps):
            half = BATCH // 2
            picked = [self.of[c][i] for c in (0, 1) for i in rng.integers(0, len(self.of[c]), half).tolist()]
            label = np.repeat([0.0, 1.0], half).astype(np.float32)
            at = [int(rng.choice(starts(len(self.docs[k])))) for k in picked]
            if step < warm:
                parts = [self.window(k, a) for k, a in zip(picked, at, strict=True)]
            else:
                best = self.best_windows(picked)
                parts = [self.window(k, a) for k, a in zip(picked, best, strict=True)] + [self.window(k, a) for k, a in zip(picked[:half], at[:half], strict=True)]
                label = np.r_[label, np.zeros(half, np.float32)]
            full = step < warm + steps * FULL_RATE
            self.learn(parts, label, 1.0 if full else 0.3)
            if not full:
                n += 1
                for k, x in self.params.items():
                    mean[k] += (x - mean[k]) / n
        return {k: x.astype(np.float32) for k, x in (mean if n else self.params).items()}


class Tables:
    """Gate inputs of some words, for scoring."""

    def __init__(self, params: dict, vectors: np.ndarray):
        self.params, self.hidden = params, params["uf"].shape[0]
        pad = gru.pad_row(self.hidden)[None]
        self.gates = [np.concatenate([pad, vectors @ params[k]]) for k in ("wf", "wb")]

    def extend(self, vectors: np.ndarray) -> None:
        self.gates = [np.concatenate([g, vectors @ self.params[k]]) for g, k in zip(self.gates, ("wf", "wb"), strict=True)]

    def windows(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit, document number and first word of every window of every document."""
        owner = np.array([k for k, d in enumerate(docs) for _ in starts(len(d))], np.int64)
        begin = np.array([a for d in docs for a in starts(len(d))], np.int64)
        size = np.array([len(d) for d in docs], np.int64)
        base = np.cumsum(size) - size
        flat = np.concatenate([*docs, np.empty(0, np.int64)]) + 1
        length = np.minimum(size[owner] - begin, WINDOW) if len(owner) else size[:0]
        logits = np.empty(len(owner))
        for i in range(0, len(owner), _TOGETHER):
            some = slice(i, i + _TOGETHER)
            step = np.arange(WINDOW)[:, None]
            real = step < length[some]
            x = np.where(real, flat[np.minimum(base[owner[some]] + begin[some] + step, len(flat) - 1)], 0)
            h = np.empty((WINDOW, x.shape[1], 2 * self.hidden), np.float32)
            for k, (u, back) in enumerate((("uf", False), ("ub", True))):
                own = np.empty((WINDOW, x.shape[1], self.hidden), np.float32)
                gru.run(self.gates[k], x, self.params[u], own, back)
                h[:, :, k * self.hidden : (k + 1) * self.hidden] = own
            logits[some] = _pool(self.params, h, real)[0]
        return logits, owner, begin


class Scorer:
    """Scores texts; keeps the words it has met with their gate inputs."""

    def __init__(self, params: dict, cache_words: int = CACHE_WORDS):
        self.params, self.cache_words = params, cache_words
        self._reset()

    def _reset(self) -> None:
        self.codes, self.known, self.tables = _Codes(), 0, None

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.params:
            return [0.0] * len(texts)
        if len(self.codes) > self.cache_words:
            self._reset()
        docs = [np.frombuffer(array("q", map(self.codes.__getitem__, words(t))), np.int64) for t in texts]
        new = list(self.codes)[self.known :]
        if new:
            v = inputs(self.params, *features(new))
            if self.tables is None:
                self.tables = Tables(self.params, v)
            else:
                self.tables.extend(v)
            self.known = len(self.codes)
        best = np.full(len(texts), -np.inf)
        if self.tables is not None:
            logits, owner, _ = self.tables.windows(docs)
            np.maximum.at(best, owner, logits)
        return [round(float(1 / (1 + np.exp(-min(60.0, max(-60.0, x))))), 6) if x > -np.inf else 0.0 for x in best.tolist()]


def train(texts: list[str], labels: list[int], hidden: int = HIDDEN, warm: int = WARM_STEPS, steps: int = STEPS, seed: int = 0) -> dict:
    """Parameters learned from labelled texts; empty if one of the labels has no text with a word."""
    model = _Trainer(texts, labels, hidden, seed).fit(warm, steps)
    release_memory()
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds score and predicted (1 where score >= 0.5)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    made = ["score", "predicted"]
    kept = [c for c in docs.columns if c not in made]
    text = text_col if text_col in kept else unused(kept, "text_read")
    source = docs.select(*(F.col(f"`{c}`") for c in kept), *([] if text == text_col else [F.col(f"`{text_col}`").alias(text)]))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in shingles.pieces(texts, 2_000_000):
                s = scorer.scores(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*kept, *made])

    return source.mapInArrow(lean(run), schema)


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most `rows` documents of each label, in order of a hash of the id.

    Ids are chosen first, and only their texts are fetched; of an id with several texts, the least.
    An id with both labels has label 1.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null and t <> ''")
    total = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.pmod(F.xxhash64("i", F.lit("toxic")), F.lit(1_000_000_000))
    # a bounded set of ids, some of which may have no text
    share = F.when(F.col("y") == 1, F.lit(min(1.0, 8.0 * rows / max(1, total.get(1, 0))))).otherwise(F.lit(min(1.0, 8.0 * rows / max(1, total.get(0, 0)))))
    some = known.withColumn("o", order).filter(F.col("o") < share * 1_000_000_000)
    found = texts.select("i").join(F.broadcast(some), "i").distinct().collect()
    picked = {r.i: (r.y, k) for y in (0, 1) for k, r in enumerate(sorted((r for r in found if r.y == y), key=lambda r: (r.o, r.i))[:rows])}
    if not picked:
        return [], []
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], known.select("i").schema)
    got = texts.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: picked[r.i])
    return [r.t for r in got], [picked[r.i][0] for r in got]


def held_out(doc_id, fold: int = 5):
    """Whether crc32 of the id as text leaves 0 modulo `fold`; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == 0, F.lit(True))
