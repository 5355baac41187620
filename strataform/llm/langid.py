"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, gives every position a distribution over the
languages it was trained on, and a document's distribution is the mean over all its positions.
It is trained in NumPy by backpropagation through time on spans from a sample of whole texts that
is bounded in rows.

Every text is read whole, in windows that overlap, as the network learns from short spans too: of
every `PIECE` bytes the labels are counted, and `CONTEXT` bytes more on either side are read for
them. That is the definition at every length; a text of at most `PIECE` bytes is one window. So all
windows of a batch advance together, and a text of any length is no chain of steps of its own. A
test compares long texts with one pass over all of their bytes.

Defined results
    null text, or text without a letter (by str.isalpha): lang_pred 'und', score 0.0.
    no labelled row to learn from: every other text is 'und' with score 0.0.
    equal texts get equal predictions; repeated rows are each returned; an empty table is empty.
    other columns are kept unless an output column has the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataform.llm import gru
from strataform.llm.names import unused
from strataform.session import lean, ship_package

HIDDEN = 8
PIECE, CONTEXT = 480, 32
#: Documents of one language that training reads at most, whole.
SAMPLE_ROWS = 400
STEPS, BATCH, SPAN = 400, 64, 64
_PAD = 256
_TOGETHER = 1024


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 0) -> dict:
    """A model from labelled texts; every language weighs the same."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    c = len(names)
    params = {
        "forward": rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32),
        "backward": rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32),
        "uf": gru.orthogonal(rng, hidden),
        "ub": gru.orthogonal(rng, hidden),
        "w": rng.normal(0, 0.1, (2 * hidden, c)).astype(np.float32),
        "b": np.zeros(c, np.float32),
    }
    of = {n: [] for n in names}
    for t, n in zip(texts, langs, strict=True):
        raw = t.encode("utf-8", "surrogatepass")
        if raw:
            of[n].append(np.frombuffer(raw, np.uint8).astype(np.int64))
    pools = [of[n] for n in names]
    opt = gru.Adam(params, 0.02)
    for step in range(steps if c > 1 else 0):
        label = rng.integers(0, c, BATCH)
        x = np.full((SPAN, BATCH), _PAD)
        for k, y in enumerate(label.tolist()):
            raw = pools[y][rng.integers(len(pools[y]))]
            at = int(rng.integers(max(1, len(raw) - SPAN + 1)))
            part = raw[at : at + SPAN]
            x[: len(part), k] = part
        real = x != _PAD
        for d in ("forward", "backward"):
            params[d][_PAD] = gru.pad_row(hidden)
        hf, kf = gru.trace(params["forward"][x], params["uf"], False)
        hb, kb = gru.trace(params["backward"][x], params["ub"], True)
        h = np.concatenate([hf, hb], axis=2)
        p = _softmax(h @ params["w"] + params["b"])
        d = p.copy()
        d[:, np.arange(BATCH), label] -= 1
        d *= (real / real.sum()).astype(np.float32)[:, :, None]
        dh = d @ params["w"].T
        dgf, duf = gru.gradient(np.ascontiguousarray(dh[:, :, :hidden]), params["uf"], kf, False)
        dgb, dub = gru.gradient(np.ascontiguousarray(dh[:, :, hidden:]), params["ub"], kb, True)
        grads = {"uf": duf, "ub": dub, "w": np.einsum("tbh,tbc->hc", h, d), "b": d.sum((0, 1))}
        for key, dg in (("forward", dgf), ("backward", dgb)):
            g = np.zeros((257, 3 * hidden), np.float32)
            np.add.at(g, x[real], dg[real])
            grads[key] = g
        opt.step(grads, scale=1.0 if step < steps * 0.6 else 0.3)
    for d in ("forward", "backward"):
        params[d][_PAD] = gru.pad_row(hidden)
    return {"names": names, **params}


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _positions(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities (steps, batch, languages) for every position of symbols (steps, batch)."""
    hidden = model["uf"].shape[0]
    h = np.empty((2, *x.shape, hidden), np.float32)
    gru.run(model["forward"], x, model["uf"], h[0], False)
    gru.run(model["backward"], x, model["ub"], h[1], True)
    z = h[0] @ model["w"][:hidden]
    z += h[1] @ model["w"][hidden:]
    z += model["b"]
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def positions(model: dict, text: str) -> list[str]:
    """The language of every byte position of a text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw) or not model["names"]:
        return []
    best = _positions(model, raw.astype(np.int64)[:, None])[:, 0].argmax(axis=1)
    return [model["names"][k] for k in best]


def pooled(model: dict, texts: list[str | None]) -> np.ndarray:
    """Mean distribution of every text, (texts, languages); zeros for empty texts."""
    raws = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    total = np.zeros((len(texts), len(model["names"])))
    spans = [(k, a, min(a + PIECE, len(r)), len(r)) for k, r in enumerate(raws) for a in range(0, len(r), PIECE)]
    spans.sort(key=lambda s: s[2] - s[1])  # pieces of about one length advance together
    for i in range(0, len(spans), _TOGETHER):
        some = spans[i : i + _TOGETHER]
        lead = [min(CONTEXT, a) for _, a, _, _ in some]
        width = max(b - a + CONTEXT + n for (_, a, b, _), n in zip(some, lead, strict=True))
        x = np.full((len(some), width), _PAD, np.int64)
        real = np.zeros((len(some), width), bool)
        for j, (k, a, b, n) in enumerate(some):
            part = raws[k][a - lead[j] : min(b + CONTEXT, n)]
            x[j, : len(part)] = part
            real[j, lead[j] : lead[j] + b - a] = True
        p = _positions(model, np.ascontiguousarray(x.T))
        p *= real.T[:, :, None]
        np.add.at(total, [k for k, _, _, _ in some], p.sum(axis=0, dtype=np.float64))
    size = np.array([max(1, len(r)) for r in raws])
    return total / size[:, None]


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the mean probability of that language)."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    made = ["lang_pred", "score"]
    kept = [c for c in docs.columns if c not in made]
    text = text_col if text_col in kept else unused(kept, "text_read")
    source = docs.select(*(F.col(f"`{c}`") for c in kept), *([] if text == text_col else [F.col(f"`{text_col}`").alias(text)]))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a in range(0, len(texts), 2000):
                some = texts[a : a + 2000]
                letters = [t is not None and any(map(str.isalpha, t)) for t in some]
                if model["names"]:
                    p = pooled(model, [t if ok else None for t, ok in zip(some, letters, strict=True)])
                    best = p.argmax(axis=1)
                    rows = [(model["names"][k], min(1.0, float(p[i, k]))) if ok else ("und", 0.0) for i, (k, ok) in enumerate(zip(best.tolist(), letters, strict=True))]
                else:
                    rows = [("und", 0.0)] * len(some)
                part = batch.slice(a, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array([x for x, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.float64())], [*kept, *made])

    return source.mapInArrow(lean(run), schema)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Whole texts and languages of at most `rows` documents of each language, in order of a hash of the id.

    Ids are chosen first, and only their texts are fetched; of an id with several texts, the least.
    An id with several languages counts as the least of them.
    """
    labelled = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("t")).filter("i is not null and lang is not null and t is not null and t <> ''")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    order = F.pmod(F.xxhash64("i", F.lit("lang")), F.lit(1_000_000_000))
    # thin out by hash first, so that about four times the rows that are kept reach the driver, as ids
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * rows / n))))
    thin = labelled.select("i", "lang", order.alias("o")).filter(F.col("o") < share[F.col("lang")] * 1_000_000_000)
    found = sorted(thin.groupBy("i", "o").agg(F.min("lang").alias("lang")).collect(), key=lambda r: (r.lang, r.o, r.i))
    picked, taken = {}, dict.fromkeys(counts, 0)
    for r in found:
        if taken[r.lang] < rows:
            taken[r.lang] += 1
            picked[r.i] = (len(picked), r.lang)
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], labelled.select("i").schema)
    got = labelled.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: picked[r.i][0])
    return [r.t for r in got], [picked[r.i][1] for r in got]


def held_out(doc_id, fold: int = 3, rest: int = 1):
    """Whether crc32 of the id as text leaves `rest` modulo `fold`; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == rest, F.lit(True))
