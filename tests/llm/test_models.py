"""The recurrent networks: gradients, held-out accuracy, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.llm import gru, langid, queries, toxicity


@pytest.mark.parametrize("backward", [False, True])
def test_gradient(backward):
    rng = np.random.default_rng(0)
    g = rng.normal(size=(5, 2, 9)).astype(np.float32)
    u, w = gru.orthogonal(rng, 3), rng.normal(size=(5, 2, 3)).astype(np.float32)
    states, kept = gru.trace(g, u, backward)
    dg, du = gru.gradient(w, u, kept, backward)
    loss = lambda g, u: float((gru.trace(g, u, backward)[0].astype(float) * w).sum())
    for i in np.ndindex(u.shape):
        a, b = u.copy(), u.copy()
        a[i] += 1e-2
        b[i] -= 1e-2
        assert abs((loss(g, a) - loss(g, b)) / 2e-2 - du[i]) < 1e-3
    for i in np.ndindex(g.shape):
        a, b = g.copy(), g.copy()
        a[i] += 1e-2
        b[i] -= 1e-2
        assert abs((loss(a, u) - loss(b, u)) / 2e-2 - dg[i]) < 1e-3


def test_padding_keeps_the_state_zero():
    rng = np.random.default_rng(1)
    table = np.concatenate([rng.normal(size=(4, 9)).astype(np.float32), gru.pad_row(3)[None]])
    u = gru.orthogonal(rng, 3)
    short, long = np.array([[1], [2]]), np.array([[1], [2], [4], [4]])
    for back in (False, True):
        a, b = np.empty((2, 1, 3), np.float32), np.empty((4, 1, 3), np.float32)
        gru.run(table, short, u, a, back)
        gru.run(table, long, u, b, back)
        assert np.array_equal(a, b[:2])


def test_language_held_out(spark, small):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    want = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(want) and len(held) > 200
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def language_model():
    return langid.train(["the of and to in that " * 30, "der die und ist das nicht " * 30], ["en", "de"], steps=60)


def test_language_cases(docs_of, odd_rows, language_model):
    got = langid.predict(docs_of(odd_rows).withColumn("score", F.lit("clash")), language_model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0.0) == (not letters)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (5, 6)}) == 1
    empty = langid.train([], [])
    assert {r.lang_pred for r in langid.predict(docs_of(odd_rows), empty).collect()} == {"und"}
    assert langid.predict(docs_of([]), language_model).count() == 0
    assert langid.positions(language_model, "the und")[0] in ("en", "de") and langid.positions(language_model, "") == []


def test_windows_agree_with_one_pass(spark):
    """Texts of several windows against one pass over all of their bytes."""
    sf = "/root/testdata/sf0.01"
    own = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(*langid.sample(own.filter(~langid.held_out(F.col("doc_id")))))
    long = [r.text for r in own.filter("length(text) between 2000 and 4000").orderBy("doc_id").limit(20).collect()]
    for text, got in zip(long, langid.pooled(model, long), strict=True):
        whole = langid._positions(model, np.frombuffer(text.encode(), np.uint8).astype(np.int64)[:, None])[:, 0].mean(axis=0)
        assert got.argmax() == whole.argmax() and np.abs(got - whole).max() < 0.01


def slow_states(gates, u):
    """States of one direction, one number at a time in double precision."""
    sigmoid = lambda x: 1 / (1 + np.exp(-2 * x))
    hidden = len(u)
    h, out = [0.0] * hidden, []
    for g in gates:
        a = [sum(h[i] * float(u[i, j]) for i in range(hidden)) for j in range(3 * hidden)]
        z = [sigmoid(g[j] + a[j]) for j in range(hidden)]
        r = [sigmoid(g[hidden + j] + a[hidden + j]) for j in range(hidden)]
        n = [np.tanh(g[2 * hidden + j] + r[j] * a[2 * hidden + j]) for j in range(hidden)]
        h = [z[j] * h[j] + (1 - z[j]) * n[j] for j in range(hidden)]
        out.append(h)
    return out


def both_ways(forward, backward, uf, ub):
    return np.array([a + b for a, b in zip(slow_states(forward, uf), slow_states(backward[::-1], ub)[::-1], strict=True)])


def test_language_equals_a_slow_forward_pass(language_model):
    m = language_model
    for text in ("the of", "und x der", "é", "to in that ist das"):
        raw = list(text.encode())
        h = both_ways(m["forward"][raw].astype(float), m["backward"][raw].astype(float), m["uf"], m["ub"])
        z = np.exp(h @ m["w"].astype(float) + m["b"])
        want = (z / z.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.abs(langid.pooled(m, [text, None])[0] - want).max() < 1e-4


def test_toxicity_equals_a_slow_forward_pass(toxic_model):
    """Every window's words one by one: embeddings, both directions, attention, and the highest window."""
    m = toxic_model
    texts = ["the of loser and", "a " * 90 + "you scum " + "the " * 70, "x"]
    for text, got in zip(texts, toxicity.Scorer(m).scores(texts), strict=True):
        words = toxicity.words(text)
        best = -np.inf
        for a in toxicity.starts(len(words)):
            rows = []
            for w in words[a : a + toxicity.WINDOW]:
                whole, grams, bounds = toxicity.features([w])
                chars = sum(m["chars"][g].astype(float) for g in grams) / np.sqrt(bounds[1])
                rows.append(np.concatenate([m["words"][whole[0]].astype(float), chars]))
            x = np.array(rows)
            h = both_ways(x @ m["wf"], x @ m["wb"], m["uf"], m["ub"])
            e = np.tanh(h @ m["wa"]) @ m["va"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ h @ m["wo"] + m["bo"][0]))
        assert abs(got - 1 / (1 + np.exp(-best))) < 1e-3


@pytest.fixture(scope="module")
def labelled_tenth(spark):
    """Held-out labelled documents of sf0.1 and what the network learns from."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).filter("text is not null")
    return toxicity.sample(docs, labels.filter(~toxicity.held_out(F.col("doc_id")))), [(r.text, r.toxic) for r in held.collect()]


@pytest.mark.parametrize("seed", [0, 1])
def test_toxicity_held_out(labelled_tenth, seed):
    (texts, labels), held = labelled_tenth
    assert max(map(len, texts)) > 20_000  # long texts are learned from, whole
    scores = np.array(toxicity.Scorer(toxicity.train(texts, labels, seed=seed)).scores([t for t, _ in held]))
    y, p = np.array([y for _, y in held]), scores >= 0.5
    long = np.array([len(t) > 8_000 for t, _ in held])
    assert (p == y).mean() > 0.96 and p[y == 1].mean() > 0.85
    assert p[(y == 1) & long].mean() > 0.85 and p[(y == 0) & long].mean() < 0.1
    assert scores.min() >= 0 and scores.max() <= 1


def test_toxicity_sample(spark):
    rows = [(k, f"text {k}") for k in range(50)] + [(0, "a text"), (51, None), (52, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(53)] + [(0, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    texts, marks = toxicity.sample(docs, labels, rows=20)
    assert marks == [0] * 20 + [1] * 20 and len(set(texts)) == 40 and set(texts) <= {t for _, t in rows[:51]}
    assert toxicity.sample(docs.limit(0), labels) == ([], []) == toxicity.sample(docs, labels.limit(0))
    every = dict(zip(*toxicity.sample(docs, labels), strict=True))
    assert len(every) == 50 and every["a text"] == 1  # of two texts the least, of two labels the greater


@pytest.fixture(scope="module")
def toxic_model():
    clean = [f"the of and w{k} to in that all is well" for k in range(40)]
    return toxicity.train(clean + [c + " you loser scum" for c in clean], [0] * 40 + [1] * 40, warm=10, steps=40)


def test_toxicity_cases(docs_of, odd_rows, toxic_model):
    got = toxicity.score(docs_of(odd_rows).withColumn("predicted", F.lit("clash")), toxic_model).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].score == 0.0 and by[k].predicted == 0 for k in (1, 2, 3, 10))
    assert len({r.score for r in got if r.doc_id in (5, 6)}) == 1
    assert {r.score for r in toxicity.score(docs_of(odd_rows), {}).collect()} == {0.0}
    assert toxicity.score(docs_of([]), toxic_model).count() == 0
    assert toxicity.train(["a"], [1]) == {}


def test_windows_cover_every_word():
    for n in range(200):
        seen = set()
        for a in toxicity.starts(n):
            seen |= set(range(a, min(n, a + toxicity.WINDOW)))
        assert seen == set(range(n))


def test_a_word_deep_inside_a_long_text_counts(toxic_model):
    scorer = toxicity.Scorer(toxic_model)
    calm = "the of and to in that all is well " * 500
    low, high = scorer.scores([calm, calm + "you loser scum " + calm])
    assert high > 0.5 > low
