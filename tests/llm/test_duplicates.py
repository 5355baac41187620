"""Suffix arrays, line dedup and the n-gram join against brute force, hot groups included."""

import collections
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strataform.llm import bpe, components, decontam, langid, linededup, ngram_join, queries, suffixdedup, toxicity


@pytest.fixture(scope="module")
def spec_of_words():
    return queries.tokenizer_spec()


def words(t):
    return (t or "").encode().lower().split()


def brute_spans(rows, length):
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[j : j + length]) for j in range(len(w) - length + 1))
    out = []
    for i, t in rows:
        w, spans = words(t), []
        for j in range(len(w) - length + 1):
            if count[tuple(w[j : j + length])] > 1:
                if spans and spans[-1][1] >= j:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        out.append((i, len(w), tuple(map(tuple, spans))))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(30)]
    some = lambda n: [rng.choice(voc) for _ in range(n)]
    shared = [some(rng.randint(10, 30)) for _ in range(6)]
    rows = []
    for k in range(80):
        w = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            cut = rng.randint(0, 4)
            w = w + s[cut : len(s) - rng.randint(0, 4)] + some(rng.randint(0, 10))
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_equal_brute_force(docs_of, odd_rows, hot):
    rows = passages(1) + [(1000 + (i or 0), t) for i, t in odd_rows if i != 8]
    got = sorted(((r.doc_id, r.n_words, tuple((s.start, s.stop) for s in r.spans)) for r in suffixdedup.repeats(docs_of(rows).withColumn("spans", F.lit(1)), length=12, k=4, hot=hot).collect()), key=repr)
    assert got == brute_spans(rows, 12) or {g for g in got} == {b for b in brute_spans(rows, 12)}


def test_repeats_on_the_table(spark, documents, table_rows):
    got = sorted(((r.doc_id, r.n_words, tuple((s.start, s.stop) for s in r.spans)) for r in suffixdedup.repeats(documents).collect()), key=repr)
    assert got == brute_spans(table_rows, 50)
    assert suffixdedup.repeats(documents.limit(0)).count() == 0


def brute_lines(rows):
    occ = [(i, n, x) for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or "")) for n, line in enumerate((t or "").split("\n")) if (x := linededup.normal(line))]
    first = {}
    for i, n, x in occ:
        first[x] = min(first.get(x, (i, n)), (i, n))
    sets = {x: {x[j : j + 8] for j in range(max(1, len(x) - 7))} for x in first}
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(first)
    for a in range(len(names)):
        for b in range(a):
            s, t = sets[names[a]], sets[names[b]]
            o = len(s & t)
            if 100 * o >= 75 * (len(s) + len(t) - o):
                x, y = find(names[a]), find(names[b])
                if x != y:
                    lo, hi = sorted((x, y), key=first.get)
                    root[hi] = lo
    return {i: sum(first[find(x)] != (j, n) for j, n, x in occ if j == i) for i, _, _ in occ}


def many_lines(seed, group=60):
    rng = random.Random(seed)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    base = [line(25) for _ in range(4)]
    rows = []
    for k in range(group):
        out = []
        for _ in range(3):
            x = rng.choice(base).split()
            if rng.random() < 0.5:
                x[rng.randrange(len(x))] = line(1)
            out.append(" ".join(x))
        rows.append((k, "\n".join([line(12), *out, ""])))
    return rows


@pytest.mark.parametrize("small", [16, 2])
def test_line_dedup_equals_brute_force(docs_of, odd_rows, small):
    rows = many_lines(2) + [(1000 + i if i is not None else None, t) for i, t in odd_rows if i != 8]
    got = linededup.dedup_lines(docs_of(rows).withColumn("n_lines", F.lit("clash")), small=small, block=5).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    lost = [(r.doc_id, r.n_removed, want.get(r.doc_id, 0)) for r in got if r.n_removed != want.get(r.doc_id, 0)]
    assert not lost
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1001].text is None and by[1002].text == "" and by[1003].text == " \n\t "
    assert linededup.dedup_lines(docs_of([])).count() == 0


def test_few_lines_of_a_band_that_is_large_in_another_batch(spark):
    """A batch with 18 lines of the only band, and one with near copies of some that it does not send on."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    stem = " ".join(word() for _ in range(6))
    made = [(x, f"{x} {rng.choice('xyz')}") for x in (" ".join([stem, *(word() for _ in range(6))]) for _ in range(400))]
    band = lambda lines: linededup.band_keys(lines, 8, 1, 1)[:, 0].tolist()
    keys = list(zip(band([x for x, _ in made]), band([y for _, y in made]), strict=True))
    common = collections.Counter(k for k, _ in keys).most_common(1)[0][0]
    pairs = [m for m, k in zip(made, keys, strict=True) if k == (common, common)][:18]
    assert len(pairs) == 18
    rows = [(1, "\n".join(x for x, _ in pairs)), (2, "\n".join(y for _, y in pairs[:12]))]
    assert brute_lines(rows) == {1: 0, 2: 12}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs, bands=1, rows=1).collect()}
    assert got == {1: 0, 2: 12}


def test_line_dedup_over_many_partitions_equals_brute_force(spark):
    """40 families of near copies, a few lines of each in every one of 16 partitions."""
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(n))
    families = [line(24) for _ in range(40)]
    rows = []
    for k in range(160):
        out = []
        for base in rng.sample(families, 4):
            x = base.split()
            x[rng.randrange(len(x))] = line(1)
            out.append(" ".join(x))
        rows.append((k, "\n".join(out)))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "61"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 16), "doc_id long, text string")
        got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(docs, small=3, block=7).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute_lines(rows)


def test_line_dedup_of_the_table_equals_brute_force(documents, table_rows):
    got = {r.doc_id: r.n_removed for r in linededup.dedup_lines(documents).collect()}
    assert got == brute_lines(table_rows)


def similar_lines(lines, k=8, percent=75):
    """All pairs of lines at the similarity, by prefixes of rare shingles."""
    sets = [{x[j : j + k] for j in range(max(1, len(x) - k + 1))} for x in lines]
    count = collections.Counter(g for s in sets for g in s)
    held, found = collections.defaultdict(list), set()
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda g: (count[g], g))
        for g in order[: len(s) - (len(s) * percent + 99) // 100 + 1]:
            for j in held[g]:
                if (j, i) not in found and 100 * min(len(s), len(sets[j])) >= percent * max(len(s), len(sets[j])):
                    o = len(s & sets[j])
                    if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                        found.add((j, i))
            held[g].append(i)
    return found


def test_recall_of_the_bands():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    lines = sorted({x for t in rows for x in linededup.text_of(linededup.normal_lines(t)) if x})
    pairs = similar_lines(lines)
    keys = linededup.band_keys(lines, linededup.K, linededup.BANDS, linededup.ROWS)
    hit = sum(bool((keys[a] == keys[b]).any()) for a, b in pairs)
    assert len(pairs) > 100 and hit >= 0.9 * len(pairs)


@pytest.mark.parametrize("text", ["a b\nc", " a b", "a b ", "a  b", "a\tb", "a \n b", "A\r\nB", "\n\n", "Ä\x0bx", " ", "a\x1cb"])
def test_normal_lines(text):
    assert linededup.normal_lines(text) == [linededup.normal(x).encode() for x in text.split("\n")]


def brute_links(rows, percent=75):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = words(t)
        sets[i].append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else ()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i in ids for s in sets[i]}


def near_copies(seed, group=70):
    """One original with many copies that link with it but often not with one another, chains, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    base = [word() for _ in range(160)]
    rows = [(500, " ".join(base))]
    for k in range(group):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
    chain = [word() for _ in range(80)]
    for k in range(12):
        rows.append((600 + k, " ".join(chain)))
        chain = chain[6:] + [word() for _ in range(6)]
    return rows + [(700, "a b c"), (701, "A B  c"), (702, "a b"), (703, "a b c d e"), (704, "a b c d e")]


@pytest.mark.parametrize(("small", "frequent", "salt"), [(16, 1 << 18, 2000), (4, 1 << 18, 10), (6, 0, 2000)])
def test_join_equals_brute_force(monkeypatch, docs_of, odd_rows, small, frequent, salt):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", salt)
    rows = near_copies(3) + [(1000 + i, t) for i, t in odd_rows if i not in (8, None)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(docs_of(rows).withColumn("component_id", F.lit(1)), small=small, frequent=frequent, block=7).collect()}
    assert got == brute_links(rows)


def test_join_across_salts_in_separate_tasks(spark, docs_of):
    """Shingles of more than 2,000 sets but few prefixes: a pair's rows are under two salts, each in a task of its own."""
    passages = [[f"p{g}x{k}" for k in range(12)] for g in range(8)]
    rows = [(100 + k, " ".join(x for g, p in enumerate(passages) for x in [*p, *(f"u{k}y{g}z{j}" for j in range(12))])) for k in range(2_100)]
    rows += [(g, " ".join(p)) for g, p in enumerate(passages)] + [(50 + g, " ".join(p[:11])) for g, p in enumerate(passages)]
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "61"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in ngram_join.link(docs_of(rows)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i - 50 if 50 <= i < 58 else i for i, _ in rows}


def test_keep_one(docs_of, documents, table_rows):
    kept = [r.doc_id for r in ngram_join.keep_one(documents).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_links(table_rows)})
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "a b c d e f")]
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (1, rows[0][1]), (3, None), (None, rows[0][1])], key=repr)
    assert ngram_join.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("at_once", [100_000, 20])
def test_components_of_hubs_and_paths(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    edges = [(k + 1, k) for k in range(50)] + [(1000, 2000 + k) for k in range(300)] + [(9, 9), (None, 3)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long").repartition(7), "a", "b").collect()}
    assert got == {k: 0 for k in range(1, 51)} | {2000 + k: 1000 for k in range(300)}


CLASHES = ["bloom_k", "BLOOM_BITS", "removal_id", "removal_lines", "gone", "text_read", "hits_so_far", "items_so_far", "_gone", "k", "bits", "doc"]


def test_columns_with_the_names_that_operators_use(spark, docs_of, spec_of_words):
    docs = docs_of([(1, "a b c d e f\nx"), (2, "a b c d e f\nx"), (3, None), (4, "")])
    odd = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    bench = spark.createDataFrame([(7, "b c d")], "item_id long, text string")
    for out in (linededup.dedup_lines(odd), ngram_join.keep_one(odd), decontam.decontaminate(odd, bench), bpe.encode(odd, spec_of_words), toxicity.score(odd, {}), langid.predict(odd, langid.train([], []))):
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    # a text column whose name an operator writes
    renamed = odd.withColumnRenamed("text", "score")
    assert [r.text_read for r in toxicity.score(renamed, {}, text_col="score").collect()] == ["own text_read"] * 4


def test_stages_of_many_pattern_blocks(spark, docs_of):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(12))) for k in range(30)]
    rows = [(k, " ".join(f"w{rng.randrange(40)}" for _ in range(30)) + (" " + items[k % 30][1] if k % 3 == 0 else "")) for k in range(40)] + [(99, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "items", "contaminated")
    one, many = (sorted(decontam.scan(docs_of(rows), bench, block_patterns=b).select(*cols).collect(), key=str) for b in (50_000, 9))
    assert one == many and sum(r.contaminated for r in one) >= 14
