"""BPE, media, decontamination, chat and licences against libraries, brute force and SQL."""

import hashlib
import io
import itertools
import math
import random
import wave
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataform.llm import bpe, chat, decontam, licences, media, queries


@pytest.fixture(scope="module")
def spec():
    return queries.tokenizer_spec()


def expected(library, text):
    e = library.encode(text or "", add_special_tokens=False)
    return len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spec, table_rows, odd_rows):
    library, own = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER)), bpe.WordBpe(spec)
    rng = random.Random(1)
    pool = "aaaabz'sSΣσ \t\n\x1c\x85\xa0éé<|endoftext|>1２İ՘Ɤ\U0001f469‍"
    texts = [t for _, t in table_rows + odd_rows] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b <|startoftext|>"]
    for text, got in zip(texts, own.encode_batch(texts), strict=True):
        assert got == expected(library, text), repr(text)[:80]


def naive_bpe(merges, symbols):
    while True:
        ranked = [(merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
        if not ranked:
            return symbols
        _, i = min(ranked)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2 :]]


def test_pair_index_equals_one_merge_at_a_time():
    pairs = [("a", "a"), ("aa", "a"), ("b", "a"), ("aa", "aa"), ("ba", "aa"), ("a", "b")]
    vocab = {s: i for i, s in enumerate(["a", "b", *dict.fromkeys(x + y for x, y in pairs)])}
    table = bpe.MergeTable(vocab, pairs)
    rng = random.Random(2)
    words = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    got, owner = bpe.merge_words(table, np.array([vocab[c] for w in words for c in w]), np.repeat(np.arange(len(words)), [len(w) for w in words]))
    names = {i: s for s, i in vocab.items()}
    for k, w in enumerate(words):
        assert [names[i] for i in got[owner == k]] == naive_bpe({p: r for r, p in enumerate(pairs)}, list(w))


def test_bpe_columns(docs_of, spec, odd_rows):
    df = docs_of(odd_rows).withColumn("ids", F.lit("clash"))
    rows = bpe.encode(df, spec).collect()
    assert len(rows) == len(odd_rows)
    library = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    for r in rows:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
    back = bpe.decode(bpe.encode(df, spec).withColumnRenamed("decoded", "was"), spec).collect()
    assert all(r.was == r.decoded for r in back)
    assert bpe.encode(docs_of([]), spec).count() == 0


def test_media_round_trip(docs_of, odd_rows):
    got = media.restore(*media.store(docs_of(odd_rows), least=256, average=1024, most=4096)).collect()
    assert len(got) == len(odd_rows)
    want = {}
    for i, t in odd_rows:
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.setdefault(i, set()).add((len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.id]
    assert media.restore(*media.store(docs_of([]))).count() == 0


def plain_feature(data):
    """Mean, deviation, sign changes and the energy of quarters, one sample at a time."""
    x = [b - 128 for b in data]
    mean = sum(x) / len(x)
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
    turns = sum((a < 0) != (b < 0) for a, b in itertools.pairwise(x))
    size, extra = divmod(len(x), 4)
    ends = list(itertools.accumulate([0, *(size + (k < extra) for k in range(4))]))
    energy = [sum(v * v for v in x[a:b]) / (b - a) for a, b in itertools.pairwise(ends)]
    return [mean, std, 1000 * turns / len(x), *energy]


def test_media_of_the_table(spark, small, table_rows):
    """Every column: the stored form is a sound file that the standard library reads, and the rest is computed from its samples."""
    got = {r.doc_id: r for r in queries.op3_media(spark, small).collect()}
    assert len(got) == len(table_rows)
    for i, t in table_rows:
        raw = (t or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = media.to_wave(data)
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, data)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        shown = [float(v) for part in r.feature.split(";") for v in part.split(",")]
        assert all(abs(a - b) <= 0.0501 for a, b in zip(shown, plain_feature(data), strict=True))


def test_a_lost_chunk_is_an_error(docs_of, odd_rows):
    m, chunks = media.store(docs_of(odd_rows), least=256, average=1024, most=4096)
    with pytest.raises(Exception, match="chunk"):
        media.restore(m, chunks.limit(1)).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()

    def parts(b):
        ends = media.cuts(b)
        return {b[x:y] for x, y in zip([0, *ends], ends, strict=False)}

    whole, moved = parts(data), parts(b"some bytes before" + data)
    assert len(whole & moved) >= 0.8 * len(whole)
    assert all(len(p) <= media.MOST for p in whole)
    h, out = 0, []
    for b in data[:100]:
        h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    assert np.array_equal(media.gear_hashes(np.frombuffer(data[:100], np.uint8)), np.array(out, np.uint32))


def brute_hits(texts, items):
    pats = [(i, p.split()) for i, t in items for p in decontam.windows(t)]
    out = []
    for t in texts:
        w = decontam.words(t)
        hit, seen = set(), set()
        for i, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    seen.add(i)
        out.append((len(w), len(hit), sorted(seen)))
    return out


@pytest.mark.parametrize("block", [50_000, 7])
def test_decontamination_equals_brute_force(spark, docs_of, odd_rows, block):
    rng = random.Random(3)
    voc = ["a", "bb", "Cc", "dé", "1", "xyz", "longerword"]
    items = [(i, " ".join(rng.choice(voc) for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 9, 10, 11, 14])] + [(99, None), (7, "a, bb; Cc")]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randint(0, 70))) for _ in range(60)] + [items[7][1] * 2 + "|" + items[3][1]]
    rows = list(enumerate(texts)) + [(1000 + k, t) for k, (_, t) in enumerate(odd_rows)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.scan(docs_of(rows).withColumn("n_hit", F.lit(1)), bench, block_patterns=block).collect()}
    want = dict(zip([i for i, _ in rows], brute_hits([t for _, t in rows], items), strict=True))
    assert got == want
    none = decontam.scan(docs_of(rows), bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(rows)
    kept = decontam.decontaminate(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[1]}


def test_chat_equals_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{small}/conversations.parquet'")
    want = con.sql(chat.SQL).df()
    got = queries.op8_chat(spark, small).toPandas()
    key = ["conv_id", "part", "speaker"]
    a, b = (x.sort_values(key).reset_index(drop=True)[sorted(x)] for x in (got, want))
    assert (a.astype(str) == b.astype(str)).all().all() and len(a) == len(b)


def test_chat_cases(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann lee", "hi"), (1, 2, "bob", None), (1, 3, None, "x <|im_start|>"), (1, None, "bob", "first"), (1, 300, "bob", "late"), (None, 0, "bob", "lost"), (2, 0, "system", "alone"), (1, 1, "ann lee", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {(r.conv_id, r.part, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, p, s) for p in (0, 1) for s in ("ann_lee", "bob", "unknown")}
    r = got[1, 0, "bob"]
    assert r.rendered.startswith("<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>system\nbe kind") and "user name=ann_lee\nhi" in r.rendered and "<| im_start|>" in r.rendered
    assert [r.rendered[s.start : s.stop] for s in r.spans] == ["first<|im_end|>\n", "<|im_end|>\n"] and r.n_trained == 2 and r.n_turns == 6
    assert [x.rendered[s.start : s.stop] for x in (got[1, 0, "ann_lee"],) for s in x.spans] == ["hi<|im_end|>\n"] * 2
    assert chat.rotate(turns.limit(0)).count() == 0


def test_licences_find_every_planted_notice(docs_of, odd_rows):
    rng = random.Random(4)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows, want = [], {}
    for k in range(120):
        name, notice = rng.choice(licences.TEMPLATES)
        shown = notice.upper() if k % 3 == 0 else notice.replace(" ", "\n ", 1) if k % 3 == 1 else notice
        rows.append((k, f"{filler(rng.randint(0, 80))} {shown} {filler(rng.randint(0, 80))}"))
        want[k] = name
        rows.append((1000 + k, filler(60)))
    got = {r.doc_id: list(r.licences) for r in licences.scan(docs_of(rows).withColumn("spots", F.lit(0))).collect()}
    assert all(want[k] in got[k] for k in want) and not any(got[1000 + k] for k in want)
    odd = licences.scan(docs_of(odd_rows)).collect()
    assert len(odd) == len(odd_rows) and [list(r.licences) for r in odd if r.doc_id == 9] == [["all-rights-reserved"]]
    assert licences.scan(docs_of(odd_rows), templates=()).filter("size(licences) > 0").count() == 0
    assert licences.scan(docs_of([])).count() == 0


def brute_windows(text, templates, percent=80, k=6):
    """For each template the windows that hold enough of it, by the definition of windows alone."""
    line = licences.normal(text)
    grams = [line[i : i + k] for i in range(max(1, len(line) - k + 1))]
    out = []
    for t, (_, template) in enumerate(templates):
        want = licences.normal(template)
        mine = {want[i : i + k] for i in range(max(1, len(want) - k + 1))}
        half = 32
        while half < len(want):
            half *= 2
        for at in range(0, len(grams), half):
            held = len(mine.intersection(grams[at : at + 2 * half]))
            if 100 * held >= percent * len(mine):
                out.append((t, at, held))
    return out


def test_licence_bands_find_what_every_window_holds():
    rng = random.Random(8)
    filler = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    scanner = licences.Scanner()
    expected = found = 0
    texts = []
    for _ in range(60):
        parts = [filler(rng.randint(0, 60))]
        for _, notice in rng.sample(licences.TEMPLATES, 3):
            words = notice.split()
            for _ in range(rng.randint(0, len(words) // 25)):
                words[rng.randrange(len(words))] = filler(1)
            parts += [" ".join(words), filler(rng.randint(0, 300))]
        texts.append(" ".join(parts))
    _, spots = scanner.scan(texts)
    for text, got in zip(texts, spots, strict=True):
        want = brute_windows(text, licences.TEMPLATES)
        held = {(t, at): n for t, at, n in want}
        assert all(held[t, at] == n for t, n, at in got)  # what is found is a window that holds as much
        expected += len({t for t, _, _ in want})
        found += len({t for t, _, _ in got})
    assert expected > 150 and found >= 0.99 * expected


def test_licence_spots_are_all_returned(spark, docs_of):
    notice = dict(licences.TEMPLATES)["unlicense"]
    far = " ".join(f"w{k}" for k in range(300))
    rows = [(1, f"{notice} {far} {notice} {far} {notice}"), (2, None), (3, "")]
    table = spark.createDataFrame([("own", notice), (None, None), ("blank", " ")], "name string, text string")
    got = {r.doc_id: r for r in licences.scan(docs_of(rows), templates=table).collect()}
    assert [s.name for s in got[1].spots] == ["own"] * 3 and got[1].licences == ["own"]
    assert got[2].spots == [] == got[3].spots
    with pytest.raises(ValueError):
        licences.template_rows(table.withColumn("text", F.repeat(F.lit("x"), licences.MAX_TEMPLATES + 1)))
