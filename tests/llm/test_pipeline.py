"""The pipeline's stages against plain computations on their own inputs, and the driver's entry."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from strataform.llm import decontam, toxicity
from strataform.session import materialize
from tests.llm.test_duplicates import brute_links


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_join", "decontamination", "bpe"]
    given = {r.doc_id: r for r in docs.collect()}
    step = materialize(spark, P.drop_toxic(spark, docs, small), "t1")
    assert step.columns == docs.columns
    left = {r.doc_id: r for r in step.collect()}
    assert set(left) <= set(given) and all(left[i] == given[i] for i in left) and len(left) > 0.6 * len(given)

    lines = materialize(spark, P.dedup_lines(spark, step, small), "t2")
    assert lines.columns == docs.columns
    kept = lines.collect()
    texts = [x for r in kept for x in (r.text or "").split("\n") if x.strip()]
    assert len(texts) == len(set(texts)) and all(r.n_chars == len(r.text) for r in kept if r.text != left[r.doc_id].text)
    assert all(set((r.text or "").split("\n")) <= set((left[r.doc_id].text or "").split("\n")) for r in kept)

    joined = materialize(spark, P.join_ngrams(spark, lines, small), "t3")
    assert sorted(r.doc_id for r in joined.collect()) == sorted({c for _, _, c in brute_links([(r.doc_id, r.text) for r in kept])})

    clean = P.decontaminate(spark, joined, small)
    found = {r.doc_id for r in clean.collect()}
    patterns = {p for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() for p in decontam.windows(r.text)}
    for r in joined.collect():
        body = b" " + b" ".join(decontam.words(r.text)) + b" "
        assert (r.doc_id in found) == (not any(p in body for p in patterns))

    last = P.encode(spark, clean, small)
    assert last.count() == len(found) and "n_tokens" in last.columns


def test_stages_of_odd_rows_and_of_none(spark, small, docs_of, odd_rows):
    """Nulls, empty and very long texts, repeated rows, columns with the names that stages write, and an empty table."""
    odd = docs_of(odd_rows).withColumns({c: F.lit("own") for c in ("score", "n_lines", "component_id", "contaminated", "gone")})
    for docs, some in ((odd, True), (odd.limit(0), False)):
        for name, stage in P.STAGES:
            docs = materialize(spark, stage(spark, docs, small), f"odd_{name}")
            if name != "bpe":
                assert docs.columns == list(P.COLUMNS)
        ids = [r.doc_id for r in docs.collect()]
        assert set(ids) >= {1, 2, 3, 4, 10, None} if some else not ids
        assert 7 not in ids  # nearly equal to 5


def test_entry_has_every_query(spark, small):
    import re

    import __spark_entry__ as entry

    known = entry.queries()
    assert "pipeline" in known and {int(re.match(r"op(\d+)_", n)[1]) for n in known if re.match(r"op\d+_", n)} == set(range(1, 11))
    assert set(entry.oracle_sql()) <= set(known)
    assert entry.entry(spark).count() >= 0
    assert toxicity.WINDOW > toxicity.STRIDE
