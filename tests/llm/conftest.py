import random

import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table_rows(small):
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture
def docs_of(spark):
    """Documents with the columns of the table, from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, marks and signs of many scripts."""
    rng = random.Random(0)
    words = ["the", "of", "loser", "überall", "niño", "été", "42", "x", "中文字", "tion"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = some(120)
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, base),
        (6, base),
        (6, base),
        (7, base.replace("of", "OF", 1) + " end"),
        (8, some(60_000)),
        (9, "All rights reserved.\n" + some(30) + "\n\n" + some(20)),
        (10, "!!! ??? ..."),
        (None, some(15)),
        (11, "\x00 a\x1cb  c <|endoftext|> d"),
        (12, "\n".join([some(12)] * 3)),
    ]
