"""Corpus cleaning as a chain of stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet in the shared
folder and read again as the next one's docs. All but the last return the columns of documents.

1. toxicity: documents that the classifier predicts toxic go.
2. line dedup: of lines alike the first stays; a document whose lines all went goes with them.
3. n-gram join: of documents alike the one with the smallest id stays.
4. decontamination: documents with a benchmark window in them go.
5. bpe: token counts and digests of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import bpe, decontam, linededup, ngram_join, toxicity
from strataform.llm.queries import tokenizer_spec, toxicity_model
from strataform.session import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(*COLUMNS), toxicity_model(spark, docs, sf_dir))
    return scored.filter("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    kept = kept.filter("n_removed = 0 or n_removed < n_lines")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.digests(docs.select(*COLUMNS), tokenizer_spec())
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: A network, MinHash components and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
