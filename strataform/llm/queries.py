"""One query for each operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm import bpe, chat, decontam, langid, licences, linededup, media, ngram_join, oracles, suffixdedup, toxicity
from strataform.session import table

#: The vocabulary file of `op1`; a parameter of the operator, never copied into the repository.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_spec(name: str = TOKENIZER) -> str:
    """The content of one of the box's public vocabulary files."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_spec()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.repeats(table(spark, sf_dir, "documents"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    shown = F.array_join(F.transform("spans", lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.stop.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("spans").cast("long").alias("n_spans"), covered.alias("n_repeated"), shown.alias("spans"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.restore(*media.store(table(spark, sf_dir, "documents")))
    return read.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    return seen.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.item_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """Learned from the labelled rows of `docs` that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    return toxicity.train(*toxicity.sample(docs, labels))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("spans", chat.span_text("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(*langid.sample(docs.filter(~langid.held_out(F.col("doc_id")))))
    named = langid.predict(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.coalesce(F.array_max(F.transform("spots", lambda s: s.percent)), F.lit(0))
    return found.select("doc_id", "n_windows", F.concat_ws(",", "licences").alias("licences"), F.size("spots").cast("long").alias("n_spots"), best.alias("best_percent"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_bpe": op1_bpe, "op2_suffix_dedup": op2_suffix_dedup, "op3_media": op3_media, "op4_decontamination": op4_decontamination, "op5_line_dedup": op5_line_dedup, "op6_ngram_join": op6_ngram_join, "op7_toxicity": op7_toxicity, "op8_chat": op8_chat, "op9_language_id": op9_language_id, "op10_licences": op10_licences}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
