"""Phrases, labels and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phrase(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def folded_words(c: Column) -> Column:
    """Words of letters and digits in lower case; a trailing s of words over 3 letters goes."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, 1, F.length(w) - 1)).otherwise(w))


def folded(c: Column) -> Column:
    return F.array_join(folded_words(c), " ")


def names_match(a: Column, b: Column) -> Column:
    """Whether two names mean one thing: equal when folded, the same head word, or the words of one all in the other."""
    x, y = folded_words(a), folded_words(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    head = F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))
    within = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.coalesce(some & ((F.array_join(x, " ") == F.array_join(y, " ")) | head | within), F.lit(False))


def json_body(c: Column) -> Column:
    """The outermost braces of an answer, without a think block and code fences."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def complete_strings(c: Column, key: str) -> Column:
    """The closed strings of a JSON list under `key`, even where the text breaks off inside the list."""
    rest = F.regexp_extract(c, rf'(?s)"{key}"\s*:\s*\[([^\]]*)', 1)
    return F.regexp_extract_all(rest, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)


def file_stem(name: Column, index: Column) -> Column:
    """A name for files: blanks as underscores, and a number of four digits."""
    return F.concat(F.regexp_replace(name, " ", "_"), F.lit("_"), F.lpad(index.cast("string"), 4, "0"))


def progress(line: Column) -> Column:
    """The share k / N that a log line reports, or null."""
    k, n = F.regexp_extract(line, r"(\d+)/(\d+)", 1), F.regexp_extract(line, r"(\d+)/(\d+)", 2)
    return F.when(k != "", F.try_divide(F.nullif(k, F.lit("")).cast("double"), F.nullif(n, F.lit("")).cast("double")))


def sentence_field(c: Column, pattern: str) -> Column:
    """A field that older rows hold only inside a sentence."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def next_label(labels: DataFrame, column: str, stem: str = "view") -> DataFrame:
    """One row: the next free label of the form `stem N`."""
    n = F.regexp_extract(F.col(column), rf"^{stem} (\d+)$", 1)
    return labels.agg((F.coalesce(F.max(F.when(n != "", F.nullif(n, F.lit("")).cast("long"))), F.lit(0)) + 1).alias("n")).select(F.concat(F.lit(f"{stem} "), F.col("n").cast("string")).alias("label"))


def vocabulary(views: DataFrame) -> DataFrame:
    """(term, n_views) of proposed terms over views (view, term): by number of views, then name.

    A plural counts for its singular where both are proposed.
    """
    each = views.select("view", phrase(F.col("term")).alias("term")).filter("term <> ''").distinct()
    terms = each.select("term").distinct()
    base = terms.select(F.col("term").alias("singular"))
    plural = terms.join(base, F.col("term") == F.concat(F.col("singular"), F.lit("s"))).select("term", "singular")
    merged = each.join(plural, "term", "left").select("view", F.coalesce("singular", "term").alias("term")).distinct()
    return merged.groupBy("term").agg(F.count("*").alias("n_views"))


def display_label(mode: str = "verified") -> Column:
    """What to show: the operator's label, then the proposed one in brackets (in `proposed` mode), the verified, the detected."""
    proposed = F.when(F.col("proposed").isNotNull(), F.concat(F.lit("("), F.col("proposed"), F.lit(")"))) if mode == "proposed" else F.lit(None).cast("string")
    return F.coalesce("operator", proposed, "verified", "detected")
