"""Label verification as policy over a table of a model's answers.

The model is outside: `answers` has its replies, and a reply that is missing or malformed is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataform.functions.text import names_match


def judged(answers: DataFrame) -> DataFrame:
    """Adds verdict and new_label: name first, then whether it matches, then the choice between the two.

    No name: UNVERIFIED. A name that means the label: CONFIRM. Else a model that says they match
    confirms; else its choice decides: label CONFIRM, name RELABEL, neither REJECT, none UNVERIFIED.
    """
    named = F.col("name").isNotNull()
    same = names_match(F.col("label"), F.col("name"))
    verdict = (
        F.when(~named, "UNVERIFIED")
        .when(same | (F.col("says_match") == "yes"), "CONFIRM")
        .when(F.col("choice") == "label", "CONFIRM")
        .when(F.col("choice") == "name", "RELABEL")
        .when(F.col("choice") == "neither", "REJECT")
        .otherwise("UNVERIFIED")
    )
    return answers.withColumn("verdict", verdict).withColumn("new_label", F.when(F.col("verdict") == "RELABEL", F.col("name")))


def constrained(rows: DataFrame, vocabulary: Sequence[str], large: float, quorum: int) -> DataFrame:
    """Relabels that may not stand: outside the vocabulary RELABEL_PROPOSED, a kind of the label (ends with its word) CONFIRM,
    a large footprint without `quorum` confirming views UNVERIFIED."""
    kind = F.col("new_label").endswith(F.concat(F.lit(" "), F.col("label"))) | F.col("label").endswith(F.concat(F.lit(" "), F.col("new_label")))
    relabel = F.col("verdict") == "RELABEL"
    out = F.when(relabel & kind, "CONFIRM").when(relabel & (F.col("box_frac") > large) & (F.col("n_confirm") < quorum), "UNVERIFIED").when(relabel & ~F.col("new_label").isin(*vocabulary), "RELABEL_PROPOSED").otherwise(F.col("verdict"))
    return rows.withColumn("verdict", out).withColumn("new_label", F.when(F.col("verdict").startswith("RELABEL"), F.col("new_label")))


def held(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """A reason to hold replaces CONFIRM and RELABEL by HELD; REJECT and UNVERIFIED stand."""
    stands = F.col("verdict").isin("REJECT", "UNVERIFIED")
    return rows.withColumn("verdict", F.when(F.col(reason).isNotNull() & ~stands, "HELD").otherwise(F.col("verdict")))


def applied(rows: DataFrame) -> DataFrame:
    """Survivors with their new numbers: rejected objects go and the rest are renumbered in order.

    Ranks come from counts by block of 1,000 numbers, so only block counts are ordered as a whole.
    """
    left = rows.filter("verdict <> 'REJECT'").withColumn("block", F.floor(F.col("object_idx") / 1000))
    counts = left.groupBy("block").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy("block").orderBy("object_idx")) - 1
    shown = F.when(F.col("verdict") == "RELABEL", F.col("new_label")).when(F.col("verdict") == "CONFIRM", F.col("label"))
    return left.withColumn("rank", rank).join(counts, "block").select("object_idx", (F.col("before") + F.col("rank")).cast("long").alias("new_idx"), "verdict", shown.alias("verified_label"), F.when(F.col("verdict") == "RELABEL_PROPOSED", F.col("new_label")).alias("proposed_label"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: objects by verdict."""
    kinds = ("CONFIRM", "RELABEL", "RELABEL_PROPOSED", "REJECT", "UNVERIFIED", "HELD")
    return rows.agg(*(F.count_if(F.col("verdict") == k).alias(k.lower()) for k in kinds), F.count("*").alias("n"))


def carried(objects: DataFrame, previous: DataFrame, marked: Column) -> DataFrame:
    """Objects that are not marked keep their previous verdict; without one, NOT_JUDGED."""
    p = previous.select("object_idx", F.col("verdict").alias("old"))
    return objects.join(p, "object_idx", "left").withColumn("verdict", F.when(marked, F.lit(None)).otherwise(F.coalesce("old", F.lit("NOT_JUDGED")))).drop("old")


def carried_labels(objects: DataFrame, overrides: DataFrame, key: str = "instance_id") -> DataFrame:
    """The latest operator label of each instance; a null label takes it back."""
    latest = overrides.groupBy(key).agg(F.max_by("operator_label", "seq").alias("operator_label"))
    return objects.join(latest, key, "left")


def mark_word(verdict: Column) -> Column:
    """The word shown for a verdict; an unknown one is shown as doubt."""
    words = {"CONFIRM": "confirmed", "RELABEL": "relabelled", "REJECT": "rejected", "HELD": "held", "NOT_JUDGED": "not judged"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), verdict), F.lit("doubtful"))


def resumed(checkpoint: DataFrame, fresh: DataFrame, key: Sequence[str] = ("object_idx",)) -> DataFrame:
    """Rows of a checkpoint, and of `fresh` those that it does not have yet; of rows written twice the last."""
    done = checkpoint.groupBy(*key).agg(F.max_by("verdict", "seq").alias("verdict"))
    return done.unionByName(fresh.join(done, list(key), "left_anti").select(*key, "verdict"))
