"""The gate journal: which approvals stand, what is stale, and what may run next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The gates of a run, in order.
GATES = ("source", "volume", "render", "vocabulary", "verify")


def standing(events: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """(keys, gate, approved_at): approvals that no later approval of an earlier gate or demotion of the same or an earlier gate has taken back.

    Per scene the events fold to one row a gate and action, and gates are few.
    """
    k = list(keys)
    last = events.groupBy(*k, "gate").agg(F.max(F.when(F.col("action") == "approve", F.col("seq"))).alias("approve"), F.max(F.when(F.col("action") == "demote", F.col("seq"))).alias("demote"))
    before = W.partitionBy(*k).orderBy("gate")
    earlier = F.max("approve").over(before.rowsBetween(W.unboundedPreceding, -1))
    demoted = F.max("demote").over(before.rowsBetween(W.unboundedPreceding, 0))
    out = last.withColumn("earlier", earlier).withColumn("demoted", demoted)
    ok = F.col("approve").isNotNull() & (F.coalesce("earlier", F.lit(-1)) < F.col("approve")) & (F.coalesce("demoted", F.lit(-1)) < F.col("approve"))
    return out.filter(ok).select(*k, "gate", F.col("approve").alias("approved_at"))


def next_gate(events: DataFrame, gates: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The first gate of each scene without a standing approval; one past the last where all stand."""
    k = list(keys)
    every = events.select(*k).distinct().withColumn("gate", F.explode(F.sequence(F.lit(1), F.lit(gates))))
    missing = every.join(standing(events, k), [*k, "gate"], "left_anti").groupBy(*k).agg(F.min("gate").alias("next_gate"))
    return events.select(*k).distinct().join(missing, k, "left").select(*k, F.coalesce("next_gate", F.lit(gates + 1)).cast("long").alias("next_gate"))


def may_start(events: DataFrame, gate: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Whether all gates before `gate` stand."""
    k = list(keys)
    n = standing(events, k).filter(F.col("gate") < gate).groupBy(*k).agg(F.count("*").alias("n"))
    return events.select(*k).distinct().join(n, k, "left").select(*k, (F.coalesce("n", F.lit(0)) == gate - 1).alias("allowed"))


def stale(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """Recorded inputs (scene, gate, name, sha) whose live hash differs or is gone."""
    now = live.select("scene", "name", F.col("sha").alias("now"))
    return recorded.join(now, ["scene", "name"], "left").filter(F.col("now").isNull() | (F.col("now") != F.col("sha"))).select("scene", "gate", "name", F.when(F.col("now").isNull(), "gone").otherwise("changed").alias("why"))


def gate_inputs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of a gate's inputs by scene and gate, over the columns in their given order."""
    return rows.select("scene", "gate", F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("absent")) for c in columns)), 256).alias("inputs"))


def params_changed(stored: Mapping, wanted: Mapping) -> list[str]:
    """Names whose values differ; a name that either side lacks differs."""
    return sorted(k for k in stored.keys() | wanted.keys() if k not in stored or k not in wanted or stored[k] != wanted[k])


def same_vocabulary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two lists of terms hold the same terms, in any order."""
    x = a.agg(F.array_sort(F.collect_set("term")).alias("x"))
    return x.crossJoin(b.agg(F.array_sort(F.collect_set("term")).alias("y"))).select((F.col("x") == F.col("y")).alias("same"))


def missing_frames(recorded: DataFrame, present: DataFrame) -> DataFrame:
    return recorded.join(present, "frame_idx", "left_anti")


def latest(overrides: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Upserts folded: the last value of each key; keys whose last value is null are gone."""
    return overrides.groupBy(key).agg(F.max_by(value, order).alias(value)).filter(F.col(value).isNotNull())


def draft(sidecar: DataFrame, profile: DataFrame) -> DataFrame:
    """A saved draft counts only while the profile it was written against is unchanged."""
    j = profile.join(sidecar.select("scene", "base_sha", F.col("terms").alias("draft_terms")), "scene", "left")
    return j.select("scene", F.when(F.col("base_sha") == F.col("sha"), F.col("draft_terms")).otherwise(F.col("terms")).alias("terms"))
