"""Class assignment from contribution weights, supports of detections, and affinity of detections."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataform.functions.numeric import exact_sum
from strataform.operators import affinities
from strataform.operators.detections import lookup
from strataform.session import materialize


def class_weights(rows: DataFrame, kept_frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A(gid, class_name, a) and T(gid, t), over frames that keep a detection."""
    used = rows.join(kept_frames.select("frame_idx").distinct(), "frame_idx", "left_semi")
    return used.groupBy("gid", "class_name").agg(exact_sum(F.col("w"), 2).alias("a")), used.groupBy("gid").agg(exact_sum(F.col("w"), 2).alias("t"))


def best_class(a: DataFrame) -> DataFrame:
    """Per point the class with the most weight; the first name on ties."""
    return a.groupBy("gid").agg(F.min_by(F.struct("class_name", "a"), F.struct(-F.col("a"), "class_name")).alias("b")).select("gid", "b.class_name", "b.a")


def labels(a: DataFrame, t: DataFrame, gamma: Mapping[str, float], default: float) -> DataFrame:
    """Best class where its weight exceeds gamma times the rest, else null (background)."""
    best = best_class(a).join(t, "gid")
    g = lookup(F.col("class_name"), gamma, default)
    return best.select("gid", F.when(F.col("a") > g * (F.col("t") - F.col("a")), F.col("class_name")).alias("class_name"))


def supports(weights: DataFrame, totals: DataFrame, floor: float) -> DataFrame:
    """(det, gid, g, f): weight of a point in a detection over its weight in the view, at most 1 and at least `floor`."""
    f = F.least(F.col("g") / F.col("tv"), F.lit(1.0))
    return weights.join(totals, ["frame_idx", "gid"]).filter("g > 0 and tv > 0").withColumn("f", f).filter(F.col("f") >= floor)


def support_norms(support: DataFrame) -> DataFrame:
    return support.groupBy("det").agg(F.count("*").alias("size"), F.sqrt(exact_sum(F.col("f") * F.col("f"))).alias("norm"))


def affinity(support: DataFrame) -> DataFrame:
    """Cosine and intersection over smaller of all pairs of detections of a class that share a point.

    Blocks of a class's detections are taken against each other; products are neither listed nor shuffled.
    """
    kind = {c: support.schema[c].dataType for c in ("class_id", "det")}
    pairs = affinities.pairs(support.select("class_id", "gid", "det", "f"))
    return pairs.select(F.col("class_id").cast(kind["class_id"]).alias("class_id"), *(F.col(c).cast(kind["det"]).alias(c) for c in ("lo", "hi")), "cosine", "ios")


def edges(pairs: DataFrame, min_cosine: float, min_ios: float) -> DataFrame:
    """Pairs that pass either threshold, numbered in the order clustering visits them: by affinity, then ids."""
    kept = pairs.filter((F.col("cosine") >= min_cosine) | (F.col("ios") >= min_ios))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("class_id").orderBy(F.desc("cosine"), "lo", "hi")))


def frame_cannot_link(support: DataFrame) -> DataFrame:
    """Pairs of detections of one class and frame: they show two objects."""
    d = support.select("class_id", "frame_idx", "det").distinct()
    return d.select("class_id", "frame_idx", F.col("det").alias("lo")).join(d.select("class_id", "frame_idx", F.col("det").alias("hi")), ["class_id", "frame_idx"]).filter("lo < hi").select("class_id", "lo", "hi")


def ambiguous(pairs: DataFrame, tracks: DataFrame, links: DataFrame, min_ios: float) -> DataFrame:
    """Detections that overlap their own track's member p and the member q of another track that p cannot be linked with."""
    both = pairs.filter(F.col("ios") >= min_ios).select(F.col("lo").alias("d"), F.col("hi").alias("e"))
    both = both.unionByName(both.select(F.col("e").alias("d"), F.col("d").alias("e")))
    forbidden = links.select(F.col("lo").alias("p"), F.col("hi").alias("q"))
    forbidden = forbidden.unionByName(forbidden.select(F.col("q").alias("p"), F.col("p").alias("q")))
    t = tracks.select("det", "track")
    own = both.withColumnRenamed("e", "p").join(t.select(F.col("det").alias("d"), F.col("track").alias("td")), "d").join(t.select(F.col("det").alias("p"), F.col("track").alias("tp")), "p").filter("td = tp")
    other = both.withColumnRenamed("e", "q").join(t.select(F.col("det").alias("q"), F.col("track").alias("tq")), "q")
    hit = own.join(forbidden, "p").join(other, ["d", "q"]).filter("tq <> td")
    return hit.select(F.col("d").alias("det")).distinct()


def track_scores(support: DataFrame, tracks: DataFrame) -> DataFrame:
    """(gid, track, score): per view the highest g of the track's detections, summed over views."""
    per = support.join(tracks.select("det", "track"), "det").groupBy("gid", "track", "frame_idx").agg(F.max("g").alias("g"))
    return per.groupBy("gid", "track").agg(exact_sum(F.col("g"), 2).alias("score"))


def best_track(scores: DataFrame, low_margin: float = 0.1) -> DataFrame:
    """Best and second track by point, the margin between them, and whether it is a tie or low."""
    r = F.row_number().over(W.partitionBy("gid").orderBy(F.desc("score"), "track"))
    two = scores.withColumn("r", r).filter("r <= 2").groupBy("gid").agg(F.max(F.when(F.col("r") == 1, F.col("track"))).alias("track"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
    second = F.coalesce("second", F.lit(0.0))
    margin = F.col("best") - second
    return two.select("gid", "track", "best", second.alias("second"), (F.floor(margin * 100 + 0.5) / 100).alias("margin"), (margin == 0).alias("tie"), (margin < low_margin * F.col("best")).alias("low"))


def conflicting_support(support: DataFrame, assigned: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """Instances with at least `least` points in the supports of both detections of a cannot-link pair."""
    held = support.select("det", "gid").join(assigned.select("gid", F.col("track").alias("instance")), "gid").groupBy("det", "instance").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    a = held.select(F.col("det").alias("lo"), "instance")
    b = held.select(F.col("det").alias("hi"), "instance")
    return links.select("lo", "hi").join(a, "lo").join(b, ["hi", "instance"]).select("instance", "lo", "hi")


def distinctness(votes: DataFrame, least: int) -> DataFrame:
    """(a, b, distinct) from per-view votes (a, b, frame_idx, vote): at least `least` votes, or at least half of the views checked."""
    t = votes.groupBy("a", "b").agg(F.count_if("vote").alias("votes"), F.count("*").alias("checked"))
    return t.withColumn("distinct", (F.col("votes") >= least) | ((F.col("checked") > 0) & (2 * F.col("votes") >= F.col("checked"))))


def dominant_masks(inside: DataFrame) -> DataFrame:
    """Per point set and frame the mask that holds the most of it: (part, frame_idx, mask, n)."""
    n = inside.groupBy("part", "frame_idx", "mask").agg(F.count("*").alias("n"))
    return n.groupBy("part", "frame_idx").agg(F.max_by("mask", F.struct("n", -F.col("mask"))).alias("mask"), F.max("n").alias("n"))


def nearest_fill(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a component without a seed get the label of its nearest seeded point; the lowest gid of equals.

    Points look for seeds in their grid cell and those around it; a seed no farther than the cell's
    size is the nearest of all. Points that find none look again in cells of twice the size, until
    the cells are as large as the scene. Points of components without a seed are left out.
    """
    spark = points.sparkSession
    rows = materialize(spark, points.select(*keys, "gid", "seed", "x", "y", "z"), "fill_points")
    seeds = rows.filter("seed is not null")
    e = rows.agg(*(F.max(c) - F.min(c) for c in "xyz"), F.count("seed")).first()
    extent = max((v or 0.0 for v in e[:3]), default=0.0)
    size = max(extent / max(1.0, e[3] ** (1 / 3)), 1e-9)
    todo = rows.filter("seed is null").join(seeds.select(*keys).distinct(), keys, "left_semi").drop("seed")
    done = [seeds.select(*keys, "gid", "seed")]
    step = F.array(*map(F.lit, (-1, 0, 1)))
    while True:
        cell = lambda c: F.floor(F.col(c) / size)  # noqa: E731, B023
        near = todo.select("*", *(cell(c).alias(f"c{c}") for c in "xyz"))
        for c in "xyz":
            near = near.withColumn("d", F.explode(step)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d")
        s = seeds.select(*keys, F.col("gid").alias("s_gid"), F.col("seed").alias("s_seed"), *(F.col(c).alias(f"s{c}") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
        d = F.pow(F.col("x") - F.col("sx"), 2) + F.pow(F.col("y") - F.col("sy"), 2) + F.pow(F.col("z") - F.col("sz"), 2)
        best = near.join(s, [*keys, "cx", "cy", "cz"]).groupBy(*keys, "gid").agg(F.min_by("s_seed", F.struct(d, "s_gid")).alias("seed"), F.min(d).alias("d"))
        if size < extent:
            best = best.filter(F.col("d") <= size * size)
        best = materialize(spark, best.select(*keys, "gid", "seed"), "filled")
        done.append(best)
        if size >= extent:
            break
        todo = materialize(spark, todo.join(best, [*keys, "gid"], "left_anti"), "unfilled")
        if todo.isEmpty():
            break
        size *= 2
    return functools.reduce(DataFrame.unionByName, done)


def histogram_by_kind(pairs: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts by kind of pair and bin of a value in 0 to 1."""
    b = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("long")
    return pairs.groupBy("kind", b.alias("bin")).agg(F.count("*").alias("n"))
