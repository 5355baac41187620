"""Splitting and merging the parts of a class by what its views show.

Tables
    points    class_id, part, gid, x, y, z
    visible   class_id, frame_idx, gid: points seen in a view that shows several masks of their class
    hits      class_id, frame_idx, mask, gid: of those, the ones that lie in a mask
    overlaps  class_id, frame_idx, mask, other, iou: masks of a view that meet; others are disjoint

A part is halved by `by_coordinates` or `by_evidence(...)`. Each round treats the parts of all classes at once and is written to the shared folder. Rows are
dealt by point, by (part, view) or by part, never by class: a class may hold any number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataform.operators.assignment import nearest_fill
from strataform.session import materialize

AXES = ("x", "y", "z")


class Evidence:
    """What the views show of the points, and the limits by which it counts."""

    def __init__(self, visible: DataFrame, hits: DataFrame, overlaps: DataFrame, min_visible: int = 50, min_frac: float = 0.5, max_iou: float = 0.1, quorum: int = 3, min_ios: float = 0.6, near: float = 0.25):
        self.visible, self.hits, self.overlaps = visible, hits, overlaps
        self.min_visible, self.min_frac, self.max_iou, self.quorum = min_visible, min_frac, max_iou, quorum
        self.min_ios, self.near = min_ios, near

    def leading_masks(self, points: DataFrame) -> DataFrame:
        """(class_id, part, frame_idx, top): the two masks that hold most of a part's visible points, as (frac, mask), best first.

        Views that show fewer than `min_visible` of a part's points are left out.
        """
        own = points.select("class_id", "part", "gid")
        n = own.join(self.visible, ["class_id", "gid"]).groupBy("class_id", "part", "frame_idx").agg(F.count("*").alias("n")).filter(F.col("n") >= self.min_visible)
        held = own.join(self.hits, ["class_id", "gid"]).groupBy("class_id", "part", "frame_idx", "mask").agg(F.count("*").alias("k"))
        place = F.row_number().over(W.partitionBy("class_id", "part", "frame_idx").orderBy(F.desc("frac"), "mask"))
        rows = n.join(held, ["class_id", "part", "frame_idx"], "left").withColumn("frac", F.coalesce(F.col("k") / F.col("n"), F.lit(0.0))).withColumn("place", place).filter("place <= 2")
        return rows.groupBy("class_id", "part", "frame_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "frac", "mask"))), lambda s: F.struct(s.frac.alias("frac"), s.mask.alias("mask"))).alias("top"))

    def _apart(self, rows: DataFrame, one: Column, two: Column) -> DataFrame:
        """Adds vote: whether masks of a view (as (frac, mask)) each hold enough and are nearly disjoint."""
        keyed = rows.withColumn("mask", F.least(one.mask, two.mask)).withColumn("other", F.greatest(one.mask, two.mask))
        enough = (one.frac >= self.min_frac) & (two.frac >= self.min_frac) & (F.col("mask") < F.col("other"))
        met = keyed.join(self.overlaps.select("class_id", "frame_idx", "mask", "other", "iou"), ["class_id", "frame_idx", "mask", "other"], "left")
        return met.withColumn("vote", F.coalesce(enough, F.lit(False)) & (F.coalesce("iou", F.lit(0.0)) <= self.max_iou)).drop("mask", "other", "iou")

    def spanning(self, points: DataFrame) -> DataFrame:
        """(class_id, part, votes): views in which a part fills two nearly disjoint masks."""
        rows = self.leading_masks(points).filter("size(top) = 2").select("class_id", "part", "frame_idx", F.col("top")[0].alias("one"), F.col("top")[1].alias("two"))
        return self._apart(rows, F.col("one"), F.col("two")).groupBy("class_id", "part").agg(F.count_if("vote").alias("votes"))

    def distinct(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """pairs (class_id, a, b) with votes, checked and distinct: a quorum of views, or half of those that show both, has them in masks of their own."""
        top = self.leading_masks(points).select("class_id", "part", "frame_idx", F.col("top")[0].alias("top"))
        side = lambda k, to: top.select("class_id", F.col("part").alias(k), "frame_idx", F.col("top").alias(to))
        both = pairs.select("class_id", "a", "b").join(side("a", "one"), ["class_id", "a"]).join(side("b", "two"), ["class_id", "b", "frame_idx"])
        t = self._apart(both, F.col("one"), F.col("two")).groupBy("class_id", "a", "b").agg(F.count_if("vote").alias("votes"), F.count("*").alias("checked"))
        out = pairs.join(t, ["class_id", "a", "b"], "left").withColumn("votes", F.coalesce("votes", F.lit(0))).withColumn("checked", F.coalesce("checked", F.lit(0)))
        return out.withColumn("distinct", (F.col("votes") >= self.quorum) | ((F.col("checked") > 0) & (2 * F.col("votes") >= F.col("checked"))))

    def near_pairs(self, points: DataFrame) -> DataFrame:
        """(class_id, a, b), a < b: parts of a class whose centres lie within its largest diagonal or a little more, by a grid of that size.

        Stacked parts are never farther apart, as `near` is at most 1.
        """
        b = points.groupBy("class_id", "part").agg(*(F.avg(a).alias(a) for a in AXES), F.sqrt(sum((F.pow(F.max(a) - F.min(a), 2) for a in AXES[1:]), F.pow(F.max("x") - F.min("x"), 2))).alias("diag"))
        size = b.groupBy("class_id").agg(F.greatest(F.max("diag"), F.lit(1e-9)).alias("size"))
        cells = b.join(size, "class_id").select("class_id", "part", *(F.floor(F.col(a) / F.col("size")).alias(f"c{a}") for a in AXES))
        step = F.array(*map(F.lit, (-1, 0, 1)))
        near = cells.withColumnRenamed("part", "a")
        for a in AXES:
            near = near.withColumn("d", F.explode(step)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("d")).drop("d")
        return near.join(cells.withColumnRenamed("part", "b"), ["class_id", "cx", "cy", "cz"]).filter("a < b").select("class_id", "a", "b").distinct()

    def stacked(self, pairs: DataFrame, points: DataFrame) -> DataFrame:
        """pairs (class_id, a, b) with ios, dist and stacked: boxes overlap or centres are near for the smaller, and near for the larger too."""
        b = points.groupBy("class_id", "part").agg(*(f(a).alias(f"{a}{k}") for a in AXES for k, f in (("0", F.min), ("1", F.max), ("m", F.avg))))
        box = lambda k: b.select("class_id", F.col("part").alias(k), F.struct(*(f"{a}{e}" for a in AXES for e in "01m")).alias(f"box_{k}"))
        p, q = F.col("box_a"), F.col("box_b")
        span = lambda s, a: s[f"{a}1"] - s[f"{a}0"]
        total = lambda f: f("x") * f("y") * f("z")
        length = lambda f: F.sqrt(F.pow(f("x"), 2) + F.pow(f("y"), 2) + F.pow(f("z"), 2))
        inter = total(lambda a: F.greatest(F.least(p[f"{a}1"], q[f"{a}1"]) - F.greatest(p[f"{a}0"], q[f"{a}0"]), F.lit(0.0)))
        ios = inter / F.greatest(F.least(total(lambda a: span(p, a)), total(lambda a: span(q, a))), F.lit(1e-9))
        dist, diag = length(lambda a: p[f"{a}m"] - q[f"{a}m"]), [length(lambda a, s=s: span(s, a)) for s in (p, q)]
        like = ((ios >= self.min_ios) | (dist <= self.near * F.least(*diag))) & (dist <= self.near * F.greatest(*diag))
        return pairs.join(box("a"), ["class_id", "a"]).join(box("b"), ["class_id", "b"]).withColumn("ios", ios).withColumn("dist", dist).withColumn("stacked", like).drop("box_a", "box_b")


def bisect(points: DataFrame, columns: Sequence[str], rounds: int = 25) -> DataFrame:
    """(class_id, part, gid, side): each part's points by 2-means, from its points of the least and the greatest hash.

    A round is an aggregation by part and side; it ends early once no centre moves. A part whose
    points are all equal, or one point, is all of side 0.
    """
    spark, keys = points.sparkSession, ["class_id", "part"]
    rows = materialize(spark, points.select(*keys, "gid", F.array(*(F.col(c).cast("double") for c in columns)).alias("v")), "bisect")
    ends = rows.withColumn("h", F.struct(F.xxhash64("gid"), "gid"))
    centres = materialize(spark, ends.groupBy(*keys).agg(F.min_by("v", "h").alias("c0"), F.max_by("v", "h").alias("c1")), "centres")
    far = lambda c: F.aggregate(F.zip_with("v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    sided = lambda c: rows.join(c, keys).withColumn("side", (far("c1") < far("c0")).cast("long"))
    for _ in range(rounds):
        means = [F.array(*(F.avg(F.when(F.col("side") == k, F.col("v")[i])) for i in range(len(columns)))) for k in (0, 1)]
        moved = sided(centres).groupBy(*keys).agg(F.first("c0").alias("old0"), F.first("c1").alias("old1"), *(m.alias(f"new{k}") for k, m in enumerate(means)))
        kept = [F.when(F.col(f"new{k}")[0].isNull(), F.col(f"old{k}")).otherwise(F.col(f"new{k}")) for k in (0, 1)]
        moved = materialize(spark, moved.select(*keys, *(c.alias(f"c{k}") for k, c in enumerate(kept)), ((kept[0] != F.col("old0")) | (kept[1] != F.col("old1"))).alias("moved")), "centres")
        centres = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return sided(centres).select(*keys, "gid", "side")


def evidence_bisect(points: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(class_id, part, gid, side): parts split by what detections say of their points, where that makes two sides.

    Points whose `columns` in features (class_id, gid, columns) sum to more than 1e-6 are split by
    2-means on them; the others of the part go with the nearest of those. Parts that evidence does
    not divide are left out.
    """
    spark, keys = points.sparkSession, ["class_id", "part"]
    told = points.join(features.select("class_id", "gid", *columns), ["class_id", "gid"])
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    sided = materialize(spark, bisect(told.filter(total > 1e-6), columns), "evidence_sides")
    both = sided.groupBy(*keys).agg((F.min("side") < F.max("side")).alias("two")).filter("two").select(*keys)
    seeds = sided.join(both, keys, "left_semi").withColumnRenamed("side", "seed")
    rows = points.join(both, keys, "left_semi").join(seeds, [*keys, "gid"], "left")
    return nearest_fill(rows, keys).select(*keys, "gid", F.col("seed").alias("side"))


def by_coordinates(points: DataFrame) -> DataFrame:
    return bisect(points, AXES)


def by_evidence(features: DataFrame, columns: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Halves by `evidence_bisect`, by coordinates where evidence does not divide a part."""

    def halve(points: DataFrame) -> DataFrame:
        told = materialize(points.sparkSession, evidence_bisect(points, features, columns), "evidence_halves")
        rest = points.join(told.select("class_id", "part").distinct(), ["class_id", "part"], "left_anti")
        return told.unionByName(by_coordinates(rest))

    return halve


def _halved(points: DataFrame, chosen: DataFrame, halve: Callable[[DataFrame], DataFrame], evidence: Evidence, least: int) -> tuple[DataFrame, DataFrame]:
    """Points of the chosen parts with a side, and (class_id, part, outcome) of each: split, fragment or ineffective."""
    spark = points.sparkSession
    own = materialize(spark, points.join(chosen.select("class_id", "part"), ["class_id", "part"]), "chosen")
    sided = materialize(spark, own.join(halve(own), ["class_id", "part", "gid"]), "sided")
    small = chosen.select("class_id", "part").join(sided.groupBy("class_id", "part").agg(F.least(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("small")), ["class_id", "part"])
    # sides are parts of their own to the evidence: 2 * part + side
    sides = sided.withColumn("part", 2 * F.col("part") + F.col("side"))
    pairs = chosen.select("class_id", (2 * F.col("part")).alias("a"), (2 * F.col("part") + 1).alias("b"))
    like = evidence.stacked(pairs, sides).filter("stacked").select("class_id", "a", "b")
    refuted = evidence.distinct(like, sides).filter("not distinct").select("class_id", (F.col("a") / 2).cast("long").alias("part"), F.lit(True).alias("undone"))
    outcome = F.when(F.col("small") < least, "fragment").when(F.col("undone"), "ineffective").otherwise("split")
    return sided, materialize(spark, small.join(refuted, ["class_id", "part"], "left").select("class_id", "part", outcome.alias("outcome")), "outcome")


def _apply(points: DataFrame, sided: DataFrame, outcome: DataFrame) -> DataFrame:
    """Points with new part numbers: the second side of a split part gets its class's next number, in order of parts."""
    done = outcome.filter("outcome = 'split'").select("class_id", "part")
    top = points.groupBy("class_id").agg(F.max("part").alias("top"))
    fresh = done.join(top, "class_id").select("class_id", "part", (F.col("top") + F.row_number().over(W.partitionBy("class_id").orderBy("part"))).alias("fresh"))
    new = sided.filter("side = 1").select("class_id", "part", "gid").join(fresh, ["class_id", "part"]).select("class_id", "part", "gid", "fresh")
    moved = points.join(new, ["class_id", "part", "gid"], "left").withColumn("part", F.coalesce("fresh", "part")).drop("fresh")
    return materialize(points.sparkSession, moved.select(*points.columns), "split_points")


def forced_split(points: DataFrame, expected: DataFrame, halve: Callable[[DataFrame], DataFrame], evidence: Evidence, least: int, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Points with their parts, and (class_id, round, part, outcome): while a class has fewer parts than expected its largest is bisected.

    A part whose split would leave a piece under `least` points ends its class's splits. A part
    whose halves are stacked and not distinct in 2D is set aside, counts as one part, and the
    next largest is tried. Of equal sizes the lowest part comes first. expected: (class_id, expected).
    """
    spark = points.sparkSession
    points = materialize(spark, points, "split_points")
    log = spark.createDataFrame([], "class_id long, round long, part long, outcome string")
    for r in range(max_rounds):
        size = points.groupBy("class_id", "part").agg(F.count("*").alias("n"))
        over = log.filter("outcome = 'fragment'").select("class_id").distinct()
        want = size.groupBy("class_id").agg(F.count("*").alias("parts")).join(expected, "class_id").filter("parts < expected").join(over, "class_id", "left_anti").select("class_id")
        aside = log.filter("outcome = 'ineffective'").select("class_id", "part")
        live = size.join(want, "class_id").join(aside, ["class_id", "part"], "left_anti")
        chosen = materialize(spark, live.groupBy("class_id").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("part")), "largest")
        if chosen.isEmpty():
            return points, log
        sided, outcome = _halved(points, chosen, halve, evidence, least)
        points = _apply(points, sided, outcome)
        log = materialize(spark, log.unionByName(outcome.select(F.col("class_id").cast("long").alias("class_id"), F.lit(r).cast("long").alias("round"), F.col("part").cast("long").alias("part"), "outcome")), "split_log")
    raise RuntimeError(f"splits did not end in {max_rounds} rounds")


def correspondence_split(points: DataFrame, halve: Callable[[DataFrame], DataFrame], evidence: Evidence, least: int, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Points with their parts, and (class_id, round, part, votes, outcome): parts that fill two masks in a quorum of views are bisected, their halves tested again.

    Parts under twice `least` points are left whole; so is one whose split would leave a fragment
    or be ineffective. Parts do not influence one another, so a round tests all new ones at once.
    """
    spark = points.sparkSession
    points = materialize(spark, points, "split_points")
    log = spark.createDataFrame([], "class_id long, round long, part long, votes long, outcome string")
    queue = points.select("class_id", "part").distinct()
    for r in range(max_rounds):
        open_ = points.join(queue, ["class_id", "part"], "left_semi")
        large = open_.groupBy("class_id", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * least)
        chosen = materialize(spark, evidence.spanning(open_).filter(F.col("votes") >= evidence.quorum).join(large, ["class_id", "part"]).select("class_id", "part", "votes"), "spanning")
        if chosen.isEmpty():
            return points, log
        sided, outcome = _halved(points, chosen, halve, evidence, least)
        before = points.select("class_id", "part").distinct()
        split = _apply(points, sided, outcome)
        fresh = split.select("class_id", "part").distinct().join(before, ["class_id", "part"], "left_anti")
        queue = materialize(spark, outcome.filter("outcome = 'split'").select("class_id", "part").unionByName(fresh), "queue")
        points = split
        log = materialize(spark, log.unionByName(outcome.join(chosen, ["class_id", "part"]).select(F.col("class_id").cast("long").alias("class_id"), F.lit(r).cast("long").alias("round"), F.col("part").cast("long").alias("part"), F.col("votes").cast("long").alias("votes"), "outcome")), "split_log")
    raise RuntimeError(f"splits did not end in {max_rounds} rounds")


def same_class_merge(points: DataFrame, evidence: Evidence, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Points with their parts, and (class_id, a, b, ios, dist, result): stacked pairs of parts, strongest first, merge unless distinct in 2D.

    Pairs are taken in order of ios descending, dist, a, b; each is tested against the unions made
    before it. A round decides, in every class, the pairs that no earlier undecided pair touches.
    """
    spark = points.sparkSession
    points = materialize(spark, points, "merge_points")
    parts = points.select("class_id", "part").distinct()
    order = W.partitionBy("class_id").orderBy(F.desc("ios"), "dist", "a", "b")
    todo = materialize(spark, evidence.stacked(evidence.near_pairs(points), points).filter("stacked").select("class_id", "a", "b", "ios", "dist", F.row_number().over(order).alias("place")), "merge_pairs")
    root = materialize(spark, parts.withColumn("root", F.col("part")), "merge_roots")
    log = spark.createDataFrame([], "class_id long, a long, b long, ios double, dist double, result string")
    for _ in range(max_rounds):
        of = lambda k, to: root.select("class_id", F.col("part").alias(k), F.col("root").alias(to))  # noqa: E731, B023
        open_ = todo.join(log.select("class_id", "a", "b"), ["class_id", "a", "b"], "left_anti").join(of("a", "ra"), ["class_id", "a"]).join(of("b", "rb"), ["class_id", "b"])
        # a pair within one union needs no test; of the rest, those that come first at both of their unions
        outer = open_.filter("ra <> rb")
        touch = outer.select("class_id", F.explode(F.array("ra", "rb")).alias("r"), "place").groupBy("class_id", "r").agg(F.min("place").alias("first"))
        first = lambda k: touch.select("class_id", F.col("r").alias(k), F.col("first").alias(f"first_{k}"))  # noqa: E731, B023
        ready = outer.join(first("ra"), ["class_id", "ra"]).join(first("rb"), ["class_id", "rb"]).filter("first_ra = place and first_rb = place")
        ready = materialize(spark, ready.select("class_id", "a", "b", "ios", "dist", "ra", "rb"), "merge_ready")
        if ready.isEmpty():
            into = points.join(root, ["class_id", "part"]).withColumn("part", F.col("root")).select(*points.columns)
            return into, log
        united = points.join(root, ["class_id", "part"]).select("class_id", F.col("root").alias("part"), "gid")
        judged = evidence.distinct(ready.select("class_id", F.col("ra").alias("a"), F.col("rb").alias("b")), united).select("class_id", F.col("a").alias("ra"), F.col("b").alias("rb"), "distinct")
        judged = materialize(spark, ready.join(judged, ["class_id", "ra", "rb"]).withColumn("result", F.when(F.col("distinct"), "kept_distinct").otherwise("merged")), "merge_judged")
        made = judged.filter("result = 'merged'").select("class_id", F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("into"))
        root = materialize(spark, root.join(made, ["class_id", "root"], "left").select("class_id", "part", F.coalesce("into", "root").alias("root")), "merge_roots")
        log = materialize(spark, log.unionByName(judged.select("class_id", "a", "b", "ios", "dist", "result")), "merge_log")
    raise RuntimeError(f"merges did not end in {max_rounds} rounds")
