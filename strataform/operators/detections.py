"""Detection rows: presence and area gates, same-frame overlap, dedup rules and summaries.

A detection row has frame_idx, concept, det_idx, score, area_frac, a box (x1, y1, x2, y2 with
exclusive upper ends) and source, which is `text` or `exemplar:<concept>`. Masks are boxes where
no mask runs are given.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from strataform.operators.boxpairs import apart


def lookup(key: Column, values: Mapping[str, float], default: Column | float | None = None) -> Column:
    """A small literal map as an expression."""
    other = default if isinstance(default, Column) else F.lit(default).cast("double")
    if not values:
        return other
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), other)


def channel(source: Column) -> Column:
    return F.when(source.startswith("exemplar:"), F.lit("exemplar")).otherwise(F.lit("text"))


def threshold(default: float, by_class: Mapping[str, float] = {}, exemplar_default: float | None = None, exemplar_by_class: Mapping[str, float] = {}) -> Column:
    """The presence threshold of a row: a class's own, else its channel's default."""
    text = lookup(F.col("concept"), by_class, default)
    exemplar = lookup(F.col("concept"), exemplar_by_class, default if exemplar_default is None else exemplar_default)
    return F.when(channel(F.col("source")) == "exemplar", exemplar).otherwise(text)


def above_threshold(rows: DataFrame, limit: Column) -> DataFrame:
    """Rows at or above their presence threshold."""
    return rows.filter(F.col("score") >= limit)


def without_negatives(rows: DataFrame, negatives: Sequence[str]) -> DataFrame:
    return rows.filter(~F.col("concept").isin(*negatives)) if negatives else rows


def within_area_cap(rows: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    """Rows that do not exceed the absolute area cap of their class, where it has one."""
    return rows.filter(F.col("area_frac") <= lookup(F.col("concept"), caps, float("inf")))


def area_medians(rows: DataFrame, caps: Mapping[str, float], min_dets: int) -> DataFrame:
    """Median area by class and channel, for classes without an absolute cap and with enough rows."""
    free = rows.filter(~F.col("concept").isin(*caps)) if caps else rows
    return free.groupBy("concept", channel(F.col("source")).alias("channel")).agg(F.percentile("area_frac", F.lit(0.5)).alias("median_area"), F.count("*").alias("n")).filter(F.col("n") >= min_dets)


def area_factor(rows: DataFrame, caps: Mapping[str, float], min_dets: int, factor: float) -> DataFrame:
    """All rows with `killed`: whether the area exceeds `factor` times the median of class and channel."""
    medians = area_medians(rows, caps, min_dets)
    keyed = rows.withColumn("channel", channel(F.col("source")))
    # one row for each class and channel of a vocabulary: adaptive execution broadcasts it when its measured size allows
    return keyed.join(medians, ["concept", "channel"], "left").withColumn("killed", F.coalesce(F.col("area_frac") > F.col("median_area") * factor, F.lit(False)))


def mask_floor(overlay: float, limit: Column) -> Column:
    """The score from which a mask is kept: the lower of the overlay's and the presence threshold."""
    return F.least(F.lit(overlay), limit)


def area(p: str = "") -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def overlap_pairs(rows: DataFrame, same_class: bool = False, keep_disjoint: bool = False, cell: int | None = None) -> DataFrame:
    """Pairs of one frame (first before second in det_idx) with their intersection and both overlaps over the smaller box.

    Frames are an equality key and the box test a residual of the same join. `cell` adds a coarse
    grid key, so that a crowded frame is dealt over many tasks; a pair is counted in the cell that
    holds the lower corner of its intersection, and so once.
    """
    cols = ["frame_idx", "det_idx", "concept", "score", "source", "x1", "y1", "x2", "y2"]
    keys = ["frame_idx"]
    if same_class:
        keys.append("concept")
    base = rows.select(*cols)
    if cell and not keep_disjoint:
        grid = lambda a: F.sequence(F.floor(F.col(f"{a}1") / cell), F.floor((F.col(f"{a}2") - 1) / cell))
        base = base.withColumn("gx", F.explode(grid("x"))).withColumn("gy", F.explode(grid("y")))
        keys += ["gx", "gy"]
    a = base.select(*(F.col(c).alias(c if c in keys else f"a_{c}") for c in base.columns))
    b = base.select(*(F.col(c).alias(c if c in keys else f"b_{c}") for c in base.columns))
    joined = a.join(b, keys).filter(F.col("a_det_idx") < F.col("b_det_idx"))
    ix = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    iy = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    if not keep_disjoint:
        joined = joined.filter((ix > 0) & (iy > 0))
    if cell and not keep_disjoint:
        joined = joined.filter((F.floor(F.greatest("a_x1", "b_x1") / cell) == F.col("gx")) & (F.floor(F.greatest("a_y1", "b_y1") / cell) == F.col("gy"))).drop("gx", "gy")
    joined = joined.withColumn("inter", F.greatest(ix, F.lit(0)) * F.greatest(iy, F.lit(0))).withColumn("a_area", area("a_")).withColumn("b_area", area("b_"))
    return joined.withColumn("ios_a", F.col("inter") / F.col("a_area")).withColumn("ios_b", F.col("inter") / F.col("b_area"))


def runs_intersection(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pixels that two masks share, from row runs (mask, y, x0, x1 exclusive) and pairs (a, b)."""
    a = runs.select(F.col("mask").alias("a"), "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = runs.select(F.col("mask").alias("b"), "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    shared = F.greatest(F.lit(0), F.least("a1", "b1") - F.greatest("a0", "b0"))
    return pairs.join(a, "a").join(b, ["b", "y"]).groupBy("a", "b").agg(F.sum(shared).cast("long").alias("inter"))


def bands(runs: DataFrame) -> DataFrame:
    """Mask bands (mask, y0, y1, x0, x1; upper ends exclusive): equal runs of neighbouring pixel rows as one."""
    place = F.row_number().over(W.partitionBy("mask", "x0", "x1").orderBy("y"))
    return runs.withColumn("band", F.col("y") - place).groupBy("mask", "x0", "x1", "band").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).select("mask", "y0", "y1", "x0", "x1")


def box_bands(rows: DataFrame) -> DataFrame:
    """Mask bands of boxes, one each."""
    return rows.select(F.col("det_idx").alias("mask"), F.col("y1").alias("y0"), F.col("y2").alias("y1"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def bands_intersection(bands: DataFrame, pairs: DataFrame) -> DataFrame:
    """What `runs_intersection` gives, from bands: a pair meets bands instead of pixel rows."""
    side = lambda k: bands.select(F.col("mask").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("y0", "y1", "x0", "x1")))
    high = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    wide = F.greatest(F.lit(0), F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(high > 0).groupBy("a", "b").agg(F.sum(high * wide).cast("long").alias("inter"))


def packed_intersection(a: Column, b: Column) -> Column:
    """Set bits that two packed masks (arrays of 64-bit words) share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda n, x: n + x)


def classified_pairs(pairs: DataFrame, mutual: float, part: float, exemplar_overlap: float, ranks: Mapping[str, int] = {}) -> DataFrame:
    """Pairs with `rule` A, B or C and, for A and C, the row that drops (`drop_det`).

    A: different classes that cover each other; the lower rank drops where both classes are ranked
    and differ, else the lower score, the first on a tie. B: one lies in the other (`part_det`).
    C: one class from text and exemplar; the exemplar row drops.
    """
    same = F.col("a_concept") == F.col("b_concept") if "a_concept" in pairs.columns else F.lit(True)
    low, high = F.least("ios_a", "ios_b"), F.greatest("ios_a", "ios_b")
    ca, cb = channel(F.col("a_source")), channel(F.col("b_source"))
    rank_a, rank_b = (lookup(F.col(c), ranks) for c in ("a_concept", "b_concept"))
    first = F.when(rank_a.isNotNull() & rank_b.isNotNull() & (rank_a != rank_b), rank_a > rank_b).otherwise(F.col("a_score") <= F.col("b_score"))
    rule = F.when(same & (ca != cb) & (high >= exemplar_overlap), F.lit("C")).when(~same & (low >= mutual), F.lit("A")).when(~same & (high >= part), F.lit("B"))
    out = pairs.withColumn("rule", rule).filter("rule is not null")
    drop = F.when(F.col("rule") == "C", F.when(ca == "exemplar", F.col("a_det_idx")).otherwise(F.col("b_det_idx"))).when(F.col("rule") == "A", F.when(first, F.col("a_det_idx")).otherwise(F.col("b_det_idx")))
    part_is_a = F.col("ios_a") >= F.col("ios_b")
    return out.withColumn("drop_det", drop).withColumn("part_det", F.when(F.col("rule") == "B", F.when(part_is_a, F.col("a_det_idx")).otherwise(F.col("b_det_idx"))))


def part_quorum(pairs: DataFrame, min_frames: int) -> DataFrame:
    """(part_concept, whole_concept) seen as part and whole in enough distinct frames; rows touching an A or C drop do not count."""
    dropped = pairs.filter("drop_det is not null").select("frame_idx", F.col("drop_det").alias("det")).distinct()
    b = pairs.filter("rule = 'B'")
    for side in ("a_det_idx", "b_det_idx"):
        b = b.join(dropped.withColumnRenamed("det", side), ["frame_idx", side], "left_anti")
    part_is_a = F.col("part_det") == F.col("a_det_idx")
    named = b.select("frame_idx", F.when(part_is_a, F.col("a_concept")).otherwise(F.col("b_concept")).alias("part_concept"), F.when(part_is_a, F.col("b_concept")).otherwise(F.col("a_concept")).alias("whole_concept"))
    return named.groupBy("part_concept", "whole_concept").agg(F.count_distinct("frame_idx").alias("n_frames")).filter(F.col("n_frames") >= min_frames)


def drop_parts(pairs: DataFrame, quorum: DataFrame, ranks: Mapping[str, int] = {}) -> DataFrame:
    """(frame_idx, det_idx, action): parts dropped or wholes carved, walking each frame's pairs in order.

    A part that has been dropped no longer acts as a whole for later pairs, so the walk is
    sequential within a frame; frames are independent.
    """
    dropped = pairs.filter("drop_det is not null").select("frame_idx", F.col("drop_det").alias("det")).distinct()
    b = pairs.filter("rule = 'B'")
    part_is_a = F.col("part_det") == F.col("a_det_idx")
    b = b.withColumn("part_concept", F.when(part_is_a, F.col("a_concept")).otherwise(F.col("b_concept"))).withColumn("whole_concept", F.when(part_is_a, F.col("b_concept")).otherwise(F.col("a_concept")))
    b = b.withColumn("whole_det", F.when(part_is_a, F.col("b_det_idx")).otherwise(F.col("a_det_idx"))).join(quorum.select("part_concept", "whole_concept"), ["part_concept", "whole_concept"])
    for side in ("part_det", "whole_det"):
        b = b.join(dropped.withColumnRenamed("det", side), ["frame_idx", side], "left_anti")
    ranked = dict(ranks)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        out: list[tuple[int, int, str]] = []
        rows = frame.sort_values(["a_det_idx", "b_det_idx"])
        for r in rows.itertuples():
            if r.part_det in gone or r.whole_det in gone:
                continue
            above = ranked.get(r.part_concept)
            below = ranked.get(r.whole_concept)
            if above is not None and (below is None or above < below):
                out.append((r.frame_idx, r.whole_det, "carve"))
            else:
                gone.add(r.part_det)
                out.append((r.frame_idx, r.part_det, "drop"))
        return pd.DataFrame(sorted(set(out)), columns=["frame_idx", "det_idx", "action"])

    cols = ["frame_idx", "a_det_idx", "b_det_idx", "part_det", "whole_det", "part_concept", "whole_concept"]
    return b.select(*cols).groupBy("frame_idx").applyInPandas(walk, "frame_idx long, det_idx long, action string")


def fold_duplicates(rows: DataFrame, min_iou: float) -> DataFrame:
    """Per frame and source, exemplar rows in order: a row that overlaps a kept one replaces it if it scores higher, else goes."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in group.sort_values("det_idx").itertuples(index=False):
            for i, k in enumerate(kept):
                ix = min(r.x2, k.x2) - max(r.x1, k.x1)
                iy = min(r.y2, k.y2) - max(r.y1, k.y1)
                inter = max(ix, 0) * max(iy, 0)
                union = (r.x2 - r.x1) * (r.y2 - r.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - inter
                if inter >= min_iou * union:
                    if r.score > k.score:
                        kept[i] = r
                    break
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=group.columns)

    return rows.groupBy("frame_idx", "source").applyInPandas(fold, rows.schema)


def cannot_link(rows: DataFrame, max_overlap: float, blocks: int = 8) -> DataFrame:
    """Pairs of one class in one frame that overlap by at most `max_overlap` of the smaller: two objects, not one.

    Nearly all pairs are results, so they are not joined row by row (`boxpairs.apart`).
    """
    return apart(rows, max_overlap, blocks)


def concept_summary(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per concept: rows, frames, highest and mean score, mean area; concepts without rows have zeros and nulls."""
    each = rows.groupBy("concept").agg(
        F.count("*").alias("n_det"),
        F.count_distinct("frame_idx").alias("n_frames"),
        F.max("score").alias("max_score"),
        (F.floor(F.sum(F.col("score").cast("decimal(18,6)")).cast("double") / F.count("*") * 1e4 + 0.5) / 1e4).alias("mean_score"),
        (F.floor(F.sum(F.col("area_frac").cast("decimal(18,6)")).cast("double") / F.count("*") * 1e4 + 0.5) / 1e4).alias("mean_area"),
    )
    return concepts.join(each, "concept", "left").fillna(0, ["n_det", "n_frames"])


def negative_ceiling(rows: DataFrame, negatives: Sequence[str]) -> DataFrame:
    """The highest-scoring row of the negative controls; of equal scores the last in order of frame, concept and number."""
    top = rows.filter(F.col("concept").isin(*negatives)).select("score", "frame_idx", "concept", "det_idx")
    return top.orderBy(F.desc("score"), F.desc("frame_idx"), F.desc("concept"), F.desc("det_idx")).limit(1)


def number_rows(rows: DataFrame, base: DataFrame) -> DataFrame:
    """New rows numbered within frame and concept, from one above the highest number that `base` has."""
    top = base.groupBy("frame_idx", "concept").agg((F.max("det_no") + 1).alias("first"))
    order = W.partitionBy("frame_idx", "concept").orderBy(F.desc("score"), "det_idx")
    return rows.join(top, ["frame_idx", "concept"], "left").withColumn("det_no", F.coalesce("first", F.lit(0)) + F.row_number().over(order) - 1).drop("first")


def global_numbers(rows: DataFrame) -> DataFrame:
    """A running number over frames, then det_idx: counts of earlier frames plus the place within the frame.

    Only the frame counts, one row a frame, are ordered as a whole.
    """
    counts = rows.groupBy("frame_idx").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(W.partitionBy("frame_idx").orderBy("det_idx")) - 1
    return rows.join(before, "frame_idx").withColumn("global_id", (F.col("before") + own).cast("long")).drop("before")


def expected_count(rows: DataFrame, min_views: int) -> DataFrame:
    """The largest k that at least `min_views` frames hold detections of: the min_views-th largest count of a frame."""
    per = rows.groupBy("concept", "frame_idx").agg(F.count("*").alias("n"))
    ranked = per.withColumn("r", F.row_number().over(W.partitionBy("concept").orderBy(F.desc("n"), "frame_idx")))
    return ranked.filter(F.col("r") == min_views).select("concept", F.col("n").alias("expected"))


def class_list(prompts: DataFrame, negatives: Sequence[str], exemplars: DataFrame) -> DataFrame:
    """Class ids in order: prompts that are not negatives, then exemplar concepts not among them."""
    kept = prompts.filter(~F.col("concept").isin(*negatives)).select("concept", F.lit(0).alias("part"), "pos")
    extra = exemplars.join(kept, "concept", "left_anti").select("concept", F.lit(1).alias("part"), "pos")
    return kept.unionByName(extra).withColumn("class_id", (F.row_number().over(W.orderBy("part", "pos")) - 1).cast("long")).select("class_id", "concept")


def funnel(rows: DataFrame, limit: Column, caps: Mapping[str, float], min_dets: int, factor: float, negatives: Sequence[str]) -> DataFrame:
    """Per class: rows logged, above threshold, inside the area gates, kept, and the percentage kept."""
    logged = without_negatives(rows, negatives).withColumn("above", F.col("score") >= limit)
    above = logged.filter("above")
    judged = area_factor(above, caps, min_dets, factor).withColumn("capped", F.col("area_frac") > lookup(F.col("concept"), caps, float("inf")))
    counts = logged.groupBy("concept").agg(F.count("*").alias("logged"), F.count_if("above").alias("above"))
    gates = judged.groupBy("concept").agg(F.count_if("capped").alias("capped"), F.count_if(F.col("killed") & ~F.col("capped")).alias("killed"))
    out = counts.join(gates, "concept", "left").fillna(0, ["capped", "killed"])
    out = out.withColumn("kept", F.col("above") - F.col("capped") - F.col("killed"))
    return out.withColumn("kept_percent", F.floor(F.col("kept") * 100.0 / F.col("logged")).cast("long"))


MASK_RUN = T.StructType([T.StructField("mask", T.LongType()), T.StructField("y", T.LongType()), T.StructField("x0", T.LongType()), T.StructField("x1", T.LongType())])


def box_runs(rows: DataFrame) -> DataFrame:
    """Mask runs of boxes, one for each pixel row."""
    return rows.select(F.col("det_idx").alias("mask"), F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)).alias("y"), F.col("x1").alias("x0"), F.col("x2").alias("x1"))


def mask_boxes(runs: DataFrame) -> DataFrame:
    """Box and area of masks from their runs; upper ends inclusive, as in detection rows."""
    return runs.groupBy("mask").agg(F.min("x0").alias("x1"), F.min("y").alias("y1"), (F.max("x1") - 1).alias("x2"), F.max("y").alias("y2"), F.sum(F.col("x1") - F.col("x0")).cast("long").alias("area"))


def carved(runs: DataFrame, carve: DataFrame) -> DataFrame:
    """Pixels of each whole left after its parts' pixels are taken off; `carve` has (whole, part). Counts by whole."""
    pixels = runs.select("mask", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"))
    wholes = pixels.join(carve.select(F.col("whole").alias("mask")).distinct(), "mask", "left_semi")
    parts = pixels.withColumnRenamed("mask", "part").join(carve, "part").select(F.col("whole").alias("mask"), "y", "x").distinct()
    return wholes.join(parts, ["mask", "y", "x"], "left_anti").groupBy("mask").agg(F.count("*").alias("left_area"))
