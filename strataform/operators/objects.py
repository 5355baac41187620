"""Objects from instances: geometry, supporting frames, confidence, holds, and the nested document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataform.functions.numeric import exact_sum
from strataform.operators.detections import channel


def geometry(points: DataFrame, key: str = "instance_id") -> DataFrame:
    """Weighted centre, bounds, mean opacity and count, all in one aggregation."""
    w = F.col("opacity")
    s = points.groupBy(key).agg(F.count("*").alias("n"), exact_sum(w).alias("w"), *(exact_sum(w * F.col(a)).alias(f"s{a}") for a in "xyz"), *(f(a).alias(f"{a}{k}") for a in "xyz" for k, f in ((0, F.min), (1, F.max))))
    r = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    return s.select(key, "n", *(r(F.col(f"s{a}") / F.col("w")).alias(f"c{a}") for a in "xyz"), *(f"{a}{k}" for a in "xyz" for k in (0, 1)), r(F.col("w") / F.col("n")).alias("mean_opacity"))


def track_frames(track: DataFrame) -> DataFrame:
    """The best unambiguous detection of each track and frame; the lowest det_idx on ties."""
    r = F.row_number().over(W.partitionBy("track_id", "frame_idx").orderBy(F.desc("score"), "det_idx"))
    return track.filter("not ambiguous").withColumn("r", r).filter("r = 1").drop("r")


def ordered_frames(frames: DataFrame) -> DataFrame:
    """Each track's frames numbered by score, best first, then by frame."""
    return frames.withColumn("place", F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("score"), "frame_idx")))


def confidence(tracks: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """Mean of each track's k best frame scores; 0 where it has none."""
    top = ordered_frames(frames).filter(F.col("place") <= k).groupBy("track_id").agg(exact_sum(F.col("score"), 4).alias("s"), F.count("*").alias("n"))
    return tracks.select("track_id").distinct().join(top, "track_id", "left").select("track_id", F.coalesce(F.floor(F.col("s") / F.col("n") * 1e4 + 0.5) / 1e4, F.lit(0.0)).alias("confidence"))


def source_counts(frames: DataFrame) -> DataFrame:
    """Frames by channel, as a map in order of its keys."""
    n = frames.groupBy("track_id", channel(F.col("source")).alias("channel")).agg(F.count("*").alias("n"))
    return n.groupBy("track_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("channel", "n")))).alias("frames_by_channel"))


def export_floor(frames: DataFrame, least: int) -> DataFrame:
    """Each track with its number of frames and whether it is exported."""
    return frames.groupBy("track_id").agg(F.count("*").alias("n_frames")).withColumn("exported", F.col("n_frames") >= least)


def hold_reasons(ambiguous_frac, low_margin_frac, refused, limit: float):
    """The reasons to hold an object, in a fixed order; empty where none holds."""
    every = F.array(F.when(ambiguous_frac > limit, F.lit("ambiguous_support")), F.when(low_margin_frac > limit, F.lit("low_margin")), F.when(refused > 0, F.lit("refused_bridge")))
    return F.filter(every, lambda r: r.isNotNull())


def held_counts(objects: DataFrame) -> DataFrame:
    """Objects by hold reason; an object with two reasons counts for both."""
    return objects.select(F.explode("hold_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def provenance(frames: DataFrame, origin: DataFrame) -> DataFrame:
    """Per track whether only manual views, only automatic ones, or both support it, and whether only exemplars do."""
    j = frames.join(origin, "frame_idx")
    return j.groupBy("track_id").agg(
        F.when(F.bool_and(F.col("provenance") == "manual"), "manual").when(F.bool_or(F.col("provenance") == "manual"), "mixed").otherwise("auto").alias("views"),
        F.when(F.bool_and(channel(F.col("source")) == "exemplar"), "exemplar").when(F.bool_or(channel(F.col("source")) == "exemplar"), "mixed").otherwise("text").alias("sources"),
    )


def documents(tracks: DataFrame, frames: DataFrame, geometry_: DataFrame, confidences: DataFrame) -> DataFrame:
    """One nested object a track: position, size, confidence and frames, and the same as JSON."""
    f = frames.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "frame_idx", "score", F.array("x1", "y1", "x2", "y2").alias("box")))).alias("f"))
    label = tracks.groupBy("track_id").agg(F.min("concept").alias("label"))
    o = label.join(geometry_, label.track_id == geometry_.instance_id).drop("instance_id").join(f, "track_id", "left").join(confidences, "track_id", "left")
    shown = F.transform(F.coalesce("f", F.array().cast("array<struct<o:double,frame_idx:bigint,score:double,box:array<bigint>>>")), lambda x: F.struct(x.frame_idx.alias("frame_idx"), x.score.alias("score"), x.box.alias("box")))
    doc = F.struct(F.col("label"), F.array("cx", "cy", "cz").alias("position"), F.array(*(F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz")).alias("scale"), F.col("confidence"), shown.alias("frames"))
    return o.select("track_id", doc.alias("object")).withColumn("json", F.to_json("object"))


def frame_annotations(frames: DataFrame) -> DataFrame:
    """By frame, the tracks seen in it with their boxes, in order of track."""
    return frames.groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct("track_id", "det_idx", F.array("x1", "y1", "x2", "y2").alias("box")))).alias("tracks"))


def lookup_refusals(tracks: DataFrame, instances: DataFrame) -> DataFrame:
    """Tracks without an instance and instances without a track: both must be empty before an export."""
    t, i = tracks.select(F.col("track_id").alias("id")).distinct(), instances.select(F.col("instance_id").alias("id")).distinct()
    return t.join(i, "id", "left_anti").select("id", F.lit("track without points").alias("what")).unionByName(i.join(t, "id", "left_anti").select("id", F.lit("points without a track").alias("what")))


def track_documents(tracks: DataFrame, exported: DataFrame) -> DataFrame:
    """(class_id, json, instances): a class's tracks with their detections as JSON, and its map from instance to track.

    tracks: (class_id, det, track); exported: (class_id, track, instance_id).
    """
    each = tracks.groupBy("class_id", "track").agg(F.sort_array(F.collect_list("det")).alias("dets"))
    named = each.join(exported, ["class_id", "track"], "left")
    listed = F.sort_array(F.collect_list(F.struct("track", "dets", "instance_id"))).alias("tracks")
    pairs = F.sort_array(F.collect_list(F.when(F.col("instance_id").isNotNull(), F.struct("instance_id", "track")))).alias("pairs")
    docs = named.groupBy("class_id").agg(listed, pairs)
    return docs.select("class_id", F.to_json(F.struct("class_id", "tracks")).alias("json"), F.map_from_entries("pairs").alias("instances"))


def histogram_document(counts: DataFrame, bins: int) -> DataFrame:
    """One row: counts (kind, bin, n) as JSON, an array of `bins` numbers for each kind."""
    each = counts.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)))
    return each.groupBy().agg(F.sort_array(F.collect_list(F.struct("kind", filled.alias("counts")))).alias("h")).select(F.to_json(F.struct(F.lit(bins).alias("bins"), F.map_from_entries("h").alias("histograms"))).alias("json"))
