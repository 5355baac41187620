"""Deterministic model tables from the driver's test tables, in Spark and as SQL.

The test tables hold no scenes, so detections come from events, points and contribution weights
from line items, poses from nations. Both forms use integer arithmetic, so they agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import table

SQL: dict[str, str] = {}


def with_(body: str, *names: str, recursive: bool = False) -> str:
    """`body` under the named model tables and those that they use; `recursive`: its own tables may refer to themselves."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in USES.get(name, ()):
            add(other)
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed) + ("," if body.lstrip().startswith("+") else "") + "\n" + body.lstrip().lstrip("+")


USES: dict[str, tuple[str, ...]] = {"support": (), "label": ("gaussian",), "object": ("gaussian",)}


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, concept, det_idx, score, area_frac, x1, y1, x2, y2 (exclusive), source."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    x1, y1 = (eid % 16) * 40, F.floor(eid / 16).cast("long") % 16 * 40
    return e.select(
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("frame_idx"),
        F.col("event_type").alias("concept"),
        eid.alias("det_idx"),
        (F.floor(F.least(F.col("value") / 100.0, F.lit(1.0)) * 10000.0 + 0.5) / 10000.0).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("area_frac"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 24 + uid % 8 * 8).alias("x2"),
        (y1 + 24 + F.floor(eid / 256).cast("long") % 8 * 8).alias("y2"),
        F.when(uid % 7 == 0, F.concat(F.lit("exemplar:"), F.col("event_type"))).otherwise(F.lit("text")).alias("source"),
    )


SQL["detection"] = """
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS frame_idx, event_type AS concept, event_id AS det_idx,
         floor(least(value / 100.0, 1.0) * 10000.0 + 0.5) / 10000.0 AS score,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS area_frac,
         event_id % 16 * 40 AS x1, (event_id // 16) % 16 * 40 AS y1,
         event_id % 16 * 40 + 24 + user_id % 8 * 8 AS x2, (event_id // 16) % 16 * 40 + 24 + (event_id // 256) % 8 * 8 AS y2,
         CASE WHEN user_id % 7 = 0 THEN 'exemplar:' || event_type ELSE 'text' END AS source
  FROM events"""


def gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, x, y (up), z, opacity, part: one point for each order line."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    return g.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("gid"),
        (F.col("p") * 7919 % 10007 / 1000.0).alias("x"),
        (F.col("l_orderkey") * 1047 % 10007 / 4000.0).alias("y"),
        ((F.col("s") * 613 + F.col("l_linenumber") * 97) % 10007 / 1000.0).alias("z"),
        (F.col("q") / 50.0).alias("opacity"),
        F.col("p").alias("part"),
    )


SQL["gaussian"] = """
  SELECT l_orderkey * 10 + l_linenumber AS gid, p * 7919 % 10007 / 1000.0::DOUBLE AS x, l_orderkey * 1047 % 10007 / 4000.0::DOUBLE AS y,
         (s * 613 + l_linenumber * 97) % 10007 / 1000.0::DOUBLE AS z, q / 50.0::DOUBLE AS opacity, p AS part
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, max(l_quantity) AS q
        FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

#: Intrinsics of every frame but those divisible by 7, which have a longer focal length.
CAMERA = {"width": 64, "height": 48, "fx": 40.0, "fy": 40.0, "cx": 32.0, "cy": 24.0, "near": 0.1}


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring poses without transcendental functions: frame_idx, c, s, px, py, pz, fx (nullable), quality columns.

    The camera stands at (px, py, pz), looks along (c, s) in the ground plane, and y is up.
    """
    t = (F.col("n_nationkey") - 12) / 4.0
    c, s = (1 - t * t) / (1 + t * t), 2 * t / (1 + t * t)
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("frame_idx"),
        c.alias("c"),
        s.alias("s"),
        (5.0 - 4.0 * c).alias("px"),
        F.lit(1.25).alias("py"),
        (5.0 - 4.0 * s).alias("pz"),
        F.when(n % 7 == 0, F.lit(48.0)).alias("fx"),
        (n * 37 % 100 / 100.0).alias("coverage"),
        (n * 53 % 100 / 10.0).alias("median_depth"),
        (n * 71 % 100 / 400.0).alias("rgb_std"),
        (n * 29 % 100 / 200.0).alias("near_alpha"),
        (n * 83 % 100 / 100.0).alias("sharpness"),
        F.when(n % 5 == 0, F.lit("manual")).otherwise(F.lit("auto")).alias("provenance"),
    )


SQL["frame"] = """
  SELECT n AS frame_idx, (1 - t * t) / (1 + t * t) AS c, 2 * t / (1 + t * t) AS s,
         5.0 - 4.0::DOUBLE * ((1 - t * t) / (1 + t * t)) AS px, 1.25::DOUBLE AS py, 5.0 - 4.0::DOUBLE * (2 * t / (1 + t * t)) AS pz,
         CASE WHEN n % 7 = 0 THEN 48.0::DOUBLE END AS fx, n * 37 % 100 / 100.0::DOUBLE AS coverage, n * 53 % 100 / 10.0::DOUBLE AS median_depth,
         n * 71 % 100 / 400.0::DOUBLE AS rgb_std, n * 29 % 100 / 200.0::DOUBLE AS near_alpha, n * 83 % 100 / 100.0::DOUBLE AS sharpness,
         CASE WHEN n % 5 = 0 THEN 'manual' ELSE 'auto' END AS provenance
  FROM (SELECT CAST(n_nationkey AS BIGINT) AS n, (n_nationkey - 12) / 4.0::DOUBLE AS t FROM nation)"""


def contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, gid, class_name, w: blending weights of points in views."""
    d = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select((F.year(d) * 12 + F.month(d)).cast("long").alias("frame_idx"), F.col("l_partkey").alias("gid"), F.concat("l_returnflag", "l_linestatus").alias("class_name"), F.col("l_extendedprice").alias("w"))


SQL["contribution"] = """
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS frame_idx, l_partkey AS gid,
         l_returnflag || l_linestatus AS class_name, l_extendedprice AS w FROM lineitem"""


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det, gid, class_id, frame_idx, f, g: points that a detection supports, f >= 0.5."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("det"), (F.col("l_partkey") % 2000).alias("gid")).agg((1.0 - 5.0 * F.max("l_discount")).alias("f"), F.max("l_extendedprice").alias("g"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("det"), (F.col("s_nationkey") % 5).cast("long").alias("class_id"))
    return li.filter("f >= 0.5").join(s, "det").select("det", "gid", "class_id", (F.col("det") % 10).alias("frame_idx"), "f", "g")


SQL["support"] = """
  SELECT det, gid, CAST(s_nationkey % 5 AS BIGINT) AS class_id, det % 10 AS frame_idx, f, g
  FROM (SELECT l_suppkey AS det, l_partkey % 2000 AS gid, 1.0 - 5.0::DOUBLE * max(l_discount) AS f, max(l_extendedprice) AS g
        FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = det WHERE f >= 0.5"""

#: Regions of interest: name, lower and upper corner.
BOXES = (("hall", (0.5, 0.0, 0.5), (4.0, 2.0, 5.0)), ("annex", (3.5, 0.2, 4.0), (8.0, 1.5, 9.5)), ("shelf", (7.0, 1.0, 0.0), (9.5, 2.5, 3.0)))


def boxes_sql(margin: float = 0.0) -> str:
    """The condition that a point lies in a box, as SQL."""
    return "(" + " OR ".join("(" + " AND ".join(f"{a} BETWEEN {lo - margin!r} AND {hi + margin!r}" for a, lo, hi in zip("xyz", low, high, strict=True)) + ")" for _, low, high in BOXES) + ")"


def instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gid, instance_id, x, y, z, opacity: points grouped into instances by their part number."""
    return gaussian(spark, sf_dir).withColumn("instance_id", F.col("part") % 40)


SQL["instance"] = "SELECT *, part % 40 AS instance_id FROM gaussian"
USES["instance"] = ("gaussian",)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in tracks: track_id, frame_idx, det_idx, concept, score, source, ambiguous."""
    d = detection(spark, sf_dir)
    return d.select((F.col("det_idx") % 60).alias("track_id"), "frame_idx", "det_idx", "concept", "score", "source", (F.col("det_idx") % 9 == 0).alias("ambiguous"), "x1", "y1", "x2", "y2")


SQL["track"] = "SELECT det_idx % 60 AS track_id, frame_idx, det_idx, concept, score, source, det_idx % 9 = 0 AS ambiguous, x1, y1, x2, y2 FROM detection"
USES["track"] = ("detection",)

WORDS = ("chair", "office chair", "lamp", "floor lamp", "table", "plants", "plant", "wall clock")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers on objects: object_idx, label, name, matches, choice, box_frac, confirms, has_reason, isolated."""
    k = F.col("c_custkey")
    word = lambda c: F.element_at(F.array(*map(F.lit, WORDS)), (c % 8 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        k.alias("object_idx"),
        word(k).alias("label"),
        F.when(k % 11 != 0, word(F.floor(k / 3).cast("long"))).alias("name"),
        F.when(k % 6 == 0, F.lit("yes")).when(k % 6 < 4, F.lit("no")).alias("says_match"),
        F.when(k % 5 == 0, F.lit("label")).when(k % 5 == 1, F.lit("name")).when(k % 5 == 2, F.lit("neither")).alias("choice"),
        (k * 31 % 100 / 100.0).alias("box_frac"),
        (k % 4).alias("n_confirm"),
        F.when(k % 9 == 0, F.lit("margin")).when(k % 13 == 0, F.lit("ambiguous")).alias("reason"),
    )


_WORD = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"
SQL["answers"] = f"""
  SELECT c_custkey AS object_idx, {_WORD}[c_custkey % 8 + 1] AS label,
         CASE WHEN c_custkey % 11 <> 0 THEN {_WORD}[(c_custkey // 3) % 8 + 1] END AS name,
         CASE WHEN c_custkey % 6 = 0 THEN 'yes' WHEN c_custkey % 6 < 4 THEN 'no' END AS says_match,
         CASE c_custkey % 5 WHEN 0 THEN 'label' WHEN 1 THEN 'name' WHEN 2 THEN 'neither' END AS choice,
         c_custkey * 31 % 100 / 100.0::DOUBLE AS box_frac, c_custkey % 4 AS n_confirm,
         CASE WHEN c_custkey % 9 = 0 THEN 'margin' WHEN c_custkey % 13 = 0 THEN 'ambiguous' END AS reason
  FROM customer"""

def gate_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal: seq, scene, gate (1 to 5), action (approve or demote)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("scene"), (F.col("event_id") * 7 % 5 + 1).alias("gate"), F.when(F.col("event_type") == "error", F.lit("demote")).otherwise(F.lit("approve")).alias("action"))


SQL["gate_event"] = "SELECT event_id AS seq, user_id % 20 AS scene, event_id * 7 % 5 + 1 AS gate, CASE WHEN event_type = 'error' THEN 'demote' ELSE 'approve' END AS action FROM events"
