"""Queries on projection, assignment and affinity."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import assignment as A
from strataform.operators import paths
from strataform.operators import projection as R
from strataform.operators import splitting as S
from strataform.plans import bindings as B
from strataform.plans.bindings import with_
from strataform.plans.query import query

SQL = B.SQL
SQL["posed"] = "SELECT * EXCLUDE (fx), coalesce(fx, 40.0)::DOUBLE AS fx, 40.0::DOUBLE AS fy, 32.0::DOUBLE AS cx, 24.0::DOUBLE AS cy, 64 AS width, 48 AS height FROM frame"
B.USES["posed"] = ("frame",)
SQL["projected"] = """SELECT frame_idx, gid, CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, depth FROM (SELECT *, trunc(fx * r / depth + cx) AS u, trunc(fy * down / depth + cy) AS v FROM (
  SELECT frame_idx, gid, fx, fy, cx, cy, width, height, (x - px) * c + (z - pz) * s AS depth, (z - pz) * c - (x - px) * s AS r, -(y - py) AS down FROM gaussian, posed) WHERE depth > 0.1)
  WHERE u >= 0 AND u < width AND v >= 0 AND v < height"""
B.USES["projected"] = ("posed", "gaussian")
SQL["seen"] = """SELECT p.* FROM projected p JOIN (SELECT frame_idx, u, v, min(depth) AS d FROM projected GROUP BY ALL) m ON p.frame_idx = m.frame_idx AND p.u = m.u AND p.v = m.v
  WHERE depth <= d * 1.05::DOUBLE + 0.2::DOUBLE"""
B.USES["seen"] = ("projected",)


def posed(s, d):
    return R.with_intrinsics(B.frame(s, d), B.CAMERA)


def projected(s, d):
    return R.project(B.gaussian(s, d), posed(s, d), 0.1)


def seen(s, d):
    p = projected(s, d)
    return R.visible(p, R.depth_map(p), 0.05, 0.2)


@query("P01_projection", with_("SELECT frame_idx, gid, u, v FROM projected", "projected"))
def p01(s, d):
    return projected(s, d).select("frame_idx", "gid", "u", "v")


@query("F07_in_image", with_("SELECT frame_idx, count(*) AS n FROM projected GROUP BY 1", "projected"))
def f07(s, d):
    return projected(s, d).groupBy("frame_idx").agg(F.count("*").alias("n"))


@query("F08_depth_visibility", with_("SELECT frame_idx, gid FROM seen", "seen"))
def f08(s, d):
    return seen(s, d).select("frame_idx", "gid")


@query("F09_min_population", with_("SELECT frame_idx, count(*) AS n FROM seen WHERE frame_idx IN (SELECT frame_idx FROM projected GROUP BY 1 HAVING count(*) >= 9000) GROUP BY 1", "seen"))
def f09(s, d):
    p = projected(s, d)
    return R.visible(p, R.depth_map(p), 0.05, 0.2, 9000).groupBy("frame_idx").agg(F.count("*").alias("n"))


@query("A13_coverage", with_("SELECT " + ", ".join(f"count(*) FILTER (WHERE n >= {k}) / count(*)::DOUBLE AS k{k}" for k in (1, 2, 3)) + " FROM (SELECT g.gid, count(s.gid) AS n FROM gaussian g LEFT JOIN seen s ON g.gid = s.gid GROUP BY 1)", "seen"))
def a13(s, d):
    return R.coverage(B.gaussian(s, d), seen(s, d))


@query("P02_intrinsics", with_("SELECT frame_idx, coalesce(fx, 40.0)::DOUBLE AS fx, 24.0::DOUBLE AS cy FROM frame", "frame"))
def p02(s, d):
    return R.with_intrinsics(B.frame(s, d), B.CAMERA).select("frame_idx", "fx", "cy")


@query("P03_fov_intrinsics", "SELECT floor(32 / tan(radians(70.0 / 2)) * 1e6 + 0.5) / 1e6 AS fx, 32.0::DOUBLE AS cx")
def p03(s, d):
    k = R.fov_intrinsics(64, 48, 70.0)
    return s.createDataFrame([(k["fx"], k["cx"])], "fx double, cx double").select((F.floor(F.col("fx") * 1e6 + 0.5) / 1e6).alias("fx"), "cx")


def quats(s, d):
    """Quaternions of length 1 about every axis, from the frames' exact cosines."""
    f = B.frame(s, d)
    n = F.sqrt(F.lit(1.0) + F.col("c") * F.col("c") + F.col("s") * F.col("s") + F.lit(4.0))
    return f.select("frame_idx", (F.lit(1.0) / n).alias("x"), (F.col("c") / n).alias("y"), (F.col("s") / n).alias("z"), (F.lit(2.0) / n).alias("w"))


SQL["quat"] = "SELECT frame_idx, 1.0::DOUBLE / n AS x, c / n AS y, s / n AS z, 2.0::DOUBLE / n AS w FROM (SELECT *, sqrt(1.0::DOUBLE + c * c + s * s + 4.0) AS n FROM frame)"
B.USES["quat"] = ("frame",)
_R6 = lambda e, n: f"floor(({e}) * 1e6 + 0.5) / 1e6 AS {n}"


def r6(c, n):
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(n)


@query("P04_quaternion_to_matrix", with_("SELECT frame_idx, " + ", ".join(_R6(e, f"m{k}") for k, e in enumerate(("1 - 2 * (y * y + z * z)", "2 * (x * y - z * w)", "2 * (x * z + y * w)", "2 * (x * y + z * w)", "1 - 2 * (x * x + z * z)", "2 * (y * z - x * w)", "2 * (x * z - y * w)", "2 * (y * z + x * w)", "1 - 2 * (x * x + y * y)"))) + " FROM quat", "quat"))
def p04(s, d):
    m = R.quaternion_to_matrix(*(F.col(k) for k in "xyzw"))
    return quats(s, d).select("frame_idx", *(r6(c, f"m{k}") for k, c in enumerate(m)))


@query("P05_matrix_to_quaternion", with_("SELECT frame_idx, " + ", ".join(_R6(k, k) for k in "xyzw") + " FROM quat", "quat"))
def p05(s, d):
    m = R.quaternion_to_matrix(*(F.col(k) for k in "xyzw"))
    rows = quats(s, d).select("frame_idx", *(c.alias(f"m{k}") for k, c in enumerate(m)))
    q = R.matrix_to_quaternion([F.col(f"m{k}") for k in range(9)])
    # the trace branch holds here, whose w is positive: the rotation comes back with its own signs
    return rows.select("frame_idx", *(r6(c, n) for c, n in zip(q, "xyzw", strict=True)))


@query("P06_pose_from_frame", with_("SELECT frame_idx, floor(2 * atan(48 / (2 * 40.0::DOUBLE)) * 1e6 + 0.5) / 1e6 AS fov, 64 / 48.0::DOUBLE AS aspect, px, py, pz FROM frame", "frame"))
def p06(s, d):
    f = R.with_intrinsics(B.frame(s, d), B.CAMERA)
    return f.select("frame_idx", r6(2 * F.atan(F.col("height") / (2 * F.col("fy"))), "fov"), (F.col("width") / F.col("height")).alias("aspect"), "px", "py", "pz")


@query("P07_look_at", with_("SELECT frame_idx, floor((5.0 - px) / n * 1e6 + 0.5) / 1e6 AS fx, floor((1.0 - py) / n * 1e6 + 0.5) / 1e6 AS fy, floor((5.0 - pz) / n * 1e6 + 0.5) / 1e6 AS fz, floor(-(5.0 - pz) / h * 1e6 + 0.5) / 1e6 AS rx, floor((5.0 - px) / h * 1e6 + 0.5) / 1e6 AS rz FROM (SELECT *, sqrt((5.0 - px) * (5.0 - px) + (1.0 - py) * (1.0 - py) + (5.0 - pz) * (5.0 - pz)) AS n, sqrt((5.0 - px) * (5.0 - px) + (5.0 - pz) * (5.0 - pz)) AS h FROM frame)", "frame"))
def p07(s, d):
    right, _, f = R.look_at([F.col(k) for k in ("px", "py", "pz")], [F.lit(5.0), F.lit(1.0), F.lit(5.0)])
    return B.frame(s, d).select("frame_idx", r6(f[0], "fx"), r6(f[1], "fy"), r6(f[2], "fz"), r6(right[0], "rx"), r6(right[2], "rz"))


@query("P08_ground_to_world", with_("SELECT gid, x, 0.25 - 1.0::DOUBLE * y AS wy, z FROM gaussian", "gaussian"))
def p08(s, d):
    return B.gaussian(s, d).select("gid", "x", (F.lit(0.25) - 1.0 * F.col("y")).alias("wy"), "z")


@query("P09_alignment", with_("SELECT gid, floor((0.8 * x - 0.6 * z) * 1e6 + 0.5) / 1e6 AS x, y, floor((0.6 * x + 0.8 * z) * 1e6 + 0.5) / 1e6 AS z FROM gaussian", "gaussian"))
def p09(s, d):
    m = [[0.8, 0.0, -0.6], [0.0, 1.0, 0.0], [0.6, 0.0, 0.8]]
    v = R.rotate(m, [F.col(a) for a in "xyz"])
    return B.gaussian(s, d).select("gid", r6(v[0], "x"), v[1].alias("y"), r6(v[2], "z"))


@query("P10_pose_to_file_frame", with_("SELECT frame_idx, floor((0.8 * px + 0.6 * pz) * 1e6 + 0.5) / 1e6 AS px, py, floor((0.8 * pz - 0.6 * px) * 1e6 + 0.5) / 1e6 AS pz FROM frame", "frame"))
def p10(s, d):
    v = R.rotate([[0.8, 0.0, 0.6], [0.0, 1.0, 0.0], [-0.6, 0.0, 0.8]], [F.col("px"), F.col("py"), F.col("pz")])
    return B.frame(s, d).select("frame_idx", r6(v[0], "px"), v[1].alias("py"), r6(v[2], "pz"))


_FAIL = "CASE WHEN NOT coverage >= 0.2 THEN 'coverage' WHEN NOT median_depth >= 1.5 THEN 'median_depth' WHEN NOT rgb_std >= 0.03 THEN 'rgb_std' WHEN NOT near_alpha <= 0.4 THEN 'near_alpha' WHEN NOT sharpness >= 0.1 THEN 'sharpness' END"


def checks():
    return [("coverage", F.col("coverage") >= 0.2), ("median_depth", F.col("median_depth") >= 1.5), ("rgb_std", F.col("rgb_std") >= 0.03), ("near_alpha", F.col("near_alpha") <= 0.4), ("sharpness", F.col("sharpness") >= 0.1)]


@query("F10_first_failure", with_(f"SELECT frame_idx, {_FAIL} AS reason FROM frame", "frame"))
def f10(s, d):
    return B.frame(s, d).select("frame_idx", R.first_failure(checks()).alias("reason"))


@query("A27_discard_diagnosis", with_(f"SELECT reason, count(*) AS n, list_sort(list(coverage))[CAST(count(*) // 2 AS INT) + 1] AS upper_median, max(coverage) AS closest FROM (SELECT *, {_FAIL} AS reason FROM frame) WHERE reason IS NOT NULL GROUP BY 1", "frame"))
def a27(s, d):
    r = B.frame(s, d).withColumn("reason", R.first_failure(checks())).filter("reason is not null")
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("coverage")).alias("v"), F.max("coverage").alias("closest")).select("reason", "n", F.element_at("v", F.floor(F.col("n") / 2).cast("int") + 1).alias("upper_median"), "closest")


SQL["pixel"] = "SELECT l_suppkey % 20 AS frame_idx, l_partkey % 40 AS u, l_orderkey % 30 AS v, max(l_quantity) / 50.0::DOUBLE AS grey, max(l_discount) * 10.0::DOUBLE AS alpha, max(l_tax) * 100.0::DOUBLE AS depth FROM lineitem GROUP BY 1, 2, 3"


def pixels(s, d):
    from strataform.session import table

    return table(s, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("frame_idx"), (F.col("l_partkey") % 40).alias("u"), (F.col("l_orderkey") % 30).alias("v")).agg((F.max("l_quantity") / 50.0).alias("grey"), (F.max("l_discount") * 10.0).alias("alpha"), (F.max("l_tax") * 100.0).alias("depth"))


_QUALITY = """SELECT frame_idx, count(*) FILTER (WHERE alpha > 0.5) / count(*)::DOUBLE AS coverage, quantile_cont(CASE WHEN alpha > 0.5 THEN depth END, 0.5) AS median_depth,
  floor(stddev_samp(grey) * 1e6 + 0.5) / 1e6 AS spread, floor(avg(CASE WHEN depth < 3 THEN alpha ELSE 0.0 END) * 1e6 + 0.5) / 1e6 AS near_alpha, floor((avg(du) + avg(dv)) * 1e6 + 0.5) / 1e6 AS sharpness
  FROM (SELECT *, abs(lead(grey) OVER (PARTITION BY frame_idx, v ORDER BY u) - 2 * grey + lag(grey) OVER (PARTITION BY frame_idx, v ORDER BY u)) AS du,
    abs(lead(grey) OVER (PARTITION BY frame_idx, u ORDER BY v) - 2 * grey + lag(grey) OVER (PARTITION BY frame_idx, u ORDER BY v)) AS dv FROM pixel) GROUP BY 1"""


@query("P16_frame_quality", with_(_QUALITY, "pixel"))
def p16(s, d):
    q = R.frame_quality(pixels(s, d), 3.0)
    return q.select("frame_idx", "coverage", "median_depth", r6(F.col("spread"), "spread"), r6(F.col("near_alpha"), "near_alpha"), r6(F.col("sharpness"), "sharpness"))


@query("W13_second_difference", with_("SELECT frame_idx, u, v, floor(abs(lead(grey) OVER (PARTITION BY frame_idx, v ORDER BY u) - 2 * grey + lag(grey) OVER (PARTITION BY frame_idx, v ORDER BY u)) * 1e6 + 0.5) / 1e6 AS du FROM pixel", "pixel"))
def w13(s, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("frame_idx", "v").orderBy("u")
    return pixels(s, d).select("frame_idx", "u", "v", r6(F.abs(F.lead("grey").over(w) - 2 * F.col("grey") + F.lag("grey").over(w)), "du"))


@query("F12_similar_pose", with_("SELECT a.frame_idx AS id, min(b.frame_idx) AS \"like\" FROM frame a JOIN frame b ON a.frame_idx <> b.frame_idx AND pow(a.px - b.px, 2) + pow(a.pz - b.pz, 2) < 1.0 AND a.c * b.c + a.s * b.s > 0.95 GROUP BY 1", "frame"))
def f12(s, d):
    f = B.frame(s, d).withColumnRenamed("frame_idx", "id")
    return R.similar_poses(f, f, 1.0, 0.95)


@query("J20_pose_similarity", with_("SELECT a.frame_idx AS id, min(b.frame_idx) AS \"like\" FROM frame a JOIN frame b ON b.provenance = 'manual' AND a.provenance = 'auto' AND a.frame_idx <> b.frame_idx AND pow(a.px - b.px, 2) + pow(a.pz - b.pz, 2) < 4.0 AND a.c * b.c + a.s * b.s > 0.9 GROUP BY 1", "frame"))
def j20(s, d):
    f = B.frame(s, d).withColumnRenamed("frame_idx", "id")
    return R.similar_poses(f.filter("provenance = 'auto'"), f.filter("provenance = 'manual'"), 2.0, 0.9)


@query("J14_pending_edits", with_("SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' ELSE 'edited' END AS change FROM (SELECT frame_idx AS id, px + CASE WHEN frame_idx % 4 = 0 THEN 0.5 ELSE 0.0 END AS px FROM frame WHERE frame_idx < 20) a FULL JOIN (SELECT frame_idx AS id, px FROM frame WHERE frame_idx >= 5) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR abs(a.px - b.px) > 1e-6", "frame"))
def j14(s, d):
    f = B.frame(s, d).select(F.col("frame_idx").alias("id"), "px")
    saved = f.filter("id < 20").withColumn("px", F.col("px") + F.when(F.col("id") % 4 == 0, 0.5).otherwise(0.0))
    return R.pose_changes(saved, f.filter("id >= 5"), ["px"])


SQL["seen_inst"] = "SELECT s.*, part % 40 AS instance_id FROM seen s JOIN gaussian g ON g.gid = s.gid"
B.USES["seen_inst"] = ("seen",)


def seen_inst(s, d):
    return seen(s, d).join(B.instance(s, d).select("gid", "instance_id"), "gid")


_BOXQ = ", ".join(f"quantile_cont({c}, {p}) AS {n}" for c, p, n in (("u", 0.03, "x1"), ("v", 0.03, "y1"), ("u", 0.97, "x2"), ("v", 0.97, "y2")))


@query("A33_projected_boxes", with_("SELECT instance_id, frame_idx, " + ", ".join(f"floor({k} * 1e4 + 0.5) / 1e4 AS {k}" for k in ("x1", "y1", "x2", "y2")) + f", n FROM (SELECT instance_id, frame_idx, {_BOXQ}, count(*) AS n FROM seen_inst GROUP BY 1, 2)", "seen_inst"))
def a33(s, d):
    b = R.projected_boxes(seen_inst(s, d))
    return b.select("instance_id", "frame_idx", *((F.floor(F.col(k) * 1e4 + 0.5) / 1e4).alias(k) for k in ("x1", "y1", "x2", "y2")), "n")


@query("W16_best_projections", with_("SELECT instance_id, frame_idx, n FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY n DESC, frame_idx) AS r FROM (SELECT instance_id, frame_idx, count(*) AS n FROM seen_inst GROUP BY 1, 2)) WHERE r <= 3", "seen_inst"))
def w16(s, d):
    from pyspark.sql.window import Window as W

    n = seen_inst(s, d).groupBy("instance_id", "frame_idx").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("instance_id").orderBy(F.desc("n"), "frame_idx"))).filter("r <= 3").drop("r")


@query("J12_point_in_mask", with_("""SELECT instance_id, det_idx, overlap, score FROM (SELECT *, row_number() OVER (PARTITION BY instance_id, frame_idx ORDER BY score DESC, det_idx) AS r FROM (
  SELECT p.instance_id, p.frame_idx, d.det_idx, d.score, count(*) FILTER (WHERE u * 10 >= x1 AND u * 10 < x2 AND v * 10 >= y1 AND v * 10 < y2) / count(*)::DOUBLE AS overlap FROM seen_inst p JOIN detection d ON p.frame_idx = d.frame_idx AND d.score >= 0.9 GROUP BY ALL) WHERE overlap >= 0.05) WHERE r = 1""", "seen_inst", "detection"))
def j12(s, d):
    from pyspark.sql.window import Window as W

    det = B.detection(s, d).filter("score >= 0.9").select("frame_idx", "det_idx", "score", "x1", "y1", "x2", "y2")
    inside = (F.col("u") * 10 >= F.col("x1")) & (F.col("u") * 10 < F.col("x2")) & (F.col("v") * 10 >= F.col("y1")) & (F.col("v") * 10 < F.col("y2"))
    m = seen_inst(s, d).join(det, "frame_idx").groupBy("instance_id", "frame_idx", "det_idx", "score").agg((F.count_if(inside) / F.count("*")).alias("overlap")).filter("overlap >= 0.05")
    return m.withColumn("r", F.row_number().over(W.partitionBy("instance_id", "frame_idx").orderBy(F.desc("score"), "det_idx"))).filter("r = 1").select("instance_id", "det_idx", "overlap", "score")


@query("P22_padded_crop", with_("SELECT det_idx, CAST(greatest(floor(x1 - greatest((x2 - x1) * 0.25, 24.0)), 0) AS BIGINT) AS cx1, CAST(greatest(floor(y1 - greatest((y2 - y1) * 0.25, 24.0)), 0) AS BIGINT) AS cy1, CAST(least(ceil(x2 + greatest((x2 - x1) * 0.25, 24.0)), 640) AS BIGINT) AS cx2, CAST(least(ceil(y2 + greatest((y2 - y1) * 0.25, 24.0)), 640) AS BIGINT) AS cy2 FROM detection", "detection"))
def p22(s, d):
    crop = R.padded_crop(*(F.col(k) for k in ("x1", "y1", "x2", "y2")), 640, 640)
    return B.detection(s, d).select("det_idx", *(c.alias(n) for c, n in zip(crop, ("cx1", "cy1", "cx2", "cy2"), strict=True)))


@query("P23_rectangle_iou", with_("+ p AS (SELECT det_idx, x1, y1, x2, y2, (det_idx * 3) % 500 AS a1, (det_idx * 3) % 500 + 90 AS a2 FROM detection) SELECT det_idx, floor(i / ((x2 - x1) * (y2 - y1) + 8100 - i)::DOUBLE * 1e6 + 0.5) / 1e6 AS iou FROM (SELECT *, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, a2) - greatest(y1, a1), 0) AS i FROM p)", "detection"))
def p23(s, d):
    a1 = F.col("det_idx") * 3 % 500
    return B.detection(s, d).select("det_idx", r6(R.iou([F.col(k) for k in ("x1", "y1", "x2", "y2")], [a1, a1, a1 + 90, a1 + 90]), "iou"))


@query("J23_box_disagreement", with_(f"SELECT instance_id, frame_idx FROM (SELECT b.instance_id, b.frame_idx, greatest(least(b.x2 * 10, 320) - greatest(b.x1 * 10, 160), 0) * greatest(least(b.y2 * 10, 320) - greatest(b.y1 * 10, 80), 0) AS i, (b.x2 - b.x1) * (b.y2 - b.y1) * 100 AS ar FROM (SELECT instance_id, frame_idx, {_BOXQ} FROM seen_inst GROUP BY 1, 2) b) WHERE CASE WHEN ar + 38400 - i > 0 THEN i / (ar + 38400 - i) ELSE 0 END < 0.2", "seen_inst"))
def j23(s, d):
    b = R.projected_boxes(seen_inst(s, d))
    return b.filter(R.iou([F.col(k) * 10 for k in ("x1", "y1", "x2", "y2")], [F.lit(160.0), F.lit(80.0), F.lit(320.0), F.lit(320.0)]) < 0.2).select("instance_id", "frame_idx")


@query("P21_focus_blend", with_("SELECT gid, floor(t * t * (3 - 2 * t) * 1e6 + 0.5) / 1e6 AS blend FROM (SELECT gid, least(greatest((d + 0.2) / 0.7, 0.0), 1.0) AS t FROM (SELECT gid, least(sqrt(pow(greatest(abs(x - 3.0) - 1.5, 0.0), 2) + pow(greatest(abs(z - 4.0) - 2.0, 0.0), 2)) + least(greatest(abs(x - 3.0) - 1.5, abs(z - 4.0) - 2.0), 0.0), sqrt(pow(greatest(abs(x - 7.0) - 1.0, 0.0), 2) + pow(greatest(abs(z - 7.0) - 1.0, 0.0), 2)) + least(greatest(abs(x - 7.0) - 1.0, abs(z - 7.0) - 1.0), 0.0)) AS d FROM gaussian))", "gaussian"))
def p21(s, d):
    dist = R.box_distance(F.col("x"), F.col("z"), [(3.0, 4.0, 1.5, 2.0, 0.0), (7.0, 7.0, 1.0, 1.0, 0.0)])
    return B.gaussian(s, d).select("gid", r6(R.smooth_step(dist, -0.2, 0.5), "blend"))


_PICK = """SELECT gid, floor(t * 1e6 + 0.5) / 1e6 AS t, floor(acc * 1e6 + 0.5) / 1e6 AS acc FROM (SELECT *, 1 - exp(sum(ln(1 - least(opacity * exp(-d2 / (2 * 0.35 * 0.35)), 0.999))) OVER (ORDER BY t, gid)) AS acc FROM (
  SELECT gid, opacity, (x - 0.5) * 0.6 + (z - 0.5) * 0.8 AS t, greatest((x - 0.5) * (x - 0.5) + (y - 1.2) * (y - 1.2) + (z - 0.5) * (z - 0.5) - pow((x - 0.5) * 0.6 + (z - 0.5) * 0.8, 2), 0.0) AS d2 FROM gaussian) WHERE t > {0} AND d2 < 0.35 * 0.35) WHERE acc >= 0.5 ORDER BY t, gid LIMIT 1"""


@query("I18_ray_pick", with_(_PICK.format("0"), "gaussian"))
def i18(s, d):
    return R.pick(B.gaussian(s, d), (0.5, 1.2, 0.5), (0.6, 0.0, 0.8), 0.35).select("gid", r6(F.col("t"), "t"), r6(F.col("acc"), "acc"))


@query("I19_label_occlusion", with_(f"+ k AS ({_PICK.format('0')}) SELECT instance_id, (SELECT t FROM k) < floor(dist * 1e6 + 0.5) / 1e6 - 0.5 AS hidden FROM (SELECT instance_id, sqrt(pow(avg(x) - 0.5, 2) + pow(avg(z) - 0.5, 2)) AS dist FROM instance GROUP BY 1)", "instance"))
def i19(s, d):
    k = i18(s, d).select("t")
    c = B.instance(s, d).groupBy("instance_id").agg(F.sqrt(F.pow(F.avg("x") - 0.5, 2) + F.pow(F.avg("z") - 0.5, 2)).alias("dist"))
    return c.crossJoin(k).select("instance_id", (F.col("t") < F.floor(F.col("dist") * 1e6 + 0.5) / 1e6 - 0.5).alias("hidden"))


KEPT = "frame_idx % 5 <> 0"
SQL["aw"] = f"SELECT gid, class_name, sum(CAST(w AS DECIMAL(18,2)))::DOUBLE AS a FROM contribution WHERE {KEPT} GROUP BY 1, 2"
SQL["tw"] = f"SELECT gid, sum(CAST(w AS DECIMAL(18,2)))::DOUBLE AS t FROM contribution WHERE {KEPT} GROUP BY 1"
SQL["best"] = "SELECT gid, class_name, a FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY a DESC, class_name) AS r FROM aw) WHERE r = 1"
B.USES |= {"aw": ("contribution",), "tw": ("contribution",), "best": ("aw",)}


def weights(s, d):
    c = B.contribution(s, d)
    return A.class_weights(c, c.select("frame_idx").filter(KEPT))


@query("A01_class_weights", with_("SELECT aw.gid, class_name, a, t FROM aw JOIN tw ON aw.gid = tw.gid", "aw", "tw"))
def a01(s, d):
    a, t = weights(s, d)
    return a.join(t, "gid").select("gid", "class_name", "a", "t")


@query("A02_class_union", with_("SELECT frame_idx, gid, class_name, max(w) AS w FROM contribution GROUP BY 1, 2, 3", "contribution"))
def a02(s, d):
    return B.contribution(s, d).groupBy("frame_idx", "gid", "class_name").agg(F.max("w").alias("w"))


@query("W01_best_class", with_("SELECT * FROM best", "best"))
def w01(s, d):
    return A.best_class(weights(s, d)[0])


@query("F16_background_test", with_("SELECT best.gid, CASE WHEN a > (CASE class_name WHEN 'AF' THEN 0.6::DOUBLE WHEN 'NO' THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END) * (t - a) THEN class_name END AS class_name FROM best JOIN tw ON best.gid = tw.gid", "best", "tw"))
def f16(s, d):
    a, t = weights(s, d)
    return A.labels(a, t, {"AF": 0.6, "NO": 0.9}, 0.75)


@query("F14_eligibility", with_(f"SELECT g.gid FROM gaussian g JOIN best b ON b.gid = g.part WHERE b.class_name = 'NO' AND opacity >= 0.3 AND {B.boxes_sql(0.2)}", "gaussian", "best"))
def f14(s, d):
    from strataform.operators.points import in_boxes

    own = A.best_class(weights(s, d)[0]).filter("class_name = 'NO'").select(F.col("gid").alias("part"))
    return B.gaussian(s, d).filter((F.col("opacity") >= 0.3) & in_boxes(B.BOXES, 0.2)).join(own, "part", "left_semi").select("gid")


@query("F15_support_rule", with_("+ g AS (SELECT frame_idx, gid, class_name AS det, max(w) AS g FROM contribution GROUP BY 1, 2, 3), tv AS (SELECT frame_idx, gid, sum(CAST(w AS DECIMAL(18,2)))::DOUBLE AS tv FROM contribution GROUP BY 1, 2) SELECT frame_idx, gid, det, floor(least(g / tv, 1.0) * 1e6 + 0.5) / 1e6 AS f FROM g JOIN tv USING (frame_idx, gid) WHERE least(g / tv, 1.0) >= 0.5", "contribution"))
def f15(s, d):
    c = B.contribution(s, d)
    g = c.groupBy("frame_idx", "gid", F.col("class_name").alias("det")).agg(F.max("w").alias("g"))
    tv = c.groupBy("frame_idx", "gid").agg(F.sum(F.col("w").cast("decimal(18,2)")).cast("double").alias("tv"))
    return A.supports(g, tv, 0.5).select("frame_idx", "gid", "det", r6(F.col("f"), "f"))


@query("A28_weight_histogram", with_("SELECT CAST(least(floor(f * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM support GROUP BY 1", "support"))
def a28(s, d):
    return B.support(s, d).groupBy(F.least(F.floor(F.col("f") * 50), F.lit(49)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


SQL["norms"] = "SELECT det, count(*) AS size, sqrt(sum(CAST(f * f AS DECIMAL(18,6)))::DOUBLE) AS norm FROM support GROUP BY 1"
B.USES["norms"] = ("support",)
SQL["aff"] = """SELECT class_id, lo, hi, dot / (a.norm * b.norm) AS cosine, shared / least(a.size, b.size)::DOUBLE AS ios FROM (
  SELECT x.class_id, x.det AS lo, y.det AS hi, sum(CAST(x.f * y.f AS DECIMAL(18,6)))::DOUBLE AS dot, count(*) AS shared FROM support x JOIN support y ON x.class_id = y.class_id AND x.gid = y.gid AND x.det < y.det GROUP BY ALL)
  JOIN norms a ON a.det = lo JOIN norms b ON b.det = hi"""
B.USES["aff"] = ("norms",)


@query("A15_support_norms", with_("SELECT det, size, floor(norm * 1e4 + 0.5) / 1e4 AS norm FROM norms", "norms"))
def a15(s, d):
    return A.support_norms(B.support(s, d)).select("det", "size", (F.floor(F.col("norm") * 1e4 + 0.5) / 1e4).alias("norm"))


@query("J06_affinity_cosine", with_("SELECT lo, hi, floor(cosine * 1e6 + 0.5) / 1e6 AS cosine FROM aff", "aff"))
def j06(s, d):
    return A.affinity(B.support(s, d)).select("lo", "hi", r6(F.col("cosine"), "cosine"))


@query("J07_support_ios", with_("SELECT lo, hi, floor(ios * 1e6 + 0.5) / 1e6 AS ios FROM aff", "aff"))
def j07(s, d):
    return A.affinity(B.support(s, d)).select("lo", "hi", r6(F.col("ios"), "ios"))


SQL["edge"] = "SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY cosine DESC, lo, hi) AS place FROM aff WHERE cosine >= 0.25 OR ios >= 0.26"
B.USES["edge"] = ("aff",)


@query("L02_edge_order", with_("SELECT class_id, lo, hi, place FROM edge", "edge"))
def l02(s, d):
    return A.edges(A.affinity(B.support(s, d)), 0.25, 0.26).select("class_id", "lo", "hi", "place")


@query("A29_affinity_histogram", with_("SELECT CASE WHEN lo % 10 = hi % 10 THEN 'same view' ELSE 'cross view' END AS kind, CAST(least(floor(ios * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM aff GROUP BY 1, 2", "aff"))
def a29(s, d):
    p = A.affinity(B.support(s, d)).withColumn("kind", F.when(F.col("lo") % 10 == F.col("hi") % 10, "same view").otherwise("cross view"))
    return A.histogram_by_kind(p, "ios", 20)


SQL["tracks"] = "SELECT DISTINCT det, det % 7 AS track FROM support"
B.USES["tracks"] = ("support",)
SQL["tscore"] = "SELECT gid, track, sum(CAST(g AS DECIMAL(18,2)))::DOUBLE AS score FROM (SELECT gid, track, frame_idx, max(g) AS g FROM support s JOIN tracks t ON s.det = t.det GROUP BY 1, 2, 3) GROUP BY 1, 2"
B.USES["tscore"] = ("tracks",)


def tracks(s, d):
    return B.support(s, d).select("det", (F.col("det") % 7).alias("track")).distinct()


@query("A16_track_score", with_("SELECT * FROM tscore", "tscore"))
def a16(s, d):
    return A.track_scores(B.support(s, d), tracks(s, d))


@query("W02_best_track", with_("SELECT gid, track, best, coalesce(second, 0) AS second, floor((best - coalesce(second, 0)) * 100 + 0.5) / 100 AS margin, best - coalesce(second, 0) = 0 AS tie, best - coalesce(second, 0) < 0.1::DOUBLE * best AS low FROM (SELECT gid, max(CASE WHEN r = 1 THEN track END) AS track, max(CASE WHEN r = 1 THEN score END) AS best, max(CASE WHEN r = 2 THEN score END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, track) AS r FROM tscore) GROUP BY 1)", "tscore"))
def w02(s, d):
    return A.best_track(A.track_scores(B.support(s, d), tracks(s, d)))


SQL["fcl"] = "SELECT DISTINCT a.class_id, a.det AS lo, b.det AS hi FROM (SELECT DISTINCT class_id, frame_idx, det FROM support) a JOIN (SELECT DISTINCT class_id, frame_idx, det FROM support) b ON a.class_id = b.class_id AND a.frame_idx = b.frame_idx AND a.det < b.det"
B.USES["fcl"] = ("support",)


@query("J08_ambiguity", with_("+ pair2 AS (SELECT lo AS d, hi AS e FROM aff WHERE ios >= 0.27 UNION ALL SELECT hi, lo FROM aff WHERE ios >= 0.27), forb AS (SELECT lo AS p, hi AS q FROM fcl UNION ALL SELECT hi, lo FROM fcl) SELECT DISTINCT a.d AS det FROM pair2 a JOIN forb f ON f.p = a.e JOIN pair2 b ON b.d = a.d AND b.e = f.q WHERE a.d % 7 = a.e % 7 AND b.e % 7 <> a.d % 7", "aff", "fcl"))
def j08(s, d):
    sup = B.support(s, d)
    return A.ambiguous(A.affinity(sup), tracks(s, d), A.frame_cannot_link(sup), 0.27)


SQL["assigned"] = "SELECT gid, track FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY score DESC, track) AS r FROM tscore) WHERE r = 1"
B.USES["assigned"] = ("tscore",)


@query("J09_conflicting_support", with_("+ held AS (SELECT s.det, track AS instance, count(*) AS n FROM support s JOIN assigned a ON a.gid = s.gid GROUP BY 1, 2 HAVING count(*) >= 60) SELECT a.instance, f.lo, f.hi FROM fcl f JOIN held a ON a.det = f.lo JOIN held b ON b.det = f.hi AND a.instance = b.instance", "assigned", "fcl"))
def j09(s, d):
    sup = B.support(s, d)
    best = A.best_track(A.track_scores(sup, tracks(s, d)))
    return A.conflicting_support(sup, best, A.frame_cannot_link(sup), 60)


@query("J10_distinctness", with_("+ m AS (SELECT part, frame_idx, mask FROM (SELECT *, row_number() OVER (PARTITION BY part, frame_idx ORDER BY n DESC, mask) AS r FROM (SELECT gid % 12 AS part, frame_idx, det AS mask, count(*) AS n FROM support GROUP BY 1, 2, 3)) WHERE r = 1) SELECT a.part AS a, b.part AS b, count(*) FILTER (WHERE a.mask <> b.mask) AS votes, count(*) AS checked, count(*) FILTER (WHERE a.mask <> b.mask) >= 8 OR 2 * count(*) FILTER (WHERE a.mask <> b.mask) >= count(*) AS \"distinct\" FROM m a JOIN m b ON a.frame_idx = b.frame_idx AND a.part < b.part GROUP BY 1, 2", "support"))
def j10(s, d):
    m = A.dominant_masks(B.support(s, d).select((F.col("gid") % 12).alias("part"), "frame_idx", F.col("det").alias("mask")))
    a = m.select(F.col("part").alias("a"), "frame_idx", F.col("mask").alias("ma"))
    b = m.select(F.col("part").alias("b"), "frame_idx", F.col("mask").alias("mb"))
    return A.distinctness(a.join(b, "frame_idx").filter("a < b").select("a", "b", "frame_idx", (F.col("ma") != F.col("mb")).alias("vote")), 8)


SQL["bounds"] = "SELECT part % 4 AS class_id, part % 500 AS part, " + ", ".join(f"min({k}) AS {k}0, max({k}) AS {k}1, sum(CAST({k} AS DECIMAL(18,6)))::DOUBLE / count(*) AS {k}m" for k in "xyz") + " FROM gaussian GROUP BY 1, 2"
B.USES["bounds"] = ("gaussian",)
_VOL = lambda p: f"({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0) * ({p}.z1 - {p}.z0)"
_DIAG = lambda p: f"sqrt(pow({p}.x1 - {p}.x0, 2) + pow({p}.y1 - {p}.y0, 2) + pow({p}.z1 - {p}.z0, 2))"


def stacked(s, d):
    points = B.gaussian(s, d).select((F.col("part") % 4).alias("class_id"), (F.col("part") % 500).alias("part"), "gid", "x", "y", "z")
    limits = S.Evidence(None, None, None, min_ios=0.8, near=0.1)
    return limits.stacked(limits.near_pairs(points), points).filter("stacked")


@query("J11_merge_candidates", with_("SELECT class_id, a, b, floor(ios * 1e6 + 0.5) / 1e6 AS ios, floor(dist * 1e6 + 0.5) / 1e6 AS dist FROM (SELECT a.class_id, a.part AS a, b.part AS b, " + " * ".join(f"greatest(least(a.{k}1, b.{k}1) - greatest(a.{k}0, b.{k}0), 0.0)" for k in "xyz") + f" / greatest(least({_VOL('a')}, {_VOL('b')}), 1e-9) AS ios, sqrt(" + " + ".join(f"pow(a.{k}m - b.{k}m, 2)" for k in "xyz") + f") AS dist, least({_DIAG('a')}, {_DIAG('b')}) AS d0, greatest({_DIAG('a')}, {_DIAG('b')}) AS d1 FROM bounds a JOIN bounds b ON a.class_id = b.class_id AND a.part < b.part) WHERE (ios >= 0.8 OR dist <= 0.1 * d0) AND dist <= 0.1 * d1", "bounds"))
def j11(s, d):
    return stacked(s, d).select("class_id", "a", "b", r6(F.col("ios"), "ios"), r6(F.col("dist"), "dist"))


@query("J18_nearest_fill", with_("+ p AS (SELECT part % 200 AS comp, gid, CASE WHEN gid % 9 = 0 THEN part % 3 END AS seed, x, y, z FROM gaussian) SELECT comp, gid, seed FROM p WHERE seed IS NOT NULL UNION ALL SELECT comp, gid, seed FROM (SELECT a.comp, a.gid, b.seed, row_number() OVER (PARTITION BY a.comp, a.gid ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), b.gid) AS r FROM p a JOIN p b ON a.comp = b.comp AND a.seed IS NULL AND b.seed IS NOT NULL) WHERE r = 1", "gaussian"))
def j18(s, d):
    p = B.gaussian(s, d).select((F.col("part") % 200).alias("comp"), "gid", F.when(F.col("gid") % 9 == 0, F.col("part") % 3).alias("seed"), "x", "y", "z")
    return A.nearest_fill(p, ["comp"])


@query("J19_aimed_cameras", with_("+ t AS (SELECT part AS target, min(x) AS x, min(z) AS z FROM gaussian GROUP BY 1), f AS (SELECT frame_idx AS pos, px, pz FROM frame) SELECT target, pos FROM (SELECT target, pos, row_number() OVER (PARTITION BY target ORDER BY abs(d - 2.5), pos) AS r FROM (SELECT target, pos, sqrt((x - px) * (x - px) + (z - pz) * (z - pz)) AS d FROM t, f) WHERE d > 1.0) WHERE r = 1", "gaussian", "frame"))
def j19(s, d):
    t = B.gaussian(s, d).groupBy(F.col("part").alias("target")).agg(F.min("x").alias("x"), F.min("z").alias("z"))
    return paths.aimed(t, B.frame(s, d).select(F.col("frame_idx").alias("pos"), "px", "pz"), 1.0, 2.5).select("target", "pos")


@query("F22_class_budget", "SELECT CAST(floor((24e9 - 2e9) / (12.0 * count(*))) AS BIGINT) AS classes FROM lineitem")
def f22(s, d):
    from strataform.functions.config import class_capacity
    from strataform.session import table

    return s.createDataFrame([(class_capacity(table(s, d, "lineitem").count(), 24e9, 2e9),)], "classes long")
