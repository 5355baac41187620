"""Queries on clustering and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import affinities as X
from strataform.operators import assignment as A
from strataform.operators import clustering as C
from strataform.operators import objects as O
from strataform.operators import splitting as S
from strataform.plans import bindings as B
from strataform.plans import q_assignment as QA
from strataform.plans import q_points as QP
from strataform.plans.bindings import with_
from strataform.plans.q_points import r6
from strataform.plans.query import query
from strataform.session import materialize

SQL = B.SQL
KEY = 1 << 20
#: Voxels so small that the scene falls into many components.
VOXEL = 0.06


def _closure(voxels: str, near: str, key: str = "", on: str = "") -> str:
    """SQL of components as (key, node, component): `voxels` has key and node, `near` the pairs (key, a, b) of touching ones."""
    k, j = (f"{key}, ", f"r.{key} = e.{key} AND ") if key else ("", "")
    return f"e AS MATERIALIZED ({near}), r AS (SELECT {k}node AS a, node AS b FROM ({voxels}) UNION SELECT {'r.' + k if key else ''}r.a, e.b FROM r JOIN e ON {j}r.b = e.a), c AS MATERIALIZED (SELECT {k}a AS node, min(b) AS component FROM r GROUP BY ALL)"


_MOVES = "SELECT a, b, c FROM range(-1, 2) t(a), range(-1, 2) u(b), range(-1, 2) w(c) WHERE NOT (a = 0 AND b = 0 AND c = 0)"
_NODE = f"CAST((CAST(vx AS BIGINT) + {KEY // 2}) * {KEY} + CAST(vy AS BIGINT) + {KEY // 2} AS HUGEINT) * {KEY} + CAST(vz AS BIGINT) + {KEY // 2}"
_V = lambda extra="": f"SELECT DISTINCT {extra}floor(x / {VOXEL}::DOUBLE) AS vx, floor(y / {VOXEL}::DOUBLE) AS vy, floor(z / {VOXEL}::DOUBLE) AS vz FROM gaussian"
_AT = f"k.vx = floor(x / {VOXEL}::DOUBLE) AND k.vy = floor(y / {VOXEL}::DOUBLE) AND k.vz = floor(z / {VOXEL}::DOUBLE)"


@query("I01_voxel_components", with_(f"""+ m AS ({_MOVES}), k AS MATERIALIZED (SELECT *, {_NODE} AS node FROM ({_V()})),
  {_closure("SELECT node FROM k", "SELECT x.node AS a, y.node AS b FROM k x CROSS JOIN m JOIN k y ON y.vx = x.vx + m.a AND y.vy = x.vy + m.b AND y.vz = x.vz + m.c")}
  SELECT gid, CAST(dense_rank() OVER (ORDER BY component) AS BIGINT) AS component FROM gaussian JOIN k ON {_AT} JOIN c ON c.node = k.node""", "gaussian", recursive=True))
def i01(s, d):
    from pyspark.sql.window import Window as W

    p = materialize(s, C.voxel_components(B.gaussian(s, d), VOXEL), "voxels")
    # ranks over the components, each a row, not over the points
    place = p.select("component").distinct().select("component", F.row_number().over(W.orderBy("component")).cast("long").alias("place"))
    return p.join(place, "component").select("gid", F.col("place").alias("component"))


@query("I02_fragment_drop", with_(f"""+ m AS ({_MOVES}), k AS MATERIALIZED (SELECT *, {_NODE} AS node FROM ({_V("part % 2 AS cls, ")})),
  {_closure("SELECT cls, node FROM k", "SELECT x.cls, x.node AS a, y.node AS b FROM k x CROSS JOIN m JOIN k y ON y.cls = x.cls AND y.vx = x.vx + m.a AND y.vy = x.vy + m.b AND y.vz = x.vz + m.c", "cls")},
  p AS (SELECT part % 2 AS cls, gid, component, count(*) OVER (PARTITION BY part % 2, component) AS n FROM gaussian JOIN k ON k.cls = part % 2 AND {_AT} JOIN c ON c.cls = k.cls AND c.node = k.node)
  SELECT cls, gid FROM p WHERE n >= 5""", "gaussian", recursive=True))
def i02(s, d):
    p = C.voxel_components(B.gaussian(s, d).withColumn("cls", F.col("part") % 2), VOXEL, ["cls"])
    return C.without_fragments(materialize(s, p, "voxels"), ["cls"], 5).select("cls", "gid")


def _grid_components(limit: float, diagonal: bool) -> str:
    near = "greatest(abs(a), abs(b)) = 1" if diagonal else "abs(a) + abs(b) = 1"
    return f"""+ k AS MATERIALIZED (SELECT i, j, i * 1000 + j AS node FROM fcells WHERE density >= {limit}),
  {_closure("SELECT node FROM k", f"SELECT x.node AS a, y.node AS b FROM k x, off JOIN k y ON y.i = x.i + off.a AND y.j = x.j + off.b WHERE {near}")},
  g AS (SELECT component, count(*) AS n, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM k JOIN c ON c.node = k.node GROUP BY 1)"""


@query("I12_volume_proposal", with_(f"{_grid_components(3.4, False)} SELECT n, i0, i1, j0, j1 FROM g WHERE n >= (SELECT max(n) FROM g) * 0.2", "fcells", "off", recursive=True))
def i12(s, d):
    cells = QP.fcells(s, d).filter("density >= 3.4").select("i", "j")
    return C.component_boxes(C.grid_components(cells), 0.2).drop("component")


@query("I13_furniture_pieces", with_(f"{_grid_components(4.5, True)} SELECT n, i0, j0 FROM g", "fcells", "off", recursive=True))
def i13(s, d):
    p = C.grid_components(QP.busy(s, d), diagonal=True)
    return p.groupBy("component").agg(F.count("*").alias("n"), F.min("i").alias("i0"), F.min("j").alias("j0")).drop("component")


@query("I06_constrained_clustering")
def i06(s, d):
    return X.constrained_edges(B.support(s, d), 0.25, 0.26)


@query("W07_track_numbers")
def w07(s, d):
    t = C.numbered(X.constrained_groups(B.support(s, d), 0.25, 0.26))
    big = t.groupBy("class_id", "track").count().filter("count >= 2")
    return C.renumbered(t, big)


@query("A30_track_readouts")
def a30(s, d):
    sup = B.support(s, d)
    pairs = materialize(s, A.affinity(sup), "affinity")
    merged = C.constrained(A.edges(pairs, 0.25, 0.26), A.frame_cannot_link(sup))
    return C.track_readouts(pairs, C.tracks(sup.select("class_id", "det").distinct(), merged))


def _cover_sql(want: int, rounds: int) -> str:
    """Greedy set cover over `seen` as a chain of tables, one a round."""
    out = ["s AS MATERIALIZED (SELECT DISTINCT frame_idx, gid FROM seen)", "p0 AS (SELECT NULL::BIGINT AS frame_idx, NULL::BIGINT AS rank, NULL::DOUBLE AS gain WHERE false)"]
    for k in range(rounds):
        out.append(f"n{k} AS MATERIALIZED (SELECT gid, count(*) AS n FROM s JOIN p{k} USING (frame_idx) GROUP BY 1)")
        out.append(f"g{k} AS MATERIALIZED (SELECT s.frame_idx, count(*) FILTER (WHERE coalesce(n, 0) = {want - 1}) AS fl, count(*) FILTER (WHERE coalesce(n, 0) < {want - 1}) AS pt FROM s LEFT JOIN n{k} USING (gid) WHERE s.frame_idx NOT IN (SELECT frame_idx FROM p{k}) GROUP BY 1)")
        out.append(f"b{k} AS MATERIALIZED (SELECT frame_idx, {k} AS rank, floor((fl + 0.5::DOUBLE * pt + 0.001::DOUBLE * sharpness) * 1e6 + 0.5) / 1e6 AS gain FROM g{k} JOIN frame USING (frame_idx) WHERE fl + pt > 0 ORDER BY fl + 0.5::DOUBLE * pt + 0.001::DOUBLE * sharpness DESC, frame_idx LIMIT 1)")
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT * FROM b{k})")
    return "+ " + ", ".join(out) + f" SELECT rank, frame_idx, gain FROM p{rounds}"


@query("I03_set_cover", with_(_cover_sql(3, 5), "seen", "frame"))
def i03(s, d):
    return C.set_cover(s, QA.seen(s, d), B.frame(s, d).select("frame_idx", "sharpness"), 3, 5).select("rank", "frame_idx", r6(F.col("gain"), "gain"))


@query("W08_view_ranks", with_(_cover_sql(2, 8), "seen", "frame"))
def w08(s, d):
    return C.set_cover(s, QA.seen(s, d), B.frame(s, d).select("frame_idx", "sharpness"), 2, 8).select("rank", "frame_idx", r6(F.col("gain"), "gain"))


def _farthest_sql(cells: str, k: int) -> str:
    out = [f"p0 AS (SELECT 0 AS rank, i, j FROM {cells} ORDER BY i, j LIMIT 1)"]
    for r in range(1, k):
        out.append(f"b{r} AS MATERIALIZED (SELECT b.i, b.j, min(pow(b.i - p.i, 2) + pow(b.j - p.j, 2)) AS d FROM {cells} b, p{r - 1} p GROUP BY 1, 2)")
        out.append(f"p{r} AS MATERIALIZED (SELECT * FROM p{r - 1} UNION ALL SELECT * FROM (SELECT {r}, i, j FROM b{r} WHERE d > 0 ORDER BY d DESC, i, j LIMIT 1))")
    return "+ " + ", ".join(out) + f" SELECT * FROM p{k - 1}"


@query("I04_farthest_points", with_(_farthest_sql("busy", 6), "busy"))
def i04(s, d):
    return C.farthest(QP.busy(s, d), 6)


_LIKE = "pow(q.px - p.px, 2) + pow(q.pz - p.pz, 2) < 1.5 * 1.5 AND p.c * q.c + p.s * q.s > 0.9"


@query("I05_diverse_poses", with_(f"""+ o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY frame_idx) AS k FROM frame), r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept
  UNION ALL SELECT r.k + 1, CASE WHEN EXISTS (SELECT 1 FROM frame q WHERE list_contains(r.kept, q.frame_idx) AND {_LIKE}) THEN r.kept ELSE list_append(r.kept, p.frame_idx) END FROM r JOIN o p ON p.k = r.k + 1)
  SELECT unnest(kept) AS id FROM (SELECT kept FROM r ORDER BY k DESC LIMIT 1)""", "frame", recursive=True))
def i05(s, d):
    return C.keep_diverse(B.frame(s, d).withColumnRenamed("frame_idx", "id"), 1.5, 0.9)


def _yaw_sql(most: int) -> str:
    """Greedy picks are the best of what no earlier pick rules out: a table a pick."""
    out = ["w AS MATERIALIZED (SELECT det_idx % 25 AS pos, det_idx % 36 AS yaw, max(score) AS score FROM detection GROUP BY 1, 2)", "p0 AS (SELECT pos, yaw FROM w WHERE false)"]
    for k in range(most):
        free = f"NOT EXISTS (SELECT 1 FROM p{k} p WHERE p.pos = w.pos AND least(abs(p.yaw - w.yaw), 36 - abs(p.yaw - w.yaw)) < 5)"
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT * FROM p{k} UNION ALL SELECT pos, yaw FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, yaw) AS r FROM w WHERE {free}) WHERE r = 1)")
    return "+ " + ", ".join(out) + f" SELECT pos, yaw FROM p{most}"


@query("L09_yaw_picks", with_(_yaw_sql(4), "detection"))
def l09(s, d):
    rows = B.detection(s, d).select((F.col("det_idx") % 36).alias("yaw"), (F.col("det_idx") % 25).alias("pos"), "score").groupBy("pos", "yaw").agg(F.max("score").alias("score"))
    return C.spread_picks(rows, ["pos"], 4, 5, 36)


def scene_parts(s, d):
    """Points in parts of classes, what detections say of them, and the views that show several detections of a class."""
    sup = B.support(s, d)
    at = B.gaussian(s, d).groupBy((F.col("part") % 2000).alias("gid")).agg(*(F.min_by(a, "gid").alias(a) for a in "xyz"))
    points = sup.select("class_id", "gid").distinct().join(at, "gid").select("class_id", (F.floor(F.col("x") / 5) + 2 * F.floor(F.col("z") / 5)).cast("long").alias("part"), "gid", "x", "y", "z")
    several = sup.select("class_id", "frame_idx", "det").distinct().groupBy("class_id", "frame_idx").count().filter("count >= 2").select("class_id", "frame_idx")
    hits = sup.join(several, ["class_id", "frame_idx"]).select("class_id", "frame_idx", F.col("det").alias("mask"), "gid")
    none = s.createDataFrame([], "class_id long, frame_idx long, mask long, other long, iou double")
    limits = S.Evidence(hits.select("class_id", "frame_idx", "gid").distinct(), hits, none, min_visible=5, min_frac=0.2, quorum=2, near=0.5)
    bands = [F.sum(F.when(F.col("det") % 4 == k, F.col("f")).otherwise(0.0)).alias(f"f{k}") for k in range(4)]
    return materialize(s, points, "scene_parts"), sup.groupBy("class_id", "gid").agg(*bands), limits


@query("I07_same_class_merge")
def i07(s, d):
    points, _, limits = scene_parts(s, d)
    return S.same_class_merge(points, limits)[1].select("class_id", "a", "b", "result")


@query("I08_correspondence_split")
def i08(s, d):
    points, _, limits = scene_parts(s, d)
    return S.correspondence_split(points, S.by_coordinates, limits, 20)[1]


@query("I09_forced_split")
def i09(s, d):
    points, features, limits = scene_parts(s, d)
    want = points.groupBy("class_id").agg((F.count_distinct("part") + 2).alias("expected"))
    return S.forced_split(points, want, S.by_evidence(features, ["f0", "f1", "f2", "f3"]), limits, 20)[1]


@query("I10_two_means")
def i10(s, d):
    points = B.instance(s, d).select((F.col("instance_id") % 4).alias("class_id"), F.col("instance_id").alias("part"), "gid", "x", "y", "z")
    return S.by_coordinates(points)


@query("I11_evidence_bisect")
def i11(s, d):
    points, features, _ = scene_parts(s, d)
    return S.evidence_bisect(points, features, ["f0", "f1", "f2", "f3"])


_G = ", ".join(f"floor(sum(CAST(opacity * {a} AS DECIMAL(18,6)))::DOUBLE / sum(CAST(opacity AS DECIMAL(18,6)))::DOUBLE * 1e4 + 0.5) / 1e4 AS c{a}" for a in "xyz") + ", " + ", ".join(f"{f}({a}) AS {a}{k}" for a in "xyz" for k, f in ((0, "min"), (1, "max")))


@query("A18_object_geometry", with_(f"SELECT instance_id, count(*) AS n, {_G}, floor(sum(CAST(opacity AS DECIMAL(18,6)))::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS mean_opacity FROM instance GROUP BY 1", "instance"))
def a18(s, d):
    return O.geometry(B.instance(s, d))


@query("A19_oriented_boxes")
def a19(s, d):
    return C.oriented_boxes(B.instance(s, d), "instance_id").drop("axes")


SQL["tframe"] = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY score DESC, det_idx) AS r FROM track WHERE NOT ambiguous) WHERE r = 1"
B.USES["tframe"] = ("track",)


def tframe(s, d):
    return O.track_frames(B.track(s, d))


@query("W03_track_frames", with_("SELECT track_id, frame_idx, det_idx, score FROM tframe", "tframe"))
def w03(s, d):
    return tframe(s, d).select("track_id", "frame_idx", "det_idx", "score")


@query("W04_frames_by_score", with_("SELECT track_id, frame_idx, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx) AS place FROM tframe", "tframe"))
def w04(s, d):
    return O.ordered_frames(tframe(s, d)).select("track_id", "frame_idx", "place")


@query("A20_confidence", with_("SELECT t.track_id, coalesce(floor(s / n * 1e4 + 0.5) / 1e4, 0.0) AS confidence FROM (SELECT DISTINCT track_id FROM track) t LEFT JOIN (SELECT track_id, sum(CAST(score AS DECIMAL(18,4)))::DOUBLE AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx) AS p FROM tframe) WHERE p <= 3 GROUP BY 1) f ON f.track_id = t.track_id", "tframe"))
def a20(s, d):
    return O.confidence(B.track(s, d), tframe(s, d), 3)


@query("A21_frames_by_source", with_("SELECT track_id, count(*) FILTER (WHERE source LIKE 'exemplar:%') AS exemplar, count(*) FILTER (WHERE source NOT LIKE 'exemplar:%') AS text FROM tframe GROUP BY 1", "tframe"))
def a21(s, d):
    m = O.source_counts(tframe(s, d))
    g = lambda k: F.coalesce(F.try_element_at("frames_by_channel", F.lit(k)), F.lit(0)).alias(k)
    return m.select("track_id", g("exemplar"), g("text"))


@query("F18_export_floor", with_("SELECT track_id, count(*) AS n_frames, count(*) >= 28 AS exported FROM tframe GROUP BY 1", "tframe"))
def f18(s, d):
    return O.export_floor(tframe(s, d), 28)


SQL["hold"] = "SELECT track_id, count(*) FILTER (WHERE ambiguous) / count(*)::DOUBLE AS fa, count(*) FILTER (WHERE score < 0.2) / count(*)::DOUBLE AS fl, count(*) FILTER (WHERE det_idx % 997 = 0) AS refused FROM track GROUP BY 1"
B.USES["hold"] = ("track",)


def held(s, d):
    t = B.track(s, d).groupBy("track_id").agg((F.count_if("ambiguous") / F.count("*")).alias("fa"), (F.count_if(F.col("score") < 0.2) / F.count("*")).alias("fl"), F.count_if(F.col("det_idx") % 997 == 0).alias("refused"))
    return t.withColumn("hold_reasons", O.hold_reasons(F.col("fa"), F.col("fl"), F.col("refused"), 0.2))


_HOLD = "concat_ws(',', CASE WHEN fa > 0.2 THEN 'ambiguous_support' END, CASE WHEN fl > 0.2 THEN 'low_margin' END, CASE WHEN refused > 0 THEN 'refused_bridge' END)"


@query("F19_hold_reasons", with_(f"SELECT track_id, {_HOLD} AS reasons FROM hold", "hold"))
def f19(s, d):
    return held(s, d).select("track_id", F.concat_ws(",", "hold_reasons").alias("reasons"))


@query("A22_held_by_reason", with_(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_HOLD}, ',')) AS reason FROM hold) WHERE reason <> '' GROUP BY 1", "hold"))
def a22(s, d):
    return O.held_counts(held(s, d))


@query("A26_provenance", with_("SELECT track_id, CASE WHEN bool_and(provenance = 'manual') THEN 'manual' WHEN bool_or(provenance = 'manual') THEN 'mixed' ELSE 'auto' END AS views, CASE WHEN bool_and(source LIKE 'exemplar:%') THEN 'exemplar' WHEN bool_or(source LIKE 'exemplar:%') THEN 'mixed' ELSE 'text' END AS sources FROM tframe JOIN frame USING (frame_idx) GROUP BY 1", "tframe", "frame"))
def a26(s, d):
    return O.provenance(tframe(s, d), B.frame(s, d).select("frame_idx", "provenance"))


@query("J13_lookup_refusals", with_("SELECT DISTINCT track_id AS id, 'track without points' AS what FROM track WHERE track_id NOT IN (SELECT instance_id FROM instance) UNION SELECT DISTINCT instance_id, 'points without a track' FROM instance WHERE instance_id NOT IN (SELECT track_id FROM track)", "track", "instance"))
def j13(s, d):
    return O.lookup_refusals(B.track(s, d), B.instance(s, d))


@query("K07_object_documents", with_("SELECT t.track_id, label, len(f) AS n_frames, confidence FROM (SELECT track_id, min(concept) AS label FROM track GROUP BY 1) t JOIN (SELECT DISTINCT instance_id FROM instance) i ON i.instance_id = t.track_id JOIN (SELECT track_id, list(frame_idx) AS f FROM tframe GROUP BY 1) f ON f.track_id = t.track_id JOIN (SELECT track_id, floor(sum(CAST(score AS DECIMAL(18,4)))::DOUBLE / count(*) * 1e4 + 0.5) / 1e4 AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, frame_idx) AS p FROM tframe) WHERE p <= 3 GROUP BY 1) c ON c.track_id = t.track_id", "tframe", "instance"))
def k07(s, d):
    docs = O.documents(B.track(s, d), tframe(s, d), O.geometry(B.instance(s, d)), O.confidence(B.track(s, d), tframe(s, d), 3))
    read = F.from_json("json", "label string, position array<double>, confidence double, frames array<struct<frame_idx:long>>")
    return docs.select("track_id", read.alias("o")).select("track_id", "o.label", F.size("o.frames").cast("long").alias("n_frames"), "o.confidence")


@query("D12_frame_annotations", with_("SELECT frame_idx, count(*) AS n, min(track_id) AS first FROM tframe GROUP BY 1", "tframe"))
def d12(s, d):
    return O.frame_annotations(tframe(s, d)).select("frame_idx", F.size("tracks").cast("long").alias("n"), F.col("tracks")[0].track_id.alias("first"))


@query("J26_instance_subset", with_("SELECT gid FROM instance WHERE instance_id = 7", "instance"))
def j26(s, d):
    return B.instance(s, d).filter("instance_id = 7").select("gid")


@query("A34_large_footprint", with_("SELECT track_id, quantile_cont((x2 - x1) * (y2 - y1) / 409600.0::DOUBLE, 0.5) AS box_frac FROM tframe GROUP BY 1", "tframe"))
def a34(s, d):
    return tframe(s, d).groupBy("track_id").agg(F.percentile((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 409600.0, F.lit(0.5)).alias("box_frac"))


@query("J28_corner_projection", with_("SELECT frame_idx, instance_id, count(*) AS corners FROM (SELECT frame_idx, instance_id, (x - px) * c + (z - pz) * s AS depth FROM (SELECT instance_id, unnest([x0, x1]) AS x, z FROM (SELECT instance_id, x0, x1, unnest([z0, z1]) AS z FROM (SELECT instance_id, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM instance GROUP BY 1))), posed) WHERE depth > 0.1 GROUP BY 1, 2", "instance", "posed"))
def j28(s, d):
    g = B.instance(s, d).groupBy("instance_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
    corners = g.withColumn("x", F.explode(F.array("x0", "x1"))).withColumn("z", F.explode(F.array("z0", "z1")))
    depth = (F.col("x") - F.col("px")) * F.col("c") + (F.col("z") - F.col("pz")) * F.col("s")
    return corners.crossJoin(QA.posed(s, d).select("frame_idx", "px", "pz", "c", "s")).filter(depth > 0.1).groupBy("frame_idx", "instance_id").agg(F.count("*").alias("corners"))
