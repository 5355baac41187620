"""Queries that write documents and read them back, and plan-time rules over the tables' few rows."""

from __future__ import annotations

import json
import math
import tempfile

from pyspark.sql import functions as F

from strataform.functions import config, numeric
from strataform.operators import alignment, assignment, clustering, objects
from strataform.operators import detections as D
from strataform.operators import projection as R
from strataform.plans import bindings as B
from strataform.plans import q_assignment as QA
from strataform.plans import q_points as QP
from strataform.plans.bindings import with_
from strataform.plans.q_detections import LIMIT_SQL
from strataform.plans.q_points import r6
from strataform.plans.q_sources import _folder, _points
from strataform.plans.query import query
from strataform.sources import rasters, records, scenes

SQL = B.SQL


def _local(name: str) -> str:
    """A file of the driver: documents that are read and written while a plan is made."""
    return f"{tempfile.mkdtemp(prefix='strataform-')}/{name}"


def _write(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


def _rows(s, rows, schema: str):
    return s.createDataFrame(list(rows), schema)


_NUM = lambda c: f"floor(sum(CAST(CAST({c} AS FLOAT) AS DECIMAL(18,4)))::DOUBLE * 10 + 0.5) / 10"


@query("S01_ply_scan", with_(f"SELECT part % 5 AS object, count(*) AS n, {_NUM('x')} AS x, {_NUM('y')} AS y, {_NUM('z')} AS z, count(*) FILTER (WHERE opacity > 0.5) AS dense, 1 AS qw, 1 AS coefficients FROM gaussian GROUP BY 1", "gaussian"))
def s01(s, d):
    out = _folder(s, "scan")
    _write(scenes.write_parts(_points(s, d), "object", F.concat(F.col("object").cast("string"), F.lit(".ply")), out))
    total = lambda c: (F.floor(F.sum(F.col(c).cast("float").cast("decimal(18,4)")).cast("double") * 10 + 0.5) / 10).alias(c)
    # opacities pass through log odds and back, so they are compared beside the middle
    each = [scenes.read_scene(s, f"{out}/{k}.ply", rows=7000).agg(F.count("*").alias("n"), total("x"), total("y"), total("z"), F.count_if(F.col("opacity") > 0.505).alias("dense"), F.max("qw").cast("int").alias("qw"), F.max(F.size("sh")).alias("coefficients")).withColumn("object", F.lit(k).cast("long")) for k in range(5)]
    out_rows = each[0]
    for e in each[1:]:
        out_rows = out_rows.unionByName(e)
    return out_rows


@query("S08_scene_of_folder", "SELECT 'whole.ply' AS file, true AS refused_two")
def s08(s, d):
    out = _folder(s, "only")
    one = _points(s, d).withColumn("object", F.lit(0))
    _write(scenes.write_files(scenes.object_files(one, "object"), F.lit("whole.ply"), out))
    found = scenes.only_scene(out).rsplit("/", 1)[1]
    _write(scenes.write_files(scenes.object_files(one, "object"), F.lit("second.ply"), out))
    try:
        scenes.only_scene(out)
        refused = False
    except config.Refusal:
        refused = True
    return _rows(s, [(found, refused)], "file string, refused_two boolean")


@query("S09_format_dispatch", with_("SELECT count(*) AS ply_points, true AS other_refused FROM gaussian", "gaussian"))
def s09(s, d):
    out = _folder(s, "dispatch")
    _write(scenes.write_parts(_points(s, d).withColumn("object", F.lit(0)), "object", F.lit("a.ply"), out))
    try:
        scenes.read_scene(s, f"{out}/a.obj")
        refused = False
    except config.Refusal:
        refused = True
    return scenes.read_scene(s, f"{out}/a.ply").agg(F.count("*").alias("ply_points")).withColumn("other_refused", F.lit(refused))


@query("S12_depth_maps", with_("SELECT frame_idx, u, v, CAST(CAST(min(depth) AS FLOAT) AS DOUBLE) AS d FROM projected GROUP BY 1, 2, 3", "projected"))
def s12(s, d):
    out = _folder(s, "depth")
    maps = R.depth_map(QA.projected(s, d))
    _write(scenes.write_files(rasters.depth_files(maps, 64, 48, F.format_string("depth_%04d.npy", "frame_idx")), F.col("name"), out))
    return rasters.read_depths(s, out).select(rasters.frame_of(F.col("path")).alias("frame_idx"), "u", "v", "d")


_BOX_ROWS = ", ".join(f"('{n}', {', '.join(f'{v}::DOUBLE' for v in (*lo, *hi))})" for n, lo, hi in B.BOXES)
_BOX_SQL = f"SELECT * FROM (VALUES {_BOX_ROWS}) t(name, x0, y0, z0, x1, y1, z1)"
_BOX = "name string, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


@query("S13_volume_scan", _BOX_SQL)
def s13(s, d):
    path = _local("volume.json")
    records.write_atomic(path, json.dumps({"coords": "ply_world", "boxes": [{"name": n, "min": lo, "max": hi} for n, lo, hi in B.BOXES]}))
    return _rows(s, [(n, *lo, *hi) for n, lo, hi in records.read_regions(path)], _BOX)


@query("K11_volume_document", f"SELECT b.*, false AS whole_is_boxed, true AS stale FROM ({_BOX_SQL}) b")
def k11(s, d):
    path, whole = _local("volume.json"), _local("whole.json")
    records.write_regions(path, "scene", B.BOXES, {"yaw": 3.0})
    records.write_regions(whole, "scene", None)
    stale = records.stale_region(path, {"yaw": 4.0}) is not None and records.stale_region(path, {"yaw": 3.0}) is None
    rows = _rows(s, [(n, *lo, *hi) for n, lo, hi in records.read_regions(path)], _BOX)
    return rows.withColumn("whole_is_boxed", F.lit(records.read_regions(whole) is not None)).withColumn("stale", F.lit(stale))


@query("S14_captured_views", with_("SELECT frame_idx AS view, 'v' || frame_idx AS id, CAST(round_even(60 * least(1.0 + frame_idx / 10.0, 2.0), 0) AS BIGINT) AS width, floor(30 / tan(radians(40.0 + frame_idx) / 2) * 1e6 + 0.5) / 1e6 AS fy, px, frame_idx / 10.0 > 1.0 AS clamped, " + ", ".join(f"floor(({e}) * 1e6 + 0.5) / 1e6 AS {n}" for e, n in (("-2 * (x * y - z * w)", "r1"), ("-2 * (x * z + y * w)", "r2"), ("2 * (x * y + z * w)", "r3"))) + " FROM quat JOIN frame USING (frame_idx)", "quat"))
def s14(s, d):
    path = _local("views.json")
    rows = QA.quats(s, d).join(B.frame(s, d), "frame_idx").orderBy("frame_idx").collect()  # a row a frame
    views = [{"id": f"v{r.frame_idx}", "position": [r.px, r.py, r.pz], "quaternion": [2 * r.x, 2 * r.y, 2 * r.z, 2 * r.w], "target": [0, 0, 0], "fov_deg": 40.0 + r.frame_idx, "aspect": 1.0 + r.frame_idx / 10.0} for r in rows]
    records.write_atomic(path, json.dumps({"version": 1, "space": "ply", "views": views}))
    got = records.view_table(s, f"file://{path}", 60, 2.0)
    return got.select(F.col("view").cast("long").alias("view"), "id", "width", r6(F.col("fy"), "fy"), "px", "clamped", *(r6(F.col("r")[k], f"r{k}") for k in (1, 2, 3)))


@query("S15_exemplar_file", with_("SELECT concept, CAST(row_number() OVER (PARTITION BY concept ORDER BY det_idx) - 1 AS BIGINT) AS crop, frame_idx, x1::DOUBLE AS x1, y2::DOUBLE AS y2, sha256(det_idx::VARCHAR) AS frame_sha256 FROM detection WHERE source <> 'text'", "detection"))
def s15(s, d):
    path = _folder(s, "exemplars")
    crops = B.detection(s, d).filter("source <> 'text'").select("concept", F.struct("det_idx", F.greatest("frame_idx", F.lit(0)).alias("frame_idx"), F.array("x1", "y1", "x2", "y2").alias("box_xyxy"), F.sha2(F.col("det_idx").cast("string"), 256).alias("frame_sha256")).alias("c"))
    kinds = crops.groupBy("concept").agg(F.sort_array(F.collect_list("c")).alias("crops"))
    doc = kinds.agg(F.sort_array(F.collect_list(F.struct("concept", "crops"))).alias("exemplars")).select(F.to_json(F.struct(F.lit(1).alias("version"), "exemplars")).alias("value"))
    doc.coalesce(1).write.text(path)
    return records.exemplar_table(s, path).select("concept", F.col("crop").cast("long").alias("crop"), "frame_idx", "x1", "y2", "frame_sha256")


_VERDICT = "SELECT CAST(c_custkey AS BIGINT) AS seq, CAST(c_custkey AS BIGINT) AS object_idx, CASE WHEN c_custkey % 3 = 0 THEN 'REJECT' ELSE 'CONFIRM' END AS verdict, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS new_label FROM customer"


def _verdicts(s, d):
    from strataform.session import table

    k = F.col("c_custkey").cast("long")
    return table(s, d, "customer").select(k.alias("seq"), k.alias("object_idx"), F.when(k % 3 == 0, "REJECT").otherwise("CONFIRM").alias("verdict"), F.when(k % 5 == 0, F.col("c_name")).alias("new_label"))


@query("S16_verdict_file", _VERDICT)
def s16(s, d):
    path = _local("verdicts")
    latest = records.write_versioned(_verdicts(s, d), path)
    return records.previous_verdicts(s, latest, "hash", "hash")


@query("K17_verdict_versions", f"SELECT version, count(*) AS n FROM (SELECT 1 AS version, * FROM ({_VERDICT}) UNION ALL SELECT 2, * FROM ({_VERDICT}) WHERE verdict = 'CONFIRM') GROUP BY 1")
def k17(s, d):
    path = _local("verdicts")
    rows = _verdicts(s, d)
    versions = [records.write_versioned(r, path) for r in (rows, rows.filter("verdict = 'CONFIRM'"))]
    each = [records.previous_verdicts(s, v, "h", "h").agg(F.count("*").alias("n")).withColumn("version", F.lit(k + 1)) for k, v in enumerate(versions)]
    return each[0].unionByName(each[1])


@query("S17_checkpoint", _VERDICT)
def s17(s, d):
    path, head = _folder(s, "checkpoint"), '{"key":"k"}'
    lines = _verdicts(s, d).select(F.to_json(F.struct("*")).alias("value"))
    torn = _rows(s, [(head,), ('{"seq": 1, "object_idx": 5, "verd',)], "value string")
    torn.unionByName(lines).write.text(path)
    return records.read_checkpoint(s, path, head)


@query("K16_checkpoint_append", "SELECT CAST(n_nationkey AS BIGINT) AS object_idx, n_name AS verdict FROM nation")
def k16(s, d):
    from strataform.session import table

    path, head = _local("c.jsonl"), '{"key":"k"}'
    for r in table(s, d, "nation").orderBy("n_nationkey").collect():  # as a run appends: one by one
        records.append_checkpoint(path, [{"seq": r.n_nationkey, "object_idx": r.n_nationkey, "verdict": r.n_name}], head)
    return records.read_checkpoint(s, f"file://{path}", head).select("object_idx", "verdict")


_LAYERS = ({"render": {"height": 480, "near": 0.1, "list": [1, 2]}, "lift": {"voxel": 0.05}}, {"render": {"height": 720, "list": [3]}}, {"lift": {"gamma": 2.0}, "new": True})


@query("S18_config_layers", "SELECT * FROM (VALUES ('lift.gamma', '2.0'), ('lift.voxel', '0.05'), ('new', 'true'), ('render.height', '720'), ('render.list', '[3]'), ('render.near', '0.1')) t(path, value)")
def s18(s, d):
    paths = [_local("layer.json") for _ in _LAYERS]
    for p, layer in zip(paths, _LAYERS, strict=True):
        records.write_atomic(p, json.dumps(layer))
    return _rows(s, [(k, json.dumps(v)) for k, v in config.leaves(records.load_config(*paths)).items()], "path string, value string")


@query("P28_leaf_paths", "SELECT * FROM (VALUES ('lift.voxel', 'geometry'), ('render.height', 'camera'), ('render.list', 'other'), ('render.near', 'other')) t(path, rule)")
def p28(s, d):
    rules = {"render": "other", "render.height": "camera", "lift": "geometry"}
    return _rows(s, [(p, config.longest_prefix(p, rules)) for p in config.leaves(_LAYERS[0])], "path string, rule string")


@query("S19_profile_listing", with_("SELECT 'scene_' || scene AS name, count(*) AS points, true AS ok FROM gate_event GROUP BY 1 UNION ALL SELECT 'torn', NULL, false", "gate_event"))
def s19(s, d):
    out = _folder(s, "profiles")
    n = B.gate_event(s, d).groupBy("scene").agg(F.count("*").alias("points"))
    docs = n.select(F.concat(F.lit("scene_"), F.col("scene").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct(F.concat(F.lit("scene_"), F.col("scene").cast("string")).alias("name"), "points")).cast("binary").alias("content"))
    torn = _rows(s, [("torn.json", bytearray(b'{"name": "to'))], "name string, content binary")
    _write(scenes.write_files(docs.unionByName(torn), F.col("name"), out))
    return records.profiles(s, out).select("name", "points", "ok")


@query("S21_missing_and_broken", "SELECT 'default' AS missing, true AS broken_refused, true AS no_default_refused")
def s21(s, d):
    def refused(*args):
        try:
            records.read_json(*args)
        except config.Refusal:
            return True
        return False

    bad = _local("bad.json")
    records.write_atomic(bad, "{")
    return _rows(s, [(records.read_json(_local("none.json"), "default"), refused(bad, "default"), refused(_local("none.json")))], "missing string, broken_refused boolean, no_default_refused boolean")


@query("K02_concept_summary_file", with_("SELECT concept, count(*) AS n_det, count(DISTINCT frame_idx) AS n_frames, max(score) AS max_score FROM detection GROUP BY 1 UNION ALL SELECT 'unseen', 0, 0, NULL", "detection"))
def k02(s, d):
    path = _folder(s, "summary")
    rows = B.detection(s, d)
    records.write_summary(rows, rows.select("concept").distinct().unionByName(_rows(s, [("unseen",)], "concept string")), path)
    return s.read.option("header", True).schema("concept string, n_det long, n_frames long, max_score double, mean_score double, mean_area double").csv(path).select("concept", "n_det", "n_frames", "max_score")


@query("K05_track_documents", with_("SELECT class_id, count(DISTINCT det % 7) AS tracks, count(DISTINCT det) AS dets, count(DISTINCT CASE WHEN det % 7 < 3 THEN det % 7 END) AS instances FROM support GROUP BY 1", "support"))
def k05(s, d):
    t = B.support(s, d).select("class_id", "det", (F.col("det") % 7).alias("track")).distinct()
    named = t.filter("track < 3").select("class_id", "track").distinct().withColumn("instance_id", F.col("class_id") * 10 + F.col("track"))
    docs = objects.track_documents(t, named)
    back = F.from_json("json", "class_id long, tracks array<struct<track: long, dets: array<long>, instance_id: long>>")
    dets = F.aggregate("o.tracks", F.lit(0).cast("long"), lambda n, x: n + F.size(x.dets))
    return docs.select(back.alias("o"), F.cardinality("instances").cast("long").alias("instances")).select("o.class_id", F.size("o.tracks").cast("long").alias("tracks"), dets.alias("dets"), "instances")


@query("K06_calibration_document", with_("SELECT CASE WHEN score >= 0.5 THEN 'own' ELSE 'other' END AS kind, CAST(least(floor(area_frac * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM detection WHERE area_frac BETWEEN 0 AND 1 GROUP BY 1, 2", "detection"))
def k06(s, d):
    rows = B.detection(s, d).filter("area_frac between 0 and 1").select(F.when(F.col("score") >= 0.5, "own").otherwise("other").alias("kind"), "area_frac")
    doc = objects.histogram_document(assignment.histogram_by_kind(rows, "area_frac", 50), 50)
    back = doc.select(F.from_json("json", "bins int, histograms map<string, array<long>>").alias("h")).select(F.explode("h.histograms").alias("kind", "counts"))
    return back.select("kind", F.posexplode("counts").alias("bin", "n")).filter("n > 0").select("kind", F.col("bin").cast("long").alias("bin"), "n")


@query("K10_refused_sidecar", with_("SELECT 21 AS width, 0 AS refused_cells, 'too large' AS refused, count(*) AS cells FROM cells", "cells"))
def k10(s, d):
    full, bare = _local("density.json"), _local("density.json")
    cells = QP.P.footprint(B.gaussian(s, d), QP.ORIGIN, QP.CELL, QP.DIMS).collect()  # at most the grid's cells
    records.write_sidecar(full, QP.ORIGIN, QP.CELL, QP.DIMS, [tuple(c) for c in cells])
    records.write_sidecar(bare, QP.ORIGIN, QP.CELL, QP.DIMS, None, config.Refusal("too large", "volume"))
    a, b = records.read_json(full), records.read_json(bare)
    return _rows(s, [(b["dims"][0], len(b["cells"]), b["refused"], len(a["cells"]))], "width int, refused_cells int, refused string, cells long")


@query("G23_refused_attempt", with_("SELECT frame_idx AS run, CASE WHEN frame_idx % 2 = 0 AND frame_idx % 3 <> 0 THEN 'render.height: 480 to ' || (480 + frame_idx) END AS changed FROM frame", "frame"))
def g23(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx").collect():  # a row a run
        k = r.frame_idx
        found = records.refused_attempt({"refused": k % 2 == 0, "time": 5 if k % 3 else 4, "settings": {"render": {"height": 480 + k, "near": 0.1}}}, {"time": 4, "settings": {"render": {"height": 480, "near": 0.1}}})
        out.append((k, "; ".join(f"{p}: {a} to {b}" for p, (a, b) in found.items()) if found is not None else None))
    return _rows(s, out, "run long, changed string")


@query("P11_angle_recovery", with_("SELECT frame_idx, floor(degrees(atan2(s, c)) * 1e6 + 0.5) / 1e6 AS yaw, floor((frame_idx - 12) * 2.0 * 1e6 + 0.5) / 1e6 AS tilt_x, floor((frame_idx - 12) * 1e6 + 0.5) / 1e6 AS tilt_z FROM frame", "frame"))
def p11(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx", "c", "s").collect():
        block = {"tilt_x": (r.frame_idx - 12) * 2.0, "tilt_z": float(r.frame_idx - 12), "yaw": math.degrees(math.atan2(r.s, r.c))}
        a = alignment.angles(alignment.matrix(block))
        out.append((r.frame_idx, a["yaw"], a["tilt_x"], a["tilt_z"]))
    return _rows(s, out, "frame_idx long, yaw double, tilt_x double, tilt_z double").select("frame_idx", *(r6(F.col(c), c) for c in ("yaw", "tilt_x", "tilt_z")))


@query("P12_levelling_clicks", with_("SELECT frame_idx, floor(degrees(atan2(-c / 10, 1)) * 1e6 + 0.5) / 1e6 AS tilt_x, floor(degrees(atan2(s / 10, sqrt(1 + c * c / 100))) * 1e6 + 0.5) / 1e6 AS tilt_z FROM frame", "frame"))
def p12(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx", "c", "s").collect():  # clicks on the plane whose normal is (s, 10, c)
        on = lambda x, z, r=r: [x, -(r.s * x + r.c * z) / 10, z]
        b = alignment.from_points([on(0.0, 0.0), on(0.0, 1.0), on(1.0, 0.0)])
        out.append((r.frame_idx, b["tilt_x"], b["tilt_z"]))
    return _rows(s, out, "frame_idx long, tilt_x double, tilt_z double").select("frame_idx", *(r6(F.col(c), c) for c in ("tilt_x", "tilt_z")))


@query("P13_block_rules", with_("SELECT frame_idx, frame_idx = 12 AS identity, CASE WHEN frame_idx >= 23 THEN 'tilt_x is beyond 90 degrees' WHEN frame_idx <= 1 THEN 'tilt_x is beyond 90 degrees' END AS reason, frame_idx = 12 AS same FROM frame", "frame"))
def p13(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx").collect():
        block = {"tilt_x": (r.frame_idx - 12) * 9.0}
        out.append((r.frame_idx, alignment.is_identity(block), alignment.valid(block), alignment.same(block, {"tilt_x": -block["tilt_x"]})))
    return _rows(s, out, "frame_idx long, identity boolean, reason string, same boolean")


_LENGTHS = {"render": {"near": 0.1, "height": 480}, "lift": {"voxel": 0.05, "merge": {"distance": 0.4}}}


@query("P14_lengths_to_units", "SELECT path, metres, floor(metres * 2.5 * 1e9 + 0.5) / 1e9 AS units FROM (VALUES ('render.near', 0.1::DOUBLE), ('lift.voxel', 0.05), ('lift.merge.distance', 0.4)) t(path, metres)")
def p14(s, d):
    _, changed = config.in_units(_LENGTHS, ["render.near", "lift.voxel", "lift.merge.distance", "lift.absent"], 2.5)
    return _rows(s, [(p, a, b) for p, (a, b) in changed.items()], "path string, metres double, units double").select("path", "metres", (F.floor(F.col("units") * 1e9 + 0.5) / 1e9).alias("units"))


@query("P15_scale_factor", with_("SELECT frame_idx, CASE WHEN frame_idx % 5 > 0 AND frame_idx > 0 THEN floor((frame_idx % 5) / (frame_idx / 2.0::DOUBLE) * 1e9 + 0.5) / 1e9 END AS units_per_metre FROM frame", "frame"))
def p15(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx").collect():
        try:
            out.append((r.frame_idx, config.scale_of({"length_m": r.frame_idx / 2.0, "units": float(r.frame_idx % 5)})))
        except config.Refusal:
            out.append((r.frame_idx, None))
    return _rows(s, out, "frame_idx long, units_per_metre double").select("frame_idx", (F.floor(F.col("units_per_metre") * 1e9 + 0.5) / 1e9).alias("units_per_metre"))


@query("P19_rounding_at_rest", with_(f"SELECT det_idx, score, area_frac FROM (SELECT det_idx, source, concept, round_even(score / 1.3::DOUBLE, 4) AS score, round_even(area_frac / 0.7::DOUBLE, 5) AS area_frac FROM detection) WHERE score >= {LIMIT_SQL}", "detection"))
def p19(s, d):
    from strataform.plans.q_detections import LIMITS

    raw = B.detection(s, d).withColumn("score", F.col("score") / 1.3).withColumn("area_frac", F.col("area_frac") / 0.7)
    return D.above_threshold(numeric.at_rest(raw), D.threshold(**LIMITS)).select("det_idx", "score", "area_frac")


@query("P20_significant_digits", with_("SELECT frame_idx, round(v, CAST(2 - floor(log10(v)) AS INT)) AS three, greatest(0, least(6, CAST(1 - floor(log10(v / 100)) AS INT))) AS decimals FROM (SELECT frame_idx, pow(1.7, frame_idx) / 13 AS v FROM frame)", "frame"))
def p20(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx").collect():
        v = 1.7**r.frame_idx / 13
        out.append((r.frame_idx, config.significant(v), config.box_decimals(v / 100)))
    return _rows(s, out, "frame_idx long, three double, decimals int")


@query("X09_metre_text", with_("SELECT frame_idx, (frame_idx / 4.0::DOUBLE)::DECIMAL(9,2)::DOUBLE AS metres, CASE WHEN frame_idx % 4 = 0 THEN CAST(frame_idx // 4 AS VARCHAR) ELSE rtrim(CAST((frame_idx / 4.0)::DECIMAL(9,2) AS VARCHAR), '0') END || ' m' AS shown FROM frame", "frame"))
def x09(s, d):
    rows = B.frame(s, d).select("frame_idx").collect()
    return _rows(s, [(r.frame_idx, r.frame_idx / 4.0, config.metres_text(r.frame_idx / 4.0)) for r in rows], "frame_idx long, metres double, shown string")


@query("F11_auto_thresholds", with_("SELECT floor(least(max(x) - min(x), max(z) - min(z)) * 0.02 * 1e6 + 0.5) / 1e6 AS voxel, 0.5::DOUBLE AS reach FROM gaussian", "gaussian"))
def f11(s, d):
    e = B.gaussian(s, d).agg(F.least(F.max("x") - F.min("x"), F.max("z") - F.min("z"))).first()[0]
    found = config.auto_thresholds({"voxel": "auto", "reach": 0.5}, e, {"voxel": 0.02})
    return _rows(s, [(found["voxel"], found["reach"])], "voxel double, reach double").select(r6(F.col("voxel"), "voxel"), "reach")


@query("F21_grid_budget", with_("SELECT frame_idx, CASE WHEN n <= 500 THEN n END AS cells FROM (SELECT frame_idx, CAST(ceil(10 / cell) * ceil(7 / cell) AS BIGINT) AS n FROM (SELECT frame_idx, 0.25 + frame_idx / 16.0::DOUBLE AS cell FROM frame))", "frame"))
def f21(s, d):
    out = []
    for r in B.frame(s, d).select("frame_idx").collect():
        try:
            out.append((r.frame_idx, config.check_grid((10, 7), 0.25 + r.frame_idx / 16.0, 500)))
        except config.Refusal:
            out.append((r.frame_idx, None))
    return _rows(s, out, "frame_idx long, cells long")


@query("L13_model_proposal", with_("SELECT frame_idx, CASE WHEN frame_idx * 0.9 >= 16 THEN 'large' WHEN frame_idx * 0.9 >= 8 THEN 'middle' WHEN frame_idx * 0.9 >= 3 THEN 'small' ELSE 'small' END AS model FROM frame", "frame"))
def l13(s, d):
    need = {"small": 3.0, "middle": 8.0, "large": 16.0}
    rows = B.frame(s, d).select("frame_idx").collect()
    return _rows(s, [(r.frame_idx, config.fit_order(need, float(r.frame_idx))) for r in rows], "frame_idx long, model string")


@query("M09_cache_validity", with_("SELECT frame_idx, frame_idx % 3 = 0 AND frame_idx % 2 = 0 AS current FROM frame", "frame"))
def m09(s, d):
    import os

    folder = os.path.dirname(_local("x"))
    records.write_manifest(folder, {"height": 480}, {"scene": "a"}, {})
    rows = B.frame(s, d).select("frame_idx").collect()
    return _rows(s, [(r.frame_idx, records.is_current(folder, {"height": 480 if r.frame_idx % 3 == 0 else 481}, {"scene": "a" if r.frame_idx % 2 == 0 else "b"})) for r in rows], "frame_idx long, current boolean")


@query("E08_moments", with_("SELECT instance_id, n, floor(w * 1e4 + 0.5) / 1e4 AS w, floor((sxx / w - pow(sx / w, 2)) * 1e4 + 0.5) / 1e4 AS mxx, floor((syz / w - sy / w * sz / w) * 1e4 + 0.5) / 1e4 AS myz FROM (SELECT instance_id, count(*) AS n, sum(opacity) AS w, sum(opacity * x) AS sx, sum(opacity * y) AS sy, sum(opacity * z) AS sz, sum(opacity * x * x) AS sxx, sum(opacity * y * z) AS syz FROM instance GROUP BY 1)", "instance"))
def e08(s, d):
    r4 = lambda c: (F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
    return clustering.moments(B.instance(s, d), "instance_id").select("instance_id", "n", r4("w"), r4("mxx"), r4("myz"))


#: A bundle whose stored numbers are whole-number rules of a point's place, so that SQL knows them.
_LO, _HI = (-1.0, -2.0, 0.0), (2.0, 1.0, 3.0)
_STORED = {a: f"(k * {f}) % 65536" for a, f in zip("xyz", (7919, 104729, 1299709), strict=True)}


def _bundle(s, d) -> str:
    import io
    import zipfile

    import numpy as np

    n = B.gaussian(s, d).count()
    side = math.ceil(math.sqrt(n))
    k = np.arange(n, dtype=np.int64)
    stored = np.stack([k * 7919 % 65536, k * 104729 % 65536, k * 1299709 % 65536], axis=1)

    def plane(*channels):
        out = np.zeros((side * side, 4), np.uint8)
        for c, v in enumerate(channels):
            out[:n, c] = v
        return rasters.encode_png(out.reshape(side, side, 4))

    table = np.zeros((64 * 3, 4), np.uint8)
    table[:, 0] = np.arange(64 * 3) % 4
    pictures = {
        "low.png": plane(*(stored % 256).T),
        "high.png": plane(*(stored // 256).T),
        "scale.png": plane(k % 3, (k + 1) % 3, (k + 2) % 3),
        "quat.png": plane(100 + k % 20, 120 + k % 10, 140 - k % 15, 252 + k % 4),
        "base.png": plane(k % 4, k % 4, k % 4, k % 256),
        "palette.png": rasters.encode_png(table.reshape(1, -1, 4)),
        "label.png": plane(k % 64),
    }
    meta = {"version": 2, "count": n, "means": {"files": ["low.png", "high.png"], "mins": _LO, "maxs": _HI}, "scales": {"files": ["scale.png"], "codebook": [-2.0, -1.0, 0.0]}, "quats": {"files": ["quat.png"]}, "sh0": {"files": ["base.png"], "codebook": [0.1, 0.2, 0.3, 0.4]}, "shN": {"bands": 1, "files": ["palette.png", "label.png"], "codebook": [5, 6, 7, 8]}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("meta.json", json.dumps(meta))
        for name, raw in pictures.items():
            z.writestr(name, raw)
    path = _local("scene.sog")
    with open(path, "wb") as f:
        f.write(out.getvalue())
    return f"file://{path}"


SQL["place"] = "SELECT row_number() OVER (ORDER BY gid) - 1 AS k FROM gaussian"
B.USES["place"] = ("gaussian",)


@query("S02_bundle_means", with_(f"SELECT k AS gid, {', '.join(f'{e} AS q{a}' for a, e in _STORED.items())}, k % 256 AS opacity FROM place", "place"))
def s02(s, d):
    def back(a, lo, hi):
        v = F.signum(a) * F.log1p(F.abs(F.col(a).cast("double")))
        return F.round((v - lo) / (hi - lo) * 65535).cast("long").alias(f"q{a}")

    rows = scenes.read_scene(s, _bundle(s, d))
    return rows.select("gid", *(back(a, lo, hi) for a, lo, hi in zip("xyz", _LO, _HI, strict=True)), F.round(F.col("opacity") * 255).cast("long").alias("opacity"))


@query("S03_raster_order", with_("SELECT k AS gid, k % 3 AS scale FROM place", "place"))
def s03(s, d):
    return scenes.read_scene(s, _bundle(s, d)).select("gid", (F.round(F.log("sx")) + 2).cast("long").alias("scale"))


@query("S04_bundle_quaternions", with_("SELECT k AS gid, k % 4 AS largest, 100 + k % 20 AS a, 120 + k % 10 AS b, 140 - k % 15 AS c FROM place", "place"))
def s04(s, d):
    q = F.array("qw", "qx", "qy", "qz")
    rows = scenes.read_scene(s, _bundle(s, d)).select("gid", q.alias("q"))
    rest = lambda k: [c for c in range(4) if c != k]
    at = (F.array_position("q", F.array_max("q")) - 1).cast("long")
    stored = lambda j: F.round((F.element_at(F.array(*(F.col("q")[rest(k)[j]] for k in range(4))), (F.col("largest") + 1).cast("int")).cast("double") / math.sqrt(2) + 0.5) * 255).cast("long")
    return rows.withColumn("largest", at).select("gid", "largest", *(stored(j).alias(n) for j, n in enumerate("abc")))


@query("S05_palette_gather", with_("SELECT k AS gid, k % 4 + 1 AS base, (k % 64) * 3 % 4 + 5 AS first, ((k % 64) * 3 + 2) % 4 + 5 AS last, 4 AS coefficients FROM place", "place"))
def s05(s, d):
    sh = lambda j: F.col("sh")[j][0]
    rows = scenes.read_scene(s, _bundle(s, d))
    return rows.select("gid", F.round(sh(0) * 10).cast("long").alias("base"), F.round(sh(1)).cast("long").alias("first"), F.round(sh(3)).cast("long").alias("last"), F.size("sh").alias("coefficients"))
