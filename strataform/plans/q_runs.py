"""Queries on runs: gates, settings, locks, publication and reports, and camera paths over whole scenes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from strataform.functions import config
from strataform.operators import journal, paths, runs
from strataform.plans import bindings as B
from strataform.plans import q_detections as QD
from strataform.plans import q_sources as QS
from strataform.plans.bindings import with_
from strataform.plans.q_points import r6
from strataform.plans.query import ORACLES, query
from strataform.sources import records, scenes


def _folder() -> str:
    return tempfile.mkdtemp(prefix="strataform-run-")


def _refused(work) -> str | None:
    """The gate that a refusal names, an empty text if none; None where there is no refusal."""
    try:
        work()
    except config.Refusal as e:
        return e.gate or ""
    return None


@query("S07_dialog_count", with_("SELECT object, n FROM cut", "cut"))
def s07(s, d):
    out = QS._folder(s, "dialog")
    files = scenes.write_files(scenes.object_files(QS._points(s, d), "object"), F.concat(F.lit("o"), F.col("object").cast("string"), F.lit(".ply")), out)
    names = [r.name for r in files.collect()]  # a row a file
    return s.createDataFrame([(int(n[1:-4]), scenes.count(s, f"{out}/{n}")) for n in names], "object long, n long")


@query("W05_detection_numbers", "SELECT det_idx, det_no FROM (" + ORACLES["J22_numbering"] + ")")
def w05(s, d):
    return QD.j22(s, d).select("det_idx", "det_no")


@query("K12_atomic_replace", "SELECT 'second' AS content, 1 AS files")
def k12(s, d):
    folder = _folder()
    for text in ("first", "second"):
        records.write_atomic(f"{folder}/a.txt", text)
    with open(f"{folder}/a.txt", encoding="utf-8") as f:
        return s.createDataFrame([(f.read(), len(os.listdir(folder)))], "content string, files int")


@query("K13_staged_publish", "SELECT 'new' AS content, true AS half_refused, false AS staged_left")
def k13(s, d):
    folder = _folder()
    for name in ("live", "staged"):
        records.write_atomic(f"{folder}/{name}/a.txt", "old" if name == "live" else "new")
    refused = _refused(lambda: records.publish(f"{folder}/staged", f"{folder}/live")) is not None
    records.write_atomic(f"{folder}/staged/_SUCCESS", "")
    records.publish(f"{folder}/staged", f"{folder}/live")
    with open(f"{folder}/live/a.txt", encoding="utf-8") as f:
        return s.createDataFrame([(f.read(), refused, os.path.exists(f"{folder}/staged"))], "content string, half_refused boolean, staged_left boolean")


@query("K14_run_report", ORACLES["A25_funnel"])
def k14(s, d):
    funnel = QD.a25(s, d)
    doc, text = records.report(funnel, "scene")
    head, rows = text.split("\n")[2], [x for x in text.split("\n")[4:] if x]
    names = [c.strip() for c in head.strip("|").split("|")]
    shown = [[c.strip() for c in r.strip("|").split("|")] for r in rows]
    if [[str(r[c]) for c in names] for r in doc["classes"]] != shown:
        raise ValueError("the two forms of the report differ")
    return s.createDataFrame([tuple(r[c] for c in names) for r in doc["classes"]], funnel.select(*names).schema)


@query("F23_stale_volume", with_("SELECT frame_idx, frame_idx <> 12 AS stale FROM frame", "frame"))
def f23(s, d):
    path = f"{_folder()}/volume.json"
    records.write_regions(path, "scene", B.BOXES, {"yaw": 12.0})
    rows = B.frame(s, d).select("frame_idx").collect()  # a row a frame
    return s.createDataFrame([(r.frame_idx, records.stale_region(path, {"yaw": float(r.frame_idx)}) is not None) for r in rows], "frame_idx long, stale boolean")


@query("G22_scope_and_levelling", "SELECT * FROM (VALUES ('boxes', 3, 2.0::DOUBLE), ('whole_scene', 0, NULL)) t(scope, boxes, yaw)")
def g22(s, d):
    out = []
    for boxes, levelling in ((B.BOXES, {"yaw": 2.0}), (None, None)):
        path = f"{_folder()}/volume.json"
        records.write_regions(path, "scene", boxes, levelling)
        doc = records.read_json(path)
        out.append((doc.get("scope", "boxes"), len(records.read_regions(path) or ()), (doc.get("alignment") or {}).get("yaw")))
    return s.createDataFrame(out, "scope string, boxes int, yaw double")


@query("G02_approvals", "SELECT * FROM (VALUES (1, 'source,volume,render', 'vocabulary', NULL), (2, 'source', 'volume', NULL), (3, 'source', 'volume', 'volume')) t(step, standing, next, refused)")
def g02(s, d):
    run, out = runs.Run(s, _folder()), []
    for gate in ("source", "volume", "render"):
        run.approve(gate)
    steps = (lambda: None, lambda: run.reopen("volume"), lambda: run.approve("render"))
    for k, work in enumerate(steps):
        refused = _refused(work)
        out.append((k + 1, ",".join(run.standing()), run.next_gate(), refused))
    return s.createDataFrame(out, "step int, standing string, next string, refused string")


@query("G03_settings_reopen", "SELECT * FROM (VALUES (1, 'render', 'source,volume', '720'), (2, '', 'source,volume', '720'), (3, NULL, 'source,volume', '720')) t(step, reopened, standing, height)")
def g03(s, d):
    run, out = runs.Run(s, _folder(), reopens={"render": "render"}), []
    for gate in ("source", "volume", "render"):
        run.approve(gate)
    for k, values in enumerate(({"render": {"height": 720}}, {"render": {"height": 720}}, {"lift": {"voxel": 1}})):
        found: list = [None]
        _refused(lambda values=values, found=found: found.__setitem__(0, ",".join(run.change_settings(values))))
        out.append((k + 1, found[0], ",".join(run.standing()), str(run.settings()["render"]["height"])))
    return s.createDataFrame(out, "step int, reopened string, standing string, height string")


@query("G04_profile_scaffold", "SELECT 'kitchen' AS name, 'indoor' AS kind, true AS again_refused, true AS path_refused")
def g04(s, d):
    root = _folder()
    run = runs.create(s, root, "kitchen", {"kind": "indoor"})
    again = _refused(lambda: runs.create(s, root, "kitchen", {})) is not None
    outside = _refused(lambda: runs.create(s, root, "../x", {})) is not None
    return s.createDataFrame([(os.path.basename(run.folder), run.settings()["scene"]["kind"], again, outside)], "name string, kind string, again_refused boolean, path_refused boolean")


@query("G06_single_writer", "SELECT true AS second_refused, true AS free_again, false AS own_is_stale")
def g06(s, d):
    folder = _folder()
    with runs.Lock(folder) as lock:
        second = _refused(lambda: runs.Lock(folder).__enter__()) is not None
        stale = lock.stale()
    return s.createDataFrame([(second, runs.Lock(folder).holder() is None, stale)], "second_refused boolean, free_again boolean, own_is_stale boolean")


@query("G07_parameter_changes", with_("SELECT frame_idx, concat_ws(',', CASE WHEN frame_idx % 5 = 0 THEN 'added' END, CASE WHEN frame_idx % 2 = 1 THEN 'height' END, CASE WHEN frame_idx % 3 = 0 THEN 'near' END) AS changed FROM frame", "frame"))
def g07(s, d):
    rows = B.frame(s, d).select("frame_idx").collect()
    stored = {"height": 480, "near": 0.1}
    wanted = lambda k: {"height": 480 + k % 2} | ({"near": 0.1} if k % 3 else {}) | ({"added": 1} if k % 5 == 0 else {})
    return s.createDataFrame([(r.frame_idx, ",".join(journal.params_changed(stored, wanted(r.frame_idx)))) for r in rows], "frame_idx long, changed string")


@query("G11_write_invariants", "SELECT 'volume' AS needs, 42 AS result, true AS locked_inside")
def g11(s, d):
    run = runs.Run(s, _folder())
    run.approve("source")
    needs = _refused(lambda: run.start("detect", lambda: 1, gate="render"))
    inside = [False]

    def work():
        inside[0] = _refused(lambda: run.approve("volume")) is not None
        return 42

    return s.createDataFrame([(needs, run.start("render", work, gate="volume"), inside[0])], "needs string, result int, locked_inside boolean")


@query("G14_typed_refusal", "SELECT 'the scene has no measured length' AS reason, 'volume' AS gate, 'measure a length whose size in metres is known' AS remedy")
def g14(s, d):
    try:
        config.scale_of(None)
    except config.Refusal as e:
        return s.createDataFrame([(e.reason, e.gate, e.remedy)], "reason string, gate string, remedy string")


@query("G25_deletion_plan", "SELECT 2 AS files, 6 AS bytes, true AS parent_refused, true AS outside_refused")
def g25(s, d):
    folder = _folder()
    for name in ("a", "b/c"):
        records.write_atomic(f"{folder}/{name}", "abc")
    plan = runs.Run(s, folder).deletion()
    parent = _refused(lambda: runs.Run(s, os.path.dirname(folder)).deletion(protected=[folder])) is not None
    outside = _refused(lambda: runs.inside_folder(folder, "../x")) is not None
    return s.createDataFrame([(plan["files"], plan["bytes"], parent, outside)], "files int, bytes int, parent_refused boolean, outside_refused boolean")


@query("F27_path_guard", "SELECT * FROM (VALUES ('a/b', true), ('a/../b', true), ('../b', false), ('/etc/passwd', false)) t(path, allowed)")
def f27(s, d):
    folder = _folder()
    return s.createDataFrame([(p, _refused(lambda p=p: runs.inside_folder(folder, p)) is None) for p in ("a/b", "a/../b", "../b", "/etc/passwd")], "path string, allowed boolean")


_ORBIT = ORACLES["A41_orbit"]


@query("I17_orbit_path", "SELECT id, floor((cx + 1.2 * radius * cos(2 * pi() * id / 8)) * 1e4 + 0.5) / 1e4 AS px, 1.6::DOUBLE AS py, floor((cz + 1.2 * radius * sin(2 * pi() * id / 8)) * 1e4 + 0.5) / 1e4 AS pz, floor(-cos(2 * pi() * id / 8) * 1e4 + 0.5) / 1e4 AS c FROM (" + _ORBIT + ") o, (SELECT unnest(range(8)) AS id)")
def i17(s, d):
    r4 = lambda c: (F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
    return paths.orbit(B.gaussian(s, d), 8, 1.6).select("id", r4("px"), "py", r4("pz"), r4("c"))


@query("G19_aimed_probes", with_("+ t AS (SELECT part AS target, min(x) AS x, max(z) AS z FROM gaussian GROUP BY 1), m AS (SELECT target, frame_idx AS pos, px, pz, x, z, sqrt(pow(x - px, 2) + pow(z - pz, 2)) AS d FROM t, frame), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(d - 2.0), pos) AS r FROM m WHERE d > 0.5) SELECT target, pos, floor((x - px) / d * 1e6 + 0.5) / 1e6 AS c, floor((z - pz) / d * 1e6 + 0.5) / 1e6 AS s FROM k WHERE r = 1", "gaussian", "frame"))
def g19(s, d):
    t = B.gaussian(s, d).groupBy(F.col("part").alias("target")).agg(F.min("x").alias("x"), F.max("z").alias("z"))
    rows = paths.aimed(t, B.frame(s, d).select(F.col("frame_idx").alias("pos"), "px", "pz"), 0.5, 2.0)
    return rows.select("target", "pos", r6(F.col("c"), "c"), r6(F.col("s"), "s"))


@query("P26_standing_poses", with_("SELECT i * 1000000 + j * 1000 + k AS id, floor((i + 0.5) * 0.1 * 1e6 + 0.5) / 1e6 AS px, floor((j + 0.5) * 0.1 * 1e6 + 0.5) / 1e6 AS pz, floor(cos(k * 2 * pi() / 4) * 1e6 + 0.5) / 1e6 AS c FROM busy, (SELECT unnest(range(4)) AS k)", "busy"))
def p26(s, d):
    from strataform.plans.q_points import busy

    views = busy(s, d).withColumn("yaw", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))))
    return paths.poses(views, (0.0, 0.0), 0.1, 1.6, 4).select("id", r6(F.col("px"), "px"), r6(F.col("pz"), "pz"), r6(F.col("c"), "c"))


@query("P27_label_fade", with_("SELECT instance_id, floor(least(greatest(1 - (d - 4) / 4, 0.0), 1.0) * 1e6 + 0.5) / 1e6 AS opacity FROM (SELECT instance_id, sqrt(pow(min(x) - 5, 2) + pow(max(z) - 5, 2)) AS d FROM instance GROUP BY 1)", "instance"))
def p27(s, d):
    from strataform.operators import projection as R

    at = B.instance(s, d).groupBy("instance_id").agg(F.min("x").alias("x"), F.max("z").alias("z"))
    far = F.sqrt(F.pow(F.col("x") - 5, 2) + F.pow(F.col("z") - 5, 2))
    return at.select("instance_id", r6(R.fade(far, 4.0, 8.0), "opacity"))
