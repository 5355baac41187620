"""Alignment algebra, camera paths, and the run surface."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.functions.config import Refusal
from strataform.operators import alignment as A
from strataform.operators import paths, runs


def test_alignment_algebra():
    rng = random.Random(0)
    for _ in range(50):
        block = {k: rng.uniform(-80, 80) for k in A.KEYS}
        m = A.matrix(block)
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) > 0
        assert np.allclose(A.matrix(A.angles(m)), m)
        n = np.array([rng.uniform(-1, 1), rng.uniform(0.2, 1), rng.uniform(-1, 1)])
        assert np.allclose(A.matrix(A.from_normal(n)) @ (n / np.linalg.norm(n)), [0, 1, 0])
        w, x, y, z = A.quaternion(m)
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(back, m)
    block = A.from_points([[0, 0, 0], [1, 0.1, 0], [0, 0.05, 1]], [[0, 0, 0], [1, 0.1, 0.3]])
    d = A.matrix(block) @ np.array([1, 0.1, 0.3])
    assert min(abs(d[0]), abs(d[2])) < 1e-6 and -45 <= block["yaw"] <= 45
    assert A.valid({"yaw": 10}) is None and A.valid({"yaw": math.nan}) and A.valid({"roll": 1}) and A.valid({"tilt_x": 91})
    assert A.same({"yaw": 360.0}, None) and A.is_identity({}) and not A.is_identity({"yaw": 1})
    with pytest.raises(ValueError):
        A.from_points([[0, 0, 0], [1, 0, 0], [2, 0, 0]])


@pytest.fixture(scope="module")
def room(spark):
    cells = spark.createDataFrame([(i, j) for i in range(12) for j in range(10)], "i long, j long")
    walls = cells.filter("i in (0, 11) or j in (0, 9) or (i = 6 and j < 5)")
    return cells, walls


def test_inside_path_stands_in_free_cells(room):
    cells, walls = room
    got = paths.inside(cells, walls, (12, 10), (0.0, 0.0), 1.0, 1.6, stands=4, views=3).collect()
    blocked = {(r.i, r.j) for r in walls.collect()}
    assert len(got) == 12
    for r in got:
        assert abs(r.c**2 + r.s**2 - 1) < 1e-9
        assert all((int(r.px) + a, int(r.pz) + b) not in blocked for a in (-1, 0, 1) for b in (-1, 0, 1))


def test_ground_and_orbit_paths(spark, room):
    cells, walls = room
    mass = walls.select("i", "j", F.lit(2.0).alias("mass"))
    heights = cells.select("i", "j", (F.col("i") * 0.1).alias("ground"))
    got = paths.ground(cells, mass, (0.0, 0.0), 1.0, heights, 1.6, [1.0, 5.0], [2, 1, 0], 20, stands=3, views=2).collect()
    assert len(got) == 6 and all(abs(r.py - 1.6 - 0.1 * int(r.px)) < 1e-9 for r in got)
    pts = spark.createDataFrame([(k, math.cos(k), 0.0, math.sin(k), 1.0) for k in range(100)], "gid long, x double, y double, z double, opacity double")
    for r in paths.orbit(pts, 8, 2.0).collect():
        assert r.px * r.c + r.pz * r.s < 0


def test_repair_adds_views_until_covered(spark, room):
    cells, _ = room
    pts = spark.createDataFrame([(k, k % 10 + 0.5, 0.0, k // 10 + 0.5, 1.0) for k in range(100)], "gid long, x double, y double, z double, opacity double")
    free = cells.select((F.col("i") * 100 + F.col("j")).alias("pos"), (F.col("i") + 0.5).alias("px"), (F.col("j") + 0.5).alias("pz"))
    start = spark.createDataFrame([(0, 0.5, 1.6, 0.5, 1.0, 0.0)], "id long, px double, py double, pz double, c double, s double")

    def sees(views):
        dx, dz = F.col("x") - F.col("px"), F.col("z") - F.col("pz")
        return views.crossJoin(pts).filter((dx * F.col("c") + dz * F.col("s") > 0) & (dx * dx + dz * dz < 30)).select(F.col("id").alias("frame_idx"), "gid")

    got = paths.repair(pts, free, sees, start, 0.95, 4, 1.0, 6, 0.5, 2.0)
    share = lambda v: sees(v).select("gid").distinct().count() / 100
    assert share(got) > share(start) and got.count() > 1


def test_run_gates_and_settings(spark, tmp_path):
    run = runs.create(spark, str(tmp_path), "attic", {"filmed": "indoors"})
    run.reopens = {"render": "render", "detect": "vocabulary"}
    with pytest.raises(Refusal):
        run.approve("render")
    for g in ("source", "volume", "render", "vocabulary"):
        run.approve(g, {"profile": "x"})
    assert run.standing() == ["source", "volume", "render", "vocabulary"] and run.next_gate() == "verify"
    assert run.stale({"profile": "y"}) == run.standing() and run.stale({"profile": "x"}) == []
    assert run.change_settings({"detect": {"threshold": 0.4}}) == ["vocabulary"]
    assert run.standing() == ["source", "volume", "render"] and run.settings()["detect"] == {"threshold": 0.4}
    with pytest.raises(Refusal):
        run.change_settings({"other": 1})
    assert run.start("count", lambda: spark.range(5).count(), gate="vocabulary") == 5
    with pytest.raises(Refusal):
        run.start("verify", lambda: None, gate="verify")
    run.reopen("source")
    assert run.standing() == []
    with pytest.raises(Refusal):
        runs.create(spark, str(tmp_path), "../x", {})
    assert run.deletion()["files"] >= 2
    with pytest.raises(Refusal):
        runs.inside_folder(str(tmp_path), "../etc")


def test_lock(tmp_path):
    lock = runs.Lock(str(tmp_path))
    with lock, pytest.raises(Refusal), runs.Lock(str(tmp_path)):
        pass
    (tmp_path / ".lock").write_text('{"pid": 999999999, "host": "%s", "since": ""}' % __import__("socket").gethostname())
    assert lock.stale()
    lock.release_dead()
    with lock:
        assert not lock.stale()
