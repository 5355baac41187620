"""Grids, visibility, clustering and boxes against plain computations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import clustering as C
from strataform.operators import points as P
from strataform.operators import projection as R


def cells(spark, some):
    return spark.createDataFrame(sorted(some), "i long, j long")


def test_enclosure_equals_a_ray_walk(spark):
    rng = random.Random(5)
    dims = (9, 7)
    occ = {(i, j) for i in range(dims[0]) for j in range(dims[1]) if rng.random() < 0.2}
    want = {}
    for i, j in itertools.product(range(dims[0]), range(dims[1])):
        if (i, j) in occ:
            continue
        n = 0
        for a, b in itertools.product((-1, 0, 1), repeat=2):
            if (a, b) != (0, 0):
                n += any((i + k * a, j + k * b) in occ for k in range(1, 10))
        if n >= 3:
            want[i, j] = n
    got = {(r.i, r.j): r.hits for r in P.enclosed(dims, cells(spark, occ), 3).collect()}
    assert got == want


def test_depth_slack(spark):
    seen = spark.createDataFrame([(0, k, 5, 5, z) for k, z in enumerate((1.0, 2.0, 2.29, 2.31))], "frame_idx long, gid long, u long, v long, depth double")
    depth = spark.createDataFrame([(0, 5, 5, 2.0)], "frame_idx long, u long, v long, d double")
    assert sorted(r.gid for r in R.visible(seen, depth, 0.05, 0.2).collect()) == [0, 1, 2]
    assert R.visible(seen, depth, 0.05, 0.2, min_points=5).count() == 0


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e5])
def test_projection_does_not_depend_on_scale(spark, scale):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 3)) * [1, 1, 0.2] + [0, 0, 2]
    frame = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 0.0, 0.0)], "frame_idx long, c double, s double, px double, py double, pz double")
    frame = R.with_intrinsics(frame, {"fx": 40, "fy": 40, "cx": 32, "cy": 24, "width": 64, "height": 48})
    rows = spark.createDataFrame([(k, *map(float, p * scale)) for k, p in enumerate(pts)], "gid long, x double, y double, z double")
    got = {r.gid for r in R.project(rows, frame, 0.1 * scale).collect()}
    want = {k for k, (x, y, z) in enumerate(pts) if z > 0.1 and 0 <= np.trunc(40 * -x / z + 32) < 64 and 0 <= np.trunc(40 * -y / z + 24) < 48}
    assert len(got ^ want) <= 2


def test_quaternion_round_trip(spark):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    df = spark.createDataFrame([tuple(map(float, r)) for r in q], "x double, y double, z double, w double")
    m = R.quaternion_to_matrix(*(F.col(k) for k in "xyzw"))
    df = df.select("*", *(c.alias(f"m{k}") for k, c in enumerate(m)))
    back = R.matrix_to_quaternion([F.col(f"m{k}") for k in range(9)])
    for r in df.select("x", "y", "z", "w", *(c.alias(f"b{n}") for c, n in zip(back, "xyzw", strict=True))).collect():
        a, b = np.array(r[:4]), np.array(r[4:])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(k, k + 1) for k in range(60)]
    hub = [(1000, 1001 + k) for k in range(40)]
    edges = spark.createDataFrame(path + hub, "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in {x for e in path + hub for x in e} | {5000}], "node long")
    got = {r.node: r.component for r in C.components(spark, nodes, edges).collect()}
    assert set(got.values()) == {0, 1000, 5000} and got[60] == 0 and got[1040] == 1000


def test_veto_refuses_one_merge(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1), (0, 2, 3, 2)], "class_id long, lo long, hi long, place long")
    links = spark.createDataFrame([(0, 1, 3)], "class_id long, lo long, hi long")
    got = sorted((r.lo, r.hi, r.merged) for r in C.constrained(edges, links).collect())
    assert got == [(1, 2, True), (2, 3, False)]


def test_oriented_box_switches(spark):
    rng = np.random.default_rng(2)
    u, v, w = rng.uniform(-1, 1, 3000), rng.uniform(-0.7, 0.7, 3000), rng.uniform(-0.01, 0.01, 3000)
    t = np.pi / 5
    tilted = np.stack([u * np.cos(t) - w * np.sin(t), u * np.sin(t) + w * np.cos(t), v], axis=1)
    upright = np.stack([u * 0.8 - w * 0.6, v, u * 0.6 + w * 0.8], axis=1)
    rows = [(k, *map(float, p), 1.0) for k, pts in ((0, tilted), (1, upright)) for p in pts]
    got = {r.instance_id: r for r in C.oriented_boxes(spark.createDataFrame(rows, "instance_id long, x double, y double, z double, opacity double"), "instance_id").collect()}
    assert got[0].mode == "pca" and got[1].mode == "gravity"
    for r in got.values():
        assert sorted(round(getattr(r, f"hi{k}") - getattr(r, f"lo{k}"), 1) for k in range(3)) == [0.0, 1.4, 2.0]


def test_plane_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    x, z = rng.uniform(0, 10, 800), rng.uniform(0, 10, 800)
    y = 0.1 * x - 0.05 * z + 1 + rng.normal(0, 0.01, 800)
    y[:80] += 3
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(zip(x, y, z, strict=True))], "gid long, x double, y double, z double")
    p = P.fit_plane(df)
    assert abs(p.a - 0.1) < 0.01 and abs(p.b + 0.05) < 0.01 and abs(p.c - 1) < 0.05


def test_holes_need_three_neighbours(spark):
    g = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0)], "i long, j long, ground double")
    got = {(r.i, r.j): r.ground for r in P.fill_holes(g, (4, 4)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 3.0, (1, 0): 2.0, (1, 1): 2.0}


def test_empty_points(spark):
    none = spark.createDataFrame([], "gid long, x double, y double, z double, opacity double, instance_id long")
    assert C.voxel_components(none, 0.5).count() == 0
    assert C.oriented_boxes(none, "instance_id").count() == 0
    assert P.footprint(none, (0.0, 0.0), 1.0, (3, 3)).count() == 0
