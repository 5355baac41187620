"""Operators that SQL cannot say, over whole tables at the smallest scale, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataform.operators import assignment as A
from strataform.operators import clustering as C
from strataform.operators import points as P
from strataform.plans import bindings as B
from strataform.plans import q_detections as QD
from strataform.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def scene_points(spark, small):
    return B.gaussian(spark, small).orderBy("gid").toPandas()


@pytest.fixture(scope="module")
def merges(spark, small):
    """Affinities of all pairs that share a point, and the walk over them one edge at a time."""
    sup = B.support(spark, small).toPandas()
    weight, frame, kind = {}, {}, {}
    for r in sup.itertuples():
        weight.setdefault((r.class_id, r.det), {})[r.gid] = r.f
        frame[r.det], kind[r.det] = r.frame_idx, r.class_id
    pairs = {}
    for (c, lo), a in weight.items():
        for (e, hi), b in weight.items():
            shared = a.keys() & b.keys() if c == e and lo < hi else ()
            if shared:
                norm = [math.sqrt(round(sum(v * v for v in x.values()), 6)) for x in (a, b)]
                pairs[c, lo, hi] = (round(sum(a[g] * b[g] for g in shared), 6) / (norm[0] * norm[1]), len(shared) / min(len(a), len(b)))
    group = {d: {d} for d in kind}
    told = {}
    for (c, lo, hi), (cosine, _) in sorted(((k, v) for k, v in pairs.items() if v[0] >= 0.25 or v[1] >= 0.26), key=lambda kv: (-round(kv[1][0], 12), kv[0])):
        a, b = group[lo], group[hi]
        if a is b:
            continue
        told[c, lo, hi] = all(frame[p] != frame[q] for p in a for q in b)
        if told[c, lo, hi]:
            a |= b
            for d in b:
                group[d] = a
    return pairs, told, {d: min(g) for d, g in group.items()}, kind


def test_constrained_clustering(spark, small, merges):
    got = {(r.class_id, r.lo, r.hi): r.merged for r in Q["I06_constrained_clustering"](spark, small).collect()}
    assert got == merges[1] and got


def test_track_numbers_and_readouts(spark, small, merges):
    pairs, _, low, kind = merges
    size = {}
    for d, m in low.items():
        size.setdefault((kind[d], m), []).append(d)
    big = sorted(k for k, v in size.items() if len(v) >= 2)
    numbers = {k: i for i, k in enumerate(big)}
    of = {c: {m: t for t, m in enumerate(sorted(m for e, m in size if e == c))} for c in set(kind.values())}
    got = {(r.class_id, r.track): r.instance_id for r in Q["W07_track_numbers"](spark, small).collect()}
    assert got == {(c, of[c][m]): i for (c, m), i in numbers.items()}
    inner = {}
    for (c, lo, hi), (cosine, _) in pairs.items():
        if low[lo] == low[hi]:
            inner.setdefault((c, of[c][low[lo]]), []).append(cosine)
    got = {(r.class_id, r.track): (round(r.low, 9), round(r.mid, 9), r.pairs) for r in Q["A30_track_readouts"](spark, small).collect()}
    assert got == {k: (round(min(v), 9), round(float(np.median(v)), 9), len(v)) for k, v in inner.items()}


def test_part_walk(spark, small):
    pairs = QD.classified(spark, small).toPandas()
    dropped = {(r.frame_idx, r.drop_det) for r in pairs.itertuples() if r.drop_det == r.drop_det and r.drop_det is not None}
    parts = pairs[pairs.rule == "B"].copy()
    first = parts.part_det == parts.a_det_idx
    parts["part"], parts["whole"] = parts.a_concept.where(first, parts.b_concept), parts.b_concept.where(first, parts.a_concept)
    parts["whole_det"] = parts.b_det_idx.where(first, parts.a_det_idx)
    named = QD.D.part_quorum(QD.classified(spark, small), 2).toPandas()
    got = {(r.frame_idx, r.det_idx, r.action) for r in QD.D.drop_parts(QD.classified(spark, small), QD.D.part_quorum(QD.classified(spark, small), 2), QD.RANKS).collect()}
    quorum, want = {(r.part_concept, r.whole_concept) for r in named.itertuples()}, set()
    for f, rows in parts.groupby("frame_idx"):
        gone = set()
        for r in sorted(rows.itertuples(), key=lambda r: (r.a_det_idx, r.b_det_idx)):
            used = {(f, r.part_det), (f, r.whole_det)}
            if (r.part, r.whole) not in quorum or used & dropped or {r.part_det, r.whole_det} & gone:
                continue
            up, down = QD.RANKS.get(r.part), QD.RANKS.get(r.whole)
            if up is not None and (down is None or up < down):
                want.add((f, r.whole_det, "carve"))
            else:
                gone.add(r.part_det)
                want.add((f, r.part_det, "drop"))
    assert got == want and got


def test_exemplar_fold(spark, small):
    rows = [r for r in B.detection(spark, small).orderBy("frame_idx", "source", "det_idx").collect() if r.source != "text"]
    kept = {}
    for r in rows:
        mine = kept.setdefault((r.frame_idx, r.source), [])
        for i, k in enumerate(mine):
            inter = max(min(r.x2, k.x2) - max(r.x1, k.x1), 0) * max(min(r.y2, k.y2) - max(r.y1, k.y1), 0)
            if inter >= 0.6 * ((r.x2 - r.x1) * (r.y2 - r.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - inter):
                mine[i] = r if r.score > k.score else k
                break
        else:
            mine.append(r)
    assert {r.det_idx for r in Q["J21_exemplar_fold"](spark, small).collect()} == {r.det_idx for v in kept.values() for r in v}


def test_oriented_boxes(spark, small, scene_points):
    got = {r.instance_id: r for r in C.oriented_boxes(B.instance(spark, small), "instance_id").collect()}
    for k, g in scene_points.groupby(scene_points.part % 40):
        x, w = g[["x", "y", "z"]].to_numpy(), g.opacity.to_numpy()
        r = got[k]
        assert r.mode == "gravity"  # these points fill the scene
        axes = np.array(r.axes).reshape(3, 3)
        c = (x - np.average(x, axis=0, weights=w))[:, ::2]
        cov = (c * w[:, None]).T @ c / w.sum()
        main = np.linalg.eigh(cov)[1][:, 1]
        assert abs(abs(axes[0, ::2] @ main) - 1) < 1e-6 and np.allclose(axes @ axes.T, np.eye(3)) and np.allclose(axes[1], [0, 1, 0])
        along = x @ axes.T
        assert np.allclose([r.lo0, r.hi0, r.lo1, r.hi1, r.lo2, r.hi2], np.stack([along.min(0), along.max(0)], axis=1).ravel())


def test_tilt_search(spark, small, scene_points):
    y, x, w = (scene_points[c].to_numpy() for c in ("y", "x", "opacity"))
    best, reach = 0.0, 15.0
    for step in (5.0, 1.0, 0.25):
        scores = []
        for i in range(-round(reach / step), round(reach / step) + 1):
            a = best + step * i
            h = y * math.cos(math.radians(a)) - x * math.sin(math.radians(a))
            lo, hi = np.quantile(h, [0.01, 0.99])
            inside = (h >= lo) & (h <= hi)
            bins = np.minimum(np.floor((h[inside] - lo) / ((hi - lo) / 40)), 39).astype(int)
            mass = np.bincount(bins, weights=w[inside])
            scores.append((-mass.max() / mass.sum(), abs(a), a))
        best, reach = min(scores)[2], step
    assert Q["I14_tilt_search"](spark, small).first().angle == best


def test_plane_fit(spark, small, scene_points):
    x = scene_points[["x", "z"]].to_numpy()
    y, keep = scene_points.y.to_numpy(), slice(None)
    m = np.c_[x, np.ones(len(x))]
    for k in range(5):
        plane = np.linalg.lstsq(m[keep], y[keep], rcond=None)[0]
        off = np.abs(y - m @ plane)
        keep = off <= np.median(off) * 3 * 1.4826
    p = P.fit_plane(B.gaussian(spark, small))
    assert np.allclose([p.a, p.b, p.c], plane, atol=1e-9)
    tilted = spark.createDataFrame([(float(i % 10), 0.1 * (i % 10) - 0.2 * (i // 10) + (5.0 if i % 17 == 0 else 0.001 * (i % 3)), float(i // 10)) for i in range(100)], "x double, y double, z double")
    p = P.fit_plane(tilted)
    assert abs(p.a - 0.1) < 2e-3 and abs(p.b + 0.2) < 2e-3


def test_two_means_and_splits_cover_every_point(spark, small):
    halves = Q["I10_two_means"](spark, small).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("side").alias("sides")).collect()
    assert sum(r.n for r in halves) == B.gaussian(spark, small).count() and {r.sides for r in halves} == {2}
    sides = Q["I11_evidence_bisect"](spark, small)
    assert sides.count() == sides.select("class_id", "gid").distinct().count() > 0


def test_affinity_of_a_point_in_many_detections(spark):
    rows = [(0, 1, d, 0.5 + d / 100) for d in range(30)]
    sup = spark.createDataFrame(rows, "class_id long, gid long, det long, f double")
    assert A.affinity(sup).count() == 30 * 29 // 2
