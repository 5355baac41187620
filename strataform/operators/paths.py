"""Camera paths through a scene: positions from free cells, views about each, and repair of gaps.

Grids and poses are small; the points they come from are aggregated in Spark first (see points).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.operators import clustering, points
from strataform.operators.projection import MAX_FRAMES


def yaw_scores(positions: DataFrame, occupied: DataFrame, steps: int, reach: int) -> DataFrame:
    """(i, j, yaw, score): cells to the first occupied one, for `steps` yaws about each position."""
    rays = F.array(*(F.struct(F.lit(k).cast("long").alias("yaw"), F.lit(math.cos(2 * math.pi * k / steps)).alias("dx"), F.lit(math.sin(2 * math.pi * k / steps)).alias("dz")) for k in range(steps)))
    walk = positions.select("i", "j").withColumn("r", F.explode(rays)).withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    walk = walk.select("i", "j", "r.yaw", "s", F.floor(F.col("i") + F.col("r.dx") * F.col("s") + 0.5).alias("ci"), F.floor(F.col("j") + F.col("r.dz") * F.col("s") + 0.5).alias("cj"))
    hit = walk.join(occupied.select(F.col("i").alias("ci"), F.col("j").alias("cj")), ["ci", "cj"], "left_semi").groupBy("i", "j", "yaw").agg(F.min("s").alias("s"))
    every = positions.select("i", "j").withColumn("yaw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long"))))
    return every.join(hit, ["i", "j", "yaw"], "left").select("i", "j", "yaw", F.coalesce("s", F.lit(reach)).cast("double").alias("score"))


def poses(views: DataFrame, origin: Sequence[float], cell: float, height: float, steps: int) -> DataFrame:
    """World poses (id, px, py, pz, c, s) of views (i, j, yaw) at cell centres."""
    turn = 2 * math.pi / steps
    return views.select((F.col("i") * 1_000_000 + F.col("j") * 1_000 + F.col("yaw")).alias("id"), (F.lit(origin[0]) + (F.col("i") + 0.5) * cell).alias("px"), F.lit(height).alias("py"), (F.lit(origin[1]) + (F.col("j") + 0.5) * cell).alias("pz"), F.cos(F.col("yaw") * turn).alias("c"), F.sin(F.col("yaw") * turn).alias("s"))


def inside(cells: DataFrame, occupied: DataFrame, dims: tuple[int, int], origin, cell: float, height: float, clearance: int = 1, enclosed_by: int = 5, stands: int = 12, views: int = 4, steps: int = 36, reach: int = 20) -> DataFrame:
    """Interior path: free cells enclosed by walls, spread out, each looking along its longest, well separated sight lines."""
    free = points.clearance(cells, occupied, clearance).join(points.enclosed(dims, occupied, enclosed_by).select("i", "j"), ["i", "j"], "left_semi")
    stand = clustering.farthest(free, stands).select("i", "j")
    best = clustering.spread_picks(yaw_scores(stand, occupied, steps, reach), ["i", "j"], views, max(1, steps // (2 * views)), steps)
    return poses(best, origin, cell, height, steps)


def ground(cells: DataFrame, mass: DataFrame, origin, cell: float, heights: DataFrame, eye: float, limits: Sequence[float], clearances: Sequence[int], least: int, stands: int = 12, views: int = 4, steps: int = 36, reach: int = 20) -> DataFrame:
    """Outdoor path: the largest clearance and strictest mass limit that leave enough cells; cameras stand above their own ground."""
    tried = []
    for c in clearances:
        for k, limit in enumerate(limits):
            free = points.clearance(cells, mass.filter(F.col("mass") > limit), c)
            tried.append(free.agg(F.count("*").alias("free")).select(F.lit(c).alias("clearance"), F.lit(k).alias("percent"), "free"))
    counts = tried[0]
    for t in tried[1:]:
        counts = counts.unionByName(t)
    row = points.strictest(counts, least).first()
    if row is None:
        return poses(cells.limit(0).withColumn("yaw", F.lit(0).cast("long")), origin, cell, eye, steps)
    blocked = mass.filter(F.col("mass") > limits[row.percent])
    stand = clustering.farthest(points.clearance(cells, blocked, row.clearance), stands).select("i", "j")
    best = clustering.spread_picks(yaw_scores(stand, blocked, steps, reach), ["i", "j"], views, max(1, steps // (2 * views)), steps)
    out = poses(best.join(heights.select("i", "j", "ground"), ["i", "j"], "left"), origin, cell, eye, steps)
    lift = best.join(heights.select("i", "j", "ground"), ["i", "j"], "left").select((F.col("i") * 1_000_000 + F.col("j") * 1_000 + F.col("yaw")).alias("id"), F.coalesce("ground", F.lit(0.0)).alias("g"))
    return out.join(lift, "id").withColumn("py", F.col("py") + F.col("g")).drop("g")


def orbit(points_: DataFrame, n: int, height: float, factor: float = 1.2) -> DataFrame:
    """n poses on a circle about the weighted centre, looking inward."""
    o = points.orbit(points_).first()
    rows = []
    for k in range(n):
        a = 2 * math.pi * k / n
        rows.append((k, o.cx + factor * o.radius * math.cos(a), height, o.cz + factor * o.radius * math.sin(a), -math.cos(a), -math.sin(a)))
    return points_.sparkSession.createDataFrame(rows, "id long, px double, py double, pz double, c double, s double")


def aimed(targets: DataFrame, free: DataFrame, least: float, prefer: float) -> DataFrame:
    """Per target (target, x, z) the free position (pos, px, pz) beyond `least` that is nearest the preferred distance, looking at it.

    Positions are cells where a camera may stand: up to `MAX_FRAMES` are broadcast. The choice is one map-side aggregate.
    """
    few = free.limit(MAX_FRAMES + 1).count() <= MAX_FRAMES
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("z") - F.col("pz"), 2))
    near = targets.crossJoin(F.broadcast(free) if few else free).withColumn("d", d).filter(F.col("d") > least)
    best = near.groupBy("target").agg(F.min_by(F.struct("pos", "px", "pz", "d", "x", "z"), F.struct(F.abs(F.col("d") - prefer), "pos")).alias("b")).select("target", "b.*")
    return best.select("target", "pos", "px", "pz", ((F.col("x") - F.col("px")) / F.col("d")).alias("c"), ((F.col("z") - F.col("pz")) / F.col("d")).alias("s"))


def repair(points_: DataFrame, free: DataFrame, visible_of, start: DataFrame, target: float, rounds: int, voxel: float, each: int, least: float, prefer: float) -> DataFrame:
    """Adds views aimed at the largest unseen voxels until enough points are seen or rounds run out.

    visible_of(poses) gives (frame_idx, gid); rendering proper is outside. A round is one
    aggregation of what is unseen; the driver keeps a few targets.
    """
    views = start
    for k in range(rounds):
        seen = visible_of(views).select("gid").distinct()
        unseen = points_.join(seen, "gid", "left_anti")
        n, left = points_.count(), unseen.count()
        if not n or 1 - left / n >= target:
            break
        gaps = points.gap_clusters(unseen, voxel, each).select((F.lit((k + 1) * 1_000) + F.monotonically_increasing_id()).alias("target"), ((F.col("vx") + 0.5) * voxel).alias("x"), ((F.col("vz") + 0.5) * voxel).alias("z"))
        new = aimed(gaps, free, least, prefer).collect()  # at most `each` rows
        if not new:
            break
        height = views.agg(F.avg("py")).first()[0]
        first = views.agg(F.max("id")).first()[0] + 1
        added = points_.sparkSession.createDataFrame([(first + q, r.px, height, r.pz, r.c, r.s) for q, r in enumerate(new)], "id long, px double, py double, pz double, c double, s double")
        views = views.unionByName(added)
    return views
