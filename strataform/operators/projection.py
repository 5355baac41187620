"""Cameras and poses: projection, visibility, coverage, pose algebra and frame quality.

A frame stands at (px, py, pz) and looks along (c, s) in the ground plane, or has a 3x3 rotation;
frames of one scene are few (at most some hundreds), points are not. Points meet frames in a
nested-loop join that reads the points once; only what is visible leaves it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.numeric import truncate

AXES = ("x", "y", "z")
#: Frames whose rows are broadcast to the cells of a projection; more are joined without.
MAX_FRAMES = 10_000


def with_intrinsics(frames: DataFrame, camera: Mapping[str, float]) -> DataFrame:
    """Each frame's own fx, fy, cx, cy, width and height, or else the camera's."""
    out = frames
    for k in ("fx", "fy", "cx", "cy", "width", "height"):
        own = F.col(k) if k in frames.columns else F.lit(None).cast("double")
        out = out.withColumn(k, F.coalesce(own, F.lit(float(camera[k]))))
    return out


def fov_intrinsics(width: int, height: int, fov_deg: float) -> dict[str, float]:
    import math

    f = width / 2 / math.tan(math.radians(fov_deg) / 2)
    return {"width": width, "height": height, "fx": f, "fy": f, "cx": width / 2, "cy": height / 2}


def _in_camera(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Depth, right and down of a place in a frame's camera."""
    dx, dy, dz = x - F.col("px"), y - F.col("py"), z - F.col("pz")
    return dx * F.col("c") + dz * F.col("s"), dz * F.col("c") - dx * F.col("s"), -dy


def cells_in_view(cells: DataFrame, frames: DataFrame, near: float, size: float) -> DataFrame:
    """Cells (k0, k1, k2) with the frames that may see a part of them: the ball about a cell meets the frustum.

    The sides of the frustum are planes through the camera; a pixel counts from -1, as truncation moves it to 0.
    """
    depth, right, down = _in_camera(*((F.col(f"k{k}") + 0.5) * size for k in range(3)))
    radius = size * (3**0.5) / 2 * (1 + 1e-9)
    keep = depth + radius > near
    for f, side, c, n in (("fx", right, "cx", "width"), ("fy", down, "cy", "height")):
        for sign, reach in ((1, F.col(c) + 1), (-1, F.col(n) - F.col(c))):
            keep = keep & (sign * F.col(f) * side + reach * depth + radius * F.sqrt(F.col(f) * F.col(f) + reach * reach) > 0)
    few = frames.limit(MAX_FRAMES + 1).count() <= MAX_FRAMES
    return cells.crossJoin(F.broadcast(frames) if few else frames).filter(keep)


def project(points: DataFrame, frames: DataFrame, near: float, size: float = 1.0) -> DataFrame:
    """(frame_idx, gid, u, v, depth) of points in front of the near plane and inside the image; u and v truncated towards zero.

    Frames meet occupied cells of `size`, and points only the frames that may see their cell.
    """
    keys = [f"k{k}" for k in range(3)]
    keyed = points.select("gid", *AXES, *(F.floor(F.col(a) / size).alias(k) for a, k in zip(AXES, keys, strict=True)))
    views = cells_in_view(keyed.select(*keys).distinct(), frames.select("frame_idx", "px", "py", "pz", "c", "s", "fx", "fy", "cx", "cy", "width", "height"), near, size)
    depth, right, down = _in_camera(*(F.col(a) for a in AXES))
    seen = keyed.join(views, keys).select("frame_idx", "gid", "fx", "fy", "cx", "cy", "width", "height", depth.alias("depth"), right.alias("right"), down.alias("down")).filter(F.col("depth") > near)
    out = seen.withColumn("u", truncate(F.col("fx") * F.col("right") / F.col("depth") + F.col("cx"))).withColumn("v", truncate(F.col("fy") * F.col("down") / F.col("depth") + F.col("cy")))
    inside = (F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height"))
    return out.filter(inside).select("frame_idx", "gid", "u", "v", "depth")


def depth_map(projected: DataFrame) -> DataFrame:
    """Nearest depth by pixel."""
    return projected.groupBy("frame_idx", "u", "v").agg(F.min("depth").alias("d"))


def visible(projected: DataFrame, depths: DataFrame, rel: float, absolute: float, min_points: int = 0) -> DataFrame:
    """Points not behind the depth map by more than the tolerance; frames with too few points are left out before the depth join."""
    rows = projected
    if min_points:
        enough = projected.groupBy("frame_idx").agg(F.count("*").alias("n")).filter(F.col("n") >= min_points)
        rows = projected.join(enough.select("frame_idx"), "frame_idx", "left_semi")
    return rows.join(depths, ["frame_idx", "u", "v"]).filter(F.col("depth") <= F.col("d") * (1 + rel) + absolute).drop("d")


def coverage(points: DataFrame, seen: DataFrame, ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row: share of points that at least k frames see; points that none sees count as zero."""
    counts = seen.groupBy("gid").agg(F.count("*").alias("n"))
    each = points.select("gid").join(counts, "gid", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return each.agg(*((F.count_if(F.col("n") >= k) / F.count("*")).alias(f"k{k}") for k in ks))


def quaternion_to_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Nine entries in row order, from a quaternion of length 1."""
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def matrix_to_quaternion(m: Sequence[Column]) -> list[Column]:
    """x, y, z, w from nine entries, around the largest of the four squared components."""
    a, b, c = m[0], m[4], m[8]
    tw, tx, ty, tz = 1 + a + b + c, 1 + a - b - c, 1 - a + b - c, 1 - a - b + c
    top = F.greatest(tw, tx, ty, tz)
    r = F.sqrt(top)
    h = F.lit(0.5) / r
    from_w = [(m[7] - m[5]) * h, (m[2] - m[6]) * h, (m[3] - m[1]) * h, 0.5 * r]
    from_x = [0.5 * r, (m[1] + m[3]) * h, (m[2] + m[6]) * h, (m[7] - m[5]) * h]
    from_y = [(m[1] + m[3]) * h, 0.5 * r, (m[5] + m[7]) * h, (m[2] - m[6]) * h]
    from_z = [(m[2] + m[6]) * h, (m[5] + m[7]) * h, 0.5 * r, (m[3] - m[1]) * h]
    return [F.when(top == tw, p).when(top == tx, q).when(top == ty, s).otherwise(t) for p, q, s, t in zip(from_w, from_x, from_y, from_z, strict=True)]


def quaternion_product(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """Hamilton product of two quaternions in w, x, y, z order."""
    w, x, y, z = a
    p, q, r, s = b
    return [w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p]


def rotate(matrix: Sequence[Sequence[float]], v: Sequence[Column]) -> list[Column]:
    return [sum((F.lit(float(r[k])) * v[k] for k in range(1, 3)), F.lit(float(r[0])) * v[0]) for r in matrix]


def normalised(v: Sequence[Column]) -> list[Column]:
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return [a / n for a in v]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def look_at(pos: Sequence[Column], target: Sequence[Column]) -> list[list[Column]]:
    """Right, down and forward of a camera with y up; looking straight up or down, up is nudged along x."""
    f = normalised([t - p for t, p in zip(target, pos, strict=True)])
    steep = F.abs(f[1]) > 0.999
    up = [F.when(steep, F.lit(1.0)).otherwise(0.0), F.when(steep, F.lit(0.0)).otherwise(1.0), F.lit(0.0)]
    right = normalised(cross(f, up))
    return [right, cross(f, right), f]


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check, in order, that fails; null if all pass."""
    out = F.when(~checks[0][1], F.lit(checks[0][0]))
    for name, ok in checks[1:]:
        out = out.when(~ok, F.lit(name))
    return out


def frame_quality(pixels: DataFrame, near_depth: float) -> DataFrame:
    """Per frame from pixels (frame_idx, u, v, grey, alpha, depth): coverage, median depth, spread, near alpha, sharpness.

    Sharpness is the mean absolute second difference along rows and columns.
    """
    from pyspark.sql.window import Window as W

    def second(line: str, step: str) -> Column:
        w = W.partitionBy("frame_idx", line).orderBy(step)
        return F.abs(F.lead("grey").over(w) - 2 * F.col("grey") + F.lag("grey").over(w))

    p = pixels.withColumn("du", second("v", "u")).withColumn("dv", second("u", "v"))
    return p.groupBy("frame_idx").agg(
        (F.count_if(F.col("alpha") > 0.5) / F.count("*")).alias("coverage"),
        F.percentile(F.when(F.col("alpha") > 0.5, F.col("depth")), F.lit(0.5)).alias("median_depth"),
        F.stddev_samp("grey").alias("spread"),
        F.avg(F.when(F.col("depth") < near_depth, F.col("alpha")).otherwise(0.0)).alias("near_alpha"),
        (F.avg("du") + F.avg("dv")).alias("sharpness"),
    )


def similar_poses(poses: DataFrame, others: DataFrame, min_distance: float, min_cos: float) -> DataFrame:
    """Poses (id, px, pz, c, s) with a pose of `others` nearby that looks the same way."""
    cell = lambda k: F.floor(F.col(k) / min_distance)
    step = F.array(*map(F.lit, (-1, 0, 1)))
    # poses nearer than the distance lie in the same or in adjacent cells of that size
    near = poses.withColumn("i", cell("px")).withColumn("j", cell("pz")).withColumn("a", F.explode(step)).withColumn("b", F.explode(step))
    near = near.withColumn("i", F.col("i") + F.col("a")).withColumn("j", F.col("j") + F.col("b")).drop("a", "b")
    o = others.select(F.col("id").alias("other"), *(F.col(k).alias(f"o_{k}") for k in ("px", "pz", "c", "s")), cell("px").alias("i"), cell("pz").alias("j"))
    close = (F.pow(F.col("px") - F.col("o_px"), 2) + F.pow(F.col("pz") - F.col("o_pz"), 2) < min_distance * min_distance) & (F.col("c") * F.col("o_c") + F.col("s") * F.col("o_s") > min_cos)
    return near.join(o, ["i", "j"]).filter((F.col("id") != F.col("other")) & close).groupBy("id").agg(F.min("other").alias("like"))


def pose_changes(saved: DataFrame, rendered: DataFrame, cols: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """(id, change): new, deleted or edited, by a full outer join of saved and rendered views."""
    r = rendered.select(F.col("id").alias("r_id"), *(F.col(c).alias(f"r_{c}") for c in cols))
    off = F.lit(False)
    for c in cols:
        off = off | (F.abs(F.col(c) - F.col(f"r_{c}")) > tolerance)
    change = F.when(F.col("r_id").isNull(), "new").when(F.col("id").isNull(), "deleted").when(off, "edited")
    return saved.join(r, F.col("id") == F.col("r_id"), "full").select(F.coalesce("id", "r_id").alias("id"), change.alias("change")).filter("change is not null")


def projected_boxes(seen: DataFrame, low: float = 0.03, high: float = 0.97) -> DataFrame:
    """Robust box by object and frame: percentiles of u and v."""
    q = lambda c, p, n: F.percentile(c, F.lit(p)).alias(n)
    return seen.groupBy("instance_id", "frame_idx").agg(q("u", low, "x1"), q("v", low, "y1"), q("u", high, "x2"), q("v", high, "y2"), F.count("*").alias("n"))


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes x1, y1, x2, y2."""
    ix = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    iy = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = ix * iy
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def padded_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, pad: float = 0.25, least: int = 24) -> list[Column]:
    """A crop around a box: padded, at least `least` pixels beyond it, clipped to the image."""
    mx, my = F.greatest((x2 - x1) * pad, F.lit(float(least))), F.greatest((y2 - y1) * pad, F.lit(float(least)))
    return [F.greatest(F.floor(x1 - mx), F.lit(0)).cast("long"), F.greatest(F.floor(y1 - my), F.lit(0)).cast("long"), F.least(F.ceil(x2 + mx), F.lit(width)).cast("long"), F.least(F.ceil(y2 + my), F.lit(height)).cast("long")]


def box_distance(x: Column, z: Column, boxes: Sequence[tuple[float, float, float, float, float]]) -> Column:
    """Signed distance to a union of ground rectangles (cx, cz, half x, half z, yaw); negative inside."""
    import math

    each = []
    for cx, cz, hx, hz, yaw in boxes:
        co, si = math.cos(yaw), math.sin(yaw)
        lx = (x - cx) * co + (z - cz) * si
        lz = (z - cz) * co - (x - cx) * si
        qx, qz = F.abs(lx) - hx, F.abs(lz) - hz
        outside = F.sqrt(F.pow(F.greatest(qx, F.lit(0.0)), 2) + F.pow(F.greatest(qz, F.lit(0.0)), 2))
        each.append(outside + F.least(F.greatest(qx, qz), F.lit(0.0)))
    return F.least(*each) if len(each) > 1 else each[0]


def smooth_step(d: Column, edge0: float, edge1: float) -> Column:
    t = F.least(F.greatest((d - edge0) / (edge1 - edge0), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def fade(distance: Column, near: float, far: float) -> Column:
    """Opacity of a label by distance: whole up to `near`, gone from `far` on, a straight line between."""
    return F.least(F.greatest(1 - (distance - near) / (far - near), F.lit(0.0)), F.lit(1.0))


def pick(points: DataFrame, origin: Sequence[float], direction: Sequence[float], size: float, limit: float = 0.5) -> DataFrame:
    """The first point along a ray at which accumulated opacity reaches `limit`.

    A point within `size` of the ray adds alpha = opacity * exp(-(d / size)^2 / 2); what is left
    after the points before it is the product of their 1 - alpha, as a running sum of logarithms.
    """
    from pyspark.sql.window import Window as W

    o, n = origin, sum(v * v for v in direction) ** 0.5
    u = [v / n for v in direction]
    rel = [F.col(a) - o[k] for k, a in enumerate("xyz")]
    t = rel[0] * u[0] + rel[1] * u[1] + rel[2] * u[2]
    d2 = rel[0] * rel[0] + rel[1] * rel[1] + rel[2] * rel[2] - t * t
    near = points.withColumn("t", t).withColumn("d2", F.greatest(d2, F.lit(0.0))).filter((F.col("t") > 0) & (F.col("d2") < size * size))
    alpha = F.least(F.col("opacity") * F.exp(-F.col("d2") / (2 * size * size)), F.lit(0.999))
    run = F.sum(F.log1p(-alpha)).over(W.orderBy("t", "gid").rowsBetween(W.unboundedPreceding, 0))
    return near.withColumn("acc", 1 - F.exp(run)).filter(F.col("acc") >= limit).orderBy("t", "gid").limit(1).select("gid", "t", "acc")
