"""Point scenes: robust bounds, weighted histograms, ground grids, neighbourhoods and regions of interest.

A point has gid, x, y (up), z and opacity. Grids lie over the two ground axes x and z; only cells
with points are rows, and a cell is dense only where an operator needs its empty neighbours.
Every aggregate combines map-side; grids and histograms are small however many points there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strataform.functions.numeric import bin_of, clamp, exact_sum, truncate
from strataform.functions.quantiles import exact_percentiles
from strataform.session import materialize

Box = tuple[str, Sequence[float], Sequence[float]]
AXES = ("x", "y", "z")


def in_boxes(boxes: Sequence[Box], margin: float = 0.0, axes: Sequence[str] = AXES) -> Column:
    """Whether a point lies in a box, edges included; literals, so the test reaches the scan."""
    out = F.lit(False)
    for _, low, high in boxes:
        inside = F.lit(True)
        for a, lo, hi in zip(axes, low, high, strict=True):
            inside = inside & F.col(a).between(lo - margin, hi + margin)
        out = out | inside
    return out


def robust_bounds(points: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: low and high percentile of every axis."""
    found = exact_percentiles(points, {f"{a}_{n}": (F.col(a), p) for a in AXES for p, n in ((low, "lo"), (high, "hi"))})
    return points.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def histogram(points: DataFrame, value: Column, low: float, width: float, bins: int, weight: Column | None = None) -> DataFrame:
    """(bin, weight) of values in range; the right edge belongs to the last bin."""
    rows = points.select(bin_of(value, low, width, bins).alias("bin"), (F.lit(1.0) if weight is None else weight).alias("w")).filter("bin is not null")
    return rows.groupBy("bin").agg(exact_sum(F.col("w")).alias("weight"))


def peak(hist: DataFrame, low: float, width: float) -> DataFrame:
    """The heaviest bin (the lowest of equals), its share and the value at its middle."""
    return hist.agg(F.max_by("bin", F.struct("weight", -F.col("bin"))).alias("bin"), F.max("weight").alias("weight"), exact_sum(F.col("weight")).alias("total")).select("bin", (F.lit(low) + (F.col("bin") + 0.5) * width).alias("height"), (F.floor(F.col("weight") / F.col("total") * 1e6 + 0.5) / 1e6).alias("share"))


def footprint(points: DataFrame, origin: tuple[float, float], cell: float, dims: tuple[int, int], weight: str = "opacity") -> DataFrame:
    """Weight by ground cell; points outside fall into the border cells."""
    return points.groupBy(cell_of("x", origin[0], cell, dims[0]).alias("i"), cell_of("z", origin[1], cell, dims[1]).alias("j")).agg(exact_sum(F.col(weight)).alias("density"))


def cell_of(axis: str, origin: float, cell: float, n: int) -> Column:
    return clamp(F.floor((F.col(axis) - origin) / cell), 0, n - 1).cast("long")


def obstacle_maps(points: DataFrame, origin: tuple[float, float], cell: float, dims: tuple[int, int], floor: float, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """By cell: mass between two heights above the floor, low and high, all mass, and its mean height."""
    h = F.col("y") - floor
    part = lambda a, b: exact_sum(F.when(h.between(a, b), F.col("opacity")).otherwise(0.0))
    grouped = points.groupBy(cell_of("x", origin[0], cell, dims[0]).alias("i"), cell_of("z", origin[1], cell, dims[1]).alias("j"))
    out = grouped.agg(part(*low).alias("low_mass"), part(*high).alias("high_mass"), exact_sum(F.col("opacity")).alias("mass"), exact_sum(F.col("opacity") * h).alias("moment"))
    return out.select("i", "j", "low_mass", "high_mass", "mass", (F.floor(F.col("moment") / F.col("mass") * 1e4 + 0.5) / 1e4).alias("mean_height"))


def _settled(c: Column) -> Column:
    """Without the noise that interpolation leaves in the last digits."""
    return F.floor(c * 1e8 + 0.5) / 1e8


def ground_envelope(points: DataFrame, origin: tuple[float, float], cell: float, dims: tuple[int, int], percent: float, min_points: int) -> DataFrame:
    """Low percentile of height by cell, for cells with enough points."""
    out = points.groupBy(cell_of("x", origin[0], cell, dims[0]).alias("i"), cell_of("z", origin[1], cell, dims[1]).alias("j")).agg(_settled(F.percentile("y", F.lit(percent))).alias("ground"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= min_points).select("i", "j", "ground")


OFFSETS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def neighbours(cells: DataFrame, value: str, radius: int = 1, centre: bool = False) -> DataFrame:
    """(i, j, value) of every neighbour of a cell, keyed by the cell: values are sent to their neighbours, no join."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if centre or (a, b) != (0, 0)]
    moves = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around))
    return cells.withColumn("__m", F.explode(moves)).select((F.col("i") + F.col("__m.a")).alias("i"), (F.col("j") + F.col("__m.b")).alias("j"), F.col(value))


def smooth(cells: DataFrame, value: str = "ground") -> DataFrame:
    """The median of each cell and its neighbours, for cells that are there."""
    med = neighbours(cells, value, centre=True).groupBy("i", "j").agg(_settled(F.percentile(value, F.lit(0.5))).alias(value))
    return cells.select("i", "j").join(med, ["i", "j"])


def fill_holes(cells: DataFrame, dims: tuple[int, int], value: str = "ground", least: int = 3) -> DataFrame:
    """Missing cells with at least `least` neighbours get their median."""
    med = neighbours(cells, value).groupBy("i", "j").agg(_settled(F.percentile(value, F.lit(0.5))).alias(value), F.count("*").alias("n"))
    new = med.filter((F.col("n") >= least) & F.col("i").between(0, dims[0] - 1) & F.col("j").between(0, dims[1] - 1)).join(cells.select("i", "j"), ["i", "j"], "left_anti")
    return cells.select("i", "j", value).unionByName(new.select("i", "j", value))


def dilate(cells: DataFrame, dims: tuple[int, int], radius: int) -> DataFrame:
    """Cells within `radius` king's moves of a cell."""
    out = neighbours(cells.select("i", "j", F.lit(True).alias("on")), "on", radius, centre=True)
    return out.filter(F.col("i").between(0, dims[0] - 1) & F.col("j").between(0, dims[1] - 1)).select("i", "j").distinct()


def clearance(cells: DataFrame, occupied: DataFrame, radius: int) -> DataFrame:
    """Cells with no occupied cell in the square of `radius` about them."""
    near = neighbours(occupied.select("i", "j", F.lit(True).alias("on")), "on", radius, centre=True).select("i", "j").distinct()
    return cells.join(near, ["i", "j"], "left_anti")


def enclosed(dims: tuple[int, int], occupied: DataFrame, hits: int) -> DataFrame:
    """Free cells from which at least `hits` of 8 rays meet an occupied cell.

    Whether one lies ahead is a running maximum along rows, columns and both diagonals: four line
    families, two directions each.
    """
    spark = occupied.sparkSession
    grid = spark.range(dims[0]).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(dims[1] - 1)))).withColumn("j", F.col("j").cast("long"))
    cells = grid.join(occupied.select("i", "j", F.lit(1).alias("on")), ["i", "j"], "left").fillna(0, ["on"])
    total = F.lit(0)
    for line, step in ((F.col("i"), F.col("j")), (F.col("j"), F.col("i")), (F.col("i") - F.col("j"), F.col("i")), (F.col("i") + F.col("j"), F.col("i"))):
        w = W.partitionBy(line).orderBy(step)
        ahead = F.max("on").over(w.rowsBetween(1, W.unboundedFollowing))
        behind = F.max("on").over(w.rowsBetween(W.unboundedPreceding, -1))
        total = total + F.coalesce(ahead, F.lit(0)) + F.coalesce(behind, F.lit(0))
    return cells.withColumn("hits", total).filter((F.col("on") == 0) & (F.col("hits") >= hits)).select("i", "j", F.col("hits").cast("long").alias("hits"))


def above_ground(points: DataFrame, ground: DataFrame, origin, cell, dims, low: float, high: float) -> DataFrame:
    """Mass of points between two heights above their own cell's ground."""
    keyed = points.withColumn("i", cell_of("x", origin[0], cell, dims[0])).withColumn("j", cell_of("z", origin[1], cell, dims[1]))
    h = F.col("y") - F.col("ground")
    return keyed.join(ground, ["i", "j"]).groupBy("i", "j").agg(exact_sum(F.when(h.between(low, high), F.col("opacity")).otherwise(0.0)).alias("mass"))


def relief(ground: DataFrame, mass: DataFrame, dims: tuple[int, int], limit: float) -> DataFrame:
    """One row: 5th and 95th percentile of ground, their difference, shares of populated and standable cells."""
    ground = materialize(ground.sparkSession, ground, "ground")
    e = exact_percentiles(ground, {"low": (F.col("ground"), 0.05), "high": (F.col("ground"), 0.95)})
    g = ground.agg(F.lit(e["low"]).alias("low"), F.lit(e["high"]).alias("high"), F.count("*").alias("n"))
    free = mass.agg(F.count_if(F.col("mass") <= limit).alias("free"))
    return g.crossJoin(free).select(_settled(F.col("low")).alias("low"), _settled(F.col("high")).alias("high"), (F.floor((F.col("high") - F.col("low")) * 1e6 + 0.5) / 1e6).alias("relief"), (F.col("n") / float(dims[0] * dims[1])).alias("populated"), (F.col("free") / F.col("n")).alias("standable"))


def gap_clusters(points: DataFrame, size: float, top: int) -> DataFrame:
    """Largest voxels of uncovered points; voxel numbers are truncated towards zero."""
    v = [truncate(F.col(a) / size).alias(f"v{a}") for a in AXES]
    return points.groupBy(*v).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vx", "vy", "vz").limit(top)


def otsu(values: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """Threshold on log1p(value) that separates two classes best; the lowest of equals.

    Only the histogram, `bins` rows, passes through the ordered window.
    """
    v = F.floor(F.log1p(F.col(column)) * 1e6 + 0.5) / 1e6
    logs = values.select(v.alias("v"))
    low, high = logs.agg(F.min("v"), F.max("v")).first()
    if low is None or high == low:
        return logs.limit(0).select(F.col("v").alias("threshold"))
    width = (high - low) / bins
    h = logs.groupBy(F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    full = values.sparkSession.range(bins).select(F.col("id").alias("bin")).join(h, "bin", "left").fillna(0, ["n"])
    mid = F.lit(low) + (F.col("bin") + 0.5) * width
    w = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    s = full.select("bin", mid.alias("mid"), F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * (F.col("bin") + 0.5)).over(w).alias("m0"), F.sum("n").over(W.partitionBy()).alias("nt"), F.sum(F.col("n") * (F.col("bin") + 0.5)).over(W.partitionBy()).alias("mt"))
    n1 = F.col("nt") - F.col("n0")
    between = F.when((F.col("n0") > 0) & (n1 > 0), F.col("n0") * n1 * F.pow(F.col("m0") / F.col("n0") - (F.col("mt") - F.col("m0")) / n1, 2)).otherwise(0.0)
    return s.select("mid", between.alias("b"), "bin").agg(F.max_by("mid", F.struct("b", -F.col("bin"))).alias("mid")).select((F.floor(F.col("mid") * 1e6 + 0.5) / 1e6).alias("threshold"))


def drop_to_next(hist: DataFrame, bins: int) -> DataFrame:
    """Each bin minus the next one; the largest drop tells how sharp a floor is."""
    full = hist.sparkSession.range(bins).select(F.col("id").alias("bin")).join(hist, "bin", "left").fillna(0.0, ["weight"])
    return full.select("bin", "weight", (F.col("weight") - F.lead("weight", 1, 0.0).over(W.orderBy("bin"))).alias("drop"))


def top_share(hist: DataFrame, k: int = 2) -> DataFrame:
    """Share of the k heaviest bins."""
    ranked = hist.withColumn("r", F.row_number().over(W.orderBy(F.desc("weight"), "bin")))
    return ranked.agg((F.sum(F.when(F.col("r") <= k, F.col("weight"))) / F.sum("weight")).alias("share"))


def sum_pool(cells: DataFrame, value: str, factor: int) -> DataFrame:
    """Coarser grid: sums over factor by factor cells."""
    return cells.groupBy(F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j")).agg(exact_sum(F.col(value)).alias(value))


def pool_factor(dims: tuple[int, int], most: int = 360) -> int:
    """The least factor at which no side has more than `most` cells."""
    return max(1, -(-max(dims) // most))


def footprint_share(boxes: Sequence[Box], extent: tuple[float, float]) -> float:
    """Area of boxes over the ground extent, at most 1."""
    area = sum((h[0] - lo[0]) * (h[2] - lo[2]) for _, lo, h in boxes)
    return min(area / (extent[0] * extent[1]), 1.0)


def orbit(points: DataFrame) -> DataFrame:
    """One row: weighted ground centre and the 90th percentile of distance from it."""
    c = points.agg(exact_sum(F.col("opacity")).alias("w"), exact_sum(F.col("x") * F.col("opacity")).alias("sx"), exact_sum(F.col("z") * F.col("opacity")).alias("sz")).first()
    cx, cz = c.sx / c.w, c.sz / c.w
    d = F.sqrt((F.col("x") - cx) * (F.col("x") - cx) + (F.col("z") - cz) * (F.col("z") - cz))
    radius = exact_percentiles(points, {"radius": (d, 0.9)})["radius"]
    return points.sparkSession.createDataFrame([(cx, cz, radius)], "cx double, cz double, radius double").select(*((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("cx", "cz", "radius")))


def height_bins(points: DataFrame, low: float = 0.002, high: float = 0.998, bins: int = 120) -> DataFrame:
    """(bin, weight): heights between two percentiles, in equal bins; the right edge belongs to the last one."""
    e = exact_percentiles(points, {"lo": (F.col("y"), low), "hi": (F.col("y"), high)})
    if e["lo"] is None:
        return points.limit(0).select(F.lit(0).cast("long").alias("bin"), F.col("opacity").alias("weight"))
    rows = points.filter(F.col("y").between(e["lo"], e["hi"]))
    at = F.least(F.floor((F.col("y") - e["lo"]) / ((e["hi"] - e["lo"]) / bins)), F.lit(bins - 1)) if e["hi"] > e["lo"] else F.lit(0)
    return rows.groupBy(at.cast("long").alias("bin")).agg(exact_sum(F.col("opacity")).alias("weight"))


def up_axis(points: DataFrame) -> DataFrame:
    """The axis of least robust extent (x, y, z on ties), and the sign that puts the heavier end of it below."""
    b = robust_bounds(points)
    extents = F.array(*(F.struct((F.col(f"{a}_hi") - F.col(f"{a}_lo")).alias("extent"), F.lit(k).alias("k"), F.lit(a).alias("axis"), F.col(f"{a}_lo").alias("lo"), F.col(f"{a}_hi").alias("hi")) for k, a in enumerate(AXES)))
    best = b.select(F.array_min(extents).alias("e")).select("e.*").first()
    third = (best.hi - best.lo) / 3
    v = F.col(best.axis)
    mass = points.agg(exact_sum(F.when(v <= best.lo + third, F.col("opacity")).otherwise(0.0)).alias("low"), exact_sum(F.when(v >= best.hi - third, F.col("opacity")).otherwise(0.0)).alias("high"))
    return mass.select(F.lit(best.axis).alias("axis"), F.when(F.col("low") >= F.col("high"), F.lit(1)).otherwise(F.lit(-1)).alias("sign"))


def sight_lines(starts: DataFrame, occupied: DataFrame, di: int, dj: int, most: int) -> DataFrame:
    """Steps from each start cell to the first occupied cell in a direction, or `most`."""
    walk = starts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("i2", F.col("i") + F.col("step") * di).withColumn("j2", F.col("j") + F.col("step") * dj)
    hit = walk.join(occupied.select(F.col("i").alias("i2"), F.col("j").alias("j2")), ["i2", "j2"], "left_semi").groupBy("i", "j").agg(F.min("step").alias("steps"))
    return starts.select("i", "j").join(hit, ["i", "j"], "left").select("i", "j", F.coalesce("steps", F.lit(most)).cast("long").alias("steps"))


def clear_pairs(pairs: DataFrame, occupied: DataFrame) -> DataFrame:
    """Pairs of cells (i, j, i2, j2) whose straight line crosses no occupied cell, ends not counted."""
    n = F.greatest(F.abs(F.col("i2") - F.col("i")), F.abs(F.col("j2") - F.col("j")))
    inner = pairs.withColumn("n", n).filter("n > 1").withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("s") / F.col("n") + 0.5).cast("long")
    samples = inner.withColumn("ci", at("i", "i2")).withColumn("cj", at("j", "j2"))
    blocked = samples.join(occupied.select(F.col("i").alias("ci"), F.col("j").alias("cj")), ["ci", "cj"], "left_semi").select("i", "j", "i2", "j2").distinct()
    return pairs.join(blocked, ["i", "j", "i2", "j2"], "left_anti")


def strictest(counts: DataFrame, least: int) -> DataFrame:
    """Of settings (clearance, percent, free): the first with enough free cells, larger clearance first, then smaller percent."""
    return counts.filter(F.col("free") >= least).orderBy(F.desc("clearance"), "percent").limit(1)


def hash_sample(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in order of a hash of gid: the same rows whatever the partitions."""
    return points.orderBy(F.md5(F.concat(F.col("gid").cast("string"), F.lit(f"|{seed}")).cast("binary")), "gid").limit(n)


def stride(points: DataFrame, every: int) -> DataFrame:
    return points.filter(F.col("gid") % every == 0)


@dataclass
class Plane:
    a: float
    b: float
    c: float


def fit_plane(points: DataFrame, rounds: int = 4, spread: float = 3 * 1.4826) -> Plane:
    """y = a x + b z + c by least squares, each round without rows beyond `spread` median deviations.

    A round is one aggregation of normal-equation sums and one of the median.
    """
    import numpy as np

    rows, plane = points, Plane(0.0, 0.0, 0.0)
    for k in range(rounds + 1):
        x, y, z = (F.col(a) for a in AXES)
        s = rows.agg(F.sum(x * x).alias("xx"), F.sum(x * z).alias("xz"), F.sum(z * z).alias("zz"), F.sum(x).alias("x"), F.sum(z).alias("z"), F.count("*").alias("n"), F.sum(x * y).alias("xy"), F.sum(z * y).alias("zy"), F.sum(y).alias("y")).first()
        m = np.array([[s.xx, s.xz, s.x], [s.xz, s.zz, s.z], [s.x, s.z, s.n]])
        plane = Plane(*np.linalg.lstsq(m, np.array([s.xy, s.zy, s.y]), rcond=None)[0].tolist())
        if k == rounds:
            break
        off = F.abs(F.col("y") - (F.col("x") * plane.a + F.col("z") * plane.b + plane.c))
        limit = exact_percentiles(points, {"median": (off, 0.5)})["median"] * spread
        if not limit:
            break
        rows = points.filter(off <= limit)
    return plane


def tilt_search(points: DataFrame, axis: str = "z", span: float = 15.0, steps: Sequence[float] = (5.0, 1.0, 0.25), bins: int = 40) -> DataFrame:
    """The tilt about a ground axis that makes the lowest layer sharpest, found coarse to fine.

    Candidate angles go through one aggregation a round; the driver keeps one number.
    """
    import math

    best = 0.0
    other = "x" if axis == "z" else "z"
    for k, step in enumerate(steps):
        reach = span if k == 0 else steps[k - 1]
        angles = [best + step * i for i in range(-round(reach / step), round(reach / step) + 1)]
        tilted = lambda a: F.col("y") * math.cos(math.radians(a)) - F.col(other) * math.sin(math.radians(a))  # noqa: E731, B023
        ends = exact_percentiles(points, {f"{i} {c}": (tilted(a), p) for i, a in enumerate(angles) for c, p in (("lo", 0.01), ("hi", 0.99))})
        # an angle's range is a literal of its candidate
        cand = F.array(*(F.struct(F.lit(a).alias("angle"), tilted(a).alias("h"), F.lit(ends[f"{i} lo"]).alias("lo"), F.lit(ends[f"{i} hi"]).alias("hi")) for i, a in enumerate(angles)))
        turned = points.select(F.explode(cand).alias("t"), "opacity").select("t.*", "opacity").filter("h between lo and hi")
        hist = turned.groupBy("angle", F.least(F.floor((F.col("h") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("long").alias("bin")).agg(exact_sum(F.col("opacity")).alias("weight"))
        total = hist.groupBy("angle").agg(F.max("weight").alias("top"), F.sum("weight").alias("all"))
        row = total.orderBy(F.desc(F.col("top") / F.col("all")), F.abs("angle"), "angle").first()
        best = row.angle
    return points.sparkSession.createDataFrame([(best,)], "angle double")
