"""Queries on point scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import points as P
from strataform.plans import bindings as B
from strataform.plans.bindings import with_
from strataform.plans.query import query

CELL, DIMS, ORIGIN = 0.5, (21, 21), (0.0, 0.0)
SQL = B.SQL
_I = "CAST(least(greatest(floor(x / 0.5), 0), 20) AS BIGINT)"
_J = "CAST(least(greatest(floor(z / 0.5), 0), 20) AS BIGINT)"
_ES = lambda c: f"sum(CAST({c} AS DECIMAL(18,6)))::DOUBLE"
SQL["cells"] = f"SELECT {_I} AS i, {_J} AS j, {_ES('opacity')} AS density FROM gaussian GROUP BY ALL"
B.USES["cells"] = ("gaussian",)
#: A finer grid, which has holes.
FINE, SIDE = 0.1, 101
FDIMS = (SIDE, SIDE)
_FI = f"CAST(least(greatest(floor(x / {FINE}::DOUBLE), 0), {SIDE - 1}) AS BIGINT)"
_FJ = f"CAST(least(greatest(floor(z / {FINE}::DOUBLE), 0), {SIDE - 1}) AS BIGINT)"
_IN = lambda i, j: f"{i} BETWEEN 0 AND {SIDE - 1} AND {j} BETWEEN 0 AND {SIDE - 1}"
SQL["fcells"] = f"SELECT {_FI} AS i, {_FJ} AS j, {_ES('opacity')} AS density FROM gaussian GROUP BY ALL"
B.USES["fcells"] = ("gaussian",)
SQL["ground"] = f"SELECT i, j, floor(quantile_cont(y, 0.05) * 1e8 + 0.5) / 1e8 AS ground FROM (SELECT {_FI} AS i, {_FJ} AS j, y FROM gaussian) GROUP BY i, j HAVING count(*) >= 2"
B.USES["ground"] = ("gaussian",)
SQL["off"] = "SELECT a, b FROM range(-1, 2) t(a), range(-1, 2) u(b)"


def fcells(s, d):
    return P.footprint(B.gaussian(s, d), ORIGIN, FINE, FDIMS)


def ground(s, d):
    return P.ground_envelope(B.gaussian(s, d), ORIGIN, FINE, FDIMS, 0.05, 2)


def r6(c, name):
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)


_Q = ", ".join(f"quantile_cont({a}, {p}) AS {a}_{n}" for a in "xyz" for p, n in ((0.01, "lo"), (0.99, "hi")))


@query("A03_robust_bounds", with_(f"SELECT {_Q} FROM gaussian", "gaussian"))
def a03(s, d):
    return P.robust_bounds(B.gaussian(s, d))


_HIST = lambda lo, w, n, v="y", src="gaussian": f"SELECT CAST(least(floor(({v} - {lo}) / {w}::DOUBLE), {n - 1}) AS BIGINT) AS bin, {_ES('opacity')} AS weight FROM {src} WHERE {v} >= {lo} AND {v} <= {lo} + {w}::DOUBLE * {n} GROUP BY 1"
_PEAK = lambda lo, w: f"SELECT bin, {lo} + (bin + 0.5::DOUBLE) * {w} AS height, floor(weight / total * 1e6 + 0.5) / 1e6 AS share FROM (SELECT *, sum(CAST(weight AS DECIMAL(18,6))) OVER ()::DOUBLE AS total FROM h) ORDER BY weight DESC, bin LIMIT 1"


@query("A04_floor_height", with_(f"+ h AS ({_HIST(0.0, 0.025, 32)}) {_PEAK(0.0, 0.025)}", "gaussian"))
def a04(s, d):
    return P.peak(P.histogram(B.gaussian(s, d), F.col("y"), 0.0, 0.025, 32, F.col("opacity")), 0.0, 0.025)


# the operator is the rule on a sample that a browser can hold: every 97th point
@query("A05_floor_of_sample", with_(f"+ sample AS (SELECT * FROM gaussian WHERE gid % 97 = 0), h AS ({_HIST(0.0, 0.05, 16, src='sample')}) {_PEAK(0.0, 0.05)}", "gaussian"))
def a05(s, d):
    return P.peak(P.histogram(P.stride(B.gaussian(s, d), 97), F.col("y"), 0.0, 0.05, 16, F.col("opacity")), 0.0, 0.05)


@query("A06_ceiling_height", with_(f"+ h AS ({_HIST(1.7, 0.025, 32)}), k AS ({_PEAK(1.7, 0.025)}) SELECT * FROM k WHERE share >= 0.02", "gaussian"))
def a06(s, d):
    return P.peak(P.histogram(B.gaussian(s, d), F.col("y"), 1.7, 0.025, 32, F.col("opacity")), 1.7, 0.025).filter("share >= 0.02")


@query("A07_footprint_density", with_("SELECT * FROM cells", "cells"))
def a07(s, d):
    return P.footprint(B.gaussian(s, d), ORIGIN, CELL, DIMS)


@query("A08_obstacle_maps", with_(f"""SELECT i, j, low_mass, high_mass, mass, floor(moment / mass * 1e4 + 0.5) / 1e4 AS mean_height FROM (SELECT {_I} AS i, {_J} AS j,
  {_ES('CASE WHEN y - 0.1 BETWEEN 0.2 AND 0.8 THEN opacity ELSE 0.0 END')} AS low_mass, {_ES('CASE WHEN y - 0.1 BETWEEN 1.2 AND 1.9 THEN opacity ELSE 0.0 END')} AS high_mass,
  {_ES('opacity')} AS mass, {_ES('opacity * (y - 0.1::DOUBLE)')} AS moment FROM gaussian GROUP BY ALL)""", "gaussian"))
def a08(s, d):
    return P.obstacle_maps(B.gaussian(s, d), ORIGIN, CELL, DIMS, 0.1, (0.2, 0.8), (1.2, 1.9))


@query("A10_ground_envelope", with_("SELECT * FROM ground", "ground"))
def a10(s, d):
    return ground(s, d)


SQL["gmass"] = f"SELECT g.i, g.j, {_ES('CASE WHEN y - ground BETWEEN 0.3 AND 1.8 THEN opacity ELSE 0.0 END')} AS mass FROM (SELECT {_FI} AS i, {_FJ} AS j, y, opacity FROM gaussian) p JOIN ground g ON p.i = g.i AND p.j = g.j GROUP BY ALL"
B.USES["gmass"] = ("ground",)


def gmass(s, d):
    return P.above_ground(B.gaussian(s, d), ground(s, d), ORIGIN, FINE, FDIMS, 0.3, 1.8)


@query("A11_mass_above_ground", with_("SELECT * FROM gmass", "gmass"))
def a11(s, d):
    return gmass(s, d)


@query("J25_ground_join", with_(f"SELECT gid, floor((y - ground) * 1e8 + 0.5) / 1e8 AS height FROM (SELECT gid, {_FI} AS i, {_FJ} AS j, y FROM gaussian) p JOIN ground USING (i, j)", "ground"))
def j25(s, d):
    keyed = B.gaussian(s, d).withColumn("i", P.cell_of("x", 0.0, FINE, SIDE)).withColumn("j", P.cell_of("z", 0.0, FINE, SIDE))
    return keyed.join(ground(s, d), ["i", "j"]).select("gid", (F.floor((F.col("y") - F.col("ground")) * 1e8 + 0.5) / 1e8).alias("height"))


@query("A12_relief", with_("SELECT floor(low * 1e8 + 0.5) / 1e8 AS low, floor(high * 1e8 + 0.5) / 1e8 AS high, floor((high - low) * 1e6 + 0.5) / 1e6 AS relief, n / 10201.0::DOUBLE AS populated, free / n::DOUBLE AS standable FROM (SELECT quantile_cont(ground, 0.05) AS low, quantile_cont(ground, 0.95) AS high, count(*) AS n FROM ground), (SELECT count(*) FILTER (WHERE mass <= 1.5) AS free FROM gmass)", "gmass"))
def a12(s, d):
    return P.relief(ground(s, d), gmass(s, d), FDIMS, 1.5)


@query("A35_footprint_share", f"SELECT {P.footprint_share(B.BOXES, (10.0, 10.0))!r}::DOUBLE AS share")
def a35(s, d):
    return s.createDataFrame([(P.footprint_share(B.BOXES, (10.0, 10.0)),)], "share double")


@query("A36_scene_analysis", with_(f"SELECT * FROM (SELECT count(*) AS n, {_Q} FROM gaussian), (SELECT floor((quantile_cont(ground, 0.95) - quantile_cont(ground, 0.05)) * 1e6 + 0.5) / 1e6 AS relief, count(*) AS ground_cells FROM ground), (SELECT {P.footprint_share(B.BOXES, (10.0, 10.0))!r}::DOUBLE AS share)", "ground"))
def a36(s, d):
    g = B.gaussian(s, d)
    rel = P.relief(ground(s, d), gmass(s, d), FDIMS, 1.5).select("relief", F.round(F.col("populated") * (SIDE * SIDE)).cast("long").alias("ground_cells"))
    # one row each
    return P.robust_bounds(g).crossJoin(g.agg(F.count("*").alias("n"))).crossJoin(rel).withColumn("share", F.lit(P.footprint_share(B.BOXES, (10.0, 10.0))))


@query("A14_gap_clusters", with_("SELECT CAST(trunc(x / 0.8) AS BIGINT) AS vx, CAST(trunc((y - 1.0) / 0.8) AS BIGINT) AS vy, CAST(trunc(z / 0.8) AS BIGINT) AS vz, count(*) AS n FROM gaussian GROUP BY ALL ORDER BY n DESC, vx, vy, vz LIMIT 25", "gaussian"))
def a14(s, d):
    return P.gap_clusters(B.gaussian(s, d).withColumn("y", F.col("y") - 1.0), 0.8, 25)


@query("F05_in_volume", with_(f"SELECT gid FROM gaussian WHERE {B.boxes_sql(0.1)}", "gaussian"))
def f05(s, d):
    return B.gaussian(s, d).filter(P.in_boxes(B.BOXES, 0.1)).select("gid")


@query("F06_in_boxes", with_(f"SELECT count(*) AS n FROM gaussian WHERE {B.boxes_sql()}", "gaussian"))
def f06(s, d):
    return B.gaussian(s, d).filter(P.in_boxes(B.BOXES)).agg(F.count("*").alias("n"))


@query("W09_median_smoothing", with_("SELECT g.i, g.j, floor(quantile_cont(n.ground, 0.5) * 1e8 + 0.5) / 1e8 AS ground FROM ground g, off JOIN ground n ON n.i = g.i + a AND n.j = g.j + b GROUP BY ALL", "ground", "off"))
def w09(s, d):
    return P.smooth(ground(s, d))


@query("W09_hole_fill", with_(f"SELECT i, j, ground FROM ground UNION ALL SELECT n.i + a, n.j + b, floor(quantile_cont(ground, 0.5) * 1e8 + 0.5) / 1e8 FROM ground n, off WHERE NOT (a = 0 AND b = 0) AND {_IN('n.i + a', 'n.j + b')} AND NOT EXISTS (SELECT 1 FROM ground g WHERE g.i = n.i + a AND g.j = n.j + b) GROUP BY 1, 2 HAVING count(*) >= 3", "ground", "off"))
def w09b(s, d):
    return P.fill_holes(ground(s, d), FDIMS)


def busy(s, d):
    return fcells(s, d).filter("density >= 4.5").select("i", "j")


SQL["busy"] = "SELECT i, j FROM fcells WHERE density >= 4.5"
B.USES["busy"] = ("fcells",)


@query("W10_dilation", with_(f"SELECT DISTINCT b.i + a AS i, b.j + c AS j FROM busy b, range(-2, 3) t(a), range(-2, 3) u(c) WHERE {_IN('b.i + a', 'b.j + c')}", "busy"))
def w10(s, d):
    return P.dilate(busy(s, d), FDIMS, 2)


SQL["grid"] = f"SELECT i, j FROM range(0, {SIDE}) a(i), range(0, {SIDE}) b(j)"


def grid(s):
    return s.range(SIDE).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))))


@query("W11_enclosure_rays", with_("""SELECT g.i, g.j, CAST(count(DISTINCT a * 3 + b) AS BIGINT) AS hits FROM grid g JOIN off o ON NOT (a = 0 AND b = 0) JOIN range(1, 102) r(k) ON true JOIN busy x ON x.i = g.i + k * a AND x.j = g.j + k * b
  WHERE NOT EXISTS (SELECT 1 FROM busy y WHERE y.i = g.i AND y.j = g.j) GROUP BY 1, 2 HAVING count(DISTINCT a * 3 + b) >= 6""", "grid", "off", "busy"))
def w11(s, d):
    return P.enclosed(FDIMS, busy(s, d), 6)


@query("W12_clearance", with_("SELECT i, j FROM grid ANTI JOIN (SELECT DISTINCT i + a AS i, j + b AS j FROM busy, off) USING (i, j)", "grid", "busy", "off"))
def w12(s, d):
    return P.clearance(grid(s), busy(s, d), 1)


# from every camera's cell to the cell of every part's first point
@query("W17_line_of_sight", with_(f"""+ t AS (SELECT arg_min(x, gid) AS x, arg_min(z, gid) AS z FROM gaussian GROUP BY part),
  p AS (SELECT DISTINCT a.i, a.j, b.i AS i2, b.j AS j2 FROM (SELECT {_FI.replace('x /', 'px /')} AS i, {_FJ.replace('z /', 'pz /')} AS j FROM frame) a, (SELECT {_FI} AS i, {_FJ} AS j FROM t) b),
  q AS (SELECT *, greatest(abs(i2 - i), abs(j2 - j)) AS n FROM p),
  w AS (SELECT q.*, floor(i + (i2 - i) * k / n::DOUBLE + 0.5) AS ci, floor(j + (j2 - j) * k / n::DOUBLE + 0.5) AS cj FROM q JOIN range(1, {SIDE}) r(k) ON k < n)
  SELECT i, j, i2, j2 FROM p ANTI JOIN (SELECT DISTINCT w.i, w.j, i2, j2 FROM w JOIN busy b ON b.i = ci AND b.j = cj) USING (i, j, i2, j2)""", "frame", "busy"))
def w17(s, d):
    cell = lambda x, z: [P.cell_of(x, 0.0, FINE, SIDE), P.cell_of(z, 0.0, FINE, SIDE)]
    cameras = B.frame(s, d).select(*(c.alias(n) for c, n in zip(cell("px", "pz"), ("i", "j"), strict=True))).distinct()
    firsts = B.gaussian(s, d).groupBy("part").agg(F.min_by("x", "gid").alias("x"), F.min_by("z", "gid").alias("z"))
    targets = firsts.select(*(c.alias(n) for c, n in zip(cell("x", "z"), ("i2", "j2"), strict=True))).distinct()
    return P.clear_pairs(targets.crossJoin(F.broadcast(cameras)), busy(s, d))  # a cell a camera: at most the grid's


@query("W18_sightline_length", with_("SELECT g.i, g.j, CAST(coalesce(min(k), 12) AS BIGINT) AS steps FROM grid g LEFT JOIN (SELECT b.i - k AS i, b.j - k AS j, k FROM busy b, range(1, 13) r(k)) x ON x.i = g.i AND x.j = g.j GROUP BY 1, 2", "grid", "busy"))
def w18(s, d):
    return P.sight_lines(grid(s), busy(s, d), 1, 1, 12)


@query("A37_floor_contrast", with_(f"+ h AS ({_HIST(0.0, 0.025, 32)}), f AS (SELECT b.bin, coalesce(weight, 0) AS weight FROM range(0, 32) b(bin) LEFT JOIN h ON h.bin = b.bin) SELECT bin, floor(drop * 1e4 + 0.5) / 1e4 AS drop FROM (SELECT bin, weight - lead(weight, 1, 0) OVER (ORDER BY bin) AS drop FROM f) ORDER BY drop DESC, bin LIMIT 1", "gaussian"))
def a37(s, d):
    h = P.histogram(B.gaussian(s, d), F.col("y"), 0.0, 0.025, 32, F.col("opacity"))
    return P.drop_to_next(h, 32).select("bin", (F.floor(F.col("drop") * 1e4 + 0.5) / 1e4).alias("drop")).orderBy(F.desc("drop"), "bin").limit(1)


@query("W14_bin_minus_next", with_(f"+ h AS ({_HIST(0.0, 0.1, 16)}), f AS (SELECT b.bin, coalesce(weight, 0) AS weight FROM range(0, 16) b(bin) LEFT JOIN h ON h.bin = b.bin) SELECT bin, floor((weight - lead(weight, 1, 0) OVER (ORDER BY bin)) * 1e4 + 0.5) / 1e4 AS drop FROM f", "gaussian"))
def w14(s, d):
    h = P.histogram(B.gaussian(s, d), F.col("y"), 0.0, 0.1, 16, F.col("opacity"))
    return P.drop_to_next(h, 16).select("bin", (F.floor(F.col("drop") * 1e4 + 0.5) / 1e4).alias("drop"))


@query("A37_wall_score", with_(f"+ h AS ({_HIST(0.0, 0.25, 40, 'x')}) SELECT floor(sum(CASE WHEN r <= 2 THEN weight END) / sum(weight) * 1e6 + 0.5) / 1e6 AS share FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, bin) AS r FROM h)", "gaussian"))
def a37b(s, d):
    return P.top_share(P.histogram(B.gaussian(s, d), F.col("x"), 0.0, 0.25, 40, F.col("opacity"))).select(r6(F.col("share"), "share"))


_OTSU = """+ v AS (SELECT floor(ln(1 + density) * 1e6 + 0.5) / 1e6 AS v FROM cells), e AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 64 AS w FROM v),
  h AS (SELECT CAST(least(floor((v - lo) / w), 63) AS BIGINT) AS bin, count(*) AS n FROM v, e GROUP BY 1), f AS (SELECT b.bin, coalesce(n, 0) AS n FROM range(0, 64) b(bin) LEFT JOIN h ON h.bin = b.bin),
  s AS (SELECT bin, sum(n) OVER w AS n0, sum(n * (bin + 0.5::DOUBLE)) OVER w AS m0, sum(n) OVER () AS nt, sum(n * (bin + 0.5::DOUBLE)) OVER () AS mt FROM f WINDOW w AS (ORDER BY bin)),
  b AS (SELECT bin, CASE WHEN n0 > 0 AND nt > n0 THEN n0::DOUBLE * (nt - n0) * pow(m0 / n0 - (mt - m0) / (nt - n0), 2) ELSE 0.0 END AS b FROM s)"""


@query("A38_otsu_threshold", with_(f"{_OTSU} SELECT floor((lo + (bin + 0.5::DOUBLE) * w) * 1e6 + 0.5) / 1e6 AS threshold FROM b, e ORDER BY b DESC, bin LIMIT 1", "cells"))
def a38(s, d):
    return P.otsu(P.footprint(B.gaussian(s, d), ORIGIN, CELL, DIMS), "density")


@query("W15_cumulative_sums", with_(f"+ h AS ({_HIST(0.0, 0.1, 26)}) SELECT bin, floor(sum(weight) OVER (ORDER BY bin) * 1e4 + 0.5) / 1e4 AS running FROM h", "gaussian"))
def w15(s, d):
    from pyspark.sql.window import Window as W

    h = P.histogram(B.gaussian(s, d), F.col("y"), 0.0, 0.1, 26, F.col("opacity"))
    return h.select("bin", (F.floor(F.sum("weight").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) * 1e4 + 0.5) / 1e4).alias("running"))


@query("A39_height_histogram", with_("""+ p AS (SELECT g.y, g.opacity FROM gaussian g JOIN cells c ON CAST(least(greatest(floor(x / 0.5), 0), 20) AS BIGINT) = c.i AND CAST(least(greatest(floor(z / 0.5), 0), 20) AS BIGINT) = c.j WHERE density >= 20),
  e AS (SELECT quantile_cont(y, 0.002) AS lo, quantile_cont(y, 0.998) AS hi FROM p) SELECT CAST(least(floor((y - lo) / ((hi - lo) / 120)), 119) AS BIGINT) AS bin, sum(CAST(opacity AS DECIMAL(18,6)))::DOUBLE AS weight FROM p, e WHERE y BETWEEN lo AND hi GROUP BY 1""", "cells"))
def a39(s, d):
    g = B.gaussian(s, d).withColumn("i", P.cell_of("x", 0.0, CELL, 21)).withColumn("j", P.cell_of("z", 0.0, CELL, 21))
    p = g.join(P.footprint(B.gaussian(s, d), ORIGIN, CELL, DIMS).filter("density >= 20").select("i", "j"), ["i", "j"])
    return P.height_bins(p)


@query("K09_density_pooling", with_("SELECT i // 3 AS i, j // 3 AS j, sum(CAST(density AS DECIMAL(18,6)))::DOUBLE AS density FROM cells GROUP BY 1, 2", "cells"))
def k09(s, d):
    return P.sum_pool(P.footprint(B.gaussian(s, d), ORIGIN, CELL, DIMS), "density", 3)


@query("A41_orbit", with_(f"+ c AS (SELECT {_ES('x * opacity')} / {_ES('opacity')} AS cx, {_ES('z * opacity')} / {_ES('opacity')} AS cz FROM gaussian) SELECT floor(any_value(cx) * 1e6 + 0.5) / 1e6 AS cx, floor(any_value(cz) * 1e6 + 0.5) / 1e6 AS cz, floor(quantile_cont(sqrt((x - cx) * (x - cx) + (z - cz) * (z - cz)), 0.9) * 1e6 + 0.5) / 1e6 AS radius FROM gaussian, c", "gaussian"))
def a41(s, d):
    return P.orbit(B.gaussian(s, d))


@query("A42_up_axis", with_(f"+ e AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM gaussian) SELECT 'y' AS axis, CASE WHEN {_ES('CASE WHEN y <= lo + (hi - lo) / 3 THEN opacity ELSE 0.0 END')} >= {_ES('CASE WHEN y >= hi - (hi - lo) / 3 THEN opacity ELSE 0.0 END')} THEN 1 ELSE -1 END AS sign FROM gaussian, e", "gaussian"))
def a42(s, d):
    return P.up_axis(B.gaussian(s, d))


@query("L07_stride_sample", with_("SELECT gid FROM gaussian WHERE gid % 21 = 0", "gaussian"))
def l07(s, d):
    return P.stride(B.gaussian(s, d), 21).select("gid")


@query("L06_hash_sample", with_("SELECT gid FROM gaussian ORDER BY md5(gid || '|0'), gid LIMIT 2000", "gaussian"))
def l06(s, d):
    return P.hash_sample(B.gaussian(s, d), 2000).select("gid")


@query("L10_strictest_setting", with_(f"""+ r(clearance) AS (VALUES (0), (1), (2)), p(percent) AS (VALUES (35), (45), (55)), o AS (SELECT a, b FROM range(-2, 3) t(a), range(-2, 3) u(b)),
  x AS (SELECT DISTINCT clearance, percent, i + a AS i, j + b AS j FROM fcells, r, p, o WHERE density >= percent / 10.0::DOUBLE AND abs(a) <= clearance AND abs(b) <= clearance AND {_IN('i + a', 'j + b')})
  SELECT clearance, percent, {SIDE * SIDE} - count(x.i) AS free FROM r CROSS JOIN p LEFT JOIN x USING (clearance, percent) GROUP BY 1, 2 HAVING {SIDE * SIDE} - count(x.i) >= 2500 ORDER BY clearance DESC, percent LIMIT 1""", "fcells"))
def l10(s, d):
    cells = fcells(s, d)
    each = [P.clearance(grid(s), cells.filter(F.col("density") >= p / 10.0), c).agg(F.count("*").alias("free")).select(F.lit(c).alias("clearance"), F.lit(p).alias("percent"), "free") for c in (0, 1, 2) for p in (35, 45, 55)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return P.strictest(out, 2500)


@query("I14_tilt_search")
def i14(s, d):
    return P.tilt_search(B.gaussian(s, d))


@query("I15_plane_fit")
def i15(s, d):
    p = P.fit_plane(B.gaussian(s, d))
    return s.createDataFrame([(p.a, p.b, p.c)], "a double, b double, c double")
