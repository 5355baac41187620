"""Dedup rules on small hand-made cases, whose results are worked out by hand."""

from strataform.operators import detections as D

COLS = "frame_idx long, concept string, det_idx long, score double, area_frac double, x1 long, y1 long, x2 long, y2 long, source string"


def rows(spark, *given):
    return spark.createDataFrame([(f, c, i, s, 0.1, *box, src) for f, c, i, s, box, src in given], COLS)


BOX = (0, 0, 10, 10)


def rule(spark, r, ranks={}):
    return [(x.rule, x.drop_det, x.part_det) for x in D.classified_pairs(D.overlap_pairs(r), 0.7, 0.9, 0.9, ranks).collect()]


def test_mutual_tie_drops_the_first(spark):
    r = rows(spark, (0, "a", 1, 0.5, BOX, "text"), (0, "b", 2, 0.5, BOX, "text"))
    assert rule(spark, r) == [("A", 1, None)]


def test_rank_beats_score(spark):
    r = rows(spark, (0, "a", 1, 0.9, BOX, "text"), (0, "b", 2, 0.1, BOX, "text"))
    assert rule(spark, r, {"a": 2, "b": 1}) == [("A", 1, None)]
    assert rule(spark, r, {"a": 2}) == [("A", 2, None)]


def test_exemplar_row_drops(spark):
    r = rows(spark, (0, "a", 1, 0.5, (2, 2, 5, 5), "exemplar:a"), (0, "a", 2, 0.4, BOX, "text"))
    assert rule(spark, r) == [("C", 1, None)]


def test_part_walk_depends_on_order(spark):
    chain = []
    for f in range(3):
        chain += [(f, "a", 1, 0.5, (0, 0, 3, 3), "text"), (f, "b", 2, 0.5, (0, 0, 6, 6), "text"), (f, "c", 3, 0.5, (0, 0, 20, 20), "text")]
    pairs = D.overlap_pairs(rows(spark, *chain)).cache()
    c = D.classified_pairs(pairs, 0.7, 0.9, 0.9)
    q = D.part_quorum(c, 3)
    assert {(x.part_concept, x.whole_concept) for x in q.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = sorted((x.frame_idx, x.det_idx, x.action) for x in D.drop_parts(c, q).collect())
    assert got == [(f, d, "drop") for f in range(3) for d in (1, 2)]
    assert {x.action for x in D.drop_parts(c, q, {"a": 1, "b": 2}).filter("det_idx = 2 and frame_idx = 0").collect()} == {"carve"}


def test_area_factor_needs_enough_rows(spark):
    base = [(0, "a", i, 0.5, BOX, "text") for i in range(12)]
    r = rows(spark, *base).withColumn("area_frac", D.F.lit(0.01)).unionByName(rows(spark, (0, "a", 99, 0.5, BOX, "text")).withColumn("area_frac", D.F.lit(0.36)))
    assert [x.det_idx for x in D.area_factor(r, {}, 12, 35).filter("killed").collect()] == [99]
    few = r.filter("det_idx < 9 or det_idx = 99")
    assert D.area_factor(few, {}, 12, 35).filter("killed").count() == 0


def test_grid_key_gives_the_same_pairs(spark):
    import random

    rng = random.Random(3)
    given = []
    for i in range(80):
        x, y = rng.randrange(200), rng.randrange(200)
        given.append((i % 2, "ab"[i % 2], i, 0.5, (x, y, x + rng.randrange(5, 90), y + rng.randrange(5, 90)), "text"))
    r = rows(spark, *given)
    key = lambda df: sorted((p.a_det_idx, p.b_det_idx, p.inter) for p in df.collect())
    assert key(D.overlap_pairs(r)) == key(D.overlap_pairs(r, cell=40))


def test_fold_keeps_the_higher_score(spark):
    r = rows(spark, (0, "a", 1, 0.5, BOX, "exemplar:a"), (0, "a", 2, 0.7, (0, 0, 10, 9), "exemplar:a"), (0, "a", 3, 0.6, (50, 50, 60, 60), "exemplar:a"))
    assert sorted(x.det_idx for x in D.fold_duplicates(r, 0.6).collect()) == [2, 3]


def test_expected_is_nth_largest(spark):
    given = [(f, "a", 10 * f + k, 0.5, BOX, "text") for f, n in ((0, 4), (1, 3), (2, 1)) for k in range(n)]
    assert D.expected_count(rows(spark, *given), 2).collect()[0].expected == 3


def test_empty_table(spark):
    r = rows(spark).limit(0) if False else spark.createDataFrame([], COLS)
    assert D.overlap_pairs(r).count() == 0
    assert D.funnel(r, D.threshold(0.3), {}, 12, 35, []).count() == 0
