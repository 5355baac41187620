"""Forced and correspondence splits, and merges, against the same rules one step at a time."""

import itertools
import random

import pytest
import xxhash

from strataform.operators import splitting

LIMITS = {"min_visible": 5, "min_frac": 0.3, "max_iou": 0.1, "quorum": 2, "min_ios": 0.6, "near": 0.25}
HASH = {}


def order_of(gid):
    h = xxhash.xxh64(int(gid).to_bytes(8, "little"), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h, gid)


class Scene:
    """One class: points by gid, and views as {frame: (visible gids, {mask: gids})}."""

    def __init__(self):
        self.at, self.part, self.views, self.iou = {}, {}, {}, {}

    def blob(self, part, n, centre, spread, rng):
        made = []
        for _ in range(n):
            g = len(self.at)
            self.at[g] = tuple(c + rng.uniform(-s, s) for c, s in zip(centre, spread, strict=True))
            self.part[g] = part
            made.append(g)
        return made

    def view(self, frame, masks, iou=None):
        self.views[frame] = ({g for m in masks.values() for g in m}, {k: set(v) for k, v in masks.items()})
        self.iou |= {(frame, *sorted(k)): v for k, v in (iou or {}).items()}

    def evidence(self, spark, class_id=0):
        seen = [(class_id, f, g) for f, (v, _) in self.views.items() for g in v]
        hits = [(class_id, f, m, g) for f, (_, masks) in self.views.items() for m, v in masks.items() for g in v]
        over = [(class_id, f, a, b, i) for (f, a, b), i in self.iou.items()]
        make = lambda rows, cols: spark.createDataFrame(rows, cols)
        return splitting.Evidence(make(seen, "class_id long, frame_idx long, gid long"), make(hits, "class_id long, frame_idx long, mask long, gid long"), make(over, "class_id long, frame_idx long, mask long, other long, iou double"), **LIMITS)

    def points(self, spark, class_id=0):
        return spark.createDataFrame([(class_id, self.part[g], g, *map(float, self.at[g])) for g in self.at], "class_id long, part long, gid long, x double, y double, z double")

    # the rules, one at a time

    def leading(self, gids, frame):
        seen, masks = self.views[frame]
        own = gids & seen
        if len(own) < LIMITS["min_visible"]:
            return None
        ranked = sorted(((-len(own & v) / len(own), m) for m, v in masks.items() if own & v))
        return [(-f, m) for f, m in ranked] or [(0.0, None)]

    def apart(self, frame, one, two):
        return one[1] != two[1] and min(one[0], two[0]) >= LIMITS["min_frac"] and self.iou.get((frame, *sorted((one[1], two[1]))), 0.0) <= LIMITS["max_iou"]

    def is_distinct(self, a, b):
        votes = checked = 0
        for f in self.views:
            p, q = self.leading(a, f), self.leading(b, f)
            if p and q:
                checked += 1
                votes += self.apart(f, p[0], q[0])
        return votes >= LIMITS["quorum"] or (checked > 0 and 2 * votes >= checked)

    def spans(self, gids):
        tops = [(f, self.leading(gids, f)) for f in self.views]
        return sum(1 for f, t in tops if t and len(t) > 1 and self.apart(f, t[0], t[1]))

    def stack(self, a, b):
        box = [[(min(self.at[g][k] for g in s), max(self.at[g][k] for g in s)) for k in range(3)] for s in (a, b)]
        mid = [[sum(self.at[g][k] for g in s) / len(s) for k in range(3)] for s in (a, b)]
        inter, vol = 1.0, [1.0, 1.0]
        for (l0, h0), (l1, h1) in zip(*box, strict=True):
            inter *= max(min(h0, h1) - max(l0, l1), 0.0)
            vol = [vol[0] * (h0 - l0), vol[1] * (h1 - l1)]
        ios = inter / max(min(vol), 1e-9)
        dist = sum((p - q) ** 2 for p, q in zip(*mid, strict=True)) ** 0.5
        diag = [sum((h - lo) ** 2 for lo, h in b) ** 0.5 for b in box]
        return ((ios >= LIMITS["min_ios"] or dist <= LIMITS["near"] * min(diag)) and dist <= LIMITS["near"] * max(diag)), ios, dist

    def halves(self, gids):
        ends = sorted(gids, key=order_of)
        c = [self.at[ends[0]], self.at[ends[-1]]]
        far = lambda g, k: sum((a - b) ** 2 for a, b in zip(self.at[g], c[k], strict=True))
        for _ in range(25):
            sides = [set(), set()]
            for g in gids:
                sides[far(g, 1) < far(g, 0)].add(g)
            new = [tuple(sum(self.at[g][k] for g in s) / len(s) for k in range(3)) if s else c[i] for i, s in enumerate(sides)]
            if new == c:
                break
            c = new
        return [{g for g in gids if (far(g, 1) < far(g, 0)) == bool(k)} for k in (0, 1)]

    def outcome(self, halves, least):
        if min(map(len, halves)) < least:
            return "fragment"
        return "ineffective" if self.stack(*halves)[0] and not self.is_distinct(*halves) else "split"

    def groups(self):
        out = {}
        for g, p in self.part.items():
            out.setdefault(p, set()).add(g)
        return out

    def forced(self, expected, least):
        parts, aside, log = self.groups(), set(), []
        while len(parts) < expected and set(parts) - aside:
            big = max(set(parts) - aside, key=lambda p: (len(parts[p]), -p))
            halves = self.halves(parts[big])
            log.append((big, self.outcome(halves, least)))
            if log[-1][1] == "fragment":
                break
            if log[-1][1] == "ineffective":
                aside.add(big)
            else:
                parts[big], parts[max(parts) + 1] = halves
        return parts, log

    def by_correspondence(self, least):
        parts, log = self.groups(), []
        queue = sorted(parts)
        while queue:
            fresh = []
            for p in queue:
                votes = self.spans(parts[p])
                if len(parts[p]) < 2 * least or votes < LIMITS["quorum"]:
                    continue
                halves = self.halves(parts[p])
                log.append((p, votes, self.outcome(halves, least)))
                if log[-1][2] == "split":
                    parts[p], parts[max(parts) + 1] = halves
                    fresh += [p, max(parts)]
            queue = sorted(fresh)
        return parts, log

    def merged(self):
        parts = self.groups()
        root = {p: p for p in parts}
        groups = {p: set(v) for p, v in parts.items()}
        pairs = sorted((-s[1], s[2], a, b) for a, b in itertools.combinations(sorted(parts), 2) if (s := self.stack(parts[a], parts[b]))[0])
        log = []
        for _, _, a, b in pairs:
            ra, rb = root[a], root[b]
            if ra == rb:
                continue
            if self.is_distinct(groups[ra], groups[rb]):
                log.append((a, b, "kept_distinct"))
                continue
            log.append((a, b, "merged"))
            low, high = min(ra, rb), max(ra, rb)
            groups[low] |= groups.pop(high)
            root = {p: low if r == high else r for p, r in root.items()}
        return groups, log


def as_groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.part, set()).add(r.gid)
    return out


@pytest.fixture
def chairs():
    """Part 0: two touching chairs that two views tell apart; part 1: a heap that no view tells apart; part 2: a chair with a speck far off."""
    rng = random.Random(3)
    s = Scene()
    left, right = s.blob(0, 60, (0, 0, 0), (0.5, 0.5, 0.5), rng), s.blob(0, 55, (1.1, 0, 0), (0.5, 0.5, 0.5), rng)
    heap = s.blob(1, 80, (10, 0, 0), (0.5, 0.5, 0.5), rng)
    single = s.blob(2, 40, (20, 0, 0), (0.2, 0.2, 0.2), rng) + s.blob(2, 4, (60, 0, 0), (0.1, 0.1, 0.1), rng)
    for f in (1, 2, 3):
        s.view(f, {1: left, 2: right, 3: heap, 4: single}, {(1, 2): 0.02 * f})
    return s


@pytest.mark.parametrize("expected", [2, 6])
def test_forced_split(spark, chairs, expected):
    want = spark.createDataFrame([(0, expected)], "class_id long, expected long")
    points, log = splitting.forced_split(chairs.points(spark), want, splitting.by_coordinates, chairs.evidence(spark), 10)
    parts, told = chairs.forced(expected, 10)
    assert as_groups(points) == parts and [(r.part, r.outcome) for r in log.orderBy("round").collect()] == told
    assert len(parts) == max(3, expected) or told[-1][1] == "fragment"


def test_a_split_into_a_fragment_ends_the_class(spark):
    s = Scene()
    rng = random.Random(2)
    s.blob(0, 40, (0, 0, 0), (0.2, 0.2, 0.2), rng), s.blob(0, 4, (60, 0, 0), (0.1, 0.1, 0.1), rng)
    s.view(1, {1: list(s.at)})
    points, log = splitting.forced_split(s.points(spark), spark.createDataFrame([(0, 3)], "class_id long, expected long"), splitting.by_coordinates, s.evidence(spark), 10)
    assert [r.outcome for r in log.collect()] == ["fragment"] and len(as_groups(points)) == 1


def test_an_ineffective_split_sets_the_part_aside(spark):
    rng = random.Random(1)
    s = Scene()
    s.blob(0, 90, (0, 0, 0), (0.5, 0.5, 0.5), rng)  # the largest: halves overlap in the one mask that holds all of it
    pair = [s.blob(1, 30, (5, 0, 0), (0.2, 0.2, 0.2), rng), s.blob(1, 30, (7, 0, 0), (0.2, 0.2, 0.2), rng)]
    for f in (1, 2):
        s.view(f, {1: [g for g in s.at if s.part[g] == 0], 2: pair[0], 3: pair[1]})
    LIMITS["near"], before = 0.6, LIMITS["near"]
    try:
        want = spark.createDataFrame([(0, 3)], "class_id long, expected long")
        points, log = splitting.forced_split(s.points(spark), want, splitting.by_coordinates, s.evidence(spark), 5)
        parts, told = s.forced(3, 5)
    finally:
        LIMITS["near"] = before
    assert [o for _, o in told] == ["ineffective", "split"] and as_groups(points) == parts
    assert [(r.part, r.outcome) for r in log.orderBy("round").collect()] == told


def test_correspondence_split(spark, chairs):
    rng = random.Random(5)
    row = [chairs.blob(3, 40, (30 + 2 * k, 0, 0), (0.4, 0.4, 0.4), rng) for k in range(3)]  # three in a row: split twice
    for f in (4, 5, 6):
        chairs.view(f, {10: row[0], 11: row[1] + row[2][:30], 12: row[2]} if f == 6 else {10: row[0], 11: row[1], 12: row[2]})
    chairs.iou |= {(4, 10, 11): 0.9}
    points, log = splitting.correspondence_split(chairs.points(spark), splitting.by_coordinates, chairs.evidence(spark), 10)
    parts, told = chairs.by_correspondence(10)
    assert sorted(map(sorted, as_groups(points).values())) == sorted(map(sorted, parts.values()))
    assert sorted((r.votes, r.outcome) for r in log.collect()) == sorted((v, o) for _, v, o in told) and told


@pytest.mark.parametrize("seed", range(2))
def test_same_class_merge(spark, seed):
    rng = random.Random(seed)
    s = Scene()
    blobs = [s.blob(k, rng.randint(8, 20), (rng.choice([0, 0.1, 0.2, 3, 3.1, 6]), rng.choice([0, 0.1]), 0), (0.5, 0.5, 0.5), rng) for k in range(9)]
    for f in range(3):
        masks = {}
        for b in blobs:
            masks.setdefault(rng.randint(0, 3), []).extend(b)
        s.view(f, masks, {(0, 1): rng.choice([0.0, 0.5])})
    points, log = splitting.same_class_merge(s.points(spark), s.evidence(spark))
    groups, told = s.merged()
    assert as_groups(points) == groups and sorted((r.a, r.b, r.result) for r in log.collect()) == sorted(told) and told


def test_evidence_bisect(spark):
    """Two interleaved halves that only detections tell apart; points without evidence go with their nearest neighbour."""
    rng = random.Random(9)
    rows = [(0, 0, g, rng.uniform(0, 1), rng.uniform(0, 1), float(g % 2) * 0.01) for g in range(60)] + [(0, 1, g, rng.uniform(5, 6), 0.0, 0.0) for g in range(100, 140)]
    points = spark.createDataFrame(rows, "class_id long, part long, gid long, x double, y double, z double")
    told = [(0, g, *((1.0, 0.0) if g % 2 else (0.0, 0.9))) for g in range(40)] + [(0, g, 0.0, 0.0) for g in range(40, 50)]
    features = spark.createDataFrame(told, "class_id long, gid long, f0 double, f1 double")
    got = {r.gid: r.side for r in splitting.evidence_bisect(points, features, ["f0", "f1"]).collect()}
    assert set(got) == set(range(60))  # nothing is known of part 1
    assert len({got[g] for g in range(0, 40, 2)}) == 1 == len({got[g] for g in range(1, 40, 2)}) and got[0] != got[1]
    at = {r[2]: r[3:] for r in rows}
    for g in range(40, 60):
        near = min(range(40), key=lambda k: (sum((a - b) ** 2 for a, b in zip(at[g], at[k], strict=True)), k))
        assert got[g] == got[near]
    halves = {r.gid: r.side for r in splitting.by_evidence(features, ["f0", "f1"])(points).collect()}
    assert {g: halves[g] for g in got} == got and {halves[g] for g in range(100, 140)} == {0, 1}


def test_classes_do_not_mix(spark, chairs):
    two = chairs.points(spark).unionByName(chairs.points(spark, 1))
    a, b = chairs.evidence(spark), chairs.evidence(spark, 1)
    both = splitting.Evidence(a.visible.union(b.visible), a.hits.union(b.hits), a.overlaps.union(b.overlaps), **LIMITS)
    want = spark.createDataFrame([(0, 4), (1, 1)], "class_id long, expected long")
    points, _ = splitting.forced_split(two, want, splitting.by_coordinates, both, 10)
    assert {c: len(as_groups(points.filter(f"class_id = {c}"))) for c in (0, 1)} == {0: 4, 1: 3}
    none = chairs.points(spark).limit(0)
    assert splitting.forced_split(none, want, splitting.by_coordinates, both, 10)[0].count() == 0 == splitting.correspondence_split(none, splitting.by_coordinates, both, 10)[0].count() == splitting.same_class_merge(none, both)[0].count()
