"""Repair, many-part polygons, kept aggregates and stale tiles against brute force."""

import math
import random

import pytest
from isobath.operators import derived as K
from isobath.operators import polygons as O
from isobath.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                inside = not inside
    return inside


def ring_area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2


def simple(ring):
    """Whether no two sides that are not neighbours cross or touch but at a shared end."""
    sides = list(zip(ring, ring[1:]))

    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    for i, (a, b) in enumerate(sides):
        for c, d in sides[i + 1 :]:
            if {tuple(a), tuple(b)} & {tuple(c), tuple(d)}:
                continue
            if turn(a, b, c) * turn(a, b, d) < -1e-9 and turn(c, d, a) * turn(c, d, b) < -1e-9:
                return False
    return True


@pytest.mark.parametrize("seed", range(12))
def test_repair_keeps_what_the_even_odd_rule_fills(seed):
    rng = random.Random(seed)
    whole = seed % 2  # on a coarse grid many sides touch, overlap and run through points
    rings = [[[rng.randrange(0, 7) if whole else rng.random() * 6, rng.randrange(0, 7) if whole else rng.random() * 6] for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, 4))]
    out = O.repaired(rings)
    for p in out:
        assert ring_area(p[0]) > 0 and all(ring_area(h) < 0 for h in p[1:])
        for r in p:
            assert r[0] == r[-1] and simple(r)
    for _ in range(3000):
        x, y = rng.random() * 6.5 - 0.2 + 1e-4, rng.random() * 6.5 - 0.2 + 1e-4
        assert even_odd(rings, x, y) == (sum(even_odd(p, x, y) for p in out) == 1), (x, y)
        assert sum(even_odd(p, x, y) for p in out) <= 1


def test_repair_of_known_shapes():
    star = [[math.cos(2 * math.pi * 2 * i / 5), math.sin(2 * math.pi * 2 * i / 5)] for i in range(5)]
    assert len(O.repaired([star])) == 5  # its middle is filled twice
    square = [[0, 0], [4, 0], [4, 4], [0, 4]]
    assert [len(p) for p in O.repaired([square, [[1, 1], [2, 1], [2, 2], [1, 2]]])] == [2]
    assert [len(p) for p in O.repaired([square, [[1, 1], [3, 1], [3, 3], [1, 3]], [[1.5, 1.5], [2, 1.5], [2, 2]]])] == [2, 1]
    for flat in ([[0, 0], [1, 1], [2, 2]], [[0, 0], [1, 1]], [[0, 0]], [], [[math.nan, 0], [1, 0], [None, 2]]):
        assert O.repaired([flat]) == []
    assert O.repaired([square, square]) == []


def test_what_cannot_be_mended_is_told(spark):
    rows = [(1, [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]], "x"), (2, None, "y"), (3, [], None), (4, [[[0.0, 0.0], [1.0, 1.0]]], "z"), (4, [[[0.0, 0.0], [1.0, 1.0]]], "z")]
    df = spark.createDataFrame(rows, "id int, rings array<array<array<double>>>, problem string")
    got = sorted((r.id, r.problem, r.polygons is None) for r in O.repair(df).collect())
    assert got == [(1, None, False), (2, "no geometry", True), (3, "no geometry", True), (4, "no area", True), (4, "no area", True)]
    assert O.repair(df.limit(0)).count() == 0


def test_rectangles_meet_polygons_with_holes_and_parts(spark):
    rng = random.Random(4)

    def blob(x, y, r):
        return [[x + math.cos(t / 9 * 2 * math.pi) * r * rng.uniform(0.6, 1), y + math.sin(t / 9 * 2 * math.pi) * r * rng.uniform(0.6, 1)] for t in range(9)]

    areas = []
    for i in range(6):
        x, y = rng.uniform(0, 20), rng.uniform(0, 20)
        rings = [blob(x, y, 6), blob(x, y, 2.5), blob(x + 14, y, 3)]
        areas.append((i, [[*r, r[0]] for r in rings]))
    boxes = [(i, *(lambda x, y, w: (x, y, x + w, y + w / 2))(rng.uniform(-6, 40), rng.uniform(-6, 28), rng.choice([0.0, 0.4, 3.0]))) for i in range(250)] + [(999, None, None, None, None)]
    got = {tuple(r) for r in O.polygons_meeting(spark.createDataFrame(boxes, "id int, xmin double, ymin double, xmax double, ymax double"), spark.createDataFrame(areas, "area_id int, rings array<array<array<double>>>"), 1.5).collect()}

    def meets(rings, x0, y0, x1, y1):
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                lo, hi = 0.0, 1.0  # the side clipped by the rectangle
                for d, p, q in ((bx - ax, x0 - ax, x1 - ax), (by - ay, y0 - ay, y1 - ay)):
                    if d == 0:
                        if p > 0 or q < 0:
                            lo, hi = 1, 0
                    else:
                        s, t = sorted((p / d, q / d))
                        lo, hi = max(lo, s), min(hi, t)
                if lo <= hi:
                    return True
        return even_odd(rings, x0, y0)

    want = {(a, i) for a, rings in areas for i, *b in boxes if b[0] is not None and meets(rings, *b)}
    assert got == want and len(want) > 50
    # rectangles in a hole are not met
    assert any(even_odd([rings[0]], *b[:2]) and (a, i) not in want for a, rings in areas for i, *b in boxes[:250])


def test_inside_cells_carry_no_sides(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    cells = O.cells_of(spark.createDataFrame([(1, [square])], "area_id int, rings array<array<array<double>>>"), 1.0).collect()
    inner = {(r.cx, r.cy) for r in cells if r.sides is None}
    assert inner == {(x, y) for x in range(1, 10) for y in range(1, 10)} and max(len(r.sides) for r in cells if r.sides) == 2


@pytest.mark.parametrize("seed", range(3))
def test_kept_aggregates_equal_a_count_from_scratch(spark, seed):
    rng = random.Random(seed)
    shape = "id int, dataset_id int, xmin double, ymin double, xmax double, ymax double"
    feature = lambda i: (i, rng.choice([1, 2, 3, None]), x := float(rng.randrange(20)), y := float(rng.randrange(20)), x + rng.choice([0, 1]), y + rng.choice([0, 2]))
    now = {i: feature(i) for i in range(12)}
    held = K.extents(spark.createDataFrame(list(now.values()), shape))
    for step in range(4):
        gone = rng.sample(sorted(now), min(len(now), 7)) if step < 3 else sorted(now)
        changes = [(*now.pop(i), -1) for i in gone]
        for i in range(100 * step + 100, 100 * step + 100 + rng.choice([0, 5])):
            now[i] = feature(i)
            changes.append((*now[i], 1))
        current = spark.createDataFrame(list(now.values()), shape)
        held = K.advanced(held, spark.createDataFrame(changes, shape + ", sign int"), current)
        rows = held.collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, K.extents(current).filter("dataset_id IS NOT NULL").union(held.filter("dataset_id IS NULL")).collect()), key=str)
        held = spark.createDataFrame(rows, held.schema)
    assert {r.dataset_id for r in rows if r.dataset_id is not None} == {f[1] for f in now.values() if f[1] is not None}


def test_only_datasets_that_may_have_shrunk_are_read_again(spark):
    shape = "dataset_id int, xmin double, ymin double, xmax double, ymax double"
    held = K.extents(spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0), (2, 0.0, 0.0, 9.0, 9.0)], shape))
    changes = spark.createDataFrame([(1, 4.0, 4.0, 5.0, 5.0, -1), (1, -3.0, 4.0, 5.0, 5.0, 1), (2, 0.0, 1.0, 2.0, 2.0, -1)], shape + ", sign int")
    # the table of features lies: what is not read again does not follow it
    lying = spark.createDataFrame([(1, 100.0, 100.0, 100.0, 100.0), (2, 7.0, 7.0, 8.0, 8.0)], shape)
    got = {r.dataset_id: tuple(r)[2:] for r in K.advanced(held.withColumn("features", F.lit(5)), changes, lying).collect()}
    assert got == {1: (-3.0, 0.0, 9.0, 9.0), 2: (7.0, 7.0, 8.0, 8.0)}


def test_degenerate_envelopes_get_an_area(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 60.0, 5.0, 60.0), (2, 2, 5.0, 0.0, 6.0, 0.0), (3, 2, 0.0, 0.0, 1.0, 1.0)], "dataset_id int, features int, xmin double, ymin double, xmax double, ymax double")
    got = {r.dataset_id: r for r in K.widened(df).collect()}
    assert math.isclose((got[1].xmax - 5) * 111320 * math.cos(math.radians(60)), 10, rel_tol=1e-6) and math.isclose((got[1].ymax - 60) * 111320, 10, rel_tol=1e-6)
    assert got[2].ymin < 0 < got[2].ymax and tuple(got[3])[2:] == (0.0, 0.0, 1.0, 1.0)


def test_stale_tiles_equal_all_pairs(spark):
    rng = random.Random(9)
    areas = [(i, x := rng.uniform(-180, 179), y := rng.uniform(-86, 85), min(180.0, x + 10 ** rng.uniform(-5, 2)), min(90.0, y + 10 ** rng.uniform(-5, 1.7))) for i in range(60)] + [(99, None, 0.0, 1.0, 1.0), (98, -180.0, -90.0, 180.0, 90.0), (97, 0.0, 0.0, 0.0, 0.0)]
    tiles = {(z, rng.randrange(2**z), rng.randrange(2**z)) for z in range(8) for _ in range(60)}
    for _, x, y, *_ in areas[:40]:  # and deep ones near the areas
        z = rng.randrange(9, 17)
        s = math.sin(math.radians(max(-85, min(85, y))))
        tiles.add((z, min(2**z - 1, int((x + 180) / 360 * 2**z)), min(2**z - 1, int((0.5 - math.atanh(s) / 2 / math.pi) * 2**z))))
    got = {tuple(r) for r in K.stale_tiles(spark.createDataFrame(areas, "id int, xmin double, ymin double, xmax double, ymax double"), spark.createDataFrame(sorted(tiles), "z int, x long, y long")).collect()}
    lat = lambda z, y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z))))
    want = {(i, z, x, y) for i, x0, y0, x1, y1 in areas if x0 is not None for z, x, y in tiles if x0 <= (x + 1) / 2**z * 360 - 180 and x1 >= x / 2**z * 360 - 180 and y0 <= lat(z, y) and y1 >= lat(z, y + 1)}
    assert got == want and len({i for i, *_ in want}) > 40


def test_bundles_of_several_xml_files_are_read_to_the_end(spark):
    from isobath.sources import vendors as V

    files = [(1, "b.xml", "<a><Sensor_Name>second</Sensor_Name><SunElev>12.5</SunElev></a>"), (1, "a.xml", "<a><Sensor_Name>first &amp; &lt;best&gt;</Sensor_Name><CloudPct>x</CloudPct></a>"), (1, "c.xml", "<m:a><m:CloudPct>7</m:CloudPct></m:a>"), (2, "notes.txt", "sensor"), (3, "x.IMD", "satId = A;")]
    df = spark.createDataFrame(files, "bundle_id int, path string, content string")
    got = {r.bundle_id: r for r in V.extract(df).collect()}
    assert set(got) == {1}  # no vendor and no XML; an .IMD alone is not Maxar's
    assert (got[1].vendor, got[1].sensor, got[1].sun_elevation_deg, got[1].cloud_cover_pct) == ("generic", "first & <best>", "12.5", "7.0")
    plan = V.extract(registry.table(spark, SF, "sidecars"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 8 and "Join" not in plan
