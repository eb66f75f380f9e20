"""Polygons of several rings: repair by even-odd parity, and joins in which only border cells look at sides.

A geometry is an array of closed rings of [x, y]; a point is inside if a ray from
it crosses the sides of all rings an odd number of times, so holes and parts need
no marks of their own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.functions import geo as G
from isobath.operators.steps import dealt

Point = tuple[Fraction, Fraction]


def _between(a: Point, b: Point, p: Point) -> bool:
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _turn(a: Point, b: Point, c: Point) -> Fraction:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _meetings(a: Point, b: Point, c: Point, d: Point) -> list[Point]:
    """The points at which two sides must be cut: their crossing, or the ends that lie on the other one."""
    cut = [p for p, (q, r) in ((c, (a, b)), (d, (a, b)), (a, (c, d)), (b, (c, d))) if _turn(q, r, p) == 0 and _between(q, r, p)]
    one, two, three, four = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if one * two < 0 and three * four < 0:
        t = three / (three - four)
        cut.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
    return cut


def _noded(sides: list[tuple[Point, Point]]) -> dict[tuple[Point, Point], int]:
    """The sides cut at all their meetings, as undirected edges with the number of times that each is passed."""
    order = sorted(range(len(sides)), key=lambda i: min(sides[i][0][0], sides[i][1][0]))
    cuts: list[set[Point]] = [set(s) for s in sides]
    open_: list[int] = []
    for i in order:
        a, b = sides[i]
        left, low, high = min(a[0], b[0]), min(a[1], b[1]), max(a[1], b[1])
        open_ = [j for j in open_ if max(sides[j][0][0], sides[j][1][0]) >= left]
        for j in open_:
            c, d = sides[j]
            if min(c[1], d[1]) <= high and max(c[1], d[1]) >= low:
                for p in _meetings(a, b, c, d):
                    cuts[i].add(p)
                    cuts[j].add(p)
        open_.append(i)
    edges: dict[tuple[Point, Point], int] = defaultdict(int)
    for (a, b), points in zip(sides, cuts):
        line = sorted(points, key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for p, q in zip(line, line[1:]):
            edges[min(p, q), max(p, q)] += 1
    return edges


def _inside(edges: list[tuple[Point, Point]], x: Fraction, y: Fraction) -> bool:
    """Whether a point that lies on no edge is inside, by the edges that a ray to the right crosses."""
    crossed = 0
    for (ax, ay), (bx, by) in edges:
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            crossed += 1
    return crossed % 2 == 1


def _left_is_inside(edges: list[tuple[Point, Point]], a: Point, b: Point) -> bool:
    """Whether the area to the left of an edge is inside: parity on either side of its middle differs by the edge alone."""
    x, y = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
    if a[1] != b[1]:
        # how many edges a ray from just right of the middle crosses; the edge itself is not one of them
        crossed = sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in edges if (p, q) not in ((a, b), (b, a)))
        right_of_middle = crossed % 2 == 1
        return right_of_middle if b[1] < a[1] else not right_of_middle
    # a level edge: the same with a ray upwards
    crossed = sum((p[0] > x) != (q[0] > x) and y < p[1] + (x - p[0]) * (q[1] - p[1]) / (q[0] - p[0]) for p, q in edges if (p, q) not in ((a, b), (b, a)))
    above = crossed % 2 == 1
    return above if b[0] > a[0] else not above


def _area(ring: list[Point]) -> Fraction:
    return sum((p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])), Fraction(0)) / 2


def repaired(rings: list[list[list[float]]]) -> list[list[list[list[float]]]]:
    """Valid polygons, each a shell and its holes, that cover what the even-odd rule makes of the rings; none if that has no area.

    Sides are cut where they meet, in exact arithmetic.  Edges passed an even number
    of times bound nothing and go; the others are walked with the inside to their
    left, at each point along the nearest edge clockwise, which gives simple rings.
    """
    sides = []
    for ring in rings:
        points = [(Fraction(p[0]), Fraction(p[1])) for p in ring if p is not None and len(p) >= 2 and all(c is not None and math.isfinite(c) for c in p[:2])]
        sides += [(a, b) for a, b in zip(points, points[1:] + points[:1]) if a != b]
    edges = [e for e, times in _noded(sides).items() if times % 2]
    around: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    found = _cycles(around) if all(len(n) == 2 for n in around.values()) else _walks(edges, around)
    shells = [r for r in found if _area(r) > 0]
    out = [[r] for r in shells]
    for hole in (r for r in found if _area(r) < 0):
        # a point just inside of the hole's own edge tells the shell around it
        (ax, ay), (bx, by) = hole[0], hole[1]
        holders = [i for i, s in enumerate(shells) if _holds(s, ((ax + bx) / 2, (ay + by) / 2))]
        out[min(holders, key=lambda i: _area(shells[i]))].append(hole)
    return [[[[float(x), float(y)] for x, y in r] for r in p] for p in out]


def _holds(ring: list[Point], p: Point) -> bool:
    return _inside(list(zip(ring, ring[1:])), *p)


def _cycles(around: dict[Point, list[Point]]) -> list[list[Point]]:
    """The rings of edges that meet in pairs only, turned by how many others they lie in."""
    found, seen = [], set()
    for start in around:
        if start in seen:
            continue
        ring, here = [start], around[start][0]
        while here != start:
            ring.append(here)
            here = next(p for p in around[here] if p != ring[-2]) if around[here][0] != around[here][1] else around[here][0]
        seen.update(ring)
        found.append([*ring, start])
    out = []
    for i, r in enumerate(found):
        middle = ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
        shell = sum(_holds(s, middle) for j, s in enumerate(found) if j != i) % 2 == 0
        out.append(r if (_area(r) > 0) == shell else r[::-1])
    return out


def _walks(edges: list[tuple[Point, Point]], around: dict[Point, list[Point]]) -> list[list[Point]]:
    """The rings of edges of which some meet in more than pairs."""
    leaving: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        if not _left_is_inside(edges, a, b):
            a, b = b, a
        leaving[a].append(b)

    def clockwise(at: Point, to: Point) -> list[Point]:
        """The neighbours of a point from the one at hand on, turning clockwise."""
        line = sorted(around[at], key=lambda p: -math.atan2(p[1] - at[1], p[0] - at[0]))
        i = line.index(to)
        return line[i + 1 :] + line[: i + 1]

    found = []
    while leaving:
        start = next(iter(leaving))
        ring, here = [start], leaving[start].pop()
        if not leaving[start]:
            del leaving[start]
        while here != start:
            ring.append(here)
            to = next(p for p in clockwise(here, ring[-2]) if p in leaving.get(here, ()))
            leaving[here].remove(to)
            if not leaving[here]:
                del leaving[here]
            here = to
        found.append([*ring, start])
    return found


POLYGONS = "array<array<array<array<double>>>>"


def repair(features: DataFrame, rings: str = "rings") -> DataFrame:
    """features with ``polygons``, the repaired geometry, and ``problem``, why there is none; such rows are for quarantine.

    rings is an array of rings of [x, y], open or closed, which may cross or touch
    themselves and one another.  Null, empty and flat geometries have none.
    """
    names = [c for c in features.columns if c not in ("polygons", "problem")]
    kept = features.select(*[f"`{c}`" for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [repaired(r) if r else [] for r in batch.column(names.index(rings)).to_pylist()]
            said = [None if p else "no geometry" if not r else "no area" for p, r in zip(fixed, batch.column(names.index(rings)).to_pylist())]
            coordinates = pa.array([p or None for p in fixed], pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))
            yield pa.RecordBatch.from_arrays([*batch.columns, coordinates, pa.array(said, pa.string())], [*names, "polygons", "problem"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return dealt(kept).mapInArrow(run, f"{fields}, polygons {POLYGONS}, problem string")


def all_sides(rings: Column) -> Column:
    """(ax, ay, bx, by) of the sides of all rings."""
    return F.flatten(F.transform(rings, G._sides))


def area(rings: Column) -> Column:
    """The signed areas of all rings together: of a polygon whose holes turn the other way, its area."""
    return F.aggregate(all_sides(rings), F.lit(0.0), lambda a, s: a + (s["ax"] * s["by"] - s["bx"] * s["ay"]) / 2)


def holds_point(sides: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the parity of the sides to its right; points on a side may count either way."""
    def crossed(s: Column) -> Column:
        return ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.when(s["by"] == s["ay"], F.lit(1.0)).otherwise(s["by"] - s["ay"]) + s["ax"])

    return F.size(F.filter(sides, crossed)) % 2 == 1


def side_meets_box(s: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a side and a closed rectangle share a point: no axis and no normal of the side keeps them apart."""
    boxes = (F.least(s["ax"], s["bx"]) <= east) & (F.greatest(s["ax"], s["bx"]) >= west) & (F.least(s["ay"], s["by"]) <= north) & (F.greatest(s["ay"], s["by"]) >= south)
    turns = [(s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]) for x in (west, east) for y in (south, north)]
    return boxes & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)


def cells_of(areas: DataFrame, size: float) -> DataFrame:
    """(area_id, cx, cy, sides): the grid cells that areas (area_id, rings) touch, with the sides that pass through a cell; null for a cell that lies inside as a whole.

    Sides find their cells themselves.  Only cells without a side ask the geometry
    where they lie, once for their middle.
    """
    def box(df: DataFrame, xs: list[Column], ys: list[Column]) -> DataFrame:
        wide = df.withColumn("cx", F.explode(G.cells(F.least(*xs), F.greatest(*xs), size)))
        return wide.withColumn("cy", F.explode(G.cells(F.least(*ys), F.greatest(*ys), size)))

    sides = areas.select("area_id", F.explode(all_sides(F.col("rings"))).alias("s"))
    passed = box(sides, [F.col("s.ax"), F.col("s.bx")], [F.col("s.ay"), F.col("s.by")])
    west, south = F.col("cx") * size, F.col("cy") * size
    passed = passed.filter(side_meets_box(F.col("s"), west, south, west + size, south + size))
    border = passed.groupBy("area_id", "cx", "cy").agg(F.collect_list("s").alias("sides"))  # a cell's own sides
    xs, ys = F.transform("sides", lambda s: s["ax"]), F.transform("sides", lambda s: s["ay"])
    whole = areas.select("area_id", all_sides(F.col("rings")).alias("sides")).select("area_id", "sides", F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    every = box(whole, [F.col("x0"), F.col("x1")], [F.col("y0"), F.col("y1")]).join(border.select("area_id", "cx", "cy"), ["area_id", "cx", "cy"], "left_anti")
    inner = every.filter(holds_point(F.col("sides"), west + size / 2, south + size / 2)).select("area_id", "cx", "cy", F.lit(None).cast("array<struct<ax:double,ay:double,bx:double,by:double>>").alias("sides"))
    return border.unionByName(inner)


def polygons_meeting(boxes: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """(area_id, id) of rectangles (id, xmin .. ymax) that share a point with areas (area_id, rings of several parts and holes).

    Both meet in grid cells, by an equi-join.  In an inside cell that settles it; in
    a border cell the rectangle's part of the cell is held against the sides that
    pass through the cell, and one corner of it against the whole geometry.
    """
    known = boxes.filter(F.col("xmin").isNotNull()).withColumn("cx", F.explode(G.cells(F.col("xmin"), F.col("xmax"), size)))
    known = known.withColumn("cy", F.explode(G.cells(F.col("ymin"), F.col("ymax"), size)))
    met = known.join(cells_of(areas, size), ["cx", "cy"])
    west, south = F.greatest("xmin", F.col("cx") * size), F.greatest("ymin", F.col("cy") * size)
    east, north = F.least("xmax", (F.col("cx") + 1) * size), F.least("ymax", (F.col("cy") + 1) * size)
    sure = F.col("sides").isNull() | F.exists("sides", lambda s: side_meets_box(s, west, south, east, north))
    marked = met.select("area_id", "id", west.alias("x"), south.alias("y"), sure.alias("sure")).distinct()
    yes = marked.filter("sure").select("area_id", "id")
    # no side near: the part lies inside or outside as a whole
    asked = marked.filter("NOT sure").join(areas.select("area_id", all_sides(F.col("rings")).alias("sides")), "area_id").filter(holds_point(F.col("sides"), F.col("x"), F.col("y"))).select("area_id", "id")
    return yes.union(asked).distinct()
