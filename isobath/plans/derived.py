"""Queries of repaired and many-part polygons, aggregates kept by changes, and stale tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobath.operators import derived as K
from isobath.operators import polygons as O
from isobath.plans.base import query

#: Rings by id modulo 8, in parts of the feature's extent: what they are, and the parts and the area that they have once repaired. The last one is flat.
SHAPES = [
    ([[(0, 0), (1, 0), (1, 1), (0, 0)]], 1, 0.5),
    ([[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]], 1, 1.0),
    ([[(0, 0), (1, 0), (1, 1), (0, 1)]], 1, 1.0),  # open
    ([[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]], 2, 0.5),  # a bow tie
    ([[(0, 0), (1, 0), (1, 1), (2, 1), (1, 1), (0, 1), (0, 0)]], 1, 1.0),  # with a spike
    ([[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]], 1, 15.0),  # with a hole
    ([[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]], 2, 6.0),  # two that overlap
    ([[(0, 0), (1, 1), (2, 2), (0, 0)]], 0, 0.0),
]


@query(
    "repaired_polygons",
    f"SELECT id, CASE id % 8 {' '.join(f'WHEN {i} THEN {n}' for i, (_, n, _) in enumerate(SHAPES))} END AS parts, round(extent * extent * CASE id % 8 {' '.join(f'WHEN {i} THEN {a}e0' for i, (_, _, a) in enumerate(SHAPES))} END, 9) AS area, CASE WHEN id % 8 = 7 THEN 'no area' END AS problem FROM vector_features WHERE geometry_type <> 'Point'",
    ("vector_features",),
)
def _(t):
    def at(x, y):
        return F.array(F.col("xmin") + x * F.col("extent"), F.col("ymin") + y * F.col("extent"))

    rings = F.get(F.array(*[F.array(*[F.array(*[at(*p) for p in ring]) for ring in shape]) for shape, _, _ in SHAPES]), (F.col("id") % 8).cast("int"))
    fixed = O.repair(t("vector_features").filter("geometry_type <> 'Point'").select("id", rings.alias("rings")))
    area = F.aggregate(F.coalesce("polygons", F.array().cast(O.POLYGONS)), F.lit(0.0), lambda a, p: a + O.area(p))
    # coordinates are multiples of an eighth, so nothing is lost to rounding
    return fixed.select("id", F.coalesce(F.size("polygons"), F.lit(0)).alias("parts"), F.round(area, 9).alias("area"), "problem")


def _outside(x1: str, y1: str, x2: str, y2: str, strict: str = "<") -> str:
    """SQL: the rectangle c lies to the right of the line as a whole; a triangle's sides turn to the left."""
    turn = [f"({x2} - ({x1})) * ({y} - ({y1})) - ({y2} - ({y1})) * ({x} - ({x1}))" for x in ("c.xmin", "c.xmax") for y in ("c.ymin", "c.ymax")]
    return f"greatest({', '.join(turn)}) {strict} 0"


def _within(corners: list[tuple[str, str]]) -> str:
    """SQL: the rectangle c lies strictly inside a triangle."""
    sides = zip(corners, corners[1:] + corners[:1])
    return " AND ".join(f"least({', '.join(f'({b[0]} - ({a[0]})) * ({y} - ({a[1]})) - ({b[1]} - ({a[1]})) * ({x} - ({a[0]}))' for x in ('c.xmin', 'c.xmax') for y in ('c.ymin', 'c.ymax'))}) > 0" for a, b in sides)


def _apart(corners: list[tuple[str, str]], box: str) -> str:
    """SQL: the rectangle c shares no point with a triangle that has these corners and this bounding box."""
    sides = list(zip(corners, corners[1:] + corners[:1]))
    return f"(NOT ({box}) OR {' OR '.join(_outside(*a, *b) for a, b in sides)})"


#: An area's two parts, triangles over its lower and its upper side, the lower one with a triangle cut out. Numerators of sixteenths of its width and height.
PARTS = {"lower": [(0, 0), (16, 0), (8, 8)], "hole": [(4, 1), (12, 1), (8, 6)], "upper": [(0, 16), (8, 10), (16, 16)]}


def _corners(name: str) -> list[tuple[str, str]]:
    return [(f"ax + (ex - ax) * {x} / 16", f"ay + (ey - ay) * {y} / 16") for x, y in PARTS[name]]


def _bounds(name: str) -> str:
    (x0, y0), (x1, y1) = (tuple(f(v) for v in zip(*PARTS[name])) for f in (min, max))
    return f"c.xmin <= ax + (ex - ax) * {x1} / 16 AND c.xmax >= ax + (ex - ax) * {x0} / 16 AND c.ymin <= ay + (ey - ay) * {y1} / 16 AND c.ymax >= ay + (ey - ay) * {y0} / 16"


@query(
    "polygon_parts_access",
    f"""SELECT a.id AS area_id, c.id FROM (SELECT id, xmin AS ax, ymin AS ay, xmax AS ex, ymax AS ey FROM areas) a JOIN raster_catalog c ON c.xmin <= ex AND c.xmax >= ax AND c.ymin <= ey AND c.ymax >= ay
    WHERE (NOT {_apart(_corners('lower'), _bounds('lower'))} AND NOT ({_within(_corners('hole'))})) OR NOT {_apart(_corners('upper'), _bounds('upper'))}""",
    ("areas", "raster_catalog"),
)
def _(t):
    x, y, w, h = F.col("xmin"), F.col("ymin"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    rings = F.array(*[F.array(*[F.array(x + w * i / 16, y + h * j / 16) for i, j in [*corners, corners[0]]]) for corners in PARTS.values()])
    return O.polygons_meeting(t("raster_catalog").select("id", *K.BOX), t("areas").select(F.col("id").alias("area_id"), rings.alias("rings")), 2.0)


FEATURES_SQL = "(SELECT dataset_id, xmin, ymin, xmin + extent AS xmax, ymin + extent AS ymax FROM vector_features WHERE id % 7 <> 3 AND (dataset_id <> 4 OR id % 14 = 4))"
_FLAT = "(xmin = xmax OR ymin = ymax)"
_DX = "(10 / 111320.0e0 / greatest(cos(radians((ymin + ymax) / 2)), 0.1e0))"


@query(
    "dataset_aggregates",
    f"""SELECT dataset_id, features, round(CASE WHEN {_FLAT} THEN xmin - {_DX} ELSE xmin END, 9) AS west, round(CASE WHEN {_FLAT} THEN ymin - 10 / 111320.0e0 ELSE ymin END, 9) AS south, round(CASE WHEN {_FLAT} THEN xmax + {_DX} ELSE xmax END, 9) AS east, round(CASE WHEN {_FLAT} THEN ymax + 10 / 111320.0e0 ELSE ymax END, 9) AS north
      FROM (SELECT dataset_id, count(*) AS features, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM {FEATURES_SQL} GROUP BY dataset_id)""",
    ("vector_features",),
)
def _(t):
    f = t("vector_features").select("id", "dataset_id", "xmin", "ymin", (F.col("xmin") + F.col("extent")).alias("xmax"), (F.col("ymin") + F.col("extent")).alias("ymax"))
    # two thirds are there; a batch brings the others and takes every seventh; another one takes most of a dataset
    first, after = "id % 3 > 0", "id % 7 <> 3"
    last = f"{after} AND (dataset_id <> 4 OR id % 14 = 4)"
    held = K.extents(f.filter(first))
    one = f.filter(f"NOT ({first}) AND {after}").withColumn("sign", F.lit(1)).union(f.filter(f"{first} AND NOT ({after})").withColumn("sign", F.lit(-1)))
    held = K.advanced(held, one, f.filter(after))
    held = K.advanced(held, f.filter(f"{after} AND NOT ({last})").withColumn("sign", F.lit(-1)), f.filter(last))
    sides = [F.round(c, 9).alias(n) for c, n in zip(K.BOX, ("west", "south", "east", "north"))]
    return K.widened(held).select("dataset_id", "features", *sides)


@query(
    "stale_tiles",
    """SELECT c.id, k.z, k.x, k.y FROM (SELECT id, xmin, ymin, xmax, ymax FROM raster_catalog WHERE updated_at > created_at AND xmin IS NOT NULL) c
      JOIN (SELECT z, x, y, x / pow(2, z) * 360 - 180 AS west, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2, z))))) AS south, (x + 1) / pow(2, z) * 360 - 180 AS east, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2, z))))) AS north FROM cached_tiles) k
      ON xmin <= east AND xmax >= west AND ymin <= north AND ymax >= south""",
    ("raster_catalog", "cached_tiles"),
)
def _(t):
    return K.stale_tiles(t("raster_catalog").filter("updated_at > created_at"), t("cached_tiles"))
