"""Rectangle predicates, grid cells and tile arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = 20037508.342789244
METRES_PER_DEGREE = 111320.0


def overlaps(xmin: Column, ymin: Column, xmax: Column, ymax: Column, west, south, east, north) -> Column:
    """Whether two closed rectangles share a point; null where one has no coordinates."""
    west, south, east, north = (v if isinstance(v, Column) else F.lit(float(v)) for v in (west, south, east, north))
    return (xmin <= east) & (xmax >= west) & (ymin <= north) & (ymax >= south)


def cells(low: Column, high: Column, size: float) -> Column:
    """The indexes of the grid cells that the closed range [low, high] touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


def tile_lonlat(z: Column, x: Column, y: Column) -> list[Column]:
    """(west, south, east, north) of an XYZ tile in degrees."""
    n = F.pow(F.lit(2.0), z)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * row / n))))

    return [x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y)]


def tile_mercator(z: Column, x: Column, y: Column) -> list[Column]:
    """(west, south, east, north) of an XYZ tile in Web-Mercator metres."""
    size = F.lit(2 * ORIGIN) / F.pow(F.lit(2.0), z)
    return [x * size - ORIGIN, F.lit(ORIGIN) - (y + 1) * size, (x + 1) * size - ORIGIN, F.lit(ORIGIN) - y * size]


def lonlat_to_mercator(lon: Column, lat: Column) -> list[Column]:
    return [lon * ORIGIN / 180.0, F.log(F.tan((90.0 + lat) * math.pi / 360.0)) / math.pi * ORIGIN]


def mercator_to_lonlat(x: Column, y: Column) -> list[Column]:
    return [x / ORIGIN * 180.0, F.degrees(2 * F.atan(F.exp(y / ORIGIN * math.pi)) - math.pi / 2)]


def envelope_geojson(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A rectangle as GeoJSON text, null without coordinates."""
    ring = F.array(F.array(xmin, ymin), F.array(xmax, ymin), F.array(xmax, ymax), F.array(xmin, ymax), F.array(xmin, ymin))
    return F.when(xmin.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))


def envelope_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in corners]), F.lit("))"))


def ground_resolution(x_res: Column, y_res: Column, lat: Column) -> Column:
    """Metres of a pixel whose sides are given in degrees."""
    return (F.abs(x_res) + F.abs(y_res)) / 2 * METRES_PER_DEGREE * F.cos(F.radians(lat))


def zoom_levels(resolution: Column) -> tuple[Column, Column]:
    """(lowest, highest) zoom at which a raster of that resolution is shown."""
    top = F.greatest(F.lit(0), F.least(F.lit(24), F.log2(156543.0 / resolution).cast("int")))
    return F.greatest(F.lit(0), top - 8), top


def target_grid(west: Column, south: Column, east: Column, north: Column, metres: float = 10.0, most: int = 1024) -> tuple[Column, Column]:
    """(width, height) of a grid of about that many metres, between 16 and most on a side; halves go to the even number."""
    cosine = F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(0.1))
    wide = F.bround(F.abs(east - west) / (metres * (1.0 / (METRES_PER_DEGREE * cosine))), 0)
    high = F.bround(F.abs(north - south) / (metres * (1.0 / METRES_PER_DEGREE)), 0)
    return tuple(F.greatest(F.lit(16), F.least(F.lit(most), x.cast("int"))) for x in (wide, high))


def to_pixel(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(row, column) of a point in a grid over closed bounds; null outside."""
    inside = lon.between(west, east) & lat.between(south, north)
    r = F.bround((north - lat) / (north - south) * (height - 1), 0).cast("long")
    c = F.bround((lon - west) / (east - west) * (width - 1), 0).cast("long")
    return F.when(inside, r), F.when(inside, c)


def half_open_cells(low: Column, high: Column, size: float) -> Column:
    """The indexes of the grid cells of [low, high), none for an empty range."""
    first, end = F.floor(low / size), F.ceil(high / size)
    return F.when(end > first, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))


def buffered(xmin: Column, ymin: Column, xmax: Column, ymax: Column, metres: float = 10.0) -> list[Column]:
    """A rectangle that is widened on all sides if it is a point or a line, so that it has an area; a plane stands in for the globe."""
    flat = (xmin == xmax) | (ymin == ymax)
    dy = metres / METRES_PER_DEGREE
    dx = dy / F.greatest(F.cos(F.radians((ymin + ymax) / 2)), F.lit(0.1))
    return [F.when(flat, xmin - dx).otherwise(xmin), F.when(flat, ymin - dy).otherwise(ymin), F.when(flat, xmax + dx).otherwise(xmax), F.when(flat, ymax + dy).otherwise(ymax)]


def ring_bounds(ring: Column) -> list[Column]:
    """(xmin, ymin, xmax, ymax) of an array of [x, y]."""
    xs, ys = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def _sides(ring: Column) -> Column:
    """(ax, ay, bx, by) of each side of a ring whose last point repeats the first."""
    n = F.size(ring)
    return F.transform(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p[0].alias("ax"), p[1].alias("ay"), F.get(ring, i + 1)[0].alias("bx"), F.get(ring, i + 1)[1].alias("by")))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a ring, by the parity of the sides to its right; points on a side may count either way."""
    cross = F.filter(_sides(ring), lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < (s["bx"] - s["ax"]) * (y - s["ay"]) / F.when(s["by"] == s["ay"], F.lit(1.0)).otherwise(s["by"] - s["ay"]) + s["ax"]))
    return F.size(cross) % 2 == 1


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def sides_cross(s: Column, t: Column) -> Column:
    """Whether two segments cross or touch each other."""
    one, two = _turn(s["ax"], s["ay"], s["bx"], s["by"], t["ax"], t["ay"]), _turn(s["ax"], s["ay"], s["bx"], s["by"], t["bx"], t["by"])
    three, four = _turn(t["ax"], t["ay"], t["bx"], t["by"], s["ax"], s["ay"]), _turn(t["ax"], t["ay"], t["bx"], t["by"], s["bx"], s["by"])
    boxes = (F.least(s["ax"], s["bx"]) <= F.greatest(t["ax"], t["bx"])) & (F.least(t["ax"], t["bx"]) <= F.greatest(s["ax"], s["bx"])) & (F.least(s["ay"], s["by"]) <= F.greatest(t["ay"], t["by"])) & (F.least(t["ay"], t["by"]) <= F.greatest(s["ay"], s["by"]))
    return boxes & (one * two <= 0) & (three * four <= 0)


def rings_intersect(a: Column, b: Column) -> Column:
    """Whether two polygons, each one closed ring, share a point."""
    touch = F.exists(_sides(a), lambda s: F.exists(_sides(b), lambda t: sides_cross(s, t)))
    return touch | contains_point(a, F.get(b, 0)[0], F.get(b, 0)[1]) | contains_point(b, F.get(a, 0)[0], F.get(a, 0)[1])


def valid_ring(ring: Column) -> Column:
    """Whether a ring is closed, has four points at least and no two sides that are not neighbours meet."""
    s = _sides(ring)
    n = F.size(s)
    crossing = F.exists(s, lambda a: F.exists(s, lambda b: sides_cross(a, b) & ~_next_to(a, b)))
    return (F.size(ring) >= 4) & (F.get(ring, 0) == F.get(ring, n)) & ~crossing


def _next_to(a: Column, b: Column) -> Column:
    """Whether two sides are one, or the end of one is the start of the other."""
    def same(p: str, q: str) -> Column:
        return (a[p + "x"] == b[q + "x"]) & (a[p + "y"] == b[q + "y"])

    return same("a", "a") | same("b", "a") | same("a", "b")
