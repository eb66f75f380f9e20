"""Queries of keys, codes, limits and geometry functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobath.functions import geo as G
from isobath.functions import keys as K
from isobath.operators.steps import dealt
from isobath.plans.base import query, r6

BOUNDS = ["west", "south", "east", "north"]
BOUND_SQL = " || ',' || ".join(f"CAST(round({b}, 5) AS VARCHAR)" for b in BOUNDS)


@query(
    "cache_keys",
    f"""SELECT scene_id, sha1({BOUND_SQL} || '|2024-01-01|2024-02-01|depth-v3|' || CASE WHEN scene_id % 2 = 0 THEN '3.1' ELSE '' END) AS result_key,
      's2_' || substr(sha1({BOUND_SQL} || '|2024-01-01|2024-02-01|' || CAST(scene_id % 3 * 10 AS VARCHAR) || '|1024'), 1, 24) AS scene_key FROM scenes""",
    ("scenes",),
)
def _(t):
    bounds, first, last = [F.col(c) for c in BOUNDS], F.lit("2024-01-01"), F.lit("2024-02-01")
    version = F.when(F.col("scene_id") % 2 == 0, "3.1")
    return t("scenes").select("scene_id", K.result_key(bounds, first, last, F.lit("depth-v3"), version).alias("result_key"), K.scene_key(bounds, first, last, (F.col("scene_id") % 3 * 10).cast("string"), F.lit("1024")).alias("scene_key"))


@query("report_codes", "SELECT id, 'RPT-' || upper(substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS code FROM reports", ("reports",))
def _(t):
    return t("reports").select("id", K.report_code(F.col("id").cast("string")).alias("code"))


@query("target_grid", "SELECT scene_id, CAST(greatest(16, least(1024, round_even(abs(east - west) / (10e0 * (1 / (111320.0e0 * greatest(cos(radians((south + north) / 2)), 0.1e0)))), 0))) AS INT) AS width, CAST(greatest(16, least(1024, round_even(abs(north - south) / (10e0 * (1 / 111320.0e0)), 0))) AS INT) AS height FROM (SELECT * REPLACE (west + (scene_id % 5) / 40.0e0 AS west) FROM scenes)", ("scenes",))
def _(t):
    s = t("scenes").withColumn("west", F.col("west") + (F.col("scene_id") % 5) / 40)
    w, h = G.target_grid(*[F.col(c) for c in BOUNDS])
    return s.select("scene_id", w.alias("width"), h.alias("height"))


@query("client_addresses", "SELECT id, CASE WHEN forwarded <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE coalesce(peer, 'unknown') END AS client FROM requests", ("requests",))
def _(t):
    return t("requests").select("id", K.first_hop(F.col("forwarded"), F.col("peer")).alias("client"))


@query(
    "rate_limits",
    """SELECT id, coalesce(n, 5) AS count, CASE WHEN n IS NULL THEN 60 ELSE CASE lower(trim(split_part(limit_spec, '/', 2))) WHEN 'second' THEN 1 WHEN 'hour' THEN 3600 WHEN 'day' THEN 86400 ELSE 60 END END AS seconds
    FROM (SELECT id, limit_spec, TRY_CAST(trim(split_part(limit_spec, '/', 1)) AS INT) AS n FROM requests)""",
    ("requests",),
)
def _(t):
    return t("requests").select("id", K.parse_limit(F.col("limit_spec")).alias("l")).select("id", "l.count", "l.seconds")


@query(
    "byte_ranges",
    """SELECT id, status, CASE WHEN status = 206 THEN a END AS start, CASE WHEN status = 206 THEN b END AS "end" FROM (SELECT *, CASE WHEN range_header IS NULL THEN 200 WHEN a IS NULL OR b IS NULL OR a >= file_size OR b >= file_size THEN 416 ELSE 206 END AS status FROM (
      SELECT *, CASE WHEN split_part(s, '-', 1) = '' THEN 0 ELSE TRY_CAST(split_part(s, '-', 1) AS BIGINT) END AS a, CASE WHEN split_part(s, '-', 2) = '' THEN file_size - 1 ELSE TRY_CAST(split_part(s, '-', 2) AS BIGINT) END AS b FROM (SELECT *, replace(range_header, 'bytes=', '') AS s FROM requests)))""",
    ("requests",),
)
def _(t):
    return t("requests").select("id", K.byte_range(F.col("range_header"), F.col("file_size")).alias("r")).select("id", "r.status", "r.start", "r.end")


@query(
    "banner_and_depth",
    """SELECT id, CASE WHEN contains(upper(marking), 'TOP SECRET') THEN '255,140,0' WHEN contains(upper(marking), 'SECRET') THEN '239,68,68' WHEN contains(upper(marking), 'CONFIDENTIAL') THEN '59,130,246' WHEN contains(upper(marking), 'RESTRICTED') THEN '234,179,8' ELSE '34,197,94' END AS colour,
      CASE WHEN dtype IN ('uint16', 'int16') THEN 16 WHEN dtype = 'float32' THEN 32 WHEN dtype = 'float64' THEN 64 ELSE 8 END AS bits, left(marking, 6) AS short FROM requests""",
    ("requests",),
)
def _(t):
    return t("requests").select("id", K.marking_colour(F.col("marking")).alias("colour"), K.bit_depth(F.col("dtype")).alias("bits"), F.left("marking", F.lit(6)).alias("short"))


@query(
    "iso_times",
    """SELECT id, CAST(epoch(TRY_CAST(replace(stamp, 'Z', '+00:00') AS TIMESTAMPTZ)) AS BIGINT) AS seconds, CASE WHEN day IS NOT NULL AND clock IS NOT NULL THEN day || 'T' || clock ELSE day END AS joined FROM requests""",
    ("requests",),
)
def _(t):
    return t("requests").select("id", F.unix_timestamp(K.iso_time(F.col("stamp"))).alias("seconds"), K.day_and_time(F.col("day"), F.col("clock")).alias("joined"))


@query("level_ladder", "SELECT id, i AS level, greatest(1, w // CAST(pow(2, i) AS BIGINT)) AS width, greatest(1, h // CAST(pow(2, i) AS BIGINT)) AS height, 1 / pow(2e0, i) AS scale FROM (SELECT *, CAST(greatest(1, least(12, trunc(log2(least(w, h) / 64.0e0)))) AS INT) AS n FROM (SELECT id, id % 9000 + 64 AS w, id % 4000 + 64 AS h FROM raster_catalog)), (SELECT CAST(unnest(generate_series(0, 12)) AS INT) AS i) WHERE i <= n", ("raster_catalog",))
def _(t):
    sized = t("raster_catalog").select("id", (F.col("id") % 9000 + 64).alias("w"), (F.col("id") % 4000 + 64).alias("h"))
    return sized.select("id", F.explode(K.levels(F.col("w"), F.col("h"), K.level_count(F.col("w"), F.col("h")))).alias("l")).select("id", "l.*")


@query("vendor_numbers", "SELECT id, TRY_CAST(json_extract_string(details, '$.view_angle') AS DOUBLE) AS angle, json_extract_string(details, '$.sensor') AS sensor FROM requests", ("requests",))
def _(t):
    return t("requests").select("id", F.get_json_object("details", "$.view_angle").try_cast("double").alias("angle"), F.get_json_object("details", "$.sensor").alias("sensor"))


@query("footprint_wkt", "SELECT scene_id, 'POLYGON((' || west || ' ' || south || ', ' || east || ' ' || south || ', ' || east || ' ' || north || ', ' || west || ' ' || north || ', ' || west || ' ' || south || '))' AS wkt, 'POINT(' || (west + east) / 2 || ' ' || (south + north) / 2 || ')' AS centre FROM scenes", ("scenes",))
def _(t):
    w, s, e, n = (F.col(c) for c in BOUNDS)
    centre = F.concat(F.lit("POINT("), ((w + e) / 2).cast("string"), F.lit(" "), ((s + n) / 2).cast("string"), F.lit(")"))
    return t("scenes").select("scene_id", G.envelope_wkt(w, s, e, n).alias("wkt"), centre.alias("centre"))


@query("mercator_round_trip", "SELECT id, round(xmin * 20037508.342789244e0 / 180, 3) AS x, round(ln(tan((90 + ymin) * pi() / 360)) / pi() * 20037508.342789244e0, 3) + 0e0 AS y, round(xmin, 6) AS lon, round(ymin, 6) + 0e0 AS lat FROM raster_catalog WHERE ymin > -85", ("raster_catalog",))
def _(t):
    x, y = G.lonlat_to_mercator(F.col("xmin"), F.col("ymin"))
    df = t("raster_catalog").filter("ymin > -85").select("id", x.alias("x"), y.alias("y"))
    lon, lat = G.mercator_to_lonlat(F.col("x"), F.col("y"))
    return df.select("id", F.round("x", 3).alias("x"), (F.round("y", 3) + 0.0).alias("y"), r6(lon, "lon"), (F.round(lat, 6) + 0.0).alias("lat"))


@query("sounding_pixels", "SELECT id, scene_id, CAST(round_even((north - lat) / (north - south) * 31, 0) AS BIGINT) AS r, CAST(round_even((lon - west) / (east - west) * 31, 0) AS BIGINT) AS c FROM raw_soundings JOIN scenes USING (scene_id) WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north AND abs(depth) BETWEEN 0.3 AND 25", ("raw_soundings", "scenes"))
def _(t):
    # scenes are a catalogue: the planner broadcasts them only within its own size bound
    df = t("raw_soundings").filter(F.abs("depth").between(0.3, 25)).join(t("scenes"), "scene_id")
    r, c = G.to_pixel(F.col("lon"), F.col("lat"), *[F.col(b) for b in BOUNDS], F.col("width"), F.col("height"))
    return df.select("id", "scene_id", r.alias("r"), c.alias("c")).filter("r IS NOT NULL")


@query("half_open_cells", "SELECT id, x, y FROM raster_catalog, (SELECT unnest(generate_series(-360, 360)) AS x) a, (SELECT unnest(generate_series(-180, 180)) AS y) b WHERE x >= floor(xmin / 0.5e0) AND x < ceil(xmax / 0.5e0) AND y >= floor(ymin / 0.5e0) AND y < ceil(ymax / 0.5e0)", ("raster_catalog",))
def _(t):
    wide = t("raster_catalog").filter("xmin IS NOT NULL").select("id", F.explode(G.half_open_cells(F.col("xmin"), F.col("xmax"), 0.5)).alias("x"), "ymin", "ymax")
    return wide.select("id", "x", F.explode(G.half_open_cells(F.col("ymin"), F.col("ymax"), 0.5)).alias("y"))


@query("feature_buffers", "SELECT id, round(CASE WHEN extent = 0 THEN xmin - 10 / 111320.0e0 / greatest(cos(radians(ymin)), 0.1e0) ELSE xmin END, 9) AS west, round(CASE WHEN extent = 0 THEN ymin - 10 / 111320.0e0 ELSE ymin END, 9) AS south, round(CASE WHEN extent = 0 THEN xmin + 10 / 111320.0e0 / greatest(cos(radians(ymin)), 0.1e0) ELSE xmin + extent END, 9) AS east, round(CASE WHEN extent = 0 THEN ymin + 10 / 111320.0e0 ELSE ymin + extent END, 9) AS north FROM vector_features", ("vector_features",))
def _(t):
    sides = G.buffered(F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("extent"), F.col("ymin") + F.col("extent"))
    return t("vector_features").select("id", *[F.round(s, 9).alias(n) for s, n in zip(sides, BOUNDS)])


@query(
    "polygon_access",
    """SELECT DISTINCT a.id AS area_id, c.id FROM (SELECT id, xmin AS ax, ymin AS ay, xmax AS ex, ymax AS ey FROM areas) a JOIN raster_catalog c ON c.xmin <= ex AND c.xmax >= ax AND c.ymin <= ey AND c.ymax >= ay
    WHERE NOT ((ey - ay) * (c.xmax - ax) - (ex - ax) / 2 * (c.ymin - ay) < 0 OR (ey - ay) * (ex - c.xmin) - (ex - ax) / 2 * (c.ymin - ay) < 0)""",
    ("areas", "raster_catalog"),
)
def _(t):
    # areas as triangles over their lower side: rectangles meet through cells first, then polygons are compared
    from isobath.operators.catalog import meeting

    def point(x, y):
        return F.array(x, y)

    a = t("areas").select(F.col("id").alias("area_id"), *[F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    c = t("raster_catalog").select("id", "xmin", "ymin", "xmax", "ymax")
    x, y, u, v = (F.col(n) for n in ("wxmin", "wymin", "wxmax", "wymax"))
    triangle = F.array(point(x, y), point(u, y), point((x + u) / 2, v), point(x, y))
    p, q, r, s = (F.col(n) for n in ("xmin", "ymin", "xmax", "ymax"))
    box = F.array(point(p, q), point(r, q), point(r, s), point(p, s), point(p, q))
    return meeting(c, a).filter(G.rings_intersect(triangle, box)).select("area_id", "id").distinct()


@query("valid_polygons", "SELECT id, id % 4 IN (0, 1) AS valid FROM vector_features WHERE geometry_type = 'Polygon'", ("vector_features",))
def _(t):
    # by id: a triangle, a square, an open ring, a bow tie
    x, y = F.col("xmin"), F.col("ymin")
    at = lambda i, j: F.array(x + i * F.col("extent"), y + j * F.col("extent"))
    rings = [[(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]
    ring = F.get(F.array(*[F.array(*[at(*p) for p in r]) for r in rings]), (F.col("id") % 4).cast("int"))
    return dealt(t("vector_features").filter("geometry_type = 'Polygon'"), "id").select("id", G.valid_ring(ring).alias("valid"))


@query("roi_bounds", "SELECT id, CASE WHEN id % 3 = 0 THEN xmin - 1 ELSE xmin END AS west, ymin AS south, CASE WHEN id % 3 = 0 THEN xmin + extent + 1 ELSE xmin + extent END AS east, ymin + extent AS north FROM vector_features", ("vector_features",))
def _(t):
    # bounds named in the metadata come first, those of the drawn ring otherwise
    x, y, e = F.col("xmin"), F.col("ymin"), F.col("extent")
    ring = F.array(F.array(x, y + e), F.array(x + e, y), F.array(x, y), F.array(x + e, y + e))
    named = F.when(F.col("id") % 3 == 0, F.array(x - 1, y, x + e + 1, y + e))
    return t("vector_features").select("id", *[F.coalesce(F.get(named, i), b).alias(n) for i, (b, n) in enumerate(zip(G.ring_bounds(ring), BOUNDS))])
