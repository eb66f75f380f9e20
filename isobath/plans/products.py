"""Queries of sources, vendor sidecars, reports and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobath.functions import geo as G
from isobath.operators import catalog as C
from isobath.operators import reports as P
from isobath.plans.base import query, r6
from isobath.sources import readers as S
from isobath.sources import vendors as V

BOX = (-60.0, -40.0, 60.0, 40.0)

# scans and lookups


@query("raster_by_id", "SELECT id, name, processing_status FROM raster_catalog WHERE id = 32", ("raster_catalog",))
def _(t):
    return t("raster_catalog").filter("id = 32").limit(1).select("id", "name", "processing_status")


@query("raster_by_parameters", "SELECT id, name FROM raster_catalog WHERE processing_status = 'ready' AND acquisition_date >= TIMESTAMP '1996-01-01' AND acquisition_date <= TIMESTAMP '1997-12-31'", ("raster_catalog",))
def _(t):
    rasters = t("raster_catalog")
    text = "SELECT id, name FROM {rasters} WHERE processing_status = :status AND acquisition_date >= CAST(:first AS TIMESTAMP_NTZ) AND acquisition_date <= CAST(:last AS TIMESTAMP_NTZ)"
    return rasters.sparkSession.sql(text, args={"status": "ready", "first": "1996-01-01", "last": "1997-12-31"}, rasters=rasters)


@query("raster_on_day", "SELECT id FROM raster_catalog WHERE CAST(acquisition_date AS DATE) = DATE '1996-01-02'", ("raster_catalog",))
def _(t):
    return t("raster_catalog").filter(F.to_date("acquisition_date") == F.lit("1996-01-02").cast("date")).select("id")


@query("raster_date_range", "SELECT id FROM raster_catalog WHERE acquisition_date >= TIMESTAMP '1996-01-01' AND acquisition_date <= TIMESTAMP '1996-06-30'", ("raster_catalog",))
def _(t):
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1996-06-30"))
    return C.where(t("raster_catalog"), F.col("acquisition_date") >= first, F.col("acquisition_date") <= last).select("id")


@query("viewport_dates", "SELECT DISTINCT CAST(acquisition_date AS DATE) AS day FROM (SELECT acquisition_date FROM raster_catalog WHERE processing_status = 'ready' AND xmin <= 60 AND xmax >= -60 AND ymin <= 40 AND ymax >= -40 ORDER BY acquisition_date DESC NULLS LAST, id LIMIT 500) WHERE acquisition_date IS NOT NULL ORDER BY day", ("raster_catalog",))
def _(t):
    newest = C.page(C.search_rasters(t("raster_catalog"), BOX, status="ready"), [F.desc_nulls_last("acquisition_date"), F.col("id")], 500)
    return newest.filter("acquisition_date IS NOT NULL").select(F.to_date("acquisition_date").alias("day")).distinct().orderBy("day")


@query("audit_page_with_total", "SELECT id, total FROM (SELECT id, event_time, count(*) OVER () AS total FROM audit_log WHERE action = 'purchase') ORDER BY event_time DESC, id LIMIT 20 OFFSET 20", ("audit_log",))
def _(t):
    found = C.where(t("audit_log"), F.col("action") == "purchase", None)
    total = found.agg(F.count("*").alias("total"))  # one row
    return C.page(found.select("id", "event_time"), [F.desc("event_time"), F.col("id")], 20, 20).join(F.broadcast(total)).select("id", "total")


@query("job_report_codes", """SELECT id, status, json_extract_string(metadata, '$.report_code') AS report_code, json_extract_string(metadata, '$.cached') = 'true' AS cached FROM job_records""", ("job_records",))
def _(t):
    return t("job_records").select("id", "status", F.get_json_object("metadata", "$.report_code").alias("report_code"), (F.get_json_object("metadata", "$.cached") == "true").alias("cached"))


@query("job_parts", """SELECT id, CASE WHEN metadata IS NULL THEN 404 ELSE 200 END AS status, json_extract_string(metadata, '$.codec.levels') AS levels FROM job_records""", ("job_records",))
def _(t):
    part = F.get_json_object("metadata", "$.codec")
    return t("job_records").select("id", F.when(F.col("metadata").isNull(), 404).otherwise(200).alias("status"), F.get_json_object(part, "$.levels").alias("levels"))


@query("series_page", "SELECT s.id, string_agg(CAST(e.raster_id AS VARCHAR), ',' ORDER BY e.sort_order, e.raster_id) AS rasters FROM (SELECT id FROM raster_timeseries ORDER BY name, id LIMIT 20 OFFSET 10) s LEFT JOIN raster_timeseries_entries e ON e.timeseries_id = s.id GROUP BY s.id", ("raster_timeseries", "raster_timeseries_entries"))
def _(t):
    chosen = C.page(t("raster_timeseries"), [F.col("name"), F.col("id")], 20, 10).select("id")
    entries = t("raster_timeseries_entries").join(F.broadcast(chosen), F.col("timeseries_id") == F.col("id"), "left_semi")  # a page of ids
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sort_order", "raster_id"))), lambda x: x["raster_id"].cast("string"))
    listed = entries.groupBy(F.col("timeseries_id").alias("id")).agg(F.array_join(ordered, ",").alias("rasters"))
    return chosen.join(listed, "id", "left")


@query("all_apps", "SELECT app_name, display_name FROM registered_apps ORDER BY app_name", ("registered_apps",))
def _(t):
    return t("registered_apps").orderBy("app_name").select("app_name", "display_name")


@query("profiles", "SELECT u.id, u.role = 'admin' AS global_access, CASE WHEN u.role <> 'admin' THEN count(a.id) ELSE 0 END AS areas FROM users u LEFT JOIN user_group_members m ON m.user_id = u.id LEFT JOIN areas a ON a.group_id = m.group_id GROUP BY u.id, u.role", ("users", "user_group_members", "areas"))
def _(t):
    # an administrator has no rows of areas but access everywhere
    rows = C.user_areas(t("areas"), t("user_group_members")).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    admin = F.col("role") == "admin"
    return t("users").join(rows, "id", "left").select("id", admin.alias("global_access"), F.when(~admin, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("areas"))


@query("group_apps", "SELECT g.id, coalesce(string_agg(a.app_name, ',' ORDER BY a.app_name), '') AS apps FROM user_groups g LEFT JOIN group_allowed_apps a ON a.group_id = g.id GROUP BY g.id", ("user_groups", "group_allowed_apps"))
def _(t):
    # one join for all groups
    apps = t("group_allowed_apps").groupBy(F.col("group_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("app_name")), ",").alias("apps"))
    return t("user_groups").select("id").join(apps, "id", "left").select("id", F.coalesce("apps", F.lit("")).alias("apps"))


@query("model_registry", "SELECT id, 'depth-v3' AS name, CASE WHEN id % 4 <> 3 THEN CAST(id % 5 AS VARCHAR) || '.0' END AS version, CASE WHEN id % 4 <> 3 THEN 2.8404e0 END AS rmse, id % 4 = 3 AS failed FROM user_groups", ("user_groups",))
def _(t):
    meta = F.when(F.col("id") % 4 == 3, F.lit("{broken")).otherwise(F.concat(F.lit('{"version": "'), (F.col("id") % 5).cast("string"), F.lit('.0", "holdout": {"rmse": 2.8404}}')))
    read = F.from_json(meta, "version STRING, holdout STRUCT<rmse: DOUBLE>")
    return t("user_groups").select("id", F.lit("depth-v3").alias("name"), read["version"].alias("version"), read["holdout"]["rmse"].alias("rmse"), read["version"].isNull().alias("failed"))


@query("active_users", "SELECT id, CASE WHEN NOT is_active OR id % 4 = 0 THEN 401 WHEN role <> 'admin' AND id % 3 = 0 THEN 403 ELSE 200 END AS status FROM users", ("users",))
def _(t):
    # every fourth token is no access token; every third page is for administrators
    token, page = F.when(F.col("id") % 4 == 0, "refresh").otherwise("access"), F.when(F.col("id") % 3 == 0, F.array(F.lit("admin"))).otherwise(F.array(*map(F.lit, ("admin", "analyst", "viewer"))))
    status = F.when(~F.col("is_active") | (token != "access"), 401).when(~F.array_contains(page, F.col("role")), 403).otherwise(200)
    return t("users").select("id", status.alias("status"))


@query("cache_hit_rate", "SELECT user_id, CASE WHEN count(*) = 0 THEN 0 ELSE round(count(*) FILTER (WHERE event_type = 'view') / CAST(count(*) AS DOUBLE), 4) END AS rate FROM events GROUP BY user_id")
def _(t):
    return t("events").groupBy("user_id").agg(F.round(F.coalesce(F.count_if(F.col("event_type") == "view") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("rate"))


@query("uploads_by_status", "SELECT processing_status, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM (SELECT * FROM raster_catalog WHERE uploaded_by = 16) GROUP BY processing_status", ("raster_catalog",))
def _(t):
    # the uploads of one person
    own = t("raster_catalog").filter("uploaded_by = 16")
    return own.groupBy("processing_status").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))


@query("top_by_index", "SELECT event_id FROM events WHERE event_type = 'view' ORDER BY value DESC, event_id LIMIT 25")
def _(t):
    return C.page(t("events").filter("event_type = 'view'"), [F.desc("value"), F.col("event_id")], 25).select("event_id")


# files


@query(
    "raster_formats",
    "SELECT id, CASE id % 9 WHEN 0 THEN 'geotiff' WHEN 1 THEN 'jp2' WHEN 2 THEN 'nitf' WHEN 3 THEN 'h5' WHEN 4 THEN 'mrsid' WHEN 5 THEN 'nc4' END AS format, CASE WHEN id % 9 >= 6 THEN 400 ELSE 201 END AS status FROM uploads",
    ("uploads",),
)
def _(t):
    kind = S.raster_format(F.col("path"), F.col("content"))
    return t("uploads").select("id", kind.alias("format"), F.when(kind.isNull(), 400).otherwise(201).alias("status"))


@query("vector_formats", "SELECT id, CASE id % 9 WHEN 7 THEN 'kmz' WHEN 8 THEN 'geojson' END AS format FROM uploads", ("uploads",))
def _(t):
    return t("uploads").select("id", S.vector_format(F.col("path"), F.col("content")).alias("format"))


@query("bundle_checks", "SELECT bundle_id, CASE WHEN n = 1 AND bad = 0 THEN 200 ELSE 400 END AS status, CASE WHEN n = 1 THEN main END AS main, bytes, bad AS refused FROM (SELECT bundle_id, count(*) FILTER (WHERE path LIKE '%.tif' OR path LIKE '%.JP2') AS n, min(path) FILTER (WHERE path LIKE '%.tif' OR path LIKE '%.JP2') AS main, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE path LIKE '../%') AS bad FROM bundle_files GROUP BY bundle_id)", ("bundle_files",))
def _(t):
    return S.bundle_check(t("bundle_files"), ["tif", "tiff", "jp2"])


@query("band_tiles", "SELECT CAST(scene_id AS VARCHAR) AS path, r, c, CAST(red AS INT) AS value FROM pixels", ("pixels",))
def _(t):
    # a scene's band as one binary tile, and back
    sample = F.transform(F.sort_array(F.collect_list(F.struct("r", "c", "red"))), lambda x: x["red"])
    tiles = t("pixels").groupBy(F.col("scene_id").cast("string").alias("path")).agg(S.write_band_tile(sample, 1, 32, 32).alias("content"))
    return S.read_band_tiles(tiles).select("path", "r", "c", "value")


K = "bundle_id % 7"


@query(
    "vendor_metadata",
    f"""SELECT DISTINCT bundle_id, CASE {K} WHEN 0 THEN 'maxar' WHEN 1 THEN 'airbus_dimap' WHEN 2 THEN 'planet' WHEN 3 THEN 'landsat' WHEN 4 THEN 'pam' WHEN 5 THEN 'generic' ELSE 'maxar+pam' END AS vendor,
      CASE {K} WHEN 1 THEN CAST(bundle_id % 5 AS VARCHAR) WHEN 2 THEN 'PS2' WHEN 3 THEN 'OLI' WHEN 5 THEN 'S' || CAST(bundle_id % 4 AS VARCHAR) WHEN 4 THEN NULL ELSE 'X' || p_brand END AS sensor,
      CASE {K} WHEN 1 THEN '12.5' WHEN 2 THEN '25.0' WHEN 3 THEN '0.5' WHEN 5 THEN '4.0' WHEN 4 THEN NULL ELSE CAST(CAST(bundle_id % 9 AS DOUBLE) / 8 * 100 AS VARCHAR) END AS cloud_cover_pct,
      CASE {K} WHEN 1 THEN '2024-03-01T04:05:06' WHEN 2 THEN '2024-04-01' WHEN 3 THEN '2024-05-01T01:02:03Z' WHEN 4 THEN '2024:02:0' || CAST(bundle_id % 9 + 1 AS VARCHAR) WHEN 5 THEN '2024-06-01' ELSE '2024-01-05T00:00:00Z' END AS acquired_at,
      CASE WHEN {K} = 5 THEN '44.5' END AS sun_elevation_deg, CASE {K} WHEN 2 THEN 'P' || CAST(bundle_id AS VARCHAR) WHEN 3 THEN 'L' || CAST(bundle_id AS VARCHAR) END AS product_id, CASE WHEN {K} = 6 THEN 'acquired_at' ELSE '' END AS conflicts
    FROM sidecars JOIN part ON p_partkey = bundle_id""",
    ("sidecars",),
)
def _(t):
    return V.extract(t("sidecars")).select("bundle_id", "vendor", "sensor", "cloud_cover_pct", "acquired_at", "sun_elevation_deg", "product_id", "conflicts")


# reports and exports


@query(
    "report_sections",
    """SELECT id, 'cover,kv,prose,' || CASE WHEN source_raster_id IS NULL THEN 'kv' ELSE 'image' END || ',raster,chart,stats,kv,prose' AS kinds, 'Bathymetric survey — ' || coalesce(site, 'Survey area') AS title,
      'Depths of ' || coalesce(site, 'Survey area') || ' by depth-v3: ' || CAST(min_m AS VARCHAR) || ' to ' || coalesce(CAST(max_m AS VARCHAR), '?') || ' m, mean 8.0 m (deviation 2.0 m), 50.0% of the scene.' AS summary,
      CASE WHEN order_1a IS NULL THEN '—:no data' ELSE 'order 1a:61.0 %' END AS compliance FROM survey_rows""",
    ("survey_rows",),
)
def _(t):
    df = P.with_sections(t("survey_rows"))
    part = lambda i, path: F.get_json_object(F.get("sections", i)["data"], path)
    return df.select("id", F.array_join("sections.type", ",").alias("kinds"), F.get("sections.title", 0).alias("title"), part(2, "$.text").alias("summary"), F.concat_ws(":", part(7, "$.rows[0][0]"), part(7, "$.rows[0][1]")).alias("compliance"))


WITHIN = "(lon IS NULL OR lat IS NULL OR (lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40))"


@query(
    "report_lines",
    f"""SELECT 0 AS part, '{{"type":"manifest","etag":"' || count(*) || '","count":' || count(*) || ',"bbox":[-60.0,-40.0,60.0,40.0]}}' AS line FROM reports WHERE {WITHIN}
    UNION ALL SELECT 1, '{{"id":"' || id || '","report_id":"' || report_code || '","country":"' || coalesce(site_name, 'Bathymetry') || '","thumbnail_url":"/api/rasters/' || depth_raster_id || '/thumbnail","status":"' || status || '"}}' FROM reports WHERE {WITHIN}""",
    ("reports",),
)
def _(t):
    inside = G.overlaps(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"), *BOX)
    chosen = t("reports").filter(F.col("lon").isNull() | F.col("lat").isNull() | inside)
    thumb = F.concat(F.lit("/api/rasters/"), F.col("depth_raster_id").cast("string"), F.lit("/thumbnail"))
    slim = chosen.select(F.col("id").cast("string").alias("id"), F.col("report_code").alias("report_id"), F.coalesce("site_name", F.lit("Bathymetry")).alias("country"), thumb.alias("thumbnail_url"), "status")
    return P.stream_lines(slim, F.count("*").cast("string"), list(BOX), [F.col("id")])


@query("audit_csv", """SELECT id, CAST(id AS VARCHAR) || ',' || coalesce(username, '') || ',' || action || ',' || coalesce(resource_type, '') || ',"a ""quoted"", text"' AS line FROM audit_log""", ("audit_log",))
def _(t):
    return t("audit_log").select("id", P.csv_line(F.col("id"), F.col("username"), F.col("action"), F.col("resource_type"), F.lit('a "quoted", text')).alias("line"))


@query(
    "layer_geojson",
    """SELECT dataset_id, '{"type":"FeatureCollection","features":[' || string_agg('{"type":"Feature","geometry":{"type":"Point","coordinates":[' || xmin || ',' || ymin || ']},"properties":{"id":' || id || ',"label":"' || label || '"}}', ',' ORDER BY id) || ']}' AS collection FROM vector_features WHERE geometry_type = 'Point' GROUP BY dataset_id""",
    ("vector_features",),
)
def _(t):
    points = t("vector_features").filter("geometry_type = 'Point'")
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("xmin", "ymin").alias("coordinates")))
    return P.feature_collections(points.select("dataset_id", "id", P.feature(geometry, F.struct("id", "label")).alias("feature")), "dataset_id", "id")


@query("layer_kml", "SELECT id, '<Placemark><name>' || replace(replace(replace(label || ' & <b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name><coordinates>' || xmin || ',' || ymin || '</coordinates></Placemark>' AS placemark FROM vector_features", ("vector_features",))
def _(t):
    at = F.concat_ws(",", F.col("xmin").cast("string"), F.col("ymin").cast("string"))
    return t("vector_features").select("id", P.placemark(F.concat("label", F.lit(" & <b>")), at).alias("placemark"))


@query("geojson_features", "SELECT id, 'Polygon' AS geometry_type, xmin AS west, ymin AS south, xmax AS east, ymax AS north FROM raster_catalog WHERE xmin IS NOT NULL", ("raster_catalog",))
def _(t):
    # footprints as GeoJSON text, read back
    text = t("raster_catalog").filter("xmin IS NOT NULL").select("id", G.envelope_geojson(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("geometry"))
    return text.select("id", *[c.alias(n) for c, n in zip(S.geometry_columns(F.col("geometry")), ("geometry_type", "west", "south", "east", "north"))])


@query("group_areas_geojson", """SELECT id, group_id, access_level, '{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]}' AS geometry FROM areas""", ("areas",))
def _(t):
    return t("areas").select("id", "group_id", "access_level", G.envelope_geojson(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("geometry"))


@query("changed_rasters", "SELECT id, xmin, ymin, xmax, ymax, updated_at FROM raster_catalog WHERE updated_at > created_at AND xmin IS NOT NULL", ("raster_catalog",))
def _(t):
    # what a tile cache is told to forget
    return t("raster_catalog").filter("updated_at > created_at AND xmin IS NOT NULL").select("id", "xmin", "ymin", "xmax", "ymax", "updated_at")


@query("raster_summary", "SELECT scene_id, 32 AS width, 32 AS height, round((west + east) / 2, 6) AS lon, round((south + north) / 2, 6) AS lat, round(0.00390625e0 * 111320.0e0 * cos(radians((south + north) / 2)), 6) AS metres, 'EPSG:4326' AS crs, 16 AS bits FROM scenes", ("scenes",))
def _(t):
    from isobath.functions.keys import bit_depth

    s = t("scenes")
    lat = (F.col("south") + F.col("north")) / 2
    res = [(F.col(b) - F.col(a)) / F.col(n) for a, b, n in (("west", "east", "width"), ("south", "north", "height"))]
    return s.select("scene_id", "width", "height", r6((F.col("west") + F.col("east")) / 2, "lon"), r6(lat, "lat"), r6(G.ground_resolution(*res, lat), "metres"), F.lit("EPSG:4326").alias("crs"), bit_depth(F.lit("uint16")).alias("bits"))
