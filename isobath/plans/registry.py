"""Queries over the catalogue, operations, pixels and vectors, with their SQL; the other modules of this package add theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.functions import depth as D
from isobath.functions import geo as G
from isobath.operators import blocks as B
from isobath.operators import catalog as C
from isobath.operators import intervals as I
from isobath.operators import raster as R
from isobath.operators import tables as T
from isobath.operators import text as X
from isobath.plans.base import QUERIES, SQL, query, r6
from isobath.sources import readers as S
from isobath.sources import vendors as V
from isobath.sources.views import table

BOX = (-60.0, -40.0, 60.0, 40.0)
USER = 16
EXTENT = ["xmin", "ymin", "xmax", "ymax"]
#: Colours of the depth ramp, from shallow to deep. Fixed values.
STOPS = [(125, 249, 255), (33, 212, 212), (31, 143, 209), (29, 95, 176), (23, 58, 134), (11, 31, 86)]
WINDOW_SQL = "xmin <= 60 AND xmax >= -60 AND ymin <= 40 AND ymax >= -40"


# catalogue


@query("viewport_rasters", f"SELECT id, acquisition_date, xmin, ymin, xmax, ymax FROM raster_catalog WHERE processing_status = 'ready' AND {WINDOW_SQL} ORDER BY acquisition_date DESC NULLS LAST, id LIMIT 500", ("raster_catalog",))
def _(t):
    found = C.search_rasters(t("raster_catalog"), BOX, status="ready").select("id", "acquisition_date", *EXTENT)
    return C.page(found, [F.desc_nulls_last("acquisition_date"), F.col("id")], 500)


@query("raster_list_page", "SELECT id, name, created_at FROM raster_catalog WHERE tag1 IN ('1-URGENT', '2-HIGH') AND (name ILIKE '%scene 1%' OR description ILIKE '%scene 1%') ORDER BY created_at DESC, id LIMIT 50 OFFSET 50", ("raster_catalog",))
def _(t):
    found = C.search_rasters(t("raster_catalog"), tags=["1-URGENT", "2-HIGH"], text="scene 1")
    return C.page(found.select("id", "name", "created_at"), [F.desc("created_at"), F.col("id")], 50, 50)


@query("raster_list_etag", """SELECT 'W/"' || CAST(count(*) AS VARCHAR) || '-' || coalesce(strftime(max(updated_at), '%Y-%m-%dT%H:%M:%S.%f'), '') || '-0-50"' AS etag FROM raster_catalog WHERE processing_status = 'ready'""", ("raster_catalog",))
def _(t):
    return t("raster_catalog").filter("processing_status = 'ready'").agg(
        F.concat(F.lit('W/"'), F.count("*").cast("string"), F.lit("-"), F.coalesce(F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("")), F.lit('-0-50"')).alias("etag")
    )


@query("acquisition_dates", "SELECT DISTINCT CAST(acquisition_date AS DATE) AS day FROM raster_catalog WHERE acquisition_date IS NOT NULL AND processing_status = 'ready' ORDER BY day", ("raster_catalog",))
def _(t):
    return t("raster_catalog").filter("processing_status = 'ready' AND acquisition_date IS NOT NULL").select(F.to_date("acquisition_date").alias("day")).distinct().orderBy("day")


@query("timeseries_entries", "SELECT e.timeseries_id, count(*) AS n, string_agg(CAST(e.raster_id AS VARCHAR), ',' ORDER BY e.sort_order, e.raster_id) AS rasters FROM raster_timeseries_entries e JOIN raster_catalog c ON c.id = e.raster_id GROUP BY e.timeseries_id", ("raster_timeseries_entries", "raster_catalog"))
def _(t):
    return C.series_entries(t("raster_timeseries_entries"), t("raster_catalog")).select("timeseries_id", "n", F.array_join(F.col("rasters").cast("array<string>"), ",").alias("rasters"))


@query(
    "area_access_rasters",
    f"SELECT c.id FROM raster_catalog c WHERE EXISTS (SELECT 1 FROM areas a JOIN user_group_members m USING (group_id) WHERE m.user_id = {USER} AND c.xmin <= a.xmax AND c.xmax >= a.xmin AND c.ymin <= a.ymax AND c.ymax >= a.ymin)",
    ("raster_catalog", "areas", "user_group_members"),
)
def _(t):
    return C.visible(t("raster_catalog"), t("areas"), t("user_group_members"), USER).select("id")


@query(
    "area_access_levels",
    """SELECT DISTINCT a.group_id, c.id FROM areas a JOIN raster_catalog c ON c.xmin <= a.xmax AND c.xmax >= a.xmin AND c.ymin <= a.ymax AND c.ymax >= a.ymin WHERE a.access_level IN ('download', 'manage')""",
    ("areas", "raster_catalog"),
)
def _(t):
    # a group's members share its access, so rows are groups and rasters, not users and rasters
    return C.group_access(t("raster_catalog"), t("areas"), "download")


@query(
    "user_area_access",
    f"""SELECT DISTINCT m.user_id, c.id FROM user_group_members m JOIN areas a USING (group_id) JOIN raster_catalog c ON c.xmin <= a.xmax AND c.xmax >= a.xmin AND c.ymin <= a.ymax AND c.ymax >= a.ymin
    WHERE a.access_level IN ('download', 'manage') AND m.user_id = {USER}""",
    ("user_group_members", "areas", "raster_catalog"),
)
def _(t):
    return C.access(t("raster_catalog"), t("areas"), t("user_group_members").filter(F.col("user_id") == USER), "download")


@query("allowed_areas", f"SELECT a.id, a.access_level, a.xmin, a.ymin, a.xmax, a.ymax FROM areas a JOIN user_group_members m USING (group_id) WHERE m.user_id = {USER}", ("areas", "user_group_members"))
def _(t):
    return C.user_areas(t("areas"), t("user_group_members")).filter(F.col("user_id") == USER).select("id", "access_level", *EXTENT)


@query(
    "user_apps", f"SELECT DISTINCT r.app_name, r.display_name FROM registered_apps r JOIN group_allowed_apps g USING (app_name) JOIN user_group_members m USING (group_id) WHERE m.user_id = {USER} ORDER BY app_name", ("registered_apps", "group_allowed_apps", "user_group_members")
)
def _(t):
    return C.accessible_apps(t("registered_apps"), t("group_allowed_apps"), t("user_group_members"), USER)


@query("group_member_counts", "SELECT g.id, g.name, count(m.user_id) AS members FROM user_groups g LEFT JOIN user_group_members m ON m.group_id = g.id GROUP BY g.id, g.name", ("user_groups", "user_group_members"))
def _(t):
    return t("user_groups").join(t("user_group_members"), F.col("id") == F.col("group_id"), "left").groupBy("id", "name").agg(F.count("user_id").alias("members"))


@query("group_members", "SELECT m.group_id, u.id, u.username, u.role FROM users u JOIN user_group_members m ON m.user_id = u.id WHERE u.is_active", ("users", "user_group_members"))
def _(t):
    return t("users").filter("is_active").join(t("user_group_members"), F.col("id") == F.col("user_id")).select("group_id", "id", "username", "role")


@query(
    "unified_search",
    f"""SELECT result_type, id, name FROM (
      SELECT 'raster' AS result_type, 0 AS type_rank, id, name, created_at FROM raster_catalog WHERE {WINDOW_SQL} AND (name ILIKE '%1%' OR description ILIKE '%1%')
      UNION ALL SELECT 'vector', 1, id, name, created_at FROM vector_datasets WHERE name ILIKE '%1%' OR description ILIKE '%1%')
    ORDER BY created_at DESC NULLS LAST, type_rank, id LIMIT 200""",
    ("raster_catalog", "vector_datasets"),
)
def _(t):
    found = C.mixed_search(t("raster_catalog"), t("vector_datasets"), BOX, text="1")
    return C.page(found, [F.desc_nulls_last("created_at"), F.col("type_rank"), F.col("id")], 200).select("result_type", "id", "name")


@query(
    "owned_or_shared_layers",
    """SELECT u.id AS user_id, d.id FROM users u JOIN vector_datasets d ON u.role = 'admin' OR d.created_by = u.id
      OR EXISTS (SELECT 1 FROM user_group_members m WHERE m.user_id = u.id AND m.group_id IN (d.shared_group, (d.shared_group + 3) % 25)) WHERE u.id IN (10, 16, 30, 33, 39)""",
    ("users", "vector_datasets", "user_group_members"),
)
def _(t):
    layers = t("vector_datasets").withColumn("shared_with", F.array("shared_group", (F.col("shared_group") + 3) % 25))
    return C.open_layers(t("users").filter(F.col("id").isin(10, 16, 30, 33, 39)), t("user_group_members"), layers).select("user_id", "id")


@query(
    "keyword_search",
    """SELECT doc_id FROM (SELECT doc_id, lower(concat_ws(chr(1), text, lang, source)) AS h FROM documents)
    WHERE (contains(h, 'the') AND NOT contains(h, 'http')) OR contains(h, 'en') AND contains(h, 'data set')""",
)
def _(t):
    return t("documents").filter(X.matches('the -http or en "data set"', ["text", "lang", "source"])).select("doc_id")


@query("chat_history", "SELECT conv_id, turn, role, back FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 20")
def _(t):
    return X.last_messages(t("conversations")).select("conv_id", "turn", "role", "back")


@query("tile_bounds", "SELECT z, x, y, round(x * (40075016.685578488e0 / pow(2e0, z)) - 20037508.342789244e0, 3) AS west, round(20037508.342789244e0 - y * (40075016.685578488e0 / pow(2e0, z)), 3) AS north FROM cached_tiles", ("cached_tiles",))
def _(t):
    west, _, _, north = G.tile_mercator(F.col("z"), F.col("x"), F.col("y"))
    return t("cached_tiles").select("z", "x", "y", F.round(west, 3).alias("west"), F.round(north, 3).alias("north"))


TILE_SQL = """(SELECT b.z, b.x, b.y, c.* FROM (SELECT z, x, y, x / pow(2e0, z) * 360 - 180 AS w, (x + 1) / pow(2e0, z) * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / pow(2e0, z))))) AS n,
      degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / pow(2e0, z))))) AS s FROM tiles WHERE z BETWEEN 3 AND 20) b JOIN raster_catalog c ON c.xmin <= e AND c.xmax >= w AND c.ymin <= n AND c.ymax >= s
      WHERE processing_status = 'ready' AND (min_zoom IS NULL OR min_zoom <= z))"""


@query("tile_membership", f"SELECT z, x, y, id, row_number() OVER (PARTITION BY z, x, y ORDER BY acquisition_date NULLS LAST, id) AS paint FROM {TILE_SQL}", ("tiles", "raster_catalog"))
def _(t):
    return C.tile_members(t("tiles"), t("raster_catalog"))


@query(
    "tile_cache_key",
    f"""SELECT z, x, y, 'sw:tile:' || z || ':' || x || ':' || y || ':le:1997-06-30T00:00:00:' || coalesce(strftime(max(acquisition_date), '%Y-%m-%dT%H:%M:%S'), 'none') || ':' ||
      CASE WHEN count(id) = 0 THEN '000000000000' ELSE substr(sha1(string_agg(id || ':' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S'), ',' ORDER BY id || ':' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S'))), 1, 12) END AS key
    FROM (SELECT t.z, t.x, t.y, m.id, m.acquisition_date, m.updated_at FROM tiles t LEFT JOIN (SELECT * FROM {TILE_SQL} WHERE acquisition_date <= TIMESTAMP '1997-06-30') m ON m.z = t.z AND m.x = t.x AND m.y = t.y) GROUP BY z, x, y""",
    ("tiles", "raster_catalog"),
)
def _(t):
    cutoff = F.lit("1997-06-30T00:00:00").cast("timestamp_ntz")
    return C.tile_keys(t("tiles"), t("raster_catalog").filter(F.col("acquisition_date") <= cutoff), cutoff).select("z", "x", "y", "key")


NUMBER = "CAST(CAST({} AS DECIMAL(9, 3)) AS VARCHAR)"


def ring_sql(*corners: tuple[str, str]) -> str:
    return "||','||".join("'['||" + NUMBER.format(x) + "||','||" + NUMBER.format(y) + "||']'" for x, y in corners)


BOX_RING = ring_sql(("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))


@query("raster_footprints", f"""SELECT id, CASE WHEN xmin IS NOT NULL THEN '{{"type":"Polygon","coordinates":[[' || {BOX_RING} || ']]}}' END AS g FROM raster_catalog""", ("raster_catalog",))
def _(t):
    return t("raster_catalog").select("id", G.envelope_geojson(*[F.col(c).cast("decimal(9,3)") for c in EXTENT]).alias("g"))


@query("next_versions", "SELECT id, CASE WHEN processing_status = 'failed' THEN 'pending' ELSE processing_status END AS processing_status FROM raster_catalog WHERE NOT (source_kind = 'bathymetry' AND processing_status = 'failed')", ("raster_catalog",))
def _(t):
    kept = t("raster_catalog").select("id", "processing_status", "source_kind")
    kept = kept.filter(~((F.col("source_kind") == "bathymetry") & (F.col("processing_status") == "failed"))).drop("source_kind")
    return T.update_where(kept, F.col("processing_status") == "failed", processing_status=F.lit("pending"))


# operations


@query("audit_action_counts", "SELECT action, count(*) AS n FROM audit_log GROUP BY action ORDER BY n DESC, action", ("audit_log",))
def _(t):
    return t("audit_log").groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action")


@query("audit_top_users", "SELECT username, count(*) AS n FROM audit_log WHERE username IS NOT NULL GROUP BY username ORDER BY n DESC, username LIMIT 10", ("audit_log",))
def _(t):
    return t("audit_log").filter("username IS NOT NULL").groupBy("username").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "username").limit(10)


@query("audit_recent", "SELECT id, action, event_time FROM audit_log ORDER BY event_time DESC, id LIMIT 10", ("audit_log",))
def _(t):
    return C.page(t("audit_log").select("id", "action", "event_time"), [F.desc("event_time"), F.col("id")], 10)


@query("audit_page", "SELECT id, username, resource_id FROM audit_log WHERE action = 'purchase' AND resource_type = 'raster' ORDER BY event_time DESC, id LIMIT 50", ("audit_log",))
def _(t):
    found = C.where(t("audit_log"), F.col("action") == "purchase", F.col("resource_type") == "raster", None)
    return C.page(found, [F.desc("event_time"), F.col("id")], 50).select("id", "username", "resource_id")


@query("report_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ready') AS ready, coalesce(strftime(max(generated_at), '%Y-%m-%d %H:%M:%S.%f'), '') AS latest FROM reports", ("reports",))
def _(t):
    return t("reports").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.date_format(F.max("generated_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("")).alias("latest"))


@query("report_sites", "SELECT coalesce(site_name, 'Bathymetry') AS site, n FROM (SELECT site_name, count(*) AS n FROM reports GROUP BY site_name)", ("reports",))
def _(t):
    return t("reports").groupBy("site_name").agg(F.count("*").alias("n")).select(F.coalesce("site_name", F.lit("Bathymetry")).alias("site"), "n")


@query("report_stream", "SELECT id, report_code FROM reports WHERE lon IS NULL OR lat IS NULL OR (lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 40)", ("reports",))
def _(t):
    inside = G.overlaps(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"), *BOX)
    return t("reports").filter(F.col("lon").isNull() | F.col("lat").isNull() | inside).select("id", "report_code")


@query("report_features", "SELECT id, lon, lat FROM (SELECT id, lon, lat FROM reports ORDER BY generated_at DESC NULLS LAST, id LIMIT 1000) WHERE lon IS NOT NULL AND lat IS NOT NULL", ("reports",))
def _(t):
    newest = C.page(t("reports").select("id", "lon", "lat", "generated_at"), [F.desc_nulls_last("generated_at"), F.col("id")], 1000)
    return newest.filter("lon IS NOT NULL AND lat IS NOT NULL").select("id", "lon", "lat")


@query("report_lookup", "SELECT id, status FROM reports WHERE report_code = 'REP-25' OR CAST(id AS VARCHAR) = 'REP-25' LIMIT 1", ("reports",))
def _(t):
    return t("reports").filter((F.col("report_code") == "REP-25") | (F.col("id").cast("string") == "REP-25")).limit(1).select("id", "status")


@query("report_cache_latest", "SELECT cache_key, id FROM (SELECT cache_key, id, row_number() OVER (PARTITION BY cache_key ORDER BY generated_at DESC NULLS LAST, id) AS n FROM reports WHERE status = 'ready') WHERE n = 1", ("reports",))
def _(t):
    return T.latest(t("reports").filter("status = 'ready'"), ["cache_key"], [F.desc_nulls_last("generated_at"), F.col("id")]).select("cache_key", "id")


@query("job_progress", "SELECT j.status, count(*) AS n, count(c.xmin) AS placed FROM jobs j LEFT JOIN raster_catalog c ON c.id = j.source_raster_id GROUP BY j.status", ("jobs", "raster_catalog"))
def _(t):
    source = t("raster_catalog").select(F.col("id").alias("source_raster_id"), "xmin")
    return t("jobs").join(source, "source_raster_id", "left").groupBy("status").agg(F.count("*").alias("n"), F.count("xmin").alias("placed"))


@query("lru_evict", "SELECT cache_key FROM (SELECT cache_key, sum(size_bytes) OVER (ORDER BY atime DESC, cache_key DESC) AS used, sum(size_bytes) OVER () AS total FROM cache_entries) WHERE total <= 50000 OR used <= 40000", ("cache_entries",))
def _(t):
    return T.evict_lru(t("cache_entries"), 50_000, 40_000).select("cache_key")


@query("membership_upsert", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 7 ELSE group_id END AS group_id FROM user_group_members", ("user_group_members",))
def _(t):
    old = t("user_group_members").select("user_id", "group_id")
    return T.upsert(old, old.filter("user_id % 3 = 0").withColumn("group_id", F.lit(7).cast(old.schema["group_id"].dataType)), ["user_id"])


@query("cascade_delete", "SELECT id, dataset_id FROM vector_features WHERE dataset_id NOT IN (SELECT id FROM vector_datasets WHERE tag = 'F')", ("vector_features", "vector_datasets"))
def _(t):
    return T.delete_cascade(t("vector_datasets"), t("vector_features"), F.col("tag") == "F", "id", "dataset_id")[1].select("id", "dataset_id")


# coverage

MERGED_SQL = """m AS (SELECT cell_x, cell_y, min(start_day) AS start_day, max(end_day) AS end_day FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY cell_x, cell_y ORDER BY start_day, end_day ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT cell_x, cell_y, start_day, end_day, CASE WHEN start_day <= max(end_day) OVER (PARTITION BY cell_x, cell_y ORDER BY start_day, end_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM coverage_requests))
  GROUP BY cell_x, cell_y, island)"""


@query("coverage_merge", f"SELECT * FROM (WITH {MERGED_SQL} SELECT * FROM m)", ("coverage_requests",))
def _(t):
    return I.merge_days(t("coverage_requests"), ["cell_x", "cell_y"])


@query(
    "coverage_missing",
    f"""SELECT * FROM (WITH {MERGED_SQL}, d AS (SELECT cell_x, cell_y, unnest(generate_series(0, 29)) AS k FROM (SELECT DISTINCT cell_x, cell_y FROM coverage_requests)),
    n AS (SELECT cell_x, cell_y, DATE '2024-01-10' + CAST(k AS INT) AS day FROM d)
    SELECT cell_x, cell_y, min(day) AS gap_start, max(day) AS gap_end FROM (SELECT cell_x, cell_y, day, day - CAST(row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY day) AS INT) AS g FROM n
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cell_x = n.cell_x AND m.cell_y = n.cell_y AND n.day BETWEEN m.start_day AND m.end_day)) GROUP BY cell_x, cell_y, g)""",
    ("coverage_requests",),
)
def _(t):
    asked = t("coverage_requests")
    wanted = asked.select("cell_x", "cell_y").distinct().select("cell_x", "cell_y", F.lit("2024-01-10").cast("date").alias("want_start"), F.lit("2024-02-08").cast("date").alias("want_end"))
    return I.gaps(I.merge_days(asked, ["cell_x", "cell_y"]), ["cell_x", "cell_y"], wanted)


# pixels

NDWI = "((green - nir) / (green + nir + 1e-6))"
WATER = f"((scl = 6 OR {NDWI} > 0.1) AND scl NOT IN (3, 8, 9, 10, 11, 4, 5))"
PIX = "SELECT scene_id, r, c, "
X_BG = "(ln(1000.0e0 * (blue / 10000.0e0 + 1e-6)) / ln(1000.0e0 * (green / 10000.0e0 + 1e-6) + 1e-6))"
DEPTH = f"g AS (SELECT scene_id, r, c, CASE WHEN {WATER} THEN greatest(0e0, least(25e0, 12 + 15 * ({X_BG} - 1))) END AS depth FROM pixels)"


@query("water_mask", f"SELECT scene_id, count(*) FILTER (WHERE {WATER}) AS water, count(*) AS n FROM pixels GROUP BY scene_id", ("pixels",))
def _(t):
    return R.indices(t("pixels")).groupBy("scene_id").agg(F.count_if("water").alias("water"), F.count("*").alias("n"))


@query("spectral_indices", f"{PIX} round({NDWI}, 6) AS ndwi, round({X_BG}, 6) AS x_bg, round((coalesce(coastal, blue) / 10000.0e0 + 1e-6) / (blue / 10000.0e0 + 1e-6), 6) AS c_b FROM pixels", ("pixels",))
def _(t):
    return R.indices(t("pixels")).select("scene_id", "r", "c", r6(F.col("ndwi"), "ndwi"), r6(F.col("x_bg"), "x_bg"), r6(F.col("c_b"), "c_b"))


@query("turbidity", "SELECT scene_id, round(avg(least(200e0, 366.14e0 * q / (1 - q / 0.19563e0))), 6) AS spm, round(avg(ndti), 6) AS ndti FROM (SELECT scene_id, greatest(1e-6, least(0.17563e0, red / 10000.0e0)) AS q, (red / 10000.0e0 - green / 10000.0e0) / (red / 10000.0e0 + green / 10000.0e0 + 1e-6) AS ndti FROM pixels) GROUP BY scene_id", ("pixels",))
def _(t):
    return R.indices(t("pixels")).groupBy("scene_id").agg(r6(F.avg("spm"), "spm"), r6(F.avg("ndti"), "ndti"))


# its join in SQL has 25 rows a pixel: tests hold it against brute force and the row form instead
@query("texture_5x5", None)
def _(t):
    return B.texture(t("pixel_blocks"), "blue", 16).select("scene_id", "r", "c", r6(F.col("blue_mean"), "blue_mean"), F.round("blue_std", 4).alias("blue_std"))


@query("band_percentiles", "SELECT scene_id, round(quantile_cont(red, 0.025), 6) AS lo, round(CASE WHEN quantile_cont(red, 0.975) <= quantile_cont(red, 0.025) THEN quantile_cont(red, 0.025) + 1 ELSE quantile_cont(red, 0.975) END, 6) AS hi FROM pixels GROUP BY scene_id", ("pixels",))
def _(t):
    return R.percentiles(t("pixels"), "red").select("scene_id", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"))


@query(
    "stretch_u8",
    "SELECT p.scene_id, sum(CAST(floor(greatest(0e0, least(255e0, (red - lo) / (hi - lo) * 255))) AS BIGINT)) AS total FROM pixels p JOIN (SELECT scene_id, quantile_cont(red, 0.025) AS lo, quantile_cont(red, 0.975) AS hi FROM pixels GROUP BY scene_id) q USING (scene_id) GROUP BY p.scene_id",
    ("pixels",),
)
def _(t):
    bands = t("pixels").select("scene_id", "red")
    return bands.join(R.percentiles(bands, "red"), "scene_id").groupBy("scene_id").agg(F.sum(D.stretch(F.col("red"), F.col("lo"), F.col("hi"))).alias("total"))


@query("gamma_stretch", "SELECT scene_id, sum(CAST(floor(pow(greatest(0e0, least(1e0, (red - 100) / 900e0)), 1 / 2.0e0) * 255) AS BIGINT)) AS total FROM pixels GROUP BY scene_id", ("pixels",))
def _(t):
    return t("pixels").groupBy("scene_id").agg(F.sum(D.gamma_stretch(F.col("red"), F.lit(100.0), F.lit(1000.0), 2.0)).alias("total"))


@query("depth_stats", f"SELECT * FROM (WITH {DEPTH} SELECT scene_id, round(min(depth), 2) AS min_m, round(max(depth), 2) AS max_m, round(avg(depth), 2) AS mean_m, round(stddev_pop(depth), 2) AS std_m, round(100.0e0 * count(depth) / count(*), 1) AS coverage_pct FROM g GROUP BY scene_id)", ("pixels",))
def _(t):
    return R.depth_stats(R.surrogate_depth(t("pixels")))


@query("depth_blockmean", f"SELECT * FROM (WITH {DEPTH} SELECT scene_id, r // 4 AS br, c // 4 AS bc, round(avg(depth), 2) AS depth FROM g GROUP BY ALL)", ("pixels",))
def _(t):
    return R.block_mean(R.surrogate_depth(t("pixels")), 32, 32, 8)


@query("depth_pyramid", f"SELECT * FROM (WITH {DEPTH} SELECT scene_id, r // (1 << k) AS br, c // (1 << k) AS bc, round(avg(depth), 6) AS depth, k AS level FROM g CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY ALL)", ("pixels",))
def _(t):
    return R.pyramid(R.surrogate_depth(t("pixels")), 32, 32, 4)


@query("depth_transect", f"SELECT * FROM (WITH {DEPTH} SELECT scene_id, CAST(c AS INT) AS i, round(c * 0.125e0 / 32 * 111320.0e0, 1) AS distance_m, round(depth, 2) AS depth FROM g WHERE r = 16)", ("pixels",))
def _(t):
    return R.transect(R.surrogate_depth(t("pixels")), t("scenes"))


STOP_SQL = [f"[{', '.join(f'{s[c]}e0' for s in STOPS)}]" for c in range(3)]
RAMP_SQL = ", ".join(f"CAST(sum(floor(list_extract({a}, i + 1) + (list_extract({a}, i + 2) - list_extract({a}, i + 1)) * (pos - i))) AS BIGINT) AS {n}" for a, n in zip(STOP_SQL, ("red", "green", "blue")))


@query("depth_ramp", f"SELECT * FROM (WITH {DEPTH} SELECT scene_id, {RAMP_SQL} FROM (SELECT scene_id, pos, least(CAST(floor(pos) AS INT), 4) AS i FROM (SELECT scene_id, greatest(0e0, least(1e0, depth / 25)) * 5 AS pos FROM g WHERE depth IS NOT NULL)) GROUP BY scene_id)", ("pixels",))
def _(t):
    grid = R.surrogate_depth(t("pixels")).filter("depth IS NOT NULL")
    return grid.select("scene_id", D.ramp(F.col("depth") / D.MAX_DEPTH, STOPS).alias("rgb")).groupBy("scene_id").agg(F.sum("rgb.r").alias("red"), F.sum("rgb.g").alias("green"), F.sum("rgb.b").alias("blue"))


CELLS = "s AS (SELECT scene_id, r, c, median(depth) AS measured FROM soundings WHERE depth BETWEEN 0.3 AND 25 GROUP BY scene_id, r, c)"


@query("sounding_cell_median", f"SELECT * FROM (WITH {CELLS} SELECT * FROM s)", ("soundings",))
def _(t):
    return R.sounding_cells(t("soundings"))


@query(
    "calibration_ols",
    f"SELECT * FROM (WITH {DEPTH}, {CELLS}, f AS (SELECT scene_id, count(*) AS n, regr_intercept(measured, depth) AS a, regr_slope(measured, depth) AS b, regr_r2(measured, depth) AS q FROM g JOIN s USING (scene_id, r, c) WHERE depth IS NOT NULL GROUP BY scene_id) SELECT scene_id, n, round(CASE WHEN n >= 5 AND isfinite(b) THEN a ELSE 0 END, 6) AS alpha, round(CASE WHEN n >= 5 AND isfinite(b) THEN b ELSE 1 END, 6) AS beta, round(CASE WHEN n >= 5 AND isfinite(b) THEN coalesce(q, 0) ELSE 0 END, 6) AS r2 FROM f)",
    ("pixels", "soundings"),
)
def _(t):
    pairs = R.surrogate_depth(t("pixels")).join(R.sounding_cells(t("soundings")), ["scene_id", "r", "c"])
    return R.calibration(pairs).select("scene_id", "n", r6(F.col("alpha"), "alpha"), r6(F.col("beta"), "beta"), r6(F.col("r2"), "r2"))


ORDER_SQL = ", ".join(f"round(100.0e0 * avg(CASE WHEN abs(depth - measured) <= sqrt({a * a!r}e0 + ({b!r}e0 * measured) * ({b!r}e0 * measured)) THEN 1.0e0 ELSE 0 END), 6) AS order_{n}" for n, a, b in D.ORDERS)


@query("survey_compliance", f"SELECT * FROM (WITH {DEPTH}, {CELLS} SELECT scene_id, count(*) AS n, round(sqrt(avg((depth - measured) * (depth - measured))), 6) AS rmse, {ORDER_SQL} FROM g JOIN s USING (scene_id, r, c) WHERE depth IS NOT NULL GROUP BY scene_id)", ("pixels", "soundings"))
def _(t):
    pairs = R.surrogate_depth(t("pixels")).filter("depth IS NOT NULL").join(R.sounding_cells(t("soundings")), ["scene_id", "r", "c"])
    found = R.compliance(pairs)
    return found.select("scene_id", "n", *[r6(F.col(c), c) for c in found.columns[2:]])


SPM_SQL = "least(200e0, 366.14e0 * greatest(1e-6, least(0.17563e0, red / 10000.0e0)) / (1 - greatest(1e-6, least(0.17563e0, red / 10000.0e0)) / 0.19563e0))"
ERF_SQL = "(1 - ((((1.061405429e0 * k - 1.453152027e0) * k + 1.421413741e0) * k - 0.284496736e0) * k + 0.254829592e0) * k * exp(-v * v))"


@query(
    "sigma_total",
    f"""SELECT scene_id, round(avg(s), 6) AS sigma, round(avg(greatest(0e0, least(1e0, {ERF_SQL}))), 6) AS within_1a FROM (SELECT *, 1e0 / (1 + 0.3275911e0 * v) AS k FROM (
      SELECT *, sqrt(0.5e0 * 0.5e0 + (0.013e0 * depth) * (0.013e0 * depth)) / (sqrt(2e0) * greatest(s, 1e-3)) AS v FROM (
        SELECT scene_id, depth, sqrt(greatest(sigma * sigma + (0.012e0 * spm) * (0.012e0 * spm) + (0.04e0 * greatest(0e0, depth - 12)) * (0.04e0 * greatest(0e0, depth - 12)), 1e-4)) AS s FROM (
          SELECT scene_id, 0.25e0 + (r % 8) / 16.0e0 AS sigma, {SPM_SQL} AS spm, CASE WHEN {WATER} THEN greatest(0e0, least(25e0, 12 + 15 * ({X_BG} - 1))) END AS depth FROM pixels) WHERE depth IS NOT NULL))) GROUP BY scene_id""",
    ("pixels",),
)
def _(t):
    grid = R.surrogate_depth(t("pixels")).filter("depth IS NOT NULL")
    sigma = D.total_sigma(F.col("sigma"), F.col("spm"), F.col("depth"))
    chance = D.chance_within(F.col("depth"), sigma, 0.5, 0.013)
    return grid.groupBy("scene_id").agg(r6(F.avg(sigma), "sigma"), r6(F.avg(chance), "within_1a"))


ROI_SQL = "(SELECT id AS roi_id, 50 + id / 8.0e0 AS wxmin, 20e0 AS wymin, 51 + id / 8.0e0 AS wxmax, 23e0 AS wymax FROM user_groups)"


@query(
    "least_cloudy_scene",
    f"""SELECT roi_id, scene_id, cloud_cover FROM (SELECT roi_id, scene_id, cloud_cover, row_number() OVER (PARTITION BY roi_id ORDER BY cloud_cover, scene_id) AS n FROM scenes JOIN {ROI_SQL}
      ON west <= wxmax AND east >= wxmin AND south <= wymax AND north >= wymin WHERE cloud_cover < 60 AND acquired BETWEEN DATE '2024-01-05' AND DATE '2024-02-20') WHERE n = 1""",
    ("scenes", "user_groups"),
)
def _(t):
    rois = t("user_groups").select(F.col("id").alias("roi_id"), (50 + F.col("id") / 8).alias("wxmin"), F.lit(20.0).alias("wymin"), (51 + F.col("id") / 8).alias("wxmax"), F.lit(23.0).alias("wymax"))
    return R.least_cloudy(t("scenes"), rois, 60.0, "2024-01-05", "2024-02-20")


# vectors and sidecars


@query("vector_dataset_bounds", "SELECT dataset_id, count(*) AS features, min(xmin) AS west, min(ymin) AS south, max(xmin + extent) AS east, max(ymin + extent) AS north FROM vector_features GROUP BY dataset_id", ("vector_features",))
def _(t):
    return t("vector_features").groupBy("dataset_id").agg(F.count("*").alias("features"), F.min("xmin").alias("west"), F.min("ymin").alias("south"), F.max(F.col("xmin") + F.col("extent")).alias("east"), F.max(F.col("ymin") + F.col("extent")).alias("north"))


@query("vector_geometry_types", "SELECT dataset_id, string_agg(DISTINCT geometry_type, ',' ORDER BY geometry_type) AS types FROM vector_features GROUP BY dataset_id", ("vector_features",))
def _(t):
    return t("vector_features").groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("geometry_type")), ",").alias("types"))


@query(
    "vendor_normalize",
    "SELECT bundle_id, sat_id AS sensor, CASE WHEN cloud_cover BETWEEN 0 AND 1 THEN cloud_cover * 100 ELSE cloud_cover END AS cloud_cover_pct, TRY_CAST(mean_sun_el AS DOUBLE) AS sun_elevation FROM vendor_imd",
    ("vendor_imd",),
)
def _(t):
    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f'{key} = "'), value.cast("string"), F.lit('";'))

    text = F.concat_ws("\n", line("satId", F.col("sat_id")), line("cloudCover", F.col("cloud_cover")), line("meanSunEl", F.col("mean_sun_el")), F.lit("END;"))
    parsed = t("vendor_imd").select("bundle_id", V.pairs(text).alias("m"))
    get = lambda *names: S.first_alias(F.col("m"), list(names))
    return parsed.select("bundle_id", get("satelliteId", "satId").alias("sensor"), S.cloud_percent(S.to_number(get("cloudCover"))).alias("cloud_cover_pct"), S.to_number(get("meanSunEl")).alias("sun_elevation"))


@query("zoom_range", "SELECT scene_id, CAST(greatest(0, z - 8) AS INT) AS min_zoom, CAST(z AS INT) AS max_zoom FROM (SELECT scene_id, greatest(0, least(24, CAST(trunc(log2(156543.0e0 / (0.00390625e0 * 111320.0e0 * cos(radians(south))))) AS INT))) AS z FROM scenes)", ("scenes",))
def _(t):
    step = F.lit(0.125 / 32)
    low, high = G.zoom_levels(G.ground_resolution(step, step, F.col("south")))
    return t("scenes").select("scene_id", low.alias("min_zoom"), high.alias("max_zoom"))


@query("first_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def _(t):
    return T.latest(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


from isobath.plans import changes as _changes  # noqa: E402, F401
from isobath.plans import derived as _derived  # noqa: E402, F401
from isobath.plans import keys as _keys  # noqa: E402, F401
from isobath.plans import model as _model  # noqa: E402, F401
from isobath.plans import products as _products  # noqa: E402, F401
from isobath.plans import state as _state  # noqa: E402, F401
from isobath.plans import vectors as _vectors  # noqa: E402, F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rasters of a viewport that a user may see, newest first."""
    found = C.visible(C.search_rasters(table(spark, sf_dir, "raster_catalog"), BOX, status="ready"), table(spark, sf_dir, "areas"), table(spark, sf_dir, "user_group_members"), USER)
    return C.page(found.select("id", "name", "acquisition_date", *EXTENT), [F.desc_nulls_last("acquisition_date"), F.col("id")], 500)
