"""Catalogue, bathymetry and platform tables as views over the star-schema tables.

Each view is one SQL text that Spark and DuckDB both read, so a query and its
check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.operators.steps import parts_of

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Pixels on a side of a scene.
SIDE = 32
#: The samples of a scene's bands by row and column.
BANDS = {
    "blue": "300 + (s_suppkey * 7919 + {r} * 31 + {c} * 17) % 1500",
    "green": "280 + (s_suppkey * 104729 + {r} * 29 + {c} * 13) % 1400",
    "red": "120 + (s_suppkey * 1299709 + {r} * 23 + {c} * 19) % 900",
    "coastal": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 320 + (s_suppkey * 15485863 + {r} * 37 + {c} * 11) % 1300 END",
    "nir": "60 + (s_suppkey * 7907 + {r} * 41 + {c} * 43) % 1600",
    "scl": "CASE (s_suppkey + CAST(floor(CAST({r} AS DOUBLE) / 4) AS BIGINT) * 3 + CAST(floor(CAST({c} AS DOUBLE) / 4) AS BIGINT) * 5) % 12 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 6 WHEN 6 THEN 6 WHEN 7 THEN 8 WHEN 8 THEN 9 WHEN 9 THEN 10 WHEN 10 THEN 11 ELSE 7 END",
}

VIEWS = {
    "users": "SELECT c_custkey AS id, c_name AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 10 < 4 THEN 'analyst' ELSE 'viewer' END AS role, c_custkey % 7 <> 0 AS is_active FROM customer",
    "user_groups": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "user_group_members": "SELECT c_nationkey AS group_id, c_custkey AS user_id FROM customer WHERE c_custkey % 10 <> 9 AND c_nationkey <> 24",
    "areas": "SELECT n_nationkey AS id, n_nationkey AS group_id, CAST(-180 + 14 * n_nationkey AS DOUBLE) AS xmin, CAST(-60 AS DOUBLE) AS ymin, CAST(-170 + 14 * n_nationkey AS DOUBLE) AS xmax, CAST(60 AS DOUBLE) AS ymax, CASE n_nationkey % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'download' ELSE 'manage' END AS access_level FROM nation",
    "registered_apps": "SELECT 'app_' || CAST(r_regionkey AS STRING) AS app_name, r_name AS display_name FROM region",
    "group_allowed_apps": "SELECT n_nationkey AS group_id, 'app_' || CAST(n_regionkey AS STRING) AS app_name FROM nation",
    "raster_catalog": """SELECT o_orderkey AS id, 'scene ' || CAST(o_orderkey AS STRING) AS name, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'priority ' || o_orderpriority END AS description,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS acquisition_date, o_orderdate AS created_at, o_orderdate + CAST(o_orderkey % 50 AS INT) * INTERVAL '1' HOUR AS updated_at,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -180 + CAST((o_orderkey * 37) % 2800 AS DOUBLE) / 8 END AS xmin, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -85 + CAST((o_orderkey * 53) % 1280 AS DOUBLE) / 8 END AS ymin,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -180 + CAST((o_orderkey * 37) % 2800 AS DOUBLE) / 8 + 0.5e0 + CAST(o_orderkey % 7 AS DOUBLE) / 4 END AS xmax,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE -85 + CAST((o_orderkey * 53) % 1280 AS DOUBLE) / 8 + 0.5e0 + CAST(o_orderkey % 7 AS DOUBLE) / 4 END AS ymax,
        CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 12 END AS min_zoom, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'processing' ELSE 'failed' END AS processing_status,
        o_orderpriority AS tag1, o_orderstatus AS tag2, o_custkey AS uploaded_by, CASE WHEN o_orderkey % 4 = 0 THEN 8 ELSE 16 END AS bit_depth, CASE WHEN o_orderkey % 6 = 0 THEN 'bathymetry' ELSE 'source' END AS source_kind FROM orders""",
    "raster_timeseries": "SELECT c_custkey AS id, 'series ' || CAST(c_custkey AS STRING) AS name FROM customer",
    "raster_timeseries_entries": "SELECT o_custkey AS timeseries_id, o_orderkey AS raster_id, o_orderkey % 50 AS sort_order FROM orders",
    "vector_datasets": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'annotation layer' END AS description, s_suppkey * 3 AS created_by, s_nationkey AS shared_group, TIMESTAMP '1996-01-02 00:00:00' + CAST(s_suppkey % 100 AS INT) * INTERVAL '1' DAY AS created_at, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE '5-LOW' END AS tag FROM supplier",
    "vector_features": """SELECT p_partkey AS id, p_partkey % 10 AS dataset_id, CASE WHEN p_partkey % 10 = 3 THEN 'Point' WHEN p_partkey % 4 = 0 THEN 'LineString' ELSE 'Polygon' END AS geometry_type,
        -170 + CAST((p_partkey * 29) % 2700 AS DOUBLE) / 8 AS xmin, -80 + CAST((p_partkey * 31) % 1250 AS DOUBLE) / 8 AS ymin, CASE WHEN p_partkey % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + p_partkey % 5 AS DOUBLE) / 8 END AS extent, p_name AS label FROM part WHERE p_partkey % 10 <> 7""",
    "audit_log": "SELECT event_id AS id, user_id, CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || CAST(user_id AS STRING) END AS username, event_type AS action, CASE event_id % 4 WHEN 0 THEN 'raster' WHEN 1 THEN 'group' WHEN 2 THEN 'annotation' ELSE NULL END AS resource_type, CAST(event_id % 100 AS STRING) AS resource_id, props AS details, ts AS event_time FROM events",
    "reports": """SELECT o_orderkey AS id, 'REP-' || CAST(o_orderkey AS STRING) AS report_code, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE n_name END AS site_name, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'generating' ELSE 'failed' END AS status,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderdate END AS generated_at, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -180 + CAST((o_orderkey * 37) % 2880 AS DOUBLE) / 8 END AS lon, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE -85 + CAST((o_orderkey * 53) % 1360 AS DOUBLE) / 8 END AS lat,
        CAST(o_orderkey % 25 AS DOUBLE) AS mean_m, CAST(o_custkey % 200 AS STRING) AS cache_key, o_orderkey AS depth_raster_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 5 = 0""",
    "jobs": "SELECT o_orderkey AS id, o_orderkey AS source_raster_id, CASE o_orderkey % 16 WHEN 0 THEN 'pending' WHEN 4 THEN 'running' WHEN 8 THEN 'done' ELSE 'failed' END AS status FROM orders WHERE o_orderkey % 4 = 0",
    "scenes": "SELECT s_suppkey AS scene_id, CAST(50 AS DOUBLE) + CAST(s_suppkey % 40 AS DOUBLE) / 8 AS west, CAST(20 AS DOUBLE) + CAST(s_suppkey % 24 AS DOUBLE) / 8 AS south, CAST(50 AS DOUBLE) + CAST(s_suppkey % 40 + 1 AS DOUBLE) / 8 AS east, CAST(20 AS DOUBLE) + CAST(s_suppkey % 24 + 1 AS DOUBLE) / 8 AS north, 32 AS width, 32 AS height, CAST((s_suppkey * 7) % 80 AS DOUBLE) AS cloud_cover, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INT) AS acquired FROM supplier",
    "pixels": "SELECT s_suppkey AS scene_id, a.r, b.c, " + ", ".join(f"{text.format(r='a.r', c='b.c')} AS {band}" for band, text in BANDS.items()) + " FROM supplier CROSS JOIN (SELECT CAST(id AS BIGINT) AS r FROM seq32) a CROSS JOIN (SELECT CAST(id AS BIGINT) AS c FROM seq32) b",
    "soundings": "SELECT l_suppkey AS scene_id, (l_orderkey * 7 + l_linenumber) % 32 AS r, (l_partkey * 5 + l_linenumber) % 32 AS c, 0.25e0 + CAST(l_quantity AS DOUBLE) / 2 AS depth FROM lineitem",
    "tiles": "SELECT z, CAST(a.id AS BIGINT) AS x, CAST(b.id AS BIGINT) AS y FROM seq16 a CROSS JOIN seq16 b CROSS JOIN (SELECT CAST(id + 2 AS INT) AS z FROM seq5) k WHERE a.id < pow(2, z) AND b.id < pow(2, z)",
    "cached_tiles": "SELECT DISTINCT z, (event_id * 7919) % CAST(pow(2, z) AS BIGINT) AS x, (event_id * 104729) % CAST(pow(2, z) AS BIGINT) AS y FROM (SELECT event_id, CAST(2 + event_id % 6 AS INT) AS z FROM events) e",
    "scene_tiles": "SELECT 8 AS z, CAST(163 + a.id AS BIGINT) AS x, CAST(110 + b.id AS BIGINT) AS y FROM seq5 a CROSS JOIN seq5 b",
    "coverage_requests": "SELECT event_id AS request_id, user_id % 20 AS cell_x, user_id % 3 AS cell_y, CAST(ts AS DATE) AS start_day, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS end_day FROM events WHERE event_type = 'purchase'",
    "job_records": """SELECT o_orderkey AS id, CASE o_orderkey % 16 WHEN 0 THEN 'pending' WHEN 4 THEN 'running' WHEN 8 THEN 'done' ELSE 'failed' END AS status, CASE o_orderkey % 3 WHEN 0 THEN chr(123) || '"report_code": "REP-' || CAST(o_orderkey AS STRING) || '", "cached": true, "codec": ' || chr(123) || '"levels": 5' || chr(125) || chr(125) WHEN 1 THEN chr(123) || '"cached": false' || chr(125) ELSE NULL END AS metadata FROM orders WHERE o_orderkey % 4 = 0""",
    "settings": "SELECT upper(n_name) AS key, 'region ' || CAST(n_regionkey AS STRING) AS value FROM nation",
    "map_states": "SELECT o_orderkey AS id, o_custkey AS user_id, 'view ' || CAST(o_orderkey % 3 AS STRING) AS name, o_orderkey % 5 = 0 AS is_default, o_orderdate AS updated_at FROM orders",
    "layer_changes": "SELECT event_id AS id, user_id % 45 AS user_id, event_id % 12 AS layer_id, CASE event_id % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' ELSE 'rename' END AS action FROM events",
    "sidecars": """SELECT p_partkey AS bundle_id, 'b/x.IMD' AS path, 'satId = "A";' || chr(10) || 'cloudCover = ' || CAST(CAST(p_partkey % 9 AS DOUBLE) / 8 AS STRING) || ';' || chr(10) || 'firstLineTime = 2024-01-05T00:00:00Z;' || chr(10) || 'satId = "X' || p_brand || '";' || chr(10) || 'meanSunEl = n/a;' AS content FROM part WHERE p_partkey % 7 IN (0, 6)
        UNION ALL SELECT p_partkey, 'b/x.RPB', 'rpc' FROM part WHERE p_partkey % 7 IN (0, 6)
        UNION ALL SELECT p_partkey, 'dim.XML', '<?xml version="1.0"?><Dimap_Document><MISSION>SPOT</MISSION><MISSION_INDEX>' || CAST(p_partkey % 5 AS STRING) || '</MISSION_INDEX><IMAGING_DATE>2024-03-01</IMAGING_DATE><IMAGING_TIME>04:05:06</IMAGING_TIME><CLOUD_COVERAGE>12.5</CLOUD_COVERAGE></Dimap_Document>' FROM part WHERE p_partkey % 7 = 1
        UNION ALL SELECT p_partkey, 'p_metadata.json', chr(123) || '"properties": ' || chr(123) || '"id": "P' || CAST(p_partkey AS STRING) || '", "instrument": "PS2", "acquired": "2024-04-01", "provider": "pl", "cloud_cover": 0.25, "gsd": 3.5' || chr(125) || chr(125) FROM part WHERE p_partkey % 7 = 2
        UNION ALL SELECT p_partkey, 'L_MTL.txt', '  SENSOR_ID = "OLI"' || chr(10) || '  DATE_ACQUIRED = 2024-05-01' || chr(10) || '  SCENE_CENTER_TIME = "01:02:03Z"' || chr(10) || '  CLOUD_COVER = 0.5' || chr(10) || '  LANDSAT_SCENE_ID = "L' || CAST(p_partkey AS STRING) || '"' FROM part WHERE p_partkey % 7 = 3
        UNION ALL SELECT p_partkey, 'x.aux.xml', '<PAMDataset><Metadata><MDI key="TIFFTAG_DATETIME">2024:02:0' || CAST(p_partkey % 9 + 1 AS STRING) || '</MDI></Metadata></PAMDataset>' FROM part WHERE p_partkey % 7 IN (4, 6)
        UNION ALL SELECT p_partkey, 'any.xml', '<meta><Sensor_Name>S' || CAST(p_partkey % 4 AS STRING) || '</Sensor_Name><AcquisitionDate>2024-06-01</AcquisitionDate><SunElev>44.5</SunElev><CloudPct>3</CloudPct><CloudPct>4</CloudPct></meta>' FROM part WHERE p_partkey % 7 = 5""",
    "uploads": """SELECT p_partkey AS id, 'up/f' || CAST(p_partkey AS STRING) || CASE p_partkey % 9 WHEN 0 THEN '.TIF' WHEN 1 THEN '.jp2' WHEN 2 THEN '.ntf' WHEN 3 THEN '.h5' WHEN 4 THEN '.sid' WHEN 5 THEN '.nc4' WHEN 6 THEN '.exe' WHEN 7 THEN '.kmz' ELSE '.json' END AS path,
        unhex(CASE p_partkey % 9 WHEN 0 THEN '4D4D002A00' WHEN 1 THEN 'FF4FFF5100' WHEN 2 THEN '4E53494630312E303000' WHEN 3 THEN '89484446' WHEN 4 THEN '00000000' WHEN 5 THEN '41' WHEN 6 THEN '4D5A' WHEN 7 THEN '504B0304' ELSE '20207B7D' END) AS content FROM part""",
    "bundle_files": """SELECT p_partkey AS bundle_id, 'a/main.tif' AS path, CAST(p_size AS BIGINT) AS size FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'b/second.JP2' WHEN 1 THEN 'notes.txt' ELSE '../up.txt' END, CAST(7 AS BIGINT) FROM part""",
    "survey_rows": "SELECT o_orderkey AS id, 'RPT-' || CAST(o_orderkey AS STRING) AS report_code, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Bay ' || CAST(o_orderkey % 7 AS STRING) END AS site, 'depth-v3' AS model, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE NULL END AS source_raster_id, o_orderkey + 1 AS depth_raster_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'S2' END AS scene, '2024-01-01' AS acquired, CAST(o_orderkey % 4 AS DOUBLE) / 2 AS min_m, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(20 AS DOUBLE) END AS max_m, CAST(8 AS DOUBLE) AS mean_m, CAST(2 AS DOUBLE) AS std_m, CAST(50 AS DOUBLE) AS coverage_pct, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(61 AS DOUBLE) END AS order_1a FROM orders",
    "tokens": "SELECT event_id AS id, ts, CASE WHEN event_id % 5 = 0 THEN 'revoke' ELSE 'use' END AS kind, user_id AS token, 3600 * (event_id % 4) AS ttl FROM events",
    "requests": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '10.0.0.' || CAST(user_id % 250 AS STRING) || ', 172.16.0.1' WHEN 1 THEN ' 10.0.1.' || CAST(user_id % 250 AS STRING) WHEN 2 THEN NULL ELSE '' END AS forwarded,
        CASE WHEN event_id % 12 = 2 THEN NULL ELSE '192.0.2.' || CAST(user_id % 250 AS STRING) END AS peer, CASE event_id % 5 WHEN 0 THEN '5/minute' WHEN 1 THEN ' 10 / HOUR ' WHEN 2 THEN 'x/day' WHEN 3 THEN '7' ELSE '3/fortnight' END AS limit_spec,
        CASE event_id % 7 WHEN 0 THEN 'bytes=0-99' WHEN 1 THEN 'bytes=500-' WHEN 2 THEN 'bytes=-200' WHEN 3 THEN 'bytes=2000-2100' WHEN 4 THEN 'bytes=a-b' WHEN 5 THEN 'bytes=7' ELSE NULL END AS range_header, CAST(1000 AS BIGINT) AS file_size,
        CASE event_id % 6 WHEN 0 THEN 'Top Secret/x' WHEN 1 THEN 'secret' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'restricted use' WHEN 4 THEN 'open' ELSE NULL END AS marking, CASE event_id % 6 WHEN 0 THEN 'uint8' WHEN 1 THEN 'uint16' WHEN 2 THEN 'int16' WHEN 3 THEN 'float32' WHEN 4 THEN 'float64' ELSE 'complex' END AS dtype,
        CASE event_id % 4 WHEN 0 THEN '2024-01-05T10:11:12Z' WHEN 1 THEN '2024-01-05T10:11:12+02:00' WHEN 2 THEN 'soon' ELSE NULL END AS stamp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '2024-02-03' END AS day, CASE WHEN event_id % 5 = 0 THEN NULL ELSE '04:05:06' END AS clock,
        CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN chr(123) || '"view_angle": 12.5, "sensor": "A"' || chr(125) ELSE chr(123) || '"view_angle": "n/a"' || chr(125) END AS details FROM events""",
    "raw_soundings": "SELECT o_orderkey AS id, o_custkey % 10 + 1 AS scene_id, CAST(50 AS DOUBLE) + CAST((o_custkey % 10 + 1) % 40 AS DOUBLE) / 8 + CAST(o_orderkey % 67 AS DOUBLE) / 512 - 1e0 / 256 AS lon, CAST(20 AS DOUBLE) + CAST((o_custkey % 10 + 1) % 24 AS DOUBLE) / 8 + CAST(o_orderkey * 5 % 67 AS DOUBLE) / 512 - 1e0 / 256 AS lat, CAST(0 - o_orderkey % 28 AS DOUBLE) AS depth FROM orders",
    "cache_entries": "SELECT page_id AS cache_key, CAST(length(html) AS BIGINT) AS size_bytes, (page_id * 7919) % 1000003 AS atime FROM pages",
    "bbox_requests": """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN CAST(value AS STRING) || ',' || CAST(user_id % 90 AS STRING) || ',' || CAST(value + 1 AS STRING) || ', ' || CAST(user_id % 90 + 1 AS STRING) || ' ' WHEN 1 THEN '1,2,' || CAST(user_id AS STRING) WHEN 2 THEN '1,2,x' || CAST(user_id AS STRING) || ',4'
        WHEN 3 THEN '-1.5e1,' || CAST(user_id AS STRING) || ',+3,.5' WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN '1,2,3,4,' || CAST(user_id AS STRING) ELSE '1,,3,' || CAST(user_id AS STRING) END AS bbox FROM events""",
    "survey_jobs": """SELECT job_id, CASE WHEN job_id % 20 = 4 THEN NULL WHEN job_id % 20 = 9 THEN chr(123) || '"west": ' || CAST(x AS STRING) || chr(125) WHEN job_id % 20 = 13 THEN '[1, "two", 3, 4]' WHEN job_id % 20 = 17 THEN '[' || CAST(x AS STRING) || ', 2, 3]'
        WHEN job_id % 3 = 0 THEN '[' || CAST(x AS STRING) || ', ' || CAST(y AS STRING) || ', ' || CAST(x + 0.5e0 AS STRING) || ', ' || CAST(y + 0.5e0 AS STRING) || ']'
        ELSE chr(123) || '"south": "' || CAST(y AS STRING) || '", "west": ' || CAST(x AS STRING) || ', "note": [1], "east": ' || CAST(x + 0.5e0 AS STRING) || ', "north": ' || CAST(y + 0.5e0 AS STRING) || chr(125) END AS bbox, x, y, name
        FROM (SELECT c_custkey AS job_id, CAST(49 AS DOUBLE) + CAST(c_custkey * 7 % 48 AS DOUBLE) / 8 AS x, CAST(19 AS DOUBLE) + CAST((c_custkey * 7 % 48 + c_custkey % 3) % 32 AS DOUBLE) / 8 AS y, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name FROM customer) j""",
    "vendor_imd": "SELECT p_partkey AS bundle_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS sat_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 9 AS DOUBLE) / 8 ELSE CAST(p_partkey % 90 AS DOUBLE) END AS cloud_cover, CASE WHEN p_partkey % 10 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS mean_sun_el FROM part",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star-schema table or one of the views over them."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text, parts = VIEWS[name], {}
    for base in BASE:
        if f"FROM {base}" in text or f"JOIN {base}" in text:
            text = text.replace(f"FROM {base}", f"FROM {{{base}}}").replace(f"JOIN {base}", f"JOIN {{{base}}}")
            parts[base] = table(spark, sf_dir, base)
            if name == "pixels":  # few rows become very many: deal them out first
                parts[base] = parts[base].repartition(parts_of(spark), "s_suppkey")
    for seq in ("seq5", "seq16", "seq32"):
        if seq in text:
            text = text.replace(seq, f"{{{seq}}}")
            parts[seq] = spark.range(int(seq[3:]))
    return spark.sql(text, **parts)


def block_table(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """The samples of ``pixels`` as square blocks of size a side: see operators.blocks."""
    from isobath.operators.blocks import KEYS

    keys = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit((SIDE - 1) // size))).alias("br")).select("*", F.explode(F.sequence(F.lit(0), F.lit((SIDE - 1) // size))).alias("bc"))
    # keys are few bytes, of which adaptive execution would make one task; what is made of them is much, so their number of parts is fixed: that of other exchanges, so that only strips move
    keys = keys.select(F.col("s_suppkey").alias("scene_id"), "br", "bc", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"))
    keys = keys.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEYS)
    # a block's rows and columns, cut at the scene's edge; lambdas are interpreted, so what they need of each place is laid out before
    rows, columns = (f"sequence(CAST({b} * {size} AS BIGINT), CAST(least({b} * {size} + {size}, {SIDE}) - 1 AS BIGINT))" for b in ("br", "bc"))
    samples = []
    for band, text in BANDS.items():
        value = text.format(r="r", c="c").replace("s_suppkey", "scene_id")
        samples.append(F.expr(f"flatten(transform({rows}, r -> transform({columns}, c -> CAST({value} AS DOUBLE))))").alias(band))
    return keys.select(*KEYS, "height", "width", *samples)


def duck(query: str, *views: str) -> str:
    """query for DuckDB with the named views in front."""
    heads = [f"{v} AS ({VIEWS[v]})" for v in views]
    for seq in ("seq5", "seq16", "seq32"):
        if any(seq in h for h in heads):
            heads.insert(0, f"{seq} AS (SELECT range AS id FROM range({seq[3:]}))")
    return f"WITH {', '.join(heads)} {query}" if heads else query
