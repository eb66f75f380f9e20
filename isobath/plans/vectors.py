"""Queries of vector files in and out, of bounds as callers give them, and of survey runs, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isobath.functions import bounds as E
from isobath.functions import geo as G
from isobath.operators import model as M
from isobath.operators import raster as R
from isobath.operators import reports as P
from isobath.operators import survey as Y
from isobath.operators.steps import dealt, shared_folder, written
from isobath.plans.base import query
from isobath.sources import xml_vectors as X

# layers as documents

#: Features of a page in these queries.
PAGE = 40
#: A feature's page, as paged() deals it.
PAGED = f"(SELECT *, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT % pages AS page FROM (SELECT *, xmin + extent AS xmax, ymin + extent AS ymax, CAST(ceil(count(*) OVER (PARTITION BY dataset_id) / {PAGE}.0) AS BIGINT) AS pages FROM vector_features) f)"
RING = "xmin || '{0}' || ymin || '{1}' || xmax || '{0}' || ymin || '{1}' || xmax || '{0}' || ymax || '{1}' || xmin || '{0}' || ymax || '{1}' || xmin || '{0}' || ymin"
GEOMETRY_SQL = f"""CASE geometry_type WHEN 'Point' THEN '{{"type":"Point","coordinates":[' || xmin || ',' || ymin || ']}}' WHEN 'LineString' THEN '{{"type":"LineString","coordinates":[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymax || ']]}}' ELSE '{{"type":"Polygon","coordinates":[[[' || {RING.format(",", "],[")} || ']]]}}' END"""


def _features(t):
    """Vector features with a geometry as GeoJSON text, dealt out before any text is made of them."""
    f = dealt(t("vector_features"), "id").withColumns({"xmax": F.col("xmin") + F.col("extent"), "ymax": F.col("ymin") + F.col("extent")})
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("xmin", "ymin").alias("coordinates")))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.array(F.array("xmin", "ymin"), F.array("xmax", "ymax")).alias("coordinates")))
    return f.withColumn("geometry", F.when(F.col("geometry_type") == "Point", point).when(F.col("geometry_type") == "LineString", line).otherwise(G.envelope_geojson(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")])))


@query(
    "layer_geojson_pages",
    f"""SELECT dataset_id, page, pages, count(*) AS features, '{{"type":"FeatureCollection","features":[' || string_agg('{{"type":"Feature","geometry":' || {GEOMETRY_SQL} || ',"properties":{{"id":' || id || ',"label":"' || label || '"}}}}', ',' ORDER BY id) || ']}}' AS document FROM {PAGED} GROUP BY ALL""",
    ("vector_features",),
)
def _(t):
    f = _features(t).withColumn("feature", P.feature(F.col("geometry"), F.struct("id", "label")))
    return P.geojson_documents(f, "dataset_id", "id", PAGE)


def _kml(t):
    named = _features(t).withColumn("title", F.concat("label", F.lit(" & <b>")))
    return P.kml_documents(named, "dataset_id", "id", "title", "geometry", ["id", "extent", "label"], PAGE)


@query(
    "layer_kml_documents",
    f"""SELECT dataset_id, page, pages, count(*) AS features, '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Schema name="layer" id="layer"><SimpleField name="id" type="int"/><SimpleField name="extent" type="float"/><SimpleField name="label" type="string"/></Schema>' ||
      string_agg('<Placemark><name>' || label || ' &amp; &lt;b&gt;</name><ExtendedData><SchemaData schemaUrl="#layer"><SimpleData name="id">' || id || '</SimpleData><SimpleData name="extent">' || extent || '</SimpleData><SimpleData name="label">' || label || '</SimpleData></SchemaData></ExtendedData>' ||
        CASE geometry_type WHEN 'Point' THEN '<Point><coordinates>' || xmin || ',' || ymin || '</coordinates></Point>' WHEN 'LineString' THEN '<LineString><coordinates>' || xmin || ',' || ymin || ' ' || xmax || ',' || ymax || '</coordinates></LineString>'
        ELSE '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || {RING.format(",", " ")} || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' END || '</Placemark>', '' ORDER BY id) || '</Document></kml>' AS document FROM {PAGED} GROUP BY ALL""",
    ("vector_features",),
)
def _(t):
    return _kml(t)


@query("kml_features", f"""SELECT dataset_id, CAST(id AS VARCHAR) AS id, label || ' & <b>' AS name, geometry_type, {GEOMETRY_SQL} AS geometry, xmin, ymin, xmax, ymax FROM {PAGED}""", ("vector_features",))
def _(t):
    # a layer's documents, read back
    read = X.kml_features(_kml(t), "document", ["dataset_id"])
    return read.select("dataset_id", F.get_json_object("properties", "$.id").alias("id"), "name", "geometry_type", "geometry", "xmin", "ymin", "xmax", "ymax")


@query(
    "gpx_features",
    f"""SELECT dataset_id, CASE geometry_type WHEN 'Point' THEN 'waypoints' WHEN 'LineString' THEN 'tracks' ELSE 'routes' END AS layer, id || ' ' || label AS name, CASE geometry_type WHEN 'Point' THEN 'Point' WHEN 'LineString' THEN 'MultiLineString' ELSE 'LineString' END AS geometry_type, xmin, ymin, xmax, ymax FROM {PAGED}""",
    ("vector_features",),
)
def _(t):
    # points as waypoints, lines as tracks, outlines as routes of two corners, and back
    def at(element: str, x: str, y: str):
        return F.concat(F.lit(f'<{element} lat="'), F.col(y).cast("string"), F.lit('" lon="'), F.col(x).cast("string"), F.lit('"/>'))

    def ends(element: str):
        return F.concat(at(element, "xmin", "ymin"), at(element, "xmax", "ymax"))

    name = F.concat(F.lit("<name>"), F.col("id").cast("string"), F.lit(" "), P.escaped(F.col("label")), F.lit("</name>"))
    waypoint = F.concat(F.lit('<wpt lat="'), F.col("ymin").cast("string"), F.lit('" lon="'), F.col("xmin").cast("string"), F.lit('">'), name, F.lit("</wpt>"))
    track = F.concat(F.lit("<trk>"), name, F.lit("<trkseg>"), ends("trkpt"), F.lit("</trkseg></trk>"))
    route = F.concat(F.lit("<rte>"), name, ends("rtept"), F.lit("</rte>"))
    marked = _features(t).withColumn("feature", F.when(F.col("geometry_type") == "Point", waypoint).when(F.col("geometry_type") == "LineString", track).otherwise(route))
    texts = P.documents(marked, "dataset_id", "id", F.lit('<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1">'), "", "</gpx>", PAGE)
    return X.gpx_features(texts, "document", ["dataset_id"]).select("dataset_id", "layer", "name", "geometry_type", "xmin", "ymin", "xmax", "ymax")


# bounds

PARTS = "list_transform(string_split(bbox, ','), lambda x: TRY_CAST(trim(x) AS DOUBLE))"


@query(
    "bbox_requests",
    "SELECT id, CASE WHEN bbox IS NOT NULL AND p IS NULL THEN 400 ELSE 200 END AS status, p[1] AS xmin, p[2] AS ymin, p[3] AS xmax, p[4] AS ymax "
    f"FROM (SELECT id, bbox, CASE WHEN len({PARTS}) = 4 AND len(list_filter({PARTS}, lambda x: x IS NULL)) = 0 THEN {PARTS} END AS p FROM bbox_requests) b",
    ("bbox_requests",),
)
def _(t):
    read = t("bbox_requests").withColumn("p", E.parse_bounds(F.col("bbox")))
    return read.select("id", E.status(F.col("bbox"), F.col("p")).alias("status"), *[F.get("p", i).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))])


# survey runs

BOX_SQL = "job_id % 20 NOT IN (4, 9, 13, 17)"
FOUND_SQL = f"""(SELECT job_id, scene_id FROM (SELECT job_id, scene_id, row_number() OVER (PARTITION BY job_id ORDER BY cloud_cover, scene_id) AS n FROM survey_jobs JOIN scenes ON west <= x + 0.5e0 AND east >= x AND south <= y + 0.5e0 AND north >= y
  WHERE {BOX_SQL} AND cloud_cover < 60 AND acquired BETWEEN DATE '2024-01-05' AND DATE '2024-02-20') f WHERE n = 1)"""
STAGE_SQL = f"CASE WHEN NOT ({BOX_SQL}) OR scene_id IS NULL THEN 'infer' WHEN scene_id % 7 = 0 THEN 'transfer' WHEN name IS NULL THEN 'report' END"


@query(
    "survey_runs",
    f"""SELECT job_id, CASE WHEN stage IS NULL THEN 'done' ELSE 'failed' END AS status, stage, scene_id, CASE WHEN {BOX_SQL} THEN CASE WHEN stage = 'infer' THEN '422: no scene' WHEN stage = 'transfer' THEN 'depth product missing' WHEN stage = 'report' THEN 'a report needs a name' END ELSE '400: bbox required' END AS error,
      CASE WHEN stage IS NULL THEN concat_ws(';', CASE WHEN scene_id % 3 = 0 THEN 'overview: not written' END, CASE WHEN scene_id % 2 = 0 THEN 'archive: not written' END) ELSE '' END AS warnings,
      CASE WHEN stage IS NULL THEN 'RPT-' || upper(substr(md5(sha1(round(x, 5) || ',' || round(y, 5) || ',' || round(x + 0.5e0, 5) || ',' || round(y + 0.5e0, 5) || '|2024-01-05|2024-02-20|{M.DEFAULT_MODEL}|1')), 1, 8)) END AS report_code,
      CASE WHEN stage IS NULL THEN 32 END AS grid_rows, CASE WHEN stage IS NULL THEN 32 END AS profile_points
    FROM (SELECT *, {STAGE_SQL} AS stage FROM survey_jobs LEFT JOIN {FOUND_SQL} USING (job_id)) r""",
    ("survey_jobs", "scenes"),
)
def _(t):
    found = survey(t)
    grid = F.get_json_object("payload", "$.grid.rows").cast("int").alias("grid_rows")
    points = F.json_array_length(F.get_json_object("payload", "$.profile.depth_m")).alias("profile_points")
    return found.select("job_id", "status", "stage", "scene_id", "error", F.array_join("warnings", ";").alias("warnings"), "report_code", grid, points)


def survey(t):
    """All survey jobs through their stages, with depths by the model, calibrated on each scene's soundings."""
    # a job is few bytes, and its bounds are much work
    scenes, jobs = t("scenes"), dealt(t("survey_jobs").select("job_id", "bbox", "name"), "job_id")
    cells = written(R.sounding_cells(t("soundings")), "cells")
    depth = written(M.predict(t("pixel_blocks"), M.synthetic_bundle(1), soundings=cells, size=16), "depth")
    pairs = depth.select("scene_id", "r", "c", "depth").join(cells, ["scene_id", "r", "c"])
    answered = written(Y.answers(depth, scenes, R.compliance(pairs)), "answers")
    box = E.coerce_bounds(F.col("bbox"))
    sides = written(jobs.select(F.col("job_id").alias("roi_id"), *[F.get(box, i).alias(n) for i, n in enumerate(("wxmin", "wymin", "wxmax", "wymax"))]), "sides").filter("wxmin IS NOT NULL")  # a filter before would be moved to where jobs are read
    first, last = "2024-01-05", "2024-02-20"
    best = R.least_cloudy(scenes, sides, 60.0, first, last).withColumnRenamed("roi_id", "job_id")
    # a scene's products are there by its number
    products = scenes.filter("scene_id % 7 <> 0").select("scene_id", F.concat(F.col("scene_id").cast("string"), F.lit("/depth_rgb.tif")).alias("product_key"))
    stages = [
        Y.infer(best, answered, M.DEFAULT_MODEL), Y.transfer(products), Y.report(answered, "1", F.lit(first), F.lit(last)),
        Y.finalize("overview", scenes.filter("scene_id % 3 <> 0")), Y.finalize("archive", scenes.filter("scene_id % 2 <> 0")),
    ]
    return Y.run_stages(jobs, stages, f"{shared_folder(jobs.sparkSession)}/isobath-survey-{uuid.uuid4().hex}")
