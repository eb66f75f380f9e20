"""Survey reports: their text, sections and rows, and how they leave as lines of JSON, CSV, GeoJSON and KML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.operators.steps import once, written

MISSING = "?"


def text_or(value: Column, other: str = MISSING) -> Column:
    return F.coalesce(value.cast("string"), F.lit(other))


def summary(site: Column, model: Column, low: Column, high: Column, mean: Column, std: Column, coverage: Column) -> Column:
    """A sentence on the range, mean and coverage of depths; what is not known is a question mark."""
    return F.format_string("Depths of %s by %s: %s to %s m, mean %s m (deviation %s m), %s%% of the scene.", site, model, *[text_or(x) for x in (low, high, mean, std, coverage)])


def section(kind: str, title: Column | str, data: Column) -> Column:
    title = F.lit(title) if isinstance(title, str) else title
    return F.struct(F.lit(kind).alias("type"), title.alias("title"), F.to_json(data, {"ignoreNullFields": "false"}).alias("data"))


def rows(*pairs: tuple[str, Column]) -> Column:
    return F.struct(F.array(*[F.array(F.lit(k), v) for k, v in pairs]).alias("rows"))


def with_sections(surveys: DataFrame) -> DataFrame:
    """surveys with ``sections``, nine in order: cover, metadata, summary, source, depth map, cross-section, statistics, compliance, method.

    surveys has id, report_code, site, model, source_raster_id, depth_raster_id, scene,
    acquired, min_m .. coverage_pct, and order_1a.  A survey without a source raster names its scene instead.
    """
    site = text_or(F.col("site"), "Survey area")
    stats = F.struct("min_m", "max_m", "mean_m", "std_m", "coverage_pct")
    dash = lambda c: text_or(F.col(c), "—")
    thumbnail = lambda c: F.concat(F.lit("/api/rasters/"), F.col(c).cast("string"), F.lit("/thumbnail"))
    image = section("image", "Source imagery", F.struct(thumbnail("source_raster_id").alias("url")))
    scene = section("kv", "Source imagery", rows(("Scene", dash("scene")), ("Acquired", dash("acquired"))))
    compliance = F.when(F.col("order_1a").isNull(), F.array(F.array(F.lit("—"), F.lit("no data")))).otherwise(F.array(F.array(F.lit("order 1a"), F.concat(F.col("order_1a").cast("string"), F.lit(" %")))))
    parts = [
        section("cover", F.concat(F.lit("Bathymetric survey — "), site), F.struct("report_code", site.alias("site_name"), "model")),
        section("kv", "Survey metadata", rows(("Report code", F.col("report_code")), ("Survey area", site), ("Model", F.col("model")), ("Scene", dash("scene")), ("Acquired", dash("acquired")), ("Depth coverage", F.concat(dash("coverage_pct"), F.lit(" %"))))),
        section("prose", "Summary", F.struct(summary(site, F.col("model"), *[F.col(c) for c in ("min_m", "max_m", "mean_m", "std_m", "coverage_pct")]).alias("text"))),
        F.when(F.col("source_raster_id").isNotNull(), image).otherwise(scene),
        section("raster", "Depth map", F.struct(F.col("depth_raster_id").alias("raster_id"), thumbnail("depth_raster_id").alias("url"))),
        section("chart", "Depth cross-section", F.struct(F.array().cast("array<double>").alias("distance_m"), F.array().cast("array<double>").alias("depth_m"))),
        section("stats", "Depth statistics", F.struct(stats.alias("stats"))),
        section("kv", "Compliance", F.struct(compliance.alias("rows"))),
        section("prose", "Method", F.struct(F.concat(F.lit("Depths are estimated from reflectances by "), F.col("model"), F.lit("; check them against soundings before use.")).alias("text"))),
    ]
    return surveys.withColumn("sections", F.array(*parts))


def stream_lines(slim: DataFrame, etag: Column, bounds: list[float], order: list[Column]) -> DataFrame:
    """(part, line) of a stream of lines: a manifest with the tag, count and bounds, then a JSON object a row; order within part 1 is given by the caller's sort."""
    count = slim.agg(F.count("*").alias("count"), etag.alias("etag"))
    manifest = F.struct(F.lit("manifest").alias("type"), "etag", "count", F.array(*map(F.lit, bounds)).alias("bbox"))
    head = count.select(F.lit(0).alias("part"), F.to_json(manifest).alias("line"))
    body = slim.orderBy(*order).select(F.lit(1).alias("part"), F.to_json(F.struct(*slim.columns), {"ignoreNullFields": "false"}).alias("line"))
    return head.unionByName(body)


def csv_line(*columns: Column) -> Column:
    """A line of CSV: nulls empty, fields quoted where they hold a comma, a quote or a line break."""
    def one(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(s.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *map(one, columns))


def feature(geometry: Column, properties: Column) -> Column:
    """A GeoJSON feature from a geometry as JSON text and a struct or map."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))


def feature_collections(features: DataFrame, key: str, order: str) -> DataFrame:
    """(key, collection) with the features (feature) of each key in order; a collection is one document, so it is as large as its layer."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "feature"))), lambda x: x["feature"])
    return features.groupBy(key).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("collection"))


def escaped(text: Column) -> Column:
    for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def placemark(name: Column, coordinates: Column) -> Column:
    """A KML placemark of a point or ring, with coordinates as x,y pairs."""
    return F.concat(F.lit("<Placemark><name>"), escaped(F.coalesce(name, F.lit(""))), F.lit("</name><coordinates>"), coordinates, F.lit("</coordinates></Placemark>"))


#: Features of a page of an exported layer, on average.
PAGE = 1000


def paged(features: DataFrame, key: str, order: str, page: int = PAGE) -> DataFrame:
    """features with ``page`` and ``pages``: each key's features dealt by a hash of order to as many pages as they fill, so no page grows with its layer.

    Layers are counted and written first: by the size of that table Spark need not
    shuffle all features to as many tasks as there are layers to join them with it.
    """
    counted = written(features.groupBy(key).agg(F.ceil(F.count("*") / page).alias("pages")), "pages")
    place = F.conv(F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    return features.join(counted, key).withColumn("page", place % F.col("pages"))


def documents(features: DataFrame, key: str, order: str, head: Column, between: str, tail: str, page: int = PAGE) -> DataFrame:
    """(key, page, pages, features, document) of the texts in ``feature``: every page is a whole document; a layer without features gives none."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order, "feature"))), lambda x: x["feature"])
    grouped = paged(features, key, order, page).groupBy(key, "page", "pages").agg(F.count("*").alias("features"), F.array_join(listed, between).alias("body"))
    return grouped.select(key, "page", "pages", "features", F.concat(head, "body", F.lit(tail)).alias("document"))


def geojson_documents(features: DataFrame, key: str, order: str, page: int = PAGE) -> DataFrame:
    """Feature collections of the GeoJSON features in ``feature``, in pages."""
    return documents(features, key, order, F.lit('{"type":"FeatureCollection","features":['), ",", "]}", page)


def kml_schema(fields: dict[str, str]) -> str:
    """The schema element of a layer: whole numbers are int, other numbers float, all else string."""
    kinds = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float"}
    return '<Schema name="layer" id="layer">' + "".join(f'<SimpleField name="{n}" type="{kinds.get(k, "string")}"/>' for n, k in fields.items()) + "</Schema>"


def kml_geometry(geometry: Column) -> Column:
    """A Point, LineString or Polygon, given as GeoJSON text, as a KML element; null for other kinds."""
    def tuples(points: Column) -> Column:
        return F.concat(F.lit("<coordinates>"), F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), ",")), " "), F.lit("</coordinates>"))

    def ring(r: Column, side: str) -> Column:
        return F.concat(F.lit(f"<{side}BoundaryIs><LinearRing>"), tuples(r), F.lit(f"</LinearRing></{side}BoundaryIs>"))

    def polygon(rings: Column) -> Column:
        inner = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: ring(r, "inner"))
        return F.concat(F.lit("<Polygon>"), ring(F.get(rings, 0), "outer"), F.array_join(inner, ""), F.lit("</Polygon>"))

    def element(g: Column) -> Column:
        point, line, rings = (F.from_json(g["at"], k) for k in ("array<double>", "array<array<double>>", "array<array<array<double>>>"))
        return F.when(g["kind"] == "Point", F.concat(F.lit("<Point>"), tuples(F.array(point)), F.lit("</Point>"))).when(g["kind"] == "LineString", F.concat(F.lit("<LineString>"), tuples(line), F.lit("</LineString>"))).when(g["kind"] == "Polygon", once(rings, polygon))

    return once(F.struct(F.get_json_object(geometry, "$.type").alias("kind"), F.get_json_object(geometry, "$.coordinates").alias("at")), element)


def kml_documents(features: DataFrame, key: str, order: str, name: str, geometry: str, fields: list[str], page: int = PAGE) -> DataFrame:
    """KML documents with a schema of the fields and one placemark a feature, in pages; null fields are left out, features of a kind that KML lacks too."""
    schema = kml_schema({f: dict(features.dtypes)[f] for f in fields})
    data = F.concat(*[F.coalesce(F.concat(F.lit(f'<SimpleData name="{f}">'), escaped(F.col(f).cast("string")), F.lit("</SimpleData>")), F.lit("")) for f in fields])
    # a filter would be pushed below the marks and evaluate the geometry again
    shaped = features.select("*", F.explode(F.array_compact(F.array(kml_geometry(F.col(geometry))))).alias("__shape"))
    mark = F.concat(F.lit("<Placemark><name>"), escaped(F.coalesce(name, F.lit(""))), F.lit('</name><ExtendedData><SchemaData schemaUrl="#layer">'), data, F.lit("</SchemaData></ExtendedData>"), F.col("__shape"), F.lit("</Placemark>"))
    marked = shaped.select(key, order, mark.alias("feature"))
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + schema
    return documents(marked, key, order, F.lit(head), "", "</Document></kml>", page)
