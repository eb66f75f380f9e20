"""KML and GPX as vector sources: every feature as GeoJSON text with its layer, name, properties and envelope.

Files are read by Spark's own XML source, which splits a document at its
features, so one large file is read by many tasks.  Documents that lie in a
column are split into features first and each is parsed alone.  Prefixes of
namespaces are ignored.  A feature whose coordinates cannot be read, or that has
none, has a null geometry and is left out, as by the GeoJSON reader; empty
documents and documents of another kind give no rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.operators.steps import dealt

from isobath.sources.readers import geometry_columns

_RING = "STRUCT<LinearRing: STRUCT<coordinates: STRING>>"
_AT = "STRUCT<coordinates: STRING>"
_POLYGON = f"STRUCT<outerBoundaryIs: {_RING}, innerBoundaryIs: ARRAY<{_RING}>>"
PLACEMARK = (
    "name STRING, description STRING, ExtendedData STRUCT<Data: ARRAY<STRUCT<_name: STRING, value: STRING>>, SchemaData: STRUCT<SimpleData: ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>>>, "
    f"Point {_AT}, LineString {_AT}, LinearRing {_AT}, Polygon {_POLYGON}, MultiGeometry STRUCT<Point: ARRAY<{_AT}>, LineString: ARRAY<{_AT}>, Polygon: ARRAY<{_POLYGON}>>"
)
_PLACE = "STRUCT<_lat: DOUBLE, _lon: DOUBLE>"
#: Elements of GPX that are features, with their layer and schema.
GPX = {
    "wpt": ("waypoints", "_lat DOUBLE, _lon DOUBLE, name STRING, desc STRING"),
    "rte": ("routes", f"name STRING, desc STRING, rtept ARRAY<{_PLACE}>"),
    "trk": ("tracks", f"name STRING, desc STRING, trkseg ARRAY<STRUCT<trkpt: ARRAY<{_PLACE}>>>"),
}
OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}


def _elements(text: Column, name: str) -> Column:
    """The elements of one name in a document, outermost first found; comments are passed over."""
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(plain, F.lit(rf"(?s)<(?:[\w.-]+:)?{name}(?:\s[^>]*)?(?:/>|(?<!/)>.*?</(?:[\w.-]+:)?{name}\s*>)"), F.lit(0))


def _pair(x: Column, y: Column) -> Column:
    return F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def positions(coordinates: Column) -> Column:
    """The [x,y] texts of a KML coordinate list, whose tuples are parted by blanks; null where there is none or one is no pair of numbers."""
    tuples = F.filter(F.split(F.regexp_replace(coordinates, r"\s*,\s*", ","), r"\s+"), lambda p: p != "")
    read = F.transform(tuples, lambda p: _pair(F.get(F.split(p, ","), 0).try_cast("double"), F.get(F.split(p, ","), 1).try_cast("double")))
    return F.when((F.size(read) > 0) & ~F.exists(read, lambda p: p.isNull()), read)


def _line(coordinates: Column, least: int) -> Column:
    read = positions(coordinates)
    return F.when(F.size(read) >= least, _list(read))


def _polygon(p: Column) -> Column:
    """Rings, the outer one first; null where a ring has fewer than four positions."""
    outer = _line(p["outerBoundaryIs"]["LinearRing"]["coordinates"], 4)
    inner = F.transform(F.coalesce(p["innerBoundaryIs"], F.array()), lambda r: _line(r["LinearRing"]["coordinates"], 4))
    return F.when(outer.isNotNull() & ~F.exists(inner, lambda r: r.isNull()), _list(F.concat(F.array(outer), inner)))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))


def _parts(parts: Column, read) -> Column:
    return F.transform(F.coalesce(parts, F.array()), read)


def _multi(m: Column) -> Column:
    """One Multi- geometry where all parts are of one kind, else a collection; null where a part is broken or none is there."""
    kinds = {"Point": _parts(m["Point"], lambda p: F.get(positions(p["coordinates"]), 0)), "LineString": _parts(m["LineString"], lambda p: _line(p["coordinates"], 2)), "Polygon": _parts(m["Polygon"], _polygon)}
    every = F.concat(*[F.transform(v, partial(_geometry, k)) for k, v in kinds.items()])
    alone = F.coalesce(*[F.when(F.size(v) == F.size(every), _geometry(f"Multi{k}", _list(v))) for k, v in kinds.items()])
    whole = (F.size(every) > 0) & ~F.exists(every, lambda g: g.isNull())
    return F.when(whole, F.coalesce(alone, F.concat(F.lit('{"type":"GeometryCollection","geometries":'), _list(every), F.lit("}"))))


def _placemark_columns(p: Column) -> list[Column]:
    geometry = F.coalesce(
        _geometry("Point", F.get(positions(p["Point"]["coordinates"]), 0)), _geometry("LineString", _line(p["LineString"]["coordinates"], 2)),
        _geometry("LineString", _line(p["LinearRing"]["coordinates"], 4)), _geometry("Polygon", _polygon(p["Polygon"])), _multi(p["MultiGeometry"]),
    )
    data = F.transform(F.coalesce(p["ExtendedData"]["Data"], F.array()), lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value")))
    simple = F.transform(F.coalesce(p["ExtendedData"]["SchemaData"]["SimpleData"], F.array()), lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value")))
    return [F.lit("placemarks").alias("layer"), p["name"].alias("name"), geometry.alias("geometry"), _properties(F.concat(data, simple)).alias("properties")]


def _properties(pairs: Column) -> Column:
    """A map of named values; the first of equal names counts, unnamed ones are left out."""
    named = F.filter(pairs, lambda d: d["key"].isNotNull())
    first = F.filter(named, lambda d, i: F.array_position(F.transform(named, lambda x: x["key"]), d["key"]) == i + 1)
    return F.map_from_entries(first)


def _gpx_columns(element: str, g: Column) -> list[Column]:
    def run(points: Column) -> Column:
        read = F.transform(F.coalesce(points, F.array()), lambda p: _pair(p["_lon"], p["_lat"]))
        return F.when((F.size(read) >= 2) & ~F.exists(read, lambda p: p.isNull()), _list(read))

    if element == "wpt":
        geometry = _geometry("Point", _pair(g["_lon"], g["_lat"]))
    elif element == "rte":
        geometry = _geometry("LineString", run(g["rtept"]))
    else:
        parts = F.transform(F.coalesce(g["trkseg"], F.array()), lambda s: run(s["trkpt"]))
        geometry = F.when((F.size(parts) > 0) & ~F.exists(parts, lambda s: s.isNull()), _geometry("MultiLineString", _list(parts)))
    described = F.filter(F.array(F.struct(F.lit("desc").alias("key"), g["desc"].alias("value"))), lambda d: d["value"].isNotNull())
    return [F.lit(GPX[element][0]).alias("layer"), g["name"].alias("name"), geometry.alias("geometry"), F.map_from_entries(described).alias("properties")]


def _shaped(features: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., layer, name, geometry_type, geometry, properties as JSON text, xmin, ymin, xmax, ymax) of the features that have a geometry."""
    clash = {"layer", "name", "geometry_type", "geometry", "properties", "xmin", "ymin", "xmax", "ymax"} & set(keep)
    if clash:
        raise ValueError(f"columns to carry have names of the result: {sorted(clash)}")
    box = F.regexp_replace("geometry", '"geometries"', '"coordinates"')  # a collection's envelope is that of all its positions
    kind, *bounds = [c.alias(n) for c, n in zip(geometry_columns(box), ("geometry_type", "xmin", "ymin", "xmax", "ymax"))]
    return features.filter("geometry IS NOT NULL").select(*keep, "layer", "name", kind, "geometry", F.to_json("properties").alias("properties"), *bounds)


def kml_features(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a placemark, at any depth of folders, of KML documents in a column; the columns of keep are carried and must not be named as the result's."""
    one = documents.select(*keep, F.explode(_elements(F.col(text), "Placemark")).alias("__one"))
    read = dealt(one).select(*keep, F.from_xml("__one", PLACEMARK, OPTIONS).alias("__p"))
    return _shaped(read.select(*keep, *_placemark_columns(F.col("__p"))), keep)


def gpx_features(documents: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row a waypoint, route or track of GPX documents in a column; a track is a MultiLineString of its segments."""
    def marked(kind: str) -> Column:
        return F.transform(_elements(F.col(text), kind), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("one")))

    found = F.array(*map(marked, GPX))
    one = documents.select(*keep, F.explode(F.flatten(found)).alias("__f")).select(*keep, "__f.kind", "__f.one")
    parts = [_shaped(one.filter(F.col("kind") == e).select(*keep, F.from_xml("one", schema, OPTIONS).alias("__g")).select(*keep, *_gpx_columns(e, F.col("__g"))), keep) for e, (_, schema) in GPX.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _read(spark: SparkSession, path: str, element: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").options(**OPTIONS, rowTag=element).schema(schema).load(path)
    return rows.select(F.struct(*rows.columns).alias("__p"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """One row a placemark of KML files, split between tasks."""
    return _shaped(_read(spark, path, "Placemark", PLACEMARK).select(*_placemark_columns(F.col("__p"))), [])


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """One row a waypoint, route or track of GPX files, split between tasks."""
    parts = [_shaped(_read(spark, path, e, schema).select(*_gpx_columns(e, F.col("__p"))), []) for e, (_, schema) in GPX.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
