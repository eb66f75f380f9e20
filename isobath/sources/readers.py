"""Format sniffing and tolerant readers for sidecars, vectors and line-delimited JSON."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes, as hex, that name a raster format. Fixed values.
RASTER_MAGIC = [
    ("49492A00", "geotiff"), ("4D4D002A", "geotiff"), ("49492B00", "geotiff"), ("4D4D002B", "geotiff"), ("0000000C6A50", "jp2"), ("FF4FFF51", "jp2"), ("894844460D0A1A0A", "hdf5"), ("0E031301", "hdf4"), ("43444601", "netcdf"), ("43444602", "netcdf"),
    ("4E49544630322E3130", "nitf"), ("4E49544630322E3030", "nitf"), ("4E53494630312E3030", "nitf"), ("656373", "ecw"), ("00004003", "ecw"),
]
#: Extensions that are taken for a raster where the bytes tell nothing. Fixed values.
RASTER_EXTENSIONS = ["tif", "tiff", "geotiff", "jp2", "j2k", "jph", "ecw", "sid", "ntf", "nitf", "nsif", "h5", "hdf5", "hdf", "he5", "nc", "nc4", "cdf", "img"]
VECTOR_EXTENSIONS = {"geojson": "geojson", "json": "geojson", "kml": "kml", "kmz": "kmz", "shp": "shapefile", "zip": "shapefile", "gpkg": "gpkg", "gpx": "gpx"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _by_extension(path: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(table, extension(path))


def raster_format(path: Column, content: Column) -> Column:
    """The format by leading bytes, then by extension; null for a file that is refused."""
    head, ext = F.hex(F.substring(content, 1, 16)), extension(path)
    by_bytes = F.coalesce(*[F.when(head.startswith(m), name) for m, name in RASTER_MAGIC])
    mrsid = F.when((head.startswith("6D736964") | head.startswith("0000")) & (ext == "sid"), "mrsid")
    return F.coalesce(by_bytes, mrsid, F.when(ext.isin(RASTER_EXTENSIONS), ext))


def vector_format(path: Column, content: Column) -> Column:
    """The format by leading bytes, then by extension; an XML prolog is read as KML, as is documented."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.ltrim(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    sniffed = F.when(head.startswith("53514C69746520666F726D6174"), "gpkg").when(text.startswith("<?xml"), "kml").when(text.startswith("<kml"), "kml").when(text.startswith("<gpx"), "gpx").when(text.startswith("{"), "geojson")
    zipped = F.when(head.startswith("504B"), F.when(extension(path) == "kmz", "kmz").otherwise("shapefile"))
    return F.coalesce(sniffed, zipped, _by_extension(path, VECTOR_EXTENSIONS))


def safe_path(path: Column) -> Column:
    """The path with forward slashes, null if it is absolute, climbs or names a drive."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = clean.startswith("/") | clean.contains(":") | F.array_contains(F.split(clean, "/"), "..")
    return F.when(~bad, clean)


def first_alias(values: Column, names: list[str]) -> Column:
    """The value of the first of names that the map holds."""
    return F.coalesce(*[F.element_at(values, n) for n in names])


def to_number(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def cloud_percent(x: Column) -> Column:
    """Cloud cover as a percentage; values from 0 to 1 are shares."""
    return F.when(x.between(0, 1), x * 100).otherwise(x)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of line-delimited JSON files; blank and malformed lines and manifest lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.get_json_object("value", "$.type").alias("__type"), F.from_json("value", f"{schema}, __bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("__row"))
    return parsed.filter("__row.__bad IS NULL AND coalesce(__type, '') <> 'manifest'").select("__row.*").drop("__bad")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature: geometry type, geometry and properties as JSON text, and the envelope."""
    whole = spark.read.text(path, wholetext=True)
    kind = "type STRING, features ARRAY<STRUCT<geometry: STRING, properties: STRING>>"
    rows = whole.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).select("f.geometry", "f.properties").filter("geometry IS NOT NULL")
    names = ("geometry_type", "xmin", "ymin", "xmax", "ymax")
    kind, *bounds = [c.alias(n) for c, n in zip(geometry_columns(F.col("geometry")), names)]
    return rows.select(kind, "geometry", "properties", *bounds)


def geometry_columns(geometry: Column) -> list[Column]:
    """(type, xmin, ymin, xmax, ymax) of a geometry given as GeoJSON text."""
    points = F.regexp_extract_all(F.get_json_object(geometry, "$.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"), F.lit(0))
    numbers = F.transform(points, lambda x: F.split(F.regexp_replace(x, r"[\[\s]", ""), ","))
    xs, ys = F.transform(numbers, lambda p: p[0].cast("double")), F.transform(numbers, lambda p: p[1].cast("double"))
    return [F.get_json_object(geometry, "$.type"), F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def read_band_tiles(files: DataFrame) -> DataFrame:
    """(path, band, r, c, value) of binary tiles: a 16-byte header (magic, version, compression, bands, width, height), then little-endian uint16 samples, plain or deflated."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                magic, _, packed, bands, _, width, height, _ = struct.unpack_from("<4sBBBBHHI", content)
                if magic != b"SWS1":
                    continue
                body = zlib.decompress(content[16:]) if packed else content[16:]
                n = width * height
                values = np.frombuffer(body, "<u2", bands * n)
                i = np.arange(bands * n)
                yield pd.DataFrame({"path": path, "band": i // n, "r": i % n // width, "c": i % width, "value": values.astype("int32")})

    return files.select("path", "content").mapInPandas(run, "path string, band long, r long, c long, value int")


def write_band_tile(values: Column, bands: int, width: int, height: int) -> Column:
    """A binary tile of samples (an array of numbers below 65536), uncompressed."""
    def two(x: Column) -> Column:
        return F.concat(F.lpad(F.hex(x % 256), 2, "0"), F.lpad(F.hex(F.floor(x / 256)), 2, "0"))

    head = b"SWS1" + struct.pack("<BBBBHHI", 1, 0, bands, 0, width, height, 0)
    return F.unhex(F.concat(F.lit(head.hex()), F.array_join(F.transform(values, two), "")))


def bundle_check(files: DataFrame, main: list[str]) -> DataFrame:
    """(bundle_id, status, main, bytes, refused): 200 where a bundle (bundle_id, path, size) has one file with a main raster's extension, else 400; refused counts unsafe paths."""
    is_main = extension(F.col("path")).isin(main) & safe_path(F.col("path")).isNotNull()
    found = files.groupBy("bundle_id").agg(
        F.count_if(is_main).alias("n"), F.min(F.when(is_main, F.col("path"))).alias("main"), F.sum("size").alias("bytes"), F.count_if(safe_path(F.col("path")).isNull()).alias("refused")
    )
    status = F.when((F.col("n") == 1) & (F.col("refused") == 0), 200).otherwise(400)
    return found.select("bundle_id", status.alias("status"), F.when(F.col("n") == 1, F.col("main")).alias("main"), "bytes", "refused")
