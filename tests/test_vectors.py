"""KML, GPX and bounds: hand-made documents with odd cases, export and import, pages, files read by the XML source."""

import json

import pytest
from pyspark.sql import functions as F

from isobath.functions import bounds as E
from isobath.operators import reports as P
from isobath.sources import xml_vectors as X

KML = """<?xml version="1.0"?><k:kml xmlns:k="http://www.opengis.net/kml/2.2"><k:Document><k:Folder><!-- <k:Placemark><k:name>no</k:name><k:Point><k:coordinates>1,1</k:coordinates></k:Point></k:Placemark> -->
<k:Placemark id="a"><k:name>A &amp; b</k:name><k:ExtendedData><k:Data name="k"><k:value>1</k:value></k:Data><k:Data name="k"><k:value>2</k:value></k:Data></k:ExtendedData><k:Point><k:coordinates> 1.5 , 2,7 </k:coordinates></k:Point></k:Placemark>
<k:Folder><k:Placemark><k:name>L</k:name><k:LineString><k:coordinates>0,0 1,1
 2,0</k:coordinates></k:LineString></k:Placemark></k:Folder>
<k:Placemark><k:name>P</k:name><k:Polygon><k:outerBoundaryIs><k:LinearRing><k:coordinates>0,0 9,0 9,9 0,0</k:coordinates></k:LinearRing></k:outerBoundaryIs><k:innerBoundaryIs><k:LinearRing><k:coordinates>1,1 2,1 2,2 1,1</k:coordinates></k:LinearRing></k:innerBoundaryIs></k:Polygon></k:Placemark>
<k:Placemark><k:name>M</k:name><k:MultiGeometry><k:Point><k:coordinates>1,1</k:coordinates></k:Point><k:Point><k:coordinates>3,3</k:coordinates></k:Point></k:MultiGeometry></k:Placemark>
<k:Placemark><k:name>C</k:name><k:MultiGeometry><k:Point><k:coordinates>1,1</k:coordinates></k:Point><k:LineString><k:coordinates>3,3 4,4</k:coordinates></k:LineString></k:MultiGeometry></k:Placemark>
<k:Placemark/><k:Placemark><k:name>bad</k:name><k:Point><k:coordinates>x,1</k:coordinates></k:Point></k:Placemark><k:Placemark><k:name>short</k:name><k:LineString><k:coordinates>1,1</k:coordinates></k:LineString></k:Placemark></k:Folder></k:Document></k:kml>"""
GPX = """<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="1" lon="2"><name>w</name><desc>d</desc></wpt><wpt lat="1" lon="3"/><wpt lat="1"/><rte><name>r</name><rtept lat="0" lon="0"/><rtept lat="1" lon="1"><name>x</name></rtept></rte>
<trk><trkseg><trkpt lat="0" lon="0"><ele>3</ele></trkpt><trkpt lat="2" lon="1"/></trkseg><trkseg><trkpt lat="5" lon="5"/><trkpt lat="6" lon="6"/></trkseg></trk></gpx>"""
WANTED = {
    "A & b": {"type": "Point", "coordinates": [1.5, 2]}, "L": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]},
    "P": {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}, "M": {"type": "MultiPoint", "coordinates": [[1, 1], [3, 3]]},
    "C": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "LineString", "coordinates": [[3, 3], [4, 4]]}]},
}


def of_kml(df):
    return {r.name: json.loads(r.geometry) for r in df.collect()}


def test_kml_of_a_column_and_of_a_file(spark, tmp_path):
    df = spark.createDataFrame([(1, KML), (2, None), (3, ""), (4, "{}")], "id long, t string")
    found = X.kml_features(df, "t", ["id"])
    assert of_kml(found) == WANTED and {r.id for r in found.collect()} == {1}
    first = found.filter("name = 'A & b'").first()
    assert json.loads(first.properties) == {"k": "1"} and found.filter("name = 'C'").first().xmax == 4
    (tmp_path / "a.kml").write_text(KML)
    assert of_kml(X.read_kml(spark, str(tmp_path / "a.kml"))) == WANTED


def test_gpx_of_a_column_and_of_a_file(spark, tmp_path):
    wanted = [("routes", "r", "LineString", 0, 0, 1, 1), ("tracks", None, "MultiLineString", 0, 0, 6, 6), ("waypoints", None, "Point", 3, 1, 3, 1), ("waypoints", "w", "Point", 2, 1, 2, 1)]
    (tmp_path / "a.gpx").write_text(GPX)
    for df in (X.gpx_features(spark.createDataFrame([(GPX,), (None,)], "t string"), "t", []), X.read_gpx(spark, str(tmp_path / "a.gpx"))):
        rows = [tuple(r) for r in df.select("layer", "name", "geometry_type", "xmin", "ymin", "xmax", "ymax").collect()]
        assert sorted(rows, key=str) == sorted(wanted, key=str)


def test_export_reads_back_and_pages_hold_each_feature_once(spark):
    geometry = json.dumps(WANTED["P"])
    rows = [(i % 3 // 2, i, None if i == 5 else f"<{i}> & co", geometry if i % 2 else json.dumps(WANTED["A & b"])) for i in range(500)]
    df = spark.createDataFrame(rows, "layer_id long, id long, name string, geometry string")
    pages = P.kml_documents(df, "layer_id", "id", "name", "geometry", ["id", "name"], page=20).cache()
    sizes = [r.features for r in pages.collect()]
    assert sum(sizes) == 500 and max(sizes) < 60 and len(sizes) > 15
    read = {int(json.loads(r.properties)["id"]): r for r in X.kml_features(pages, "document", ["layer_id"]).collect()}
    assert len(read) == 500
    for layer, i, name, g in rows:
        assert read[i].layer_id == layer and json.loads(read[i].geometry) == json.loads(g) and (read[i].name or None) == name
    with pytest.raises(ValueError, match="layer"):
        X.kml_features(pages.withColumnRenamed("layer_id", "layer"), "document", ["layer"])
    assert P.kml_documents(df.limit(0), "layer_id", "id", "name", "geometry", ["id"]).count() == 0


@pytest.mark.parametrize(
    "text, wanted",
    [("1,2,3,4", [1, 2, 3, 4]), (" -1.5e1, +2 ,.5,4 ", [-15, 2, 0.5, 4]), ("1,2,3", None), ("1,2,3,4,5", None), ("1,2,x,4", None), ("1,,3,4", None), ("", None), (None, None)],
)
def test_bounds_as_text(spark, text, wanted):
    row = spark.createDataFrame([(text,)], "t string").select(E.parse_bounds(F.col("t")).alias("p"), E.status(F.col("t"), E.parse_bounds(F.col("t"))).alias("s")).first()
    assert row.p == wanted and row.s == (200 if wanted or text is None else 400)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("[1, 2.5, 3, 4]", [1, 2.5, 3, 4]), ('["1", 2, 3, 4]', [1, 2, 3, 4]), ("[1, 2, 3]", None), ("[1, 2, null, 4]", None), ('[1, "x", 3, 4]', None), ("[[1], 2, 3, 4]", None), ("[]", None), ("{}", None),
        ('{"north": 4, "west": 1, "east": "3", "south": 2, "more": {"a": 1}}', [1, 2, 3, 4]), ('{"north": 4, "west": 1, "east": 3}', None), ('{"north": 4, "west": 1, "east": 3, "south": null}', None), ("{broken", None), ("7", None), ('"1,2,3,4"', None), (None, None),
    ],
)
def test_bounds_as_json(spark, text, wanted):
    assert spark.createDataFrame([(text,)], "t string").select(E.coerce_bounds(F.col("t")).alias("p")).first().p == wanted
