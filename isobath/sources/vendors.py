"""Vendor sidecars: which vendor a bundle comes from, its metadata under common names, and merging where several match.

Files are rows (bundle_id, path, content as text).  Each vendor is a matcher over
a bundle's paths and a parser over one file's text, both column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.sources.readers import cloud_percent, first_alias, to_number

FIELDS = ["acquired_at", "sensor", "platform", "cloud_cover_pct", "sun_elevation_deg", "sun_azimuth_deg", "off_nadir_deg", "gsd_m", "product_id"]
NUMBERS = FIELDS[3:8]
#: Names of a field in a vendor's key=value files, the first that is there. Fixed values.
MAXAR = {
    "acquired_at": ["firstLineTime", "earliestAcqTime", "TLCTime"], "sensor": ["satId", "SATID"], "platform": ["platform"], "cloud_cover_pct": ["cloudCover"], "sun_elevation_deg": ["meanSunEl", "sunElevationAngle", "meanSunElevation"],
    "sun_azimuth_deg": ["meanSunAz", "sunAzimuth"], "off_nadir_deg": ["meanOffNadirViewAngle", "offNadirAngle"], "gsd_m": ["meanCollectedGSD", "groundSampleDistance"], "product_id": ["productCatalogId", "productOrderId", "catId"],
}
LANDSAT = {"sensor": ["SENSOR_ID"], "platform": ["SPACECRAFT_ID"], "cloud_cover_pct": ["CLOUD_COVER"], "sun_elevation_deg": ["SUN_ELEVATION"], "sun_azimuth_deg": ["SUN_AZIMUTH"], "product_id": ["LANDSAT_PRODUCT_ID", "LANDSAT_SCENE_ID"]}
#: Elements of an XML sidecar. Fixed values.
DIMAP = {
    "sensor": ["MISSION_INDEX", "INSTRUMENT"], "platform": ["MISSION"], "cloud_cover_pct": ["CLOUD_COVERAGE", "Cloud_Cover"], "sun_elevation_deg": ["SUN_ELEVATION"], "sun_azimuth_deg": ["SUN_AZIMUTH"],
    "off_nadir_deg": ["INCIDENCE_ANGLE", "VIEWING_ANGLE"], "product_id": ["DATASET_NAME", "PRODUCT_ID"],
}
#: Properties of a JSON sidecar. Fixed values.
PLANET = {"acquired_at": ["acquired"], "sensor": ["instrument"], "platform": ["satellite_id", "provider"], "cloud_cover_pct": ["cloud_cover"], "sun_elevation_deg": ["sun_elevation"], "sun_azimuth_deg": ["sun_azimuth"], "off_nadir_deg": ["view_angle"], "gsd_m": ["gsd"], "product_id": ["id"]}
#: Keys of dates in an auxiliary file. Fixed values.
PAM_DATES = ["ACQUISITIONDATETIME", "TIFFTAG_DATETIME", "AcquisitionDateTime"]
#: Patterns of element names by which unknown XML is read. Fixed values.
HINTS = {
    "acquired_at": r"acqui[a-z]*|first[- ]?line[- ]?time|imaging[- ]?date|datetime", "cloud_cover_pct": "cloud", "sun_elevation_deg": "sun[- ]?el", "sun_azimuth_deg": "sun[- ]?az",
    "sensor": r"sensor|sat[- ]?id|mission", "gsd_m": r"gsd|ground[- ]?sample", "off_nadir_deg": r"off[- ]?nadir|incid|view[- ]?angle",
}
_PAIR = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.+?);?\s*$"


def pairs(text: Column) -> Column:
    """A map of the key = value lines of a text; of equal keys the last counts."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2)).alias("v"))
    clean = F.transform(both, lambda p: F.struct(p["k"].alias("key"), F.btrim(F.trim(p["v"]), F.lit('"')).alias("value")))
    return _last_wins(clean)


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) in which the last value of a key stands at the key's first place."""
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def elements(text: Column) -> Column:
    """(key, value) of all XML elements that hold text, in the order of the document."""
    name = r"<(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_]+)(?:\s[^<>]*)?>\s*([^<>\s][^<>]*?)\s*</"
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(name), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(name), F.lit(2)).alias("v")), lambda p: F.struct(p["k"].alias("key"), plain(p["v"]).alias("value")))


def plain(text: Column) -> Column:
    """XML text without its entities, of which the one for & goes last."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def root(text: Column) -> Column:
    """The name of an XML text's outermost element."""
    return F.regexp_extract(text, r"<(?:[A-Za-z0-9_]+:)?([A-Za-z_][A-Za-z0-9_]*)", 1)


def _named(values: Column, names: dict[str, list[str]]) -> dict[str, Column]:
    return {f: first_alias(values, a) for f, a in names.items()}


def maxar(m: Column) -> dict[str, Column]:
    out = _named(m, MAXAR)
    return out | {"cloud_cover_pct": cloud_percent(to_number(out["cloud_cover_pct"])).cast("string")}


def landsat(m: Column) -> dict[str, Column]:
    day, time = F.element_at(m, "DATE_ACQUIRED"), F.element_at(m, "SCENE_CENTER_TIME")
    return _named(m, LANDSAT) | {"acquired_at": F.when(time.isNotNull(), F.concat_ws("T", day, time)).otherwise(day)}


def _first_element(text: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.xpath_string(text, F.lit(f"//{n}"))), F.lit("")) for n in names])


def dimap(text: Column) -> dict[str, Column]:
    out = {f: _first_element(text, a) for f, a in DIMAP.items()}
    day, time = _first_element(text, ["IMAGING_DATE", "START_TIME"]), _first_element(text, ["IMAGING_TIME"])
    return out | {"acquired_at": F.when(day.isNotNull() & time.isNotNull(), F.concat_ws("T", day, time)).otherwise(day)}


def planet(text: Column) -> dict[str, Column]:
    props = F.coalesce(F.get_json_object(text, "$.properties"), text)
    out = {f: F.coalesce(*[F.nullif(F.get_json_object(props, f"$.{n}"), F.lit("")) for n in a]) for f, a in PLANET.items()}
    return out | {"cloud_cover_pct": cloud_percent(to_number(out["cloud_cover_pct"])).cast("string")}


def pam(text: Column) -> dict[str, Column]:
    return {"acquired_at": F.coalesce(*[F.nullif(F.trim(F.xpath_string(text, F.lit(f"//Metadata/MDI[@key='{k}']"))), F.lit("")) for k in PAM_DATES])}


def last_elements(text: Column) -> Column:
    """(key, value) of the elements that hold text, each name at its first place with its last text."""
    return F.map_entries(_last_wins(elements(text)))


def generic(entries: Column) -> dict[str, Column]:
    """The first element whose name fits a field's pattern."""
    return {f: F.get(F.filter(entries, lambda e: e["key"].rlike(f"(?i){p}")), 0)["value"] for f, p in HINTS.items()}


@dataclass(frozen=True)
class Vendor:
    """A vendor: its name, its name in merged metadata, which files are read, what else the bundle must hold, how a file is parsed and what it is made into once before that."""

    name: str
    label: str
    reads: Callable[[Column, Column], Column]
    needs: Callable[[Column], Column] | None
    parse: Callable[[Column], dict[str, Column]]
    prepare: Callable[[Column], Column] = lambda text: text


def _ends(*ends: str) -> Callable[[Column, Column], Column]:
    return lambda path, _: reduce(lambda a, b: a | b, [F.lower(path).endswith(e) for e in ends])


#: In the order in which they are asked; more vendors can be given to extract().
VENDORS = [
    Vendor("maxar", "maxar", _ends(".imd"), lambda path: F.lower(path).endswith(".rpb") | F.lower(path).endswith(".til"), maxar, pairs),
    Vendor("dimap", "airbus_dimap", lambda path, text: F.lower(path).endswith(".xml") & (root(text) == "Dimap_Document"), None, dimap),
    Vendor("planet", "planet", _ends("_metadata.json"), None, planet),
    Vendor("landsat", "landsat", _ends("_mtl.txt"), None, landsat, pairs),
    Vendor("pam", "pam", lambda path, text: F.lower(path).endswith(".aux.xml") & (root(text) == "PAMDataset"), None, pam),
]


def extract(files: DataFrame, vendors: list[Vendor] = VENDORS) -> DataFrame:
    """One row a bundle: vendor, the common fields, and warnings where vendors disagree.

    Of several vendors the earlier one's values stay, and the vendor names are joined;
    a bundle of none is read by the hints of all its XML files, by path, each field
    from the first file that names it.  Of a vendor's files the first by path is
    read.  What is no number in a number field is null.  Files are read once and
    dealt out once, by bundle.
    """
    path, content = F.col("path"), F.col("content")
    xml = F.lower(path).endswith(".xml")
    held = []
    for i, v in enumerate(vendors):
        own = v.reads(path, content)
        held.append(F.min_by(F.when(own, content), F.when(own, path)).alias(f"content{i}"))
        held.append((F.max(v.needs(path)) if v.needs else F.lit(True)).alias(f"needed{i}"))
    # a bundle's own files
    bundles = files.groupBy("bundle_id").agg(*held, F.sort_array(F.collect_list(F.when(xml, F.struct("path", "content")))).alias("xml"))

    def said(prepared: Column, parse: Callable[[Column], dict[str, Column]]) -> Column:
        """The fields of a file; each step is bound to a variable, so that it is taken once."""
        def raw(m: Column) -> Column:
            named = parse(m)
            return F.struct(*[named.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])

        def clean(r: Column) -> Column:
            value = {f: F.nullif(r[f], F.lit("")) for f in FIELDS}
            return F.struct(*[(to_number(x).cast("string") if f in NUMBERS else x).alias(f) for f, x in value.items()])

        return F.get(F.transform(F.transform(F.array(prepared), raw), clean), 0)

    there = [F.col(f"content{i}").isNotNull() & F.coalesce(f"needed{i}", F.lit(False)) for i in range(len(vendors))]
    read = [F.when(t, F.struct(F.lit(v.name).alias("name"), F.lit(v.label).alias("label"), said(v.prepare(F.col(f"content{i}")), v.parse).alias("v"))) for i, (v, t) in enumerate(zip(vendors, there))]
    any_of = reduce(lambda a, b: a | b, there)
    found = bundles.filter(any_of | (F.size("xml") > 0)).select("bundle_id", F.array_compact(F.array(*read)).alias("found"), F.when(~any_of, F.col("xml")).alias("xml"))
    found = found.select("bundle_id", "found", F.transform("xml", lambda x: said(last_elements(x["content"]), generic)).alias("rest"))

    def values(f: str) -> Column:
        return F.array_compact(F.when(F.size("found") > 0, F.transform("found", lambda x: x["v"][f])).otherwise(F.transform("rest", lambda x: x[f])))

    vendor = F.when(F.size("found") == 0, "generic").when(F.size("found") == 1, F.get("found", 0)["label"]).otherwise(F.array_join("found.name", "+"))
    conflicts = F.when(F.size("found") > 0, F.concat_ws(",", *[F.when(F.size(F.array_distinct(values(f))) > 1, F.lit(f)) for f in FIELDS])).otherwise("")
    return found.select("bundle_id", vendor.alias("vendor"), *[F.get(values(f), 0).alias(f) for f in FIELDS], conflicts.alias("conflicts"))
