"""Blocks, warps and pictures against NumPy and against the row forms."""

import math

import numpy as np
import pytest
from isobath.functions import projection as P
from isobath.operators import blocks as B
from isobath.operators import raster as R
from isobath.operators import warp as W
from isobath.plans import registry
from isobath.sources.views import block_table, table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def arrays(spark, band, height=32, width=32):
    out = {}
    for r in table(spark, SF, "pixels").select("scene_id", "r", "c", band).collect():
        out.setdefault(r.scene_id, np.full((height, width), np.nan))[r.r, r.c] = np.nan if r[band] is None else r[band]
    return out


def test_block_table_holds_the_pixels(spark):
    got = {}
    for r in block_table(spark, SF, 11).select("scene_id", "br", "bc", "red", "coastal", "scl").collect():
        high, wide = min(11, 32 - r.br * 11), min(11, 32 - r.bc * 11)
        for band in ("red", "coastal", "scl"):
            a = got.setdefault((r.scene_id, band), np.zeros((32, 32)))
            a[r.br * 11 : r.br * 11 + high, r.bc * 11 : r.bc * 11 + wide] = np.array(r[band], float).reshape(high, wide)
    for band in ("red", "coastal", "scl"):
        for scene, a in arrays(spark, band).items():
            assert np.array_equal(got[scene, band], a, equal_nan=True)


@pytest.mark.parametrize("size", [5, 11, 16, 31, 32, 40])
def test_texture_equals_the_row_form(spark, size):
    pixels = table(spark, SF, "pixels").filter("scene_id < 3")
    want = {(r.scene_id, r.r, r.c): r for r in R.moving_stats(pixels, "blue", 32, 32).collect()}
    got = B.texture(B.to_blocks(pixels, ["blue"], 32, 32, size), "blue", size).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.scene_id, r.r, r.c]
        assert math.isclose(r.blue_mean, w.blue_mean, abs_tol=1e-9) and math.isclose(r.blue_std, w.blue_std, abs_tol=1e-4)


@pytest.mark.parametrize("height, width", [(1, 1), (1, 9), (2, 3), (17, 4)])
def test_small_scenes_are_mirrored(spark, height, width):
    a = np.random.default_rng(height).normal(size=(height, width))
    pixels = spark.createDataFrame([("s", r, c, float(a[r, c])) for r in range(height) for c in range(width)], "scene_id string, r long, c long, v double")
    wide = np.pad(a, 2, mode="symmetric")
    for r in B.texture(B.to_blocks(pixels, ["v"], height, width, 4), "v", 4).collect():
        near = wide[r.r : r.r + 5, r.c : r.c + 5]
        assert math.isclose(r.v_mean, near.mean(), abs_tol=1e-9) and math.isclose(r.v_std, near.std(), abs_tol=1e-6)


def test_only_strips_are_shuffled(spark):
    plan = B.with_halo(block_table(spark, SF).select(*B.KEYS, "height", "width", "blue"), ["blue"], 16)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line]
    # block keys before their samples are made, twice; and strips
    assert len(exchanges) == 3 and sum("ENSURE_REQUIREMENTS" in e for e in exchanges) == 1


def test_missing_samples_make_their_neighbourhood_missing(spark):
    pixels = table(spark, SF, "pixels").filter("scene_id = 1").withColumn("blue", F.when((F.col("r") != 3) | (F.col("c") != 15), F.col("blue")))
    got = {(r.r, r.c): r.blue_mean for r in B.texture(B.to_blocks(pixels, ["blue"], 32, 32, 16), "blue", 16).collect()}
    assert {k for k, v in got.items() if v is None} == {(r, c) for r in range(1, 6) for c in range(13, 18)}


# places with coordinates that are published to the millimetre or better: the grid's origin, a scale of the central meridian, a quarter meridian
def test_projection_of_known_places():
    for (lon, lat, zone, north), (east, northing) in {
        (3.0, 0.0, 31, 1): (500000.0, 0.0),
        (3.0, 90.0 - 1e-9, 31, 1): (500000.0, 0.9996 * 10001965.7293),
        (3.0, -1e-12, 31, 0): (500000.0, 10000000.0),
        (44.4, 33.3, 38, 1): (444140.54, 3684706.36),
    }.items():
        got = P.to_utm(np.array(lon), np.array(lat), zone, north, P.ARRAYS)
        assert np.allclose(got, (east, northing), atol=6e-3)


def test_projection_there_and_back_below_a_millimetre(spark):
    lon, lat = (x.ravel() for x in np.meshgrid(np.linspace(48, 54, 25), np.linspace(-84, 84, 57)))
    for north in (0, 1):
        e, n = P.to_utm(lon, lat, 39, north, P.ARRAYS)
        back = P.from_utm(e, n, 39, north, P.ARRAYS)
        assert np.abs(np.stack(back) - [lon, lat]).max() * 111320 < 1e-4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    east, northing = P.to_utm(F.col("lon"), F.col("lat"), F.lit(39), F.lit(1))
    rows = np.array([tuple(r) for r in df.select(east, northing).collect()])
    assert np.allclose(rows, np.stack(P.to_utm(lon, lat, 39, 1, P.ARRAYS), 1), atol=1e-6)
    with pytest.raises(ValueError):
        P.project(2154, lon, lat)


def plain_warp(a, source, target, nearest):
    """One pixel at a time, over the whole source."""
    out = np.full((target["height"], target["width"]), np.nan)
    for r in range(target["height"]):
        for c in range(target["width"]):
            lon, lat = target["x0"] + (c + 0.5) * target["dx"], target["y0"] + (r + 0.5) * target["dy"]
            x, y = P.project(source["epsg"], np.array(lon), np.array(lat))
            i, j = (y - source["y0"]) / source["dy"] - 0.5, (x - source["x0"]) / source["dx"] - 0.5
            if not (-0.5 <= i < a.shape[0] - 0.5 and -0.5 <= j < a.shape[1] - 0.5):
                continue
            if nearest:
                out[r, c] = a[math.floor(i + 0.5), math.floor(j + 0.5)]
                continue
            total = weight = 0.0
            for p in (math.floor(i), math.floor(i) + 1):
                for q in (math.floor(j), math.floor(j) + 1):
                    w = (1 - abs(i - p)) * (1 - abs(j - q))
                    if 0 <= p < a.shape[0] and 0 <= q < a.shape[1] and w > 0 and not math.isnan(a[p, q]):
                        total, weight = total + w * a[p, q], weight + w
            out[r, c] = total / weight if weight else math.nan
    return out


@pytest.mark.parametrize("nearest, band", [(False, "coastal"), (True, "scl")])
def test_warp_from_a_utm_grid_equals_plain(spark, nearest, band):
    source = {"epsg": 32639, "x0": 400000.0, "y0": 2500000.0, "dx": 10.0, "dy": -10.0, "height": 32, "width": 32}
    lon, lat = P.from_utm(np.array(400160.0), np.array(2499840.0), 39, 1, P.ARRAYS)
    target = {"epsg": 4326, "x0": float(lon) - 0.0019, "y0": float(lat) + 0.0017, "dx": 0.00013, "dy": -0.00011, "height": 35, "width": 29}
    pixels = table(spark, SF, "pixels").filter("scene_id IN (6, 7)").withColumn("coastal", F.when(F.col("r") != 9, F.coalesce("coastal", "blue")))
    blocks = B.to_blocks(pixels, [band], 32, 32, 13)
    grid = ", ".join(f"{n} {'int' if isinstance(v, int) else 'double'}" for n, v in source.items())
    sources, targets = (spark.createDataFrame([(i, *g.values()) for i in (6, 7)], f"scene_id long, {grid}") for g in (source, target))
    got = {i: np.full((35, 29), np.nan) for i in (6, 7)}
    for r in W.warped_rows(W.warp(blocks, sources, targets, band, 13, 10, nearest), 10).collect():
        got[r.scene_id][r.r, r.c] = r.value
    for i in (6, 7):
        a = np.full((32, 32), np.nan)
        for r in pixels.filter(f"scene_id = {i}").collect():
            a[r.r, r.c] = np.nan if r[band] is None else r[band]
        want = plain_warp(a, source, target, nearest)
        assert np.isfinite(want).sum() > 500 and np.isnan(want).any()
        assert np.allclose(got[i], want, atol=1e-5, equal_nan=True)


@pytest.mark.parametrize("painted", [64, 2])
def test_pictures_are_painted_in_order(spark, monkeypatch, painted):
    monkeypatch.setattr(W, "PAINTED", painted)
    scenes = spark.createDataFrame([(i, 50.0, 20.0, 51.0 - i * 0.1, 21.0, 32, 32, f"2024-01-{10 - i:02}" if i % 3 else None, 8 if i % 2 else 16) for i in range(7)], "scene_id long, west double, south double, east double, north double, width int, height int, acquired string, bit_depth int")
    pixels = table(spark, SF, "pixels").filter("scene_id < 7").withColumn("red", F.when((F.col("r") + F.col("c")) % 5 > 0, F.col("red")))
    tiles = spark.createDataFrame([(8, 163, 113), (8, 163, 112), (8, 164, 113), (8, 0, 0)], "z int, x long, y long")
    got = {tuple(r)[:5]: r.value for r in W.composite(tiles, scenes, B.to_blocks(pixels, ["red"], 32, 32, 9), "red", 100.0, 1000.0, 16, 9).collect()}
    a = {}
    for r in pixels.collect():
        a.setdefault(r.scene_id, np.full((32, 32), np.nan))[r.r, r.c] = np.nan if r.red is None else r.red
    want = {}
    for s in sorted(scenes.collect(), key=lambda s: (s.acquired is None, s.acquired or "", s.scene_id)):
        for z, x, y in [tuple(t) for t in tiles.collect()]:
            side = 2 * P.MERCATOR_LIMIT / 2**z
            for pr in range(16):
                for pc in range(16):
                    lon, lat = P.unproject(3857, np.array(x * side - P.MERCATOR_LIMIT + (pc + 0.5) * side / 16), np.array(P.MERCATOR_LIMIT - y * side - (pr + 0.5) * side / 16))
                    r, c = math.floor((s.north - lat) / (s.north - s.south) * 32), math.floor((lon - s.west) / (s.east - s.west) * 32)
                    if 0 <= r < 32 and 0 <= c < 32 and not math.isnan(v := a[s.scene_id][r, c]):
                        want[z, x, y, pr, pc] = int(min(255, v)) if s.bit_depth == 8 else int(min(255, max(0, (v - 100) / 900 * 255)))
    assert len(want) > 100 and got == want


def test_texture_query_equals_row_form_on_the_whole_table(spark):
    got = {tuple(r)[:3]: (r.blue_mean, r.blue_std) for r in registry.QUERIES["texture_5x5"](spark, SF).collect()}
    want = {tuple(r)[:3]: (r.blue_mean, r.blue_std) for r in R.moving_stats(table(spark, SF, "pixels"), "blue", 32, 32).collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-4) for k in got for a, b in zip(got[k], want[k]))
