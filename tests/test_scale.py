"""Steps whose cost at size was found too high: their parts, their joins and their results against the plain forms."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.operators import derived as K
from isobath.operators import model as M
from isobath.plans import registry
from isobath.sources.views import block_table

SF = "/root/testdata/sf0.001"


def test_blocks_keep_their_parts(spark):
    # a few bytes a key: adaptive execution made one task of them
    assert block_table(spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


@pytest.mark.parametrize("version", [1, 2])
def test_passes_taken_together_equal_single_ones(version):
    bundle, rng = M.synthetic_bundle(version), np.random.default_rng(5)
    for n in (1, 83, 700):
        x, seeds = rng.normal(size=(n, bundle.inputs)), M._mix(np.arange(n, dtype=np.uint64))
        out = np.stack([M.forward(bundle, x, seeds, s) for s in range(30)])
        mean, std = M.sample_passes(bundle, x, seeds, 30)
        assert np.allclose(mean, out.mean(0), atol=2e-5) and np.allclose(std, out.std(0), atol=2e-5)


def test_grouped_centres_equal_those_by_rounds(spark):
    blocks = block_table(spark, SF).filter("scene_id IN (1, 3)")
    want = {r.scene_id: r for r in M.bottom_centres(blocks, starts=3, size=16).collect()}
    for limit in (M.GATHERED, 0):
        got = {r.scene_id: r for r in M.scene_centres(blocks, starts=3, size=16, gathered=limit).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert np.allclose(r.centres, want[i].centres) and math.isclose(r.cost, want[i].cost, rel_tol=1e-9)


def test_neither_pixels_nor_weights_are_broadcast(spark):
    blocks = block_table(spark, SF)
    truth = blocks.select("scene_id", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(3.0).alias("measured")).distinct()
    tuned = M.fine_tune(M.block_features(blocks, 16), truth, M.synthetic_bundle(1))
    weights = blocks.select("scene_id").distinct().withColumn("weights", F.array(F.lit(0.0)))
    sampled = M.sample_depth(blocks, M.synthetic_bundle(1), 2, 16, tuned=weights)
    for df in (tuned, sampled):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["repaired_polygons", "valid_polygons", "kml_features", "sounding_cell_median", "warped_band"])
def test_work_is_dealt_to_all_cores(spark, name):
    # small files and few bytes gave these to one task or to as many as there are cores
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_requests_of_a_warp_are_dealt(spark):
    plan = registry.QUERIES["warped_utm"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scene_id" in plan and plan.count("REPARTITION_BY_NUM") >= 2


@pytest.mark.parametrize("name", ["layer_kml_documents", "layer_geojson_pages", "gpx_features"])
def test_features_are_dealt_before_texts_are_made_of_them(spark, name):
    # two tasks made all texts of 1,080,000 features, three times over
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    read = plan[plan.rindex("REPARTITION_BY_NUM") :]
    assert "FileScan" in read and not any(made in read for made in ("ToJson", "get_json_object", "<Placemark>", "<wpt"))
    assert "SortMergeJoin" not in plan  # with few layers


def test_areas_of_few_stale_tiles_are_not_shuffled(spark):
    # each area went with each tile above it, nine million areas to as many tasks as there are large tiles
    plan = registry.QUERIES["stale_tiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and plan.count("FileScan") == 2


@pytest.mark.parametrize("few", [10**6, 0])
def test_stale_tiles_of_repeated_rows_equal_all_pairs(spark, few):
    rng = random.Random(4)
    areas = [(i, x := rng.uniform(-180, 179), y := rng.uniform(-86, 85), min(180.0, x + 10 ** rng.uniform(-4, 2.3)), min(90.0, y + 10 ** rng.uniform(-4, 2))) for i in range(80)] + [(98, -180.0, -90.0, 180.0, 90.0), (97, 0.0, 0.0, 0.0, 0.0), (96, -180.0, -90.0, -180.0, -89.0)]
    areas += areas[:5] + [(0, 1.0, 1.0, 2.0, 2.0)]
    tiles = [(0, 0, 0), (0, 0, 0)] + [(z, rng.randrange(2**z), rng.randrange(2**z)) for z in range(1, 9) for _ in range(50)]
    for _, x, y, *_ in areas[:40]:  # deep ones at the areas' corners
        z, s = rng.randrange(9, 31), math.sin(math.radians(max(-85, min(85, y))))
        tiles.append((z, int((x + 180) / 360 * 2**z), int((0.5 - math.atanh(s) / 2 / math.pi) * 2**z)))
    got = K.stale_tiles(spark.createDataFrame(areas, "id int, xmin double, ymin double, xmax double, ymax double"), spark.createDataFrame(tiles, "z int, x long, y long"), few)
    lat = lambda z, y: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 2**z))))
    want = Counter((i, z, x, y) for i, x0, y0, x1, y1 in areas for z, x, y in tiles if x0 <= (x + 1) / 2**z * 360 - 180 and x1 >= x / 2**z * 360 - 180 and y0 <= lat(z, y) and y1 >= lat(z, y + 1))
    assert Counter(map(tuple, got.collect())) == want and max(z for _, z, *_ in want) > 20
