"""Queries give rows for every scene and series."""

import math

from isobath.plans import registry
from isobath.sources.views import table

SF = "/root/testdata/sf0.001"


def ids(df, column):
    return {r[0] for r in df.select(column).distinct().collect()}


def test_every_scene_and_series_has_rows(spark):
    scenes = ids(table(spark, SF, "scenes"), "scene_id")
    assert max(scenes) > 3 and ids(registry.QUERIES["spectral_indices"](spark, SF), "scene_id") == scenes
    series = ids(table(spark, SF, "orders"), "o_custkey")
    assert max(series) >= 50 and ids(registry.QUERIES["timeseries_entries"](spark, SF), "timeseries_id") == series


def test_texture_equals_brute_force(spark):
    blue = {(r.scene_id, r.r, r.c): float(r.blue) for r in table(spark, SF, "pixels").select("scene_id", "r", "c", "blue").collect()}
    got = {(r.scene_id, r.r, r.c): (r.blue_mean, r.blue_std) for r in registry.QUERIES["texture_5x5"](spark, SF).collect()}
    assert got.keys() == blue.keys() and max(k[0] for k in got) > 3

    def inside(i):
        return -1 - i if i < 0 else 63 - i if i > 31 else i

    for (s, r, c), (mean, deviation) in got.items():
        v = [blue[s, inside(r + i), inside(c + j)] for i in range(-2, 3) for j in range(-2, 3)]
        m = sum(v) / 25
        assert math.isclose(mean, m, abs_tol=2e-6)
        assert math.isclose(deviation, math.sqrt(max(sum(x * x for x in v) / 25 - m * m, 0)), abs_tol=2e-4)
