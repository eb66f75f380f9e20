"""Stages of survey runs: failures keep their stage, a dead run starts at its first unfinished stage, answers equal NumPy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobath.operators import survey as Y
from isobath.plans import vectors
from isobath.sources.views import table

SF = "/root/testdata/sf0.001"


def stage(name, bad, seen, best_effort=False, dies=False):
    def run(jobs):
        seen.append(name)
        if dies:
            raise RuntimeError("lost")
        return jobs.withColumns({f"{name}_out": F.lit(name), "error": F.when(F.col("job_id").isin(bad), F.lit("x" * 3000))})

    return Y.Stage(name, run, best_effort)


def test_failed_jobs_keep_their_stage_and_the_others_finish(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(6)] + [(None,)], "job_id long")
    seen = []
    rows = {r.job_id: r for r in Y.run_stages(jobs, [stage("one", [1, 2], seen), stage("two", [1, 3], seen), stage("extra", [2, 4], seen, True)], str(tmp_path / "run")).collect()}
    assert {k: (r.status, r.stage) for k, r in rows.items()} == {0: ("done", None), 1: ("failed", "one"), 2: ("failed", "one"), 3: ("failed", "two"), 4: ("done", None), 5: ("done", None), None: ("done", None)}
    assert len(rows[1].error) == 2000 and rows[1].two_out is None and rows[4].extra_out == "extra"
    assert len(rows[4].warnings) == 1 and rows[4].warnings[0].startswith("extra: x") and rows[0].warnings == [] and rows[4].error is None
    assert Y.run_stages(jobs.limit(0), [stage("one", [], [])], str(tmp_path / "none")).count() == 0


def test_a_dead_run_starts_at_its_first_unfinished_stage(spark, tmp_path):
    jobs, folder = spark.createDataFrame([(i,) for i in range(4)], "job_id long"), str(tmp_path / "run")
    first, again = [], []
    with pytest.raises(RuntimeError):
        Y.run_stages(jobs, [stage("one", [1], first), stage("two", [2], first, dies=True)], folder)
    rows = Y.run_stages(jobs, [stage("one", [1], again), stage("two", [2], again)], folder).collect()
    assert first == ["one", "two"] and again == ["two"]
    assert {r.job_id: r.stage for r in rows} == {0: None, 1: "one", 2: "two", 3: None}


@pytest.mark.parametrize("height, width, most", [(5, 7, 3), (1, 1, 4), (70, 100, 16), (8, 8, 512)])
def test_profile_and_grid_equal_numpy(spark, height, width, most):
    rng = np.random.default_rng(height)
    depth = np.where(rng.random((height, width)) < 0.3, np.nan, rng.integers(0, 80, (height, width)) / 4)
    rows = [(1, r, c, float(depth[r, c]), float(r % 3)) for r in range(height) for c in range(width) if np.isfinite(depth[r, c])]
    df = spark.createDataFrame(rows, "scene_id long, r long, c long, depth double, sigma double")
    scenes = spark.createDataFrame([(1, height, width, 10.0, 11.0), (2, height, width, 0.0, 1.0)], "scene_id long, height int, width int, west double, east double")
    got = {r.scene_id: r.profile for r in Y.profiles(df, scenes).collect()}
    at = np.linspace(0, width - 1, min(64, width)).astype(int)
    clean = [None if not np.isfinite(x) else x for x in depth[height // 2, at]]
    assert got[1].depth_m == clean and got[2].depth_m == [None] * len(at)
    assert np.allclose(got[1].distance_m, at / width * 111320.0, atol=0.051)
    grid = {r.scene_id: r.grid for r in Y.grids(df, scenes, most).collect()}
    step = max(1, -(-max(height, width) // most))
    gh, gw = height // step, width // step
    blocks = depth[: gh * step, : gw * step].reshape(gh, step, gw, step)
    for i in range(gh):
        for j in range(gw):
            v = blocks[i, :, j, :][np.isfinite(blocks[i, :, j, :])]
            x = grid[1].depth[i * gw + j]
            assert x is None if not len(v) else abs(x - v.mean()) < 0.00501
    assert (grid[1].rows, grid[1].cols, len(grid[1].depth)) == (gh, gw, gh * gw) and grid[2].depth == [None] * (gh * gw)


def test_whole_run_has_every_outcome_and_full_payloads(spark):
    rows = vectors.survey(lambda n: vectors_table(spark, n)).collect()
    assert len(rows) == table(spark, SF, "survey_jobs").count()
    assert {r.stage for r in rows} == {None, "infer", "transfer", "report"} and {r.error for r in rows if r.stage == "infer"} >= {"400: bbox required", "422: no scene"}
    done = [r for r in rows if r.status == "done"]
    for r in done:
        p = json.loads(r.payload)
        assert len(p["grid"]["depth"]) == 32 * 32 and len(p["profile"]["depth_m"]) == 32 and p["stats"]["min_m"] <= p["stats"]["max_m"] <= 25
        assert abs(100 * sum(x is not None for x in p["grid"]["depth"]) / 1024 - p["stats"]["coverage_pct"]) < 0.051 and json.loads(r.derived.metadata)["bathymetry"]["stats"] == p["stats"]
    assert done and any(r.warnings for r in done)


def vectors_table(spark, name):
    from isobath.sources.views import block_table

    return block_table(spark, SF) if name == "pixel_blocks" else table(spark, SF, name)


def test_scenes_and_regions_of_one_rectangle_meet_once(spark, monkeypatch):
    from isobath.operators import catalog, raster

    met, kept = [], catalog.meeting

    def meeting(left, right, *args, **kw):
        met.append((left.count(), right.count()))
        return kept(left, right, *args, **kw)

    monkeypatch.setattr(catalog, "meeting", meeting)
    rows = [(i, float(i * 7 % 5), i % 4 / 4.0, 0.0, i % 4 / 4.0 + 0.3, 1.0) for i in range(200)] + [(200, 0.0, None, 0.0, 1.0, 1.0), (201, None, 0.0, 0.0, 0.3, 1.0)]
    asked = [(i, i % 3 / 3.0, 0.5, i % 3 / 3.0 + 0.3, 2.0) for i in range(90)] + [(90, 5.0, 5.0, 6.0, 6.0), (91, None, 0.0, 1.0, 1.0)]
    scenes = spark.createDataFrame(rows, "scene_id long, cloud_cover double, west double, south double, east double, north double")
    rois = spark.createDataFrame(asked, "roi_id long, wxmin double, wymin double, wxmax double, wymax double")
    got = {r.roi_id: (r.cloud_cover, r.scene_id) for r in raster.least_cloudy(scenes, rois, 4.0).collect()}
    want = {}
    for roi, x0, y0, x1, y1 in asked:
        best = [(cloud, i) for i, cloud, w, s, e, n in rows if None not in (w, cloud, x0) and cloud < 4 and w <= x1 and e >= x0 and s <= y1 and n >= y0]
        if best:
            want[roi] = min(best)
    assert got == want and len(got) == 90 and met == [(5, 5)]
