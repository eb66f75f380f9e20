"""Survey runs: jobs go through stages whose results and failures are written tables.

A stage is a function of a DataFrame of jobs (``job_id`` and what the stages
before added) that returns the jobs with its own columns and ``error``, null
where it went well.  Jobs with an error stop there and keep the stage's name;
the others go on.  A best-effort stage stops no job: its errors are warnings.
Each stage is one written table in the run's folder, so a run that dies starts
again at its first unfinished stage, and a lost executor repeats one stage only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobath.functions import bounds as E
from isobath.functions.depth import MAX_DEPTH
from isobath.functions.keys import report_code, result_key
from isobath.operators.steps import dealt

#: Longest error text that is kept.
LONGEST = 2000
#: Columns of a cross-section and cells a side of a grid. Fixed values.
PROFILE, GRID = 64, 512
METRES = 111320.0


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[DataFrame], DataFrame]
    best_effort: bool = False


def _exists(df: DataFrame, path: str) -> bool:
    sc = df.sparkSession.sparkContext
    done = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done)


def run_stages(jobs: DataFrame, stages: list[Stage], folder: str) -> DataFrame:
    """jobs with the columns of all stages, ``status`` (done or failed), ``stage`` and ``error`` of a failure, and ``warnings``.

    folder is the run's own, on storage that driver and executors share; a stage
    whose table is complete there is not run again.  Stages must return every job
    once.  No jobs give no rows; a job of a null id is a job like any other.
    """
    spark = jobs.sparkSession
    clear = [F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("warnings")]
    alive, failed = jobs.select("*", *clear), []
    for number, stage in enumerate(stages):
        path = f"{folder.rstrip('/')}/{number:02d}-{stage.name}"
        if not _exists(jobs, path):
            told = stage.run(alive.drop("stage", "error"))
            text = F.substring("error", 1, LONGEST)
            if stage.best_effort:
                warned = F.when(F.col("error").isNotNull(), F.concat("warnings", F.array(F.concat(F.lit(f"{stage.name}: "), text)))).otherwise(F.col("warnings"))
                told = told.withColumns({"warnings": warned, "stage": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
            else:
                told = told.withColumns({"stage": F.when(F.col("error").isNotNull(), stage.name), "error": text})
            told.write.mode("overwrite").parquet(path)
        told = spark.read.parquet(path)
        failed.append(told.filter("stage IS NOT NULL"))
        alive = told.filter("stage IS NULL")
    out = alive.withColumn("status", F.lit("done"))
    for part in failed:
        out = out.unionByName(part.withColumn("status", F.lit("failed")), allowMissingColumns=True)
    return out


def profiles(depth: DataFrame, scenes: DataFrame) -> DataFrame:
    """(scene_id, profile): depths along the middle row at up to 64 columns, with their distance from the west side in metres."""
    size = scenes.select("scene_id", "height", "width", ((F.col("east") - F.col("west")) / F.col("width")).alias("step"))
    many = F.least(F.lit(PROFILE), F.col("width"))
    last = F.col("width").cast("long") - 1
    at = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.when(i == many - 1, last).otherwise(F.floor(i * (last / (many - 1)))))
    wanted = size.select("scene_id", "step", F.floor(F.col("height") / 2).alias("r"), F.explode(at).alias("c"))
    row = wanted.join(depth.select("scene_id", "r", "c", "depth"), ["scene_id", "r", "c"], "left")
    point = F.struct("c", F.bround(F.col("c") * F.col("step") * METRES, 1).alias("distance_m"), F.bround("depth", 2).alias("depth_m"))
    listed = row.groupBy("scene_id").agg(F.sort_array(F.collect_list(point)).alias("p"))  # 64 points at most
    return listed.select("scene_id", F.struct(F.col("p.distance_m").alias("distance_m"), F.col("p.depth_m").alias("depth_m")).alias("profile"))


def grids(depth: DataFrame, scenes: DataFrame, most: int = GRID) -> DataFrame:
    """(scene_id, grid): means of depth and sigma in square blocks that leave at most `most` a side, row by row; incomplete far blocks are dropped, blocks without depth null."""
    step = F.greatest(F.lit(1), F.ceil(F.greatest("height", "width") / most)).cast("long")
    size = scenes.select("scene_id", step.alias("step"), F.floor(F.col("height") / step).alias("rows"), F.floor(F.col("width") / step).alias("cols"))
    shape = ["scene_id", "rows", "cols"]
    inside = depth.join(size, "scene_id").select(*shape, F.floor(F.col("r") / F.col("step")).alias("br"), F.floor(F.col("c") / F.col("step")).alias("bc"), "depth", "sigma").filter("br < rows AND bc < cols")
    # few scenes become very many blocks: deal them out first
    empty = dealt(size, "scene_id").select(*shape, F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("br")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("bc"))
    every = inside.unionByName(empty, allowMissingColumns=True)  # so that each block is there
    cells = every.groupBy(*shape, "br", "bc").agg(F.bround(F.avg("depth"), 2).alias("depth"), F.bround(F.avg("sigma"), 2).alias("sigma"))
    listed = cells.groupBy(*shape).agg(F.sort_array(F.collect_list(F.struct("br", "bc", "depth", "sigma"))).alias("g"))  # most * most cells at most
    return listed.select("scene_id", F.struct("rows", "cols", F.col("g.depth").alias("depth"), F.col("g.sigma").alias("sigma")).alias("grid"))


def answers(depth: DataFrame, scenes: DataFrame, compliance: DataFrame) -> DataFrame:
    """(scene_id, valid, stats, orders_pct, profile, grid) of every scene: what an inference answers; each scene is computed once, however many jobs ask for it."""
    of = depth.groupBy("scene_id").agg(F.count("depth").alias("valid"), *[f("depth").alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"), (F.stddev_pop, "std"))])
    stats = scenes.select("scene_id", (F.col("height") * F.col("width")).alias("n")).join(of, "scene_id", "left").withColumn("valid", F.coalesce("valid", F.lit(0).cast("long")))
    r2 = lambda c: F.bround(c, 2)
    told = stats.select("scene_id", "valid", F.struct(r2("lo").alias("min_m"), r2("hi").alias("max_m"), r2("mean").alias("mean_m"), r2("std").alias("std_m"), F.bround(100.0 * F.col("valid") / F.col("n"), 1).alias("coverage_pct")).alias("stats"))
    orders = [c for c in compliance.columns if c.startswith("order_")]
    share = compliance.select("scene_id", F.struct(*[F.bround(c, 1).alias(c) for c in orders]).alias("orders_pct"))
    return told.join(share, "scene_id", "left").join(profiles(depth, scenes), "scene_id", "left").join(grids(depth, scenes), "scene_id", "left")


def infer(found: DataFrame, answered: DataFrame, model: str) -> Stage:
    """The stage that finds a job (job_id, bbox as JSON, ..) its scene (job_id, scene_id, cloud_cover) and that scene's statistics; answered is from answers()."""

    def run(jobs: DataFrame) -> DataFrame:
        box = E.coerce_bounds(F.col("bbox"))
        df = jobs.withColumn("bounds", box).join(found.select("job_id", "scene_id", "cloud_cover"), "job_id", "left").join(answered.select("scene_id", "valid", "stats"), "scene_id", "left")
        error = F.when(F.col("bounds").isNull(), "400: bbox required").when(F.col("scene_id").isNull(), "422: no scene").when(F.coalesce("valid", F.lit(0)) == 0, "422: no valid water pixels")
        return df.withColumns({"model": F.lit(model), "max_depth_m": F.lit(MAX_DEPTH), "error": error})

    return Stage("infer", run)


def transfer(products: DataFrame) -> Stage:
    """The stage that takes over each scene's depth product (scene_id, product_key) as a pending raster derived from no source."""

    def run(jobs: DataFrame) -> DataFrame:
        df = jobs.join(products.select("scene_id", "product_key"), "scene_id", "left")
        derived = F.struct(
            F.concat(F.lit("Bathymetry — "), F.col("name")).alias("name"), F.lit("pending").alias("processing_status"),
            F.to_json(F.struct(F.lit("bathymetry").alias("source_kind"), F.struct("model", "stats", "max_depth_m").alias("bathymetry"))).alias("metadata"),
        )
        return df.withColumns({"derived": derived, "error": F.when(F.col("product_key").isNull(), "depth product missing")})

    return Stage("transfer", run)


def report(answered: DataFrame, version: str, start: Column, end: Column) -> Stage:
    """The stage that gives a job its report's code and payload, cross-section and grids included; jobs of one area, period and model share the code."""
    heavy = ["orders_pct", "profile", "grid"]

    def run(jobs: DataFrame) -> DataFrame:
        columns = jobs.columns
        jobs = jobs.join(answered.select("scene_id", *heavy), "scene_id", "left")
        named = F.col("name").isNotNull()
        key = result_key([F.get("bounds", i) for i in range(4)], start, end, F.col("model"), F.lit(version))
        payload = F.to_json(F.struct("model", F.struct(*[F.get("bounds", i).alias(s) for i, s in enumerate(E.SIDES)]).alias("bbox"), "stats", "orders_pct", "profile", "grid", "max_depth_m", "scene_id", "cloud_cover"), {"ignoreNullFields": "false"})
        return jobs.select(*columns, F.when(named, report_code(key)).alias("report_code"), F.when(named, payload).alias("payload"), F.when(~named, "a report needs a name").alias("error"))

    return Stage("report", run)


def finalize(name: str, ready: DataFrame) -> Stage:
    """A best-effort stage: a job's scene is in ready (scene_id), or the job is warned."""

    def run(jobs: DataFrame) -> DataFrame:
        there = ready.select("scene_id").distinct().withColumn("__there", F.lit(True))
        df = jobs.join(there, "scene_id", "left")
        return df.withColumns({"error": F.when(F.col("__there").isNull(), "not written")}).drop("__there")

    return Stage(name, run, best_effort=True)
