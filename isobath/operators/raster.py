"""Pixel tables: feature stacks, neighbourhoods, depth products and their summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions import depth as D
from isobath.operators.steps import dealt

#: Pixels on each side of the neighbourhood.
REACH = 2


def indices(pixels: DataFrame) -> DataFrame:
    """pixels with reflectances, ratios, turbidity and the water mask; a missing coastal band is blue."""
    df = pixels.withColumn("ndwi", D.ndwi(F.col("green"), F.col("nir"))).withColumn("water", D.water_mask(F.col("scl"), F.col("ndwi")))
    b, g, r, k = (D.reflectance(x) for x in (F.col("blue"), F.col("green"), F.col("red"), F.coalesce("coastal", "blue")))
    red, green, blue = (F.col(c) / 10000.0 for c in ("red", "green", "blue"))
    return df.withColumns({
        "x_bg": D.log_ratio(b, g), "x_cg": D.log_ratio(k, g), "ln_rg": F.log(r / g + D.EPS), "b_g": b / g, "c_g": k / g, "lum": F.log10(b + g + k + D.EPS), "c_b": k / b,
        "spm": D.suspended_matter(red), "ndti": D.ndti(red, green), "clarity": F.coalesce("coastal", "blue") / 10000.0 / (blue + D.EPS),
    })


def mirrored(df: DataFrame, place: str, size: Column) -> DataFrame:
    """df with copies of its first and last REACH rows or columns beyond the border, mirrored at the border itself."""
    at = F.col(place)
    outside = F.filter(
        F.array(at, F.when(at < REACH, -1 - at), F.when(at >= size - REACH, 2 * size - 1 - at)), lambda x: x.isNotNull()
    )
    return df.withColumn(place, F.explode(outside))


def moving_stats(pixels: DataFrame, value: str, height: int, width: int) -> DataFrame:
    """pixels with the mean and deviation of value over the 5 x 5 neighbourhood, in two passes of one direction each."""
    # each of the scene's lines is a window partition of bounded size
    base = pixels.select("scene_id", "r", "c", F.col(value).cast("double").alias("v"))
    span = (-REACH, REACH)
    along = Window.partitionBy("scene_id", "r").orderBy("c").rowsBetween(*span)
    wide = mirrored(base, "c", F.lit(width)).withColumns({"s": F.avg("v").over(along), "q": F.avg(F.col("v") * F.col("v")).over(along)}).filter(F.col("c").between(0, width - 1))
    down = Window.partitionBy("scene_id", "c").orderBy("r").rowsBetween(*span)
    tall = mirrored(wide.select("scene_id", "r", "c", "s", "q"), "r", F.lit(height)).withColumns({"mean": F.avg("s").over(down), "square": F.avg("q").over(down)}).filter(F.col("r").between(0, height - 1))
    deviation = F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return tall.select("scene_id", "r", "c", F.col("mean").alias(f"{value}_mean"), deviation.alias(f"{value}_std"))


def surrogate_depth(pixels: DataFrame) -> DataFrame:
    """A stand-in for model output in product queries: depth on water from the blue-green ratio, sigma by row."""
    df = indices(pixels)
    value = D.clip(12.0 + 15.0 * (F.col("x_bg") - 1.0), 0.0, D.MAX_DEPTH)
    return df.select("scene_id", "r", "c", "spm", F.when(F.col("water"), value).alias("depth"), (0.25 + (F.col("r") % 8) / 16.0).alias("sigma"))


def depth_stats(grid: DataFrame) -> DataFrame:
    """Per scene: extremes, mean and population deviation of depth, and the share of pixels that have one."""
    return grid.groupBy("scene_id").agg(
        F.round(F.min("depth"), 2).alias("min_m"), F.round(F.max("depth"), 2).alias("max_m"), F.round(F.avg("depth"), 2).alias("mean_m"), F.round(F.stddev_pop("depth"), 2).alias("std_m"),
        F.round(100.0 * F.count("depth") / F.count("*"), 1).alias("coverage_pct"),
    )


def block_mean(grid: DataFrame, height: int, width: int, most: int = 512, digits: int = 2) -> DataFrame:
    """Means of square blocks that leave at most `most` a side; null pixels are skipped, partial blocks at the far edges dropped."""
    step = max(1, -(-max(height, width) // most))
    inside = grid.filter((F.col("r") < height // step * step) & (F.col("c") < width // step * step))
    return inside.groupBy("scene_id", F.floor(F.col("r") / step).alias("br"), F.floor(F.col("c") / step).alias("bc")).agg(F.round(F.avg("depth"), digits).alias("depth"))


def pyramid(grid: DataFrame, height: int, width: int, least: int = 256) -> DataFrame:
    """All overview levels by factors of two while the smaller side has at least `least` pixels; each level is summed from the one before."""
    sums = grid.select("scene_id", F.col("r").alias("br"), F.col("c").alias("bc"), F.col("depth").alias("s"), F.col("depth").isNotNull().cast("long").alias("k"))
    out, level = [], 1
    while min(height, width) // 2**level >= least:
        sums = sums.groupBy("scene_id", F.floor(F.col("br") / 2).alias("br"), F.floor(F.col("bc") / 2).alias("bc")).agg(F.sum("s").alias("s"), F.sum("k").alias("k"))
        out.append(sums.withColumn("level", F.lit(level)))
        level += 1
    every = reduce(DataFrame.unionByName, out) if out else sums.limit(0).withColumn("level", F.lit(0))
    return every.select("scene_id", "br", "bc", F.round(F.col("s") / F.nullif("k", F.lit(0)), 6).alias("depth"), "level")


def transect(grid: DataFrame, scenes: DataFrame, samples: int = 64) -> DataFrame:
    """Depth along the middle row at evenly spaced columns; metres ignore the latitude, as the product defines them."""
    n = F.least(F.lit(samples), F.col("width"))
    points = scenes.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("c", F.when(n > 1, F.floor(F.col("i") * (F.col("width") - 1) / (n - 1))).otherwise(0))
    points = points.select("scene_id", "i", "c", F.floor(F.col("height") / 2).alias("r"), (F.col("c") * (F.col("east") - F.col("west")) / F.col("width") * 111320.0).alias("distance_m"))
    return points.join(grid.select("scene_id", "r", "c", "depth"), ["scene_id", "r", "c"], "left").select("scene_id", "i", F.round("distance_m", 1).alias("distance_m"), F.round("depth", 2).alias("depth"))


def sounding_cells(soundings: DataFrame, low: float = 0.3, high: float = 25.0) -> DataFrame:
    """The median sounding of each pixel; depths outside the range are left out.

    Soundings are numbered in their cell, so the middle ones are averaged by a plain
    aggregate and the cells stay partitioned for a join on them.
    """
    kept = soundings.select("scene_id", "r", "c", F.abs("depth").alias("d")).filter(F.col("d").between(low, high))
    kept = dealt(kept, "scene_id", "r", "c")  # small parts, as a task sorts its part
    cell = Window.partitionBy("scene_id", "r", "c")
    placed = kept.withColumn("i", F.row_number().over(cell.orderBy("d"))).withColumn("n", F.count("*").over(cell))
    middle = placed.filter((F.col("i") == F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.floor((F.col("n") + 2) / 2)))
    return middle.groupBy("scene_id", "r", "c").agg(F.avg("d").alias("measured"))


def calibration(pairs: DataFrame, least: int = 5) -> DataFrame:
    """(scene_id, n, alpha, beta, r2) of measured = alpha + beta * depth; (0, 1, 0) with fewer than least pairs or no spread."""
    # regressions pass over nulls; a filter on depth would be tested for each pixel by itself, its whole expression several times
    fitted = pairs.groupBy("scene_id").agg(
        F.regr_count("measured", "depth").alias("n"), F.regr_intercept("measured", "depth").alias("a"), F.regr_slope("measured", "depth").alias("b"), F.regr_r2("measured", "depth").alias("r")
    ).filter("n > 0")
    good = (F.col("n") >= least) & F.col("b").isNotNull()
    return fitted.select("scene_id", "n", F.when(good, F.col("a")).otherwise(0.0).alias("alpha"), F.when(good, F.col("b")).otherwise(1.0).alias("beta"), F.when(good, F.coalesce("r", F.lit(0.0))).otherwise(0.0).alias("r2"))


def compliance(pairs: DataFrame) -> DataFrame:
    """Per survey order, the percentage of pairs whose error stays within its uncertainty, and the root mean square error."""
    err = F.abs(F.col("depth") - F.col("measured"))
    shares = [(100.0 * F.avg((err <= D.allowed_uncertainty(F.col("measured"), a, b)).cast("double"))).alias(f"order_{name}") for name, a, b in D.ORDERS]
    return pairs.groupBy("scene_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), *shares)


def percentiles(pixels: DataFrame, band: str, nodata: int | None = None) -> DataFrame:
    """The 2.5 and 97.5 per cent points of a band, exact and interpolated; 0 and 255 for a scene without data, one apart for a constant one."""
    data = F.when(F.col(band) != nodata, F.col(band)) if nodata is not None else F.col(band)
    p = pixels.groupBy("scene_id").agg(F.percentile(data, [0.025, 0.975]).alias("p"))
    lo, hi = F.coalesce(F.col("p")[0], F.lit(0.0)), F.coalesce(F.col("p")[1], F.lit(255.0))
    return p.select("scene_id", lo.alias("lo"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("hi"))


def least_cloudy(scenes: DataFrame, rois: DataFrame, below: float, first: str | None = None, last: str | None = None) -> DataFrame:
    """The least cloudy scene of each region of interest (roi_id, wxmin .. wymax) in a closed range of days; ties go to the smaller id.

    Of scenes that cover the same rectangle only the least cloudy meets regions, and
    regions of the same rectangle meet scenes once: their pairs would grow with the
    square of the tables.
    """
    from isobath.operators.catalog import meeting

    days = [F.col("acquired") >= F.lit(first).cast("date")] * (first is not None) + [F.col("acquired") <= F.lit(last).cast("date")] * (last is not None)
    for day in days:
        scenes = scenes.filter(day)
    sides = [F.col(side).alias(name) for side, name in (("west", "xmin"), ("south", "ymin"), ("east", "xmax"), ("north", "ymax"))]
    boxes = scenes.filter(F.col("cloud_cover") < below).groupBy(*sides).agg(F.min(F.struct("cloud_cover", "scene_id")).alias("best"))
    asked = ["wxmin", "wymin", "wxmax", "wymax"]
    found = meeting(boxes, rois.select(*asked).distinct(), size=0.5).groupBy(*asked).agg(F.min("best").alias("best"))
    each = rois.select("roi_id", *asked).join(found, asked).groupBy("roi_id").agg(F.min("best").alias("best"))
    return each.select("roi_id", "best.scene_id", "best.cloud_cover")


def moving_stats_of(pixels: DataFrame, values: list[str], height: int, width: int) -> DataFrame:
    """(scene_id, r, c) with the mean and deviation of several columns over the 5 x 5 neighbourhood, in one pass a direction."""
    along = Window.partitionBy("scene_id", "r").orderBy("c").rowsBetween(-REACH, REACH)
    down = Window.partitionBy("scene_id", "c").orderBy("r").rowsBetween(-REACH, REACH)
    base = pixels.select("scene_id", "r", "c", *[F.col(v).cast("double").alias(v) for v in values])
    first = {k: x for v in values for k, x in ((f"{v}_s", F.avg(v).over(along)), (f"{v}_q", F.avg(F.col(v) * F.col(v)).over(along)))}
    wide = mirrored(base, "c", F.lit(width)).withColumns(first).filter(F.col("c").between(0, width - 1)).select("scene_id", "r", "c", *first)
    second = {k: F.avg(k).over(down) for k in first}
    tall = mirrored(wide, "r", F.lit(height)).withColumns({f"{k}_m": x for k, x in second.items()}).filter(F.col("r").between(0, height - 1))
    out = []
    for v in values:
        mean = F.col(f"{v}_s_m")
        out += [mean.alias(f"{v}_mean"), F.sqrt(F.greatest(F.col(f"{v}_q_m") - mean * mean, F.lit(0.0))).alias(f"{v}_std")]
    return tall.select("scene_id", "r", "c", *out)


def resample(pixels: DataFrame, band: str, height: int, width: int, out_height: int, out_width: int, nearest: bool = False) -> DataFrame:
    """(scene_id, r, c, value) of a band on another grid over the same bounds, bilinear between pixel centres or nearest.

    A target pixel joins its source rows and columns, four at most; at the border the edge pixel stands for what lies outside.
    """
    def axis(n: int, size: int) -> Column:
        at = (F.col("id") + 0.5) * (size / n) - 0.5
        low = F.floor(F.floor(at + 0.5) if nearest else at)
        share = F.lit(0.0) if nearest else at - low
        return F.filter(F.array(F.struct(low.alias("i"), (1 - share).alias("w")), F.struct((low + 1).alias("i"), (share + 0.0).alias("w"))), lambda x: x["w"] > 0)

    spark = pixels.sparkSession

    def steps(n: int, size: int, name: str, source: str) -> DataFrame:
        one = spark.range(n).select(F.col("id").alias(name), F.explode(axis(n, size)).alias("x"))
        return one.select(name, F.greatest(F.lit(0), F.least(F.lit(size - 1), F.col("x.i"))).alias(source), F.col("x.w").alias(f"w{name}"))

    # the two tables of steps hold one axis of the grids each
    rows, columns = steps(out_height, height, "tr", "r"), steps(out_width, width, "tc", "c")
    met = pixels.select("scene_id", "r", "c", F.col(band).cast("double").alias("v")).join(F.broadcast(rows), "r").join(F.broadcast(columns), "c")
    return met.groupBy("scene_id", F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum(F.col("v") * F.col("wtr") * F.col("wtc")).alias("value"))


def rgba(value: Column) -> Column:
    """(r, g, b, a) of a single band; nothing is transparent black."""
    return F.struct(*[F.coalesce(value, F.lit(0)).alias(c) for c in "rgb"], F.when(value.isNull(), 0).otherwise(255).alias("a"))


def padded(bands: Column) -> Column:
    """Red, green, blue and coverage of one to four bands; missing colours repeat, missing coverage is full."""
    n = F.size(bands)
    red = F.get(bands, 0)
    green = F.when(n >= 2, F.get(bands, 1)).otherwise(red)
    return F.when(n == 4, bands).otherwise(F.array(red, green, F.when(n >= 3, F.get(bands, 2)).otherwise(red), F.lit(65535)))
