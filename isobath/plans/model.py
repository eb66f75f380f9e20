"""Queries of the depth model, resampling and tile composition, with SQL where it can say them; tests hold the others against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobath.functions import depth as D
from isobath.functions import projection as P
from isobath.functions.keys import finite
from isobath.operators import model as M
from isobath.operators import raster as R
from isobath.operators import warp as W
from isobath.operators.steps import written
from isobath.plans.base import query, r6

B, G_, K_ = "(blue / 10000.0e0 + 1e-6)", "(green / 10000.0e0 + 1e-6)", "(coalesce(coastal, blue) / 10000.0e0 + 1e-6)"
RED = "(red / 10000.0e0 + 1e-6)"
SPM = "least(200e0, 366.14e0 * greatest(1e-6, least(0.17563e0, red / 10000.0e0)) / (1 - greatest(1e-6, least(0.17563e0, red / 10000.0e0)) / 0.19563e0))"


@query(
    "pixel_features",
    f"""SELECT scene_id, r, c, round(ln(1000 * {K_}) / ln(1000 * {G_} + 1e-6), 6) AS x_cg, round(ln({RED} / {G_} + 1e-6), 6) AS ln_rg, round({B} / {G_}, 6) AS b_g, round({K_} / {G_}, 6) AS c_g, round(log10({B} + {G_} + {K_} + 1e-6), 6) AS lum,
      round(coalesce(coastal, blue) / 10000.0e0 / (blue / 10000.0e0 + 1e-6), 6) AS clarity, round(ln(1 + {SPM}), 6) AS log_spm FROM pixels""",
    ("pixels",),
)
def _(t):
    df = R.indices(t("pixels"))
    return df.select("scene_id", "r", "c", *[r6(D.finite_or_zero(F.col(n)), n) for n in ("x_cg", "ln_rg", "b_g", "c_g", "lum", "clarity")], r6(F.log1p("spm"), "log_spm"))


@query("finite_values", "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0 ELSE value END AS filled FROM events")
def _(t):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 3, F.col("value")).when(k == 4, F.col("value"))
    df = t("events").withColumn("x", raw)
    return df.select("event_id", finite(F.col("x")).alias("value"), D.finite_or_zero(F.col("x")).alias("filled"))


DEPTH_SQL = "(SELECT scene_id, r, c, d, s, greatest(0e0, least(25e0, 0.384e0 + 0.9793e0 * d)) AS depth, greatest(0.1e0, least(10e0, s + 0.1e0)) AS sigma FROM (SELECT scene_id, r, c, CAST((r * 37 + c * 11) % 30 AS DOUBLE) - 2 AS d, CAST((r + c) % 13 AS DOUBLE) AS s FROM pixels))"


@query("calibrated_depth", f"SELECT scene_id, r, c, round(depth, 6) AS depth, round(sigma, 6) AS sigma, round(greatest(0e0, least(25e0, depth - 1.96e0 * sigma)), 6) AS lower, round(greatest(0e0, least(25e0, depth + 1.96e0 * sigma)), 6) AS upper, round(greatest(0e0, least(1e0, depth / 25)), 6) AS share FROM {DEPTH_SQL}", ("pixels",))
def _(t):
    p = t("pixels").select("scene_id", "r", "c", (((F.col("r") * 37 + F.col("c") * 11) % 30).cast("double") - 2).alias("mean"), ((F.col("r") + F.col("c")) % 13).cast("double").alias("std"), F.lit(0.0).alias("spm"))
    df = M.finish(p, F.lit(0.384), F.lit(0.9793))
    return df.select("scene_id", "r", "c", *[r6(F.col(n), n) for n in ("depth", "sigma", "lower", "upper")], r6(D.clip(F.col("depth") / D.MAX_DEPTH, 0.0, 1.0), "share"))


#: Pixels a side of the blocks of the scenes here, which have 32.
SIZE = 16


@query("feature_stack_v1")
def _(t):
    return M.block_features(t("pixel_blocks"), SIZE).select("scene_id", "r", "c", *M.STACK)


@query("bottom_types")
def _(t):
    blocks = t("pixel_blocks")
    return M.bottom_types(blocks, M.scene_centres(blocks, size=SIZE), SIZE).groupBy("scene_id", "bottom").agg(F.count("*").alias("n"))


@query("feature_stack_v2")
def _(t):
    blocks = t("pixel_blocks")
    return M.block_features(blocks, SIZE, M.scene_centres(blocks, size=SIZE)).select("scene_id", "r", "c", *M.STACK, *M.TURBID)


@query("model_depth")
def _(t):
    return M.predict(t("pixel_blocks"), M.synthetic_bundle(1), size=SIZE).drop("spm")


@query("model_depth_v2")
def _(t):
    return M.predict(t("pixel_blocks"), M.synthetic_bundle(2), size=SIZE).drop("spm")


@query("model_depth_calibrated")
def _(t):
    return M.predict(t("pixel_blocks"), M.synthetic_bundle(1), R.sounding_cells(t("soundings")), size=SIZE).drop("spm")


@query("survey_payload")
def _(t):
    pixels = t("pixels")
    depth = R.surrogate_depth(pixels)
    pairs = depth.filter("depth IS NOT NULL").join(R.sounding_cells(t("soundings")), ["scene_id", "r", "c"])
    return M.payload(depth, t("scenes"), R.compliance(pairs))


def _tuned(t):
    return M.fine_tune(M.block_features(t("pixel_blocks"), SIZE), R.sounding_cells(t("soundings")), M.synthetic_bundle(1))


@query("fine_tuned_rmse")
def _(t):
    return _tuned(t).drop("weights")


@query("model_depth_tuned")
def _(t):
    tuned = written(_tuned(t).select("scene_id", "weights"), "tuned")
    return M.predict(t("pixel_blocks"), M.synthetic_bundle(1), size=SIZE, tuned=tuned).drop("spm")


@query("active_models", "SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'depth-v2' ELSE 'depth-v1' END, 'depth-v3') AS model, CASE WHEN id % 3 = 1 THEN '2.0' END AS version, CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END AS stack FROM user_groups", ("user_groups",))
def _(t):
    k = F.col("id") % 3
    asked = F.when(k == 1, "depth-v2").when(k == 2, "depth-v1")
    stacks = {n: "v2" if n >= 22 else "v1" for n in (16, 23)}
    inputs = F.when(F.col("id") % 2 == 0, 23).otherwise(16)
    stack = F.element_at(F.create_map(*[x for n, v in stacks.items() for x in (F.lit(n), F.lit(v))]), inputs)
    return t("user_groups").select("id", F.coalesce(asked, F.lit(M.DEFAULT_MODEL)).alias("model"), F.when(k == 1, "2.0").alias("version"), stack.alias("stack"))


def _axis_sql(n: int, size: int) -> str:
    at = f"((i + 0.5e0) * {size / n!r}e0 - 0.5e0)"
    return f"(SELECT i AS t, CAST(greatest(0, least({size - 1}, floor({at}) + k)) AS BIGINT) AS s, CASE k WHEN 0 THEN 1 - ({at} - floor({at})) ELSE {at} - floor({at}) END AS w FROM (SELECT unnest(generate_series(0, {n - 1})) AS i), (SELECT unnest([0, 1]) AS k))"


@query("warped_band", f"SELECT p.scene_id, a.t AS r, b.t AS c, round(sum(blue * a.w * b.w), 6) AS value FROM pixels p JOIN {_axis_sql(20, 32)} a ON a.s = p.r JOIN {_axis_sql(48, 32)} b ON b.s = p.c WHERE a.w > 0 AND b.w > 0 GROUP BY ALL", ("pixels",))
def _(t):
    return R.resample(t("pixels"), "blue", 32, 32, 20, 48).select("scene_id", "r", "c", r6(F.col("value"), "value"))


@query("warped_classes", "SELECT p.scene_id, a.i AS r, b.i AS c, CAST(scl AS DOUBLE) AS value FROM pixels p JOIN (SELECT unnest(generate_series(0, 15)) AS i) a ON CAST(floor((a.i + 0.5e0) * 2) AS BIGINT) = p.r JOIN (SELECT unnest(generate_series(0, 15)) AS i) b ON CAST(floor((b.i + 0.5e0) * 2) AS BIGINT) = p.c", ("pixels",))
def _(t):
    return R.resample(t("pixels"), "scl", 32, 32, 16, 16, nearest=True)


def _sums_sql(factors: list[float], x: str, y: str) -> tuple[str, str]:
    """The series of functions.projection in SQL."""
    along = " + ".join(f"{a!r} * sin({2 * j + 2} * {x}) * cosh({2 * j + 2} * {y})" for j, a in enumerate(factors))
    across = " + ".join(f"{a!r} * cos({2 * j + 2} * {x}) * sinh({2 * j + 2} * {y})" for j, a in enumerate(factors))
    return along, across


def to_utm_sql(rows: str, lon: str, lat: str, zone: str, north: str) -> str:
    """A subquery of rows with e and n, the coordinates of (lon, lat) in a zone."""
    along, across = _sums_sql(P.ALPHA, "xi", "eta")
    return f"""(SELECT *, 500000 + 0.9996e0 * {P.RADIUS!r} * (eta + {across}) AS e, (1 - {north}) * 10000000e0 + 0.9996e0 * {P.RADIUS!r} * (xi + {along}) AS n FROM (
      SELECT *, atan2(tc, cos(dl)) AS xi, asinh(sin(dl) / sqrt(tc * tc + cos(dl) * cos(dl))) AS eta FROM (
        SELECT *, sinh(atanh(sin(radians({lat}))) - {P._E!r} * atanh({P._E!r} * sin(radians({lat})))) AS tc, radians({lon} - ({zone} * 6 - 183)) AS dl FROM {rows})))"""


def from_utm_sql(rows: str, e: str, n: str, zone: str, north: str) -> str:
    """A subquery of rows with lon and lat, the degrees of a place of a zone."""
    along, across = _sums_sql(P.BETA, "xi", "eta")
    s = "sin(xj) / cosh(ej)"
    for _ in range(7):
        s = f"tanh(atanh(sin(xj) / cosh(ej)) + {P._E!r} * atanh({P._E!r} * {s}))"
    return f"""(SELECT *, degrees(atan2(sinh(ej), cos(xj))) + ({zone} * 6 - 183) AS lon, degrees(asin({s})) AS lat FROM (
      SELECT *, xi - ({along}) AS xj, eta - ({across}) AS ej FROM (
        SELECT *, ({n} - (1 - {north}) * 10000000e0) / (0.9996e0 * {P.RADIUS!r}) AS xi, ({e} - 500000) / (0.9996e0 * {P.RADIUS!r}) AS eta FROM {rows})))"""


ZONES_SQL = "(SELECT id, lon AS lon0, lat AS lat0, least(60, CAST(floor((lon + 180) / 6) AS INT) + 1) AS zone, CASE WHEN lat >= 0 THEN 1 ELSE 0 END AS north FROM reports WHERE abs(lat) <= 84)"


@query("utm_places", f"SELECT id, CASE WHEN north = 1 THEN 32600 + zone ELSE 32700 + zone END AS epsg, round(e, 3) AS east, round(n, 3) AS north_m FROM {to_utm_sql(ZONES_SQL, 'lon0', 'lat0', 'zone', 'north')}", ("reports",))
def _(t):
    places = t("reports").filter("abs(lat) <= 84").withColumn("zone", P.zone_of(F.col("lon"))).withColumn("north", F.when(F.col("lat") >= 0, 1).otherwise(0))
    east, north = P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    return places.select("id", P.utm_code(F.col("zone"), F.col("north")).alias("epsg"), F.round(east, 3).alias("east"), F.round(north, 3).alias("north_m"))


@query("utm_round_trip", "SELECT id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM reports WHERE abs(lat) <= 84", ("reports",))
def _(t):
    places = t("reports").filter("abs(lat) <= 84").withColumn("zone", P.zone_of(F.col("lon"))).withColumn("north", F.when(F.col("lat") >= 0, 1).otherwise(0))
    east, north = P.to_utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("north"))
    placed = places.select("id", "zone", "north", east.alias("e"), north.alias("n"))
    lon, lat = P.from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("north"))
    # adding nothing turns a rounded minus zero into zero
    return placed.select("id", (F.round(lon, 8) + 0.0).alias("lon"), (F.round(lat, 8) + 0.0).alias("lat"))


#: The scenes' samples as if they lay in zone 39 of the northern UTM grid, ten metres a pixel.
UTM_WEST, UTM_NORTH = "300000 + 3200 * (scene_id % 40)", "2500000 + 3200 * (scene_id % 24)"
_CENTRES_SQL = from_utm_sql("scenes", f"({UTM_WEST} + 160)", f"({UTM_NORTH} - 160)", "39", "1")
_TARGET_SQL = f"(SELECT scene_id, r, c, lon - 0.002e0 + (c + 0.5e0) * 0.0001e0 AS plon, lat + 0.002e0 - (r + 0.5e0) * 0.0001e0 AS plat FROM {_CENTRES_SQL}, (SELECT unnest(range(40)) AS r), (SELECT unnest(range(40)) AS c))"


@query(
    "warped_utm",
    f"""SELECT t.scene_id, t.r, t.c, round(sum(p.green * w) / sum(w), 1) AS value FROM (
      SELECT scene_id, r, c, fi + a AS pr, fj + b AS pc, abs(1 - a - (fr - fi)) * abs(1 - b - (fc - fj)) AS w FROM (
        SELECT *, CAST(floor(fr) AS BIGINT) AS fi, CAST(floor(fc) AS BIGINT) AS fj FROM (SELECT *, ({UTM_NORTH} - n) / 10 - 0.5e0 AS fr, (e - ({UTM_WEST})) / 10 - 0.5e0 AS fc FROM {to_utm_sql(_TARGET_SQL, 'plon', 'plat', '39', '1')})
        WHERE fr >= -0.5e0 AND fr < 31.5e0 AND fc >= -0.5e0 AND fc < 31.5e0), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)) t
      JOIN pixels p ON p.scene_id = t.scene_id AND p.r = t.pr AND p.c = t.pc WHERE w > 0 GROUP BY ALL""",
    ("scenes", "pixels"),
)
def _(t):
    scenes = t("scenes").select("scene_id", F.expr(UTM_WEST).cast("double").alias("west"), F.expr(UTM_NORTH).cast("double").alias("top"))
    sources = scenes.select("scene_id", F.lit(32639).alias("epsg"), F.col("west").alias("x0"), F.col("top").alias("y0"), F.lit(10.0).alias("dx"), F.lit(-10.0).alias("dy"), F.lit(32).alias("height"), F.lit(32).alias("width"))
    lon, lat = P.from_utm(F.col("west") + 160, F.col("top") - 160, F.lit(39), F.lit(1))
    targets = scenes.select("scene_id", F.lit(4326).alias("epsg"), (lon - 0.002).alias("x0"), (lat + 0.002).alias("y0"), F.lit(0.0001).alias("dx"), F.lit(-0.0001).alias("dy"), F.lit(40).alias("height"), F.lit(40).alias("width"))
    out = W.warped_rows(W.warp(t("pixel_blocks"), sources, targets, "green", SIZE, SIZE), SIZE)
    return out.select("scene_id", "r", "c", F.round("value", 1).alias("value"))


ORIGIN, SIDE = "20037508.342789244e0", "(40075016.685578488e0 / 256)"
COMPOSITE_SQL = f"""(SELECT x, y, pr, pc, arg_max(v, acquired * 1000000 + scene_id) AS value FROM (SELECT g.x, g.y, g.pr, g.pc, s.scene_id, datediff('day', DATE '2024-01-01', s.acquired) AS acquired,
  CAST(CASE WHEN s.scene_id % 4 = 0 THEN greatest(0, least(255, p.red)) ELSE floor(greatest(0e0, least(255e0, (p.red - 100) / 900.0e0 * 255))) END AS INT) AS v FROM (
    SELECT x, y, pr, pc, (x * {SIDE} - {ORIGIN} + (pc + 0.5e0) * {SIDE} / 8) / {ORIGIN} * 180 AS lon, degrees(2 * atan(exp(({ORIGIN} - y * {SIDE} - (pr + 0.5e0) * {SIDE} / 8) / {ORIGIN} * pi())) - pi() / 2) AS lat
    FROM scene_tiles, (SELECT unnest(generate_series(0, 7)) AS pr), (SELECT unnest(generate_series(0, 7)) AS pc)) g
  JOIN scenes s ON lon >= west AND lon < east AND lat > south AND lat <= north
  JOIN pixels p ON p.scene_id = s.scene_id AND p.r = CAST(floor((north - lat) / (north - south) * 32) AS BIGINT) AND p.c = CAST(floor((lon - west) / (east - west) * 32) AS BIGINT)) GROUP BY x, y, pr, pc)"""


def _composite(t):
    scenes = t("scenes").withColumn("bit_depth", F.when(F.col("scene_id") % 4 == 0, 8).otherwise(16))
    return W.composite(t("scene_tiles"), scenes, t("pixel_blocks"), "red", 100.0, 1000.0, 8, SIZE)


@query("tile_composite", f"SELECT x, y, pr, pc, value AS r, value AS g, value AS b, 255 AS a FROM {COMPOSITE_SQL}", ("scene_tiles", "scenes", "pixels"))
def _(t):
    return _composite(t).select("x", "y", "pr", "pc", R.rgba(F.col("value")).alias("p")).select("x", "y", "pr", "pc", "p.*")


@query("empty_tiles", f"SELECT t.x, t.y, count(c.value) AS covered, count(c.value) = 0 AS empty FROM scene_tiles t LEFT JOIN {COMPOSITE_SQL} c ON c.x = t.x AND c.y = t.y GROUP BY t.x, t.y", ("scene_tiles", "scenes", "pixels"))
def _(t):
    covered = _composite(t).groupBy("z", "x", "y").agg(F.count("value").alias("covered"))
    found = t("scene_tiles").join(covered, ["z", "x", "y"], "left").select("x", "y", F.coalesce("covered", F.lit(0)).alias("covered"))
    return found.withColumn("empty", F.col("covered") == 0)


@query("padded_bands", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1,1,1,65535' WHEN 1 THEN '1,2,1,65535' WHEN 2 THEN '1,2,3,65535' ELSE '1,2,3,4' END AS bands FROM events")
def _(t):
    bands = F.slice(F.array(*map(F.lit, (1, 2, 3, 4))), 1, (F.col("event_id") % 4 + 1).cast("int"))
    return t("events").select("event_id", F.array_join(R.padded(bands).cast("array<string>"), ",").alias("bands"))


@query("derived_products", "SELECT id FROM raster_catalog WHERE processing_status = 'ready' AND coalesce(source_kind, '') <> 'bathymetry'", ("raster_catalog",))
def _(t):
    # what is itself a product of a survey starts no survey
    return t("raster_catalog").filter("processing_status = 'ready'").filter(F.coalesce("source_kind", F.lit("")) != "bathymetry").select("id")


@query("scene_thumbnails", "SELECT scene_id, r // 8 AS br, c // 8 AS bc, round(avg(red), 6) AS value FROM pixels GROUP BY ALL", ("pixels",))
def _(t):
    return R.block_mean(t("pixels").select("scene_id", "r", "c", F.col("red").alias("depth")), 32, 32, 4, 6).withColumnRenamed("depth", "value")
