"""Rasters on other grids: warps between projections and tile pictures, gathered from blocks.

A target block asks, pixel by pixel, which source blocks hold its samples; these
requests, a few numbers each, are sent to the source blocks, which answer with
their share.  Shares add up (a warp) or are painted over one another (a picture).
Samples never leave as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions.projection import MERCATOR_LIMIT, project, unproject
from isobath.operators import blocks as B
from isobath.operators.steps import dealt

#: Pictures that one task paints over one another at once.
PAINTED = 64
#: A grid: its projection, the outer corner of its first pixel, the steps to the next column and row, its size.
GRID = ["epsg", "x0", "y0", "dx", "dy", "height", "width"]


def _source_places(target: dict, source: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the source, in pixels from its first pixel's centre, of each pixel centre of a target block."""
    top, left = target["tbr"] * size, target["tbc"] * size
    high, wide = min(size, target["height"] - top), min(size, target["width"] - left)
    x = target["x0"] + (left + np.arange(wide) + 0.5) * target["dx"]
    y = target["y0"] + (top + np.arange(high) + 0.5) * target["dy"]
    x, y = np.broadcast_to(x, (high, wide)), np.broadcast_to(y[:, None], (high, wide))
    if target["epsg"] != source["epsg"]:
        x, y = project(source["epsg"], *unproject(target["epsg"], x, y))
    return (y - source["y0"]) / source["dy"] - 0.5, (x - source["x0"]) / source["dx"] - 0.5


def _neighbours(r: np.ndarray, c: np.ndarray, height: int, width: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, weight) of the source pixels that a place takes its value from; weight 0 outside of the source."""
    inside = (r >= -0.5) & (r < height - 0.5) & (c >= -0.5) & (c < width - 0.5)
    if nearest:
        yield np.floor(r + 0.5).astype(np.int64), np.floor(c + 0.5).astype(np.int64), inside.astype(float)
        return
    i, j = np.floor(r), np.floor(c)
    for a in (0, 1):
        for b in (0, 1):
            y, x = (i + a).astype(np.int64), (j + b).astype(np.int64)
            w = np.abs(1 - a - (r - i)) * np.abs(1 - b - (c - j))
            yield y, x, np.where(inside & (y >= 0) & (y < height) & (x >= 0) & (x < width), w, 0.0)


def _grids(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("scene_id", F.struct(*[F.col(g) for g in GRID]).alias(prefix))


def warp(blocks: DataFrame, sources: DataFrame, targets: DataFrame, band: str, size: int = B.SIZE, out_size: int = B.SIZE, nearest: bool = False) -> DataFrame:
    """(scene_id, tbr, tbc, height, width, value array<double>): a band of scenes on other grids, as blocks of out_size a side.

    sources and targets are (scene_id and GRID), one grid a scene each.  A target
    pixel takes the bilinear mean of the four source pixels around its centre, or
    the nearest one; samples that are missing or beyond the source's edge have no
    weight, and a target pixel whose centre lies outside of the source is NaN.
    Only requests and answers are shuffled where blocks are dealt out by their
    keys.  A target block has as many answers as source blocks that it meets: a
    much coarser target should start from an overview.
    """
    scene = blocks.schema["scene_id"].dataType.simpleString()
    pair = _grids(targets, "target").join(_grids(sources, "source"), "scene_id")
    every = pair.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("target.height") - 1) / out_size).cast("int"))).alias("tbr"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("target.width") - 1) / out_size).cast("int"))).alias("tbc"))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, br, bc = [], [], []
            for i, row in enumerate(B.rows_of([batch])):
                target, source = row["target"] | row, row["source"]
                r, c = _source_places(target, source, out_size)
                found = [np.unique(np.stack([y[w > 0] // size, x[w > 0] // size], 1), axis=0) for y, x, w in _neighbours(r, c, source["height"], source["width"], nearest)]
                for y, x in np.unique(np.concatenate(found), axis=0).tolist():
                    at.append(i)
                    br.append(y)
                    bc.append(x)
            out = pa.Table.from_batches([batch]).take(pa.array(at, pa.int64()))
            out = out.append_column("br", pa.array(br, pa.int32())).append_column("bc", pa.array(bc, pa.int32()))
            yield from out.to_batches()

    grid = "struct<epsg:int,x0:double,y0:double,dx:double,dy:double,height:int,width:int>"
    asked = dealt(every, "scene_id", "tbr", "tbc").select("scene_id", F.col("target").cast(grid).alias("target"), F.col("source").cast(grid).alias("source"), "tbr", "tbc")
    asked = asked.mapInArrow(need, f"scene_id {scene}, target {grid}, source {grid}, tbr int, tbc int, br int, bc int")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            b, target = B.Block(row, [band], size), row["target"] | row
            target["height"], target["width"] = row["target"]["height"], row["target"]["width"]
            r, c = _source_places(target, row["source"], out_size)
            total, weight, held = np.zeros(r.shape), np.zeros(r.shape), b.bands[band]
            for y, x, w in _neighbours(r, c, row["source"]["height"], row["source"]["width"], nearest):
                y, x = y - b.top, x - b.left
                own = (w > 0) & (y >= 0) & (y < b.high) & (x >= 0) & (x < b.wide)
                v = held[np.where(own, y, 0), np.where(own, x, 0)]
                w = np.where(own & np.isfinite(v), w, 0.0)
                total += np.where(w > 0, v * w, 0.0)
                weight += w
            columns = {"scene_id": [b.scene], "tbr": [row["tbr"]], "tbc": [row["tbc"]], "height": [target["height"]], "width": [target["width"]], "total": [total.ravel()], "weight": [weight.ravel()]}
            yield pa.RecordBatch.from_pydict(columns, schema=kinds)

    kinds = pa.schema([("scene_id", {"bigint": pa.int64(), "int": pa.int32()}.get(scene, pa.string())), *((n, pa.int32()) for n in ("tbr", "tbc", "height", "width")), ("total", pa.list_(pa.float64())), ("weight", pa.list_(pa.float64()))])
    met = blocks.select(*B.KEYS, "height", "width", band).join(asked.hint("shuffle_hash"), B.KEYS)
    shares = met.mapInArrow(answer, f"scene_id {scene}, tbr int, tbc int, height int, width int, total array<double>, weight array<double>")

    def add(rows: pa.Table) -> pa.Table:
        total, weight = (sum(x.values.to_numpy() for x in rows[n]) for n in ("total", "weight"))
        with np.errstate(all="ignore"):
            value = np.where(weight > 0, total / weight, np.nan)
        return rows.slice(0, 1).select(["scene_id", "tbr", "tbc", "height", "width"]).append_column("value", pa.array([value], pa.list_(pa.float64())))

    return shares.groupBy("scene_id", "tbr", "tbc").applyInArrow(add, f"scene_id {scene}, tbr int, tbc int, height int, width int, value array<double>")


def warped_rows(warped: DataFrame, out_size: int = B.SIZE) -> DataFrame:
    """(scene_id, r, c, value) of the pixels of warp() that have a value."""
    wide = F.least(F.lit(out_size), F.col("width") - F.col("tbc") * out_size)
    rows = warped.select("scene_id", "tbr", "tbc", wide.alias("w"), F.posexplode("value").alias("i", "value"))
    at = (F.col("tbr") * out_size + F.floor(F.col("i") / F.col("w"))).cast("long"), (F.col("tbc") * out_size + F.col("i") % F.col("w")).cast("long")
    return rows.filter(~F.isnan("value")).select("scene_id", at[0].alias("r"), at[1].alias("c"), "value")


def composite(tiles: DataFrame, scenes: DataFrame, blocks: DataFrame, band: str, low: float, high: float, picture: int = 256, size: int = B.SIZE) -> DataFrame:
    """(z, x, y, pr, pc, value) of tile pixels that a scene covers, stretched to a byte; later scenes paint over earlier ones, those without a date over all.

    tiles is (z, x, y); scenes has bounds in degrees, width, height, acquired and
    bit_depth, of which 8 leaves values as they are; blocks are theirs.  A missing
    sample paints nothing.  A tile's pictures are painted PAINTED at a time, in
    as many levels as the tile with most scenes needs.
    """
    from isobath.operators.catalog import meeting, tile_boxes

    boxes = scenes.withColumnsRenamed({"west": "xmin", "south": "ymin", "east": "xmax", "north": "ymax"})
    pairs = meeting(boxes, tile_boxes(tiles), size=0.5)
    last = Window.partitionBy("z", "x", "y").orderBy(F.col("acquired").isNull(), "acquired", "scene_id")  # names of scenes alone
    pairs = pairs.withColumn("rank", F.row_number().over(last) - 1).select("scene_id", "z", "x", "y", "rank", F.col("bit_depth").cast("int").alias("bits"), "xmin", "ymin", "xmax", "ymax", F.col("height").cast("int").alias("h"), F.col("width").cast("int").alias("w"))

    def places(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the picture, row, column of the scene) of the pixels inside of the scene."""
        side = 2 * MERCATOR_LIMIT / 2 ** row["z"]
        step = (np.arange(picture) + 0.5) * side / picture
        lon, lat = unproject(3857, row["x"] * side - MERCATOR_LIMIT + step[None, :], MERCATOR_LIMIT - row["y"] * side - step[:, None])
        r = np.floor((row["ymax"] - lat) / (row["ymax"] - row["ymin"]) * row["h"]).astype(np.int64)[:, 0]
        c = np.floor((lon - row["xmin"]) / (row["xmax"] - row["xmin"]) * row["w"]).astype(np.int64)[0]
        inside = ((r >= 0) & (r < row["h"]))[:, None] & ((c >= 0) & (c < row["w"]))[None, :]
        at = np.flatnonzero(inside)
        return at, r[at // picture], c[at % picture]

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, br, bc = [], [], []
            for i, row in enumerate(B.rows_of([batch])):
                _, r, c = places(row)
                for y, x in np.unique(np.stack([r // size, c // size], 1), axis=0).tolist():
                    at.append(i)
                    br.append(y)
                    bc.append(x)
            out = pa.Table.from_batches([batch]).take(pa.array(at, pa.int64()))
            yield from out.append_column("br", pa.array(br, pa.int32())).append_column("bc", pa.array(bc, pa.int32())).to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    asked = pairs.mapInArrow(need, f"{fields}, br int, bc int")

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            b = B.Block(row, [band], size)
            at, r, c = places(row)
            r, c = r - b.top, c - b.left
            own = (r >= 0) & (r < b.high) & (c >= 0) & (c < b.wide)
            at, v = at[own], b.bands[band][r[own], c[own]]
            at, v = at[seen := np.isfinite(v)], v[seen]
            v = np.trunc(np.clip(v, 0, 255)) if row["bits"] == 8 else np.floor(np.clip((v - low) / (high - low) * 255, 0, 255))
            yield pa.RecordBatch.from_pydict({"z": [row["z"]], "x": [row["x"]], "y": [row["y"]], "rank": [row["rank"]], "at": [at], "value": [v.astype(np.uint8).tobytes()]}, schema=drawn)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    drawn = pa.schema([*((n, {"bigint": pa.int64(), "int": pa.int32()}[kinds[n]]) for n in ("z", "x", "y", "rank")), ("at", pa.list_(pa.int32())), ("value", pa.binary())])
    shape = f"z {kinds['z']}, x {kinds['x']}, y {kinds['y']}, rank {kinds['rank']}, at array<int>, value binary"
    parts = blocks.select(*B.KEYS, "height", "width", band).join(asked.hint("shuffle_hash"), B.KEYS).mapInArrow(paint, shape)

    def over(rows: pa.Table) -> pa.Table:
        out, seen = np.zeros(picture * picture, np.uint8), np.zeros(picture * picture, bool)
        for i in np.argsort(rows["rank"].to_numpy(), kind="stable").tolist():
            at = rows["at"][i].values.to_numpy()
            out[at], seen[at] = np.frombuffer(rows["value"][i].as_py(), np.uint8), True
        at = np.flatnonzero(seen)
        first = rows.slice(0, 1)
        return pa.table({**{n: first[n] for n in ("z", "x", "y")}, "rank": pa.array([int(rows["rank"][0].as_py()) // PAINTED], drawn.field("rank").type), "at": pa.array([at], pa.list_(pa.int32())), "value": pa.array([out[at].tobytes()], pa.binary())})

    most = pairs.agg(F.max("rank")).first()[0] or 0
    while True:
        parts = parts.groupBy("z", "x", "y", F.floor(F.col("rank") / PAINTED).alias("level")).applyInArrow(over, shape)
        if most < PAINTED:
            break
        most //= PAINTED

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows_of(batches):
            at, n = np.array(row["at"], np.int64), len(row["at"])
            columns = [pa.array([row[k]] * n, drawn.field(k).type) for k in ("z", "x", "y")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at // picture), pa.array(at % picture), pa.array(np.frombuffer(row["value"], np.uint8).astype(np.int32))], ["z", "x", "y", "pr", "pc", "value"])

    return parts.mapInArrow(spread, f"z {kinds['z']}, x {kinds['x']}, y {kinds['y']}, pr long, pc long, value int")
