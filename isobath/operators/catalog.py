"""Catalogue search, area access control, paging, tiles and time series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobath.functions.geo import cells, overlaps, tile_lonlat

#: Side of the grid cells by which rectangles meet, in degrees.
CELL = 2.0
RANKS = {"view": 0, "download": 1, "manage": 2}


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """df under the conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def search_rasters(catalog: DataFrame, bbox=None, date_from=None, date_to=None, tags=None, text: str | None = None, status: str | None = None, max_zoom: int | None = None) -> DataFrame:
    """Rasters under every filter that is given; rows without the filtered value drop.

    text is a pattern in which % and _ keep their meaning; a raster without a
    lowest zoom passes every zoom.
    """
    pattern = f"%{text}%" if text is not None else None
    return where(
        catalog,
        overlaps(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], *bbox) if bbox else None,
        F.col("acquisition_date") >= F.lit(date_from) if date_from else None,
        F.col("acquisition_date") <= F.lit(date_to) if date_to else None,
        F.arrays_overlap(F.array("tag1", "tag2"), F.array(*map(F.lit, tags))) if tags else None,
        F.col("name").ilike(pattern) | F.col("description").ilike(pattern) if pattern else None,
        F.col("processing_status") == status if status else None,
        F.col("min_zoom").isNull() | (F.col("min_zoom") <= max_zoom) if max_zoom is not None else None,
    )


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list; order must end with a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def rank_of(level: Column) -> Column:
    """The rank of an access level; unknown levels rank lowest."""
    known = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, level), F.lit(0))


def meeting(left: DataFrame, right: DataFrame, how: str = "inner", size: float = CELL) -> DataFrame:
    """Pairs of rectangles that share a point, joined on grid cells instead of by comparing all pairs.

    left has xmin .. ymax, right has wxmin .. wymax.  Each pair is found in the one
    cell that holds the lower left corner of its intersection, so none repeats.
    For left_semi every cell may find it.
    """
    def spread(df: DataFrame, p: str) -> DataFrame:
        known = df.filter(F.col(f"{p}xmin").isNotNull())
        wide = known.withColumn(f"{p}cx", F.explode(cells(F.col(f"{p}xmin"), F.col(f"{p}xmax"), size)))
        return wide.withColumn(f"{p}cy", F.explode(cells(F.col(f"{p}ymin"), F.col(f"{p}ymax"), size)))

    a, b = spread(left, ""), spread(right, "w")
    same = (F.col("cx") == F.col("wcx")) & (F.col("cy") == F.col("wcy"))
    touch = overlaps(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], *[F.col(c) for c in ("wxmin", "wymin", "wxmax", "wymax")])
    if how == "left_semi":
        return a.join(b, same & touch, "left_semi").drop("cx", "cy").distinct()
    first = (F.col("cx") == F.floor(F.greatest("xmin", "wxmin") / size)) & (F.col("cy") == F.floor(F.greatest("ymin", "wymin") / size))
    return a.join(b, same & touch & first).drop("cx", "cy", "wcx", "wcy")


def user_areas(areas: DataFrame, members: DataFrame) -> DataFrame:
    """(user_id, area columns) of all areas that a user's groups open."""
    return members.join(areas, "group_id")


def visible(catalog: DataFrame, areas: DataFrame, members: DataFrame, user_id: int, role: str = "viewer") -> DataFrame:
    """The rasters that a user may list: an administrator all, others those that meet any of the user's areas."""
    if role == "admin":
        return catalog
    own = user_areas(areas, members).filter(F.col("user_id") == user_id)
    return meeting(catalog, own.select(*[F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), "left_semi")


def group_access(catalog: DataFrame, areas: DataFrame, level: str) -> DataFrame:
    """(group_id, id) of each group and raster for which an area of at least that level meets the raster."""
    able = areas.filter(rank_of(F.col("access_level")) >= RANKS.get(level, 0))
    able = able.select("group_id", *[F.col(c).alias(f"w{c}") for c in ("xmin", "ymin", "xmax", "ymax")]).distinct()
    return meeting(catalog, able).select("group_id", "id").distinct()


def access(catalog: DataFrame, areas: DataFrame, members: DataFrame, level: str) -> DataFrame:
    """(user_id, id) of each given user and raster that one of the user's groups opens at that level."""
    own = areas.join(members, "group_id", "left_semi")
    return group_access(catalog, own, level).join(members, "group_id").select("user_id", "id").distinct()


def tile_boxes(tiles: DataFrame, low: int = 3, high: int = 20) -> DataFrame:
    """tiles in the served zooms with their rectangles as wxmin .. wymax."""
    west, south, east, north = tile_lonlat(F.col("z"), F.col("x"), F.col("y"))
    return tiles.filter(F.col("z").between(low, high)).select("z", "x", "y", west.alias("wxmin"), south.alias("wymin"), east.alias("wxmax"), north.alias("wymax"))


def tile_rasters(tiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """(z, x, y and the catalogue's columns) of the ready rasters of each tile.

    Tiles meet rasters in grid cells that fit the tile, so that the tiles of a deep
    zoom do not all share a cell with every raster around: a tile names the cell of
    its zoom, a raster the cells of all zooms asked for that it touches, and past
    zoom 8 the cells stay those of zoom 8.
    """
    ready = catalog.filter("processing_status = 'ready' AND xmin IS NOT NULL")
    boxes = tile_boxes(tiles).withColumn("level", F.least("z", F.lit(8)))
    side = 360.0 / F.pow(F.lit(2.0), F.col("level"))
    # a closed tile touches the neighbouring cells at its borders
    def span(low: str, high: str) -> Column:
        return F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side))

    b = boxes.withColumn("cx", F.explode(span("wxmin", "wxmax"))).withColumn("cy", F.explode(span("wymin", "wymax")))
    levels = boxes.select("level").distinct()  # six at most
    a = ready.join(F.broadcast(levels)).filter(F.col("min_zoom").isNull() | (F.col("level") == 8) | (F.col("min_zoom") <= F.col("level")))
    a = a.withColumn("cx", F.explode(span("xmin", "xmax"))).withColumn("cy", F.explode(span("ymin", "ymax")))
    touch = overlaps(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")], *[F.col(c) for c in ("wxmin", "wymin", "wxmax", "wymax")])
    first = (F.col("cx") == F.floor(F.greatest("xmin", "wxmin") / side)) & (F.col("cy") == F.floor(F.greatest("ymin", "wymin") / side))
    pairs = a.join(b, ["level", "cx", "cy"]).filter(touch & first & (F.col("min_zoom").isNull() | (F.col("min_zoom") <= F.col("z"))))
    return pairs.select("z", "x", "y", *catalog.columns)


def tile_members(tiles: DataFrame, catalog: DataFrame) -> DataFrame:
    """(z, x, y, id, paint) of the ready rasters of each tile; later dates paint over earlier ones, undated ones last of all."""
    order = Window.partitionBy("z", "x", "y").orderBy(F.asc_nulls_last("acquisition_date"), "id")
    return tile_rasters(tiles, catalog).select("z", "x", "y", "id", F.row_number().over(order).alias("paint"))


def tile_keys(tiles: DataFrame, catalog: DataFrame, cutoff: Column | None = None, exact: Column | None = None) -> DataFrame:
    """(z, x, y, key) of each tile: its place, the date filter and a digest of the rasters that it shows with their last change.

    A cutoff adds the latest date shown, since a raster that comes late may change what the same cutoff shows.
    """
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    shown = tile_rasters(tiles, catalog).select("z", "x", "y", "acquisition_date", F.concat_ws(":", F.col("id").cast("string"), F.date_format("updated_at", iso)).alias("item"))
    # a tile's list is what the tile shows
    found = tiles.join(shown.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list("item")).alias("items"), F.max("acquisition_date").alias("latest")), ["z", "x", "y"], "left")
    digest = F.when(F.col("items").isNull(), F.lit("0" * 12)).otherwise(F.substring(F.sha1(F.array_join("items", ",")), 1, 12))
    if exact is not None:
        day = F.date_format(exact, "yyyy-MM-dd")
    elif cutoff is not None:
        day = F.concat(F.lit("le:"), F.date_format(cutoff, iso), F.lit(":"), F.coalesce(F.date_format("latest", iso), F.lit("none")))
    else:
        day = F.lit("all")
    return found.select("z", "x", "y", F.concat_ws(":", F.lit("sw:tile"), "z", "x", "y", day, digest).alias("key"))


def open_layers(users: DataFrame, members: DataFrame, layers: DataFrame) -> DataFrame:
    """(user_id, layer columns) of the layers that each user may see: an administrator all, others their own and those shared with one of their groups (shared_with)."""
    people = users.select(F.col("id").alias("user_id"), "role")
    groups = members.join(people.select("user_id"), "user_id", "left_semi")
    shared = layers.withColumn("__group", F.explode("shared_with")).join(groups, F.col("__group") == F.col("group_id")).select("user_id", *layers.columns)
    own = layers.join(people.select("user_id"), F.col("created_by") == F.col("user_id"))
    every = layers.crossJoin(F.broadcast(people.filter("role = 'admin'").select("user_id")))  # what administrators see by definition
    return shared.unionByName(own).unionByName(every).dropDuplicates(["user_id", "id"])


def series_entries(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row a series with its raster ids in their order."""
    rows = entries.join(catalog.select(F.col("id").alias("raster_id")), "raster_id")
    ordered = F.array_sort(F.collect_list(F.struct("sort_order", "raster_id")))
    return rows.groupBy("timeseries_id").agg(F.transform(ordered, lambda x: x["raster_id"]).alias("rasters"), F.count("*").alias("n"))


def mixed_search(catalog: DataFrame, datasets: DataFrame, bbox=None, text: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """Rasters and vector datasets in one result shape; dates restrict rasters only."""
    rasters = search_rasters(catalog, bbox, date_from, date_to, text=text).select(F.lit("raster").alias("result_type"), F.lit(0).alias("type_rank"), "id", "name", "description", "created_at")
    pattern = f"%{text}%" if text is not None else None
    vectors = where(datasets, F.col("name").ilike(pattern) | F.col("description").ilike(pattern) if pattern else None)
    vectors = vectors.select(F.lit("vector").alias("result_type"), F.lit(1).alias("type_rank"), "id", "name", "description", "created_at")
    return rasters.unionByName(vectors)


def painted(pixels: DataFrame) -> DataFrame:
    """(z, x, y, r, c, value) of the topmost pixel, from rows with a paint order; null values do not cover."""
    return pixels.filter(F.col("value").isNotNull()).groupBy("z", "x", "y", "r", "c").agg(F.max_by("value", "paint").alias("value"))


def accessible_apps(apps: DataFrame, allowed: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """The applications that any of the user's groups allows."""
    own = allowed.join(members.filter(F.col("user_id") == user_id), "group_id", "left_semi")
    return apps.join(own, "app_name", "left_semi").orderBy("app_name")
