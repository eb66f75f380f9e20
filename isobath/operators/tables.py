"""Changes to tables as DataFrame transformations: upserts, cascades, defaults, arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with rows of new in place of those with the same keys; of several new rows the last by order counts."""
    if order is not None:
        last = Window.partitionBy(*keys).orderBy(order.desc())
        new = new.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys it lacks; of equal new keys one row is taken."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_cascade(parent: DataFrame, child: DataFrame, gone: Column, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows where gone holds and without their children; a null condition deletes nothing."""
    dead = parent.filter(gone).select(F.col(parent_key).alias("__dead")).distinct()
    return parent.filter(~F.coalesce(gone, F.lit(False))), child.join(dead, F.col(child_key) == F.col("__dead"), "left_anti")


def delete_set_null(child: DataFrame, dead: DataFrame, child_key: str) -> DataFrame:
    """child with its reference nulled where dead (one column of keys) holds it."""
    marked = dead.select(F.col(dead.columns[0]).alias("__dead")).distinct()
    joined = child.join(marked, F.col(child_key) == F.col("__dead"), "left")
    return joined.withColumn(child_key, F.when(F.col("__dead").isNull(), F.col(child_key))).drop("__dead")


def exclusive_default(df: DataFrame, owner: str, key: str, chosen: DataFrame) -> DataFrame:
    """df with is_default true for the chosen row of each owner in chosen (owner, key), and false for the owner's others."""
    pick = chosen.select(F.col(owner), F.col(key).alias("__chosen"))
    joined = df.join(pick, owner, "left")
    return joined.withColumn("is_default", F.when(F.col("__chosen").isNull(), F.col("is_default")).otherwise(F.col(key) == F.col("__chosen"))).drop("__chosen")


def merge_maps(old: Column, new: Column) -> Column:
    """A shallow merge of two maps; keys of new win."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def append_item(items: Column, item: Column) -> Column:
    return F.array_append(F.coalesce(items, F.array()), item)


def remove_item(items: Column, item_id: Column) -> Column:
    return F.filter(items, lambda x: x["id"] != item_id)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def evict_lru(entries: DataFrame, trigger: int, target: int, buckets: int = 64) -> DataFrame:
    """The entries that stay: if all together exceed trigger bytes, the most recently used ones up to target.

    The running sum is taken in two levels, over ranges of access times, so no
    task orders the whole table.
    """
    total = F.broadcast(entries.agg(F.sum("size_bytes").alias("__total"), F.min("atime").alias("__lo"), F.max("atime").alias("__hi")))
    width = F.greatest((F.col("__hi") - F.col("__lo") + 1) / buckets, F.lit(1.0))
    placed = entries.join(total).withColumn("__b", F.floor((F.col("atime") - F.col("__lo")) / width))
    sums = placed.groupBy("__b").agg(F.sum("size_bytes").alias("__own"))
    after = sums.withColumn("__after", F.coalesce(F.sum("__own").over(Window.orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__b").orderBy(F.desc("atime"), F.desc("cache_key"))
    ranked = placed.join(F.broadcast(after.select("__b", "__after")), "__b").withColumn("__used", F.col("__after") + F.sum("size_bytes").over(inside))
    return ranked.filter((F.col("__total") <= trigger) | (F.col("__used") <= target)).select(*entries.columns)
