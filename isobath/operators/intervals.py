"""Sets of day intervals per grid cell: union, gaps, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_days(df: DataFrame, keys: list[str], start: str = "start_day", end: str = "end_day") -> DataFrame:
    """The union of closed day intervals of each key; intervals that overlap or follow on the next day become one.

    Only the longest interval of each start day goes on, so a key's window holds as
    many rows as there are days, however many intervals it has.
    """
    df = df.filter(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col(start) > F.date_add(F.max(end).over(before), 1)).cast("int"), F.lit(1))
    running = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = df.withColumn("__fresh", fresh).withColumn("__island", F.sum("__fresh").over(running))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def gaps(merged: DataFrame, keys: list[str], wanted: DataFrame, start: str = "start_day", end: str = "end_day") -> DataFrame:
    """The days of wanted (keys, want_start, want_end) that the merged intervals of the key do not cover."""
    joined = wanted.join(merged, keys, "left")
    inside = joined.filter((F.col(start) <= F.col("want_end")) & (F.col(end) >= F.col("want_start")))
    per_key = Window.partitionBy(*keys, "want_start", "want_end").orderBy(start)
    # before each interval and after the last one
    lead = inside.withColumn("gap_start", F.coalesce(F.date_add(F.lag(end).over(per_key), 1), F.col("want_start"))).withColumn("gap_end", F.date_sub(F.col(start), 1))
    between = lead.select(*keys, "gap_start", "gap_end")
    tail = inside.groupBy(*keys, "want_start", "want_end").agg(F.max(end).alias("__last")).select(*keys, F.date_add("__last", 1).alias("gap_start"), F.col("want_end").alias("gap_end"))
    bare = wanted.join(inside.select(*keys, "want_start", "want_end").distinct(), [*keys, "want_start", "want_end"], "left_anti").select(*keys, F.col("want_start").alias("gap_start"), F.col("want_end").alias("gap_end"))
    return between.union(tail).union(bare).filter(F.col("gap_start") <= F.col("gap_end"))
