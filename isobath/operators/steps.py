"""Steps of iterative jobs: tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local master, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="isobath-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later plans start from its files and a lost executor repeats no earlier step."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/isobath-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._isobath_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables from written() that no later plan reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._isobath_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def parts_of(spark: SparkSession) -> int:
    """Parts that keep all cores busy and each task small."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in a fixed number of parts: of rows of few bytes that are much work, a file's splits and adaptive execution make few tasks."""
    return df.repartition(parts_of(df.sparkSession), *keys)


def checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with the hint to broadcast it, if it has at most limit rows; counts no further than that."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)
