"""Pieces that several operators share: working tables, checked broadcasts, column handling."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a side that may be broadcast; a larger side is shuffled instead.
BROADCAST_ROWS = 1_000_000
#: Bytes of a batch that a Python worker takes at once.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder (tests); a cluster
    is refused, as each executor would write to a folder of its own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="isobath-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts its lineage.

    The files stay until discard() is called with the result, at the latest until the session ends.
    """
    spark = df.sparkSession
    path = working_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._isobath_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from materialise() that no later plan reads."""
    for df in tables:
        delete(df.sparkSession, df._isobath_path)


def working_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/isobath-{name}-{uuid.uuid4().hex}"

    def dispose() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session has already gone; its shared folder is cleaned with it
            pass

    atexit.register(dispose)
    return path


def in_parts(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes at most, so that a worker's copies of a batch stay small; a longer row is a batch of its own."""
    for batch in batches:
        steps = max(1, min(batch.num_rows, -(-batch.nbytes // limit)))
        size = -(-batch.num_rows // steps) if batch.num_rows else 0
        if steps == 1:
            yield batch
        else:
            for i in range(0, batch.num_rows, size):
                yield batch.slice(i, size)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes, for columns of any names, dots and repeats included; run sees batches under these names."""
    names = df.columns

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in in_parts(batches))

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, schema)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a working folder that no later plan reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect plans that are done with, so that Spark removes their shuffle files now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with right broadcast if its counted size allows it, otherwise shuffled with adaptive splitting of skewed keys."""
    return left.join(F.broadcast(right) if small(right, limit) else right, on, how)


def with_fields(df: DataFrame, added: StructType) -> tuple[DataFrame, StructType]:
    """df without columns that added replaces, and the schema of the result."""
    names = {f.name.lower() for f in added}
    kept = df.select(*[quoted(c) for c in df.columns if c.lower() not in names])
    return kept, StructType([StructField(f.name, f.dataType, True) for f in kept.schema] + list(added))


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


