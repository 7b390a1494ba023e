"""Helpers that several operators share."""
from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class body.
WS = r"\x20\x09-\x0D"


#: Spark deletes an execution's shuffle files when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run on one machine (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back.

    A lost executor costs nothing then, and the files are compressed, unlike RDD checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads this plan's shuffles once the table is written
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalog_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_stratalog_path", None)
        if not path:
            continue
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def beside(docs: DataFrame, *made: str) -> list[str]:
    """Columns of docs without those that an operator makes itself: its own take their place."""
    return [c for c in docs.columns if c not in made]


def words(text: Column) -> Column:
    """Array of the maximal runs of characters that are no ASCII white space; [] for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), "")


def byte_slices(batch, column: str = "text", size: int = 1 << 20) -> Iterator:
    """An Arrow batch in slices of about `size` bytes of a string column, one row at least: long texts don't gather."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def release() -> None:
    """Hand memory that is free back to the system: Arrow's and the C library's allocators keep it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with release() once its own objects are gone: Spark's workers go on to other tasks, and what each leaves adds up."""
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of key: bounded, and the same on every run.

    The rows are counted first; only hashes under a threshold that about `rows` of them pass are sorted, so
    the one task that ends the sort meets about that many, however many partitions there are.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    count = df.count()
    share = (rows + 8 * rows**0.5 + 64) / max(1, count)
    if share < 0.5:
        df = df.where(h < F.lit(int(share * 2**64) - 2**63))
    return df.orderBy(h, F.col(key)).limit(rows)
