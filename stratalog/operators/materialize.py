"""Tables in the shared folder, which cut lineage and outlive executors."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Spark deletes an execution's shuffle files when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, int]:
    """df written to the shared folder and read back, and its number of rows, which the write itself counts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalog-facts-{uuid.uuid4().hex}"
    seen = Observation()
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # nothing reads this plan's shuffles once the table is written
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def materialize(df: DataFrame) -> DataFrame:
    return stored(df)[0]
