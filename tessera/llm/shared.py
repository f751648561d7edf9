"""Tables and checkpoints in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a new temporary one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, where the session allows larger ones: each is held by the JVM and a worker at once."""
    most = spark.conf.get(LIMIT, None)
    if most is None or (most.rstrip("b").isdigit() and int(most.rstrip("b")) > BATCH_BYTES):
        spark.conf.set(LIMIT, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := fresh_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, more: str) -> str:
    """df's schema and more fields, as DDL."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def text_bytes(df: DataFrame, column: str) -> int:
    """Total bytes of a text column; one narrow scan, one row to the driver."""
    return int(df.select(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0)


def power_of_two(x: float, least: int, most: int) -> int:
    return int(min(most, max(least, 1 << max(0, math.ceil(math.log2(max(x, 1)))))))
