"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := fresh_path(spark, what))
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, what: str, kind: str = "json", compression: str = "none") -> DataFrame:
    """df as files of a kind (json, csv or parquet) in the shared folder, read back with its schema."""
    if kind == "parquet":
        return stash(df, what)
    spark, path = df.sparkSession, fresh_path(df.sparkSession, what)
    if kind == "csv":
        df.write.csv(path, header=True, quoteAll=True, escape='"', compression=compression)
        return spark.read.schema(df.schema).csv(path, header=True, quote='"', escape='"')
    df.write.json(path, ignoreNullFields=False, compression=compression)
    return spark.read.schema(df.schema).json(path)
