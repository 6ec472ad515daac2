"""Parquet tables of a scale-factor directory, and conversations as parsed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(conversations: DataFrame, collection: str = "conversations") -> DataFrame:
    """Messages as the transcript parser gives them: user and assistant rows, `[text]` before the text, blank ones dropped."""
    body = strip(F.concat(F.lit("[text]\n"), F.coalesce("text", F.lit(""))))
    return conversations.where(F.col("role").isin("user", "assistant")).select(
        F.lit(collection).alias("collection"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("pos"), F.lit(None).cast("string").alias("timestamp"), "role", body.alias("content")
    )


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's spark.checkpoint.dir. Only on one machine, as in tests, may it be unset: there the warehouse does."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def set_checkpoint_folder(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer pieces than there are cores (one small file, say), dealt out before costly work on each; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
