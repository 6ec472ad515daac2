"""Transcript files (one JSON object a line) and hook events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import collection

EVENT_SCHEMA = "hook_event_name string, session_id string, transcript_path string, prompt string, stop_hook_active boolean"
EVENT_NAMES = ("UserPromptSubmit", "Stop", "SessionEnd")


def read_lines(spark: SparkSession, paths: str | list[str], skip_first_line: bool = False) -> DataFrame:
    """path, collection, session_id (file name without ending), pos (line number), line.

    skip_first_line leaves out line 0, as a scan from the end that stops at a line break would.
    """
    # files are read in pieces; places in a file are those of its pieces, then of the lines in a piece
    raw = spark.read.text(paths, lineSep="\n").select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    order = Window.partitionBy("path").orderBy("block", "at")
    lines = raw.withColumn("pos", F.row_number().over(order) - 1).where(F.length(F.trim("line")) > 0)
    if skip_first_line:
        lines = lines.where(F.col("pos") > 0)
    name = F.element_at(F.split("path", "/"), -1)
    return lines.select("path", collection(F.col("path")).alias("collection"), F.regexp_replace(name, r"\.[^.]*$", "").alias("session_id"), "pos", "line")


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Hook events of JSON text; blank and malformed rows are dropped."""
    parsed = raw.where(F.length(F.trim(column)) > 0).select(F.from_json(column, EVENT_SCHEMA).alias("e")).select("e.*")
    return parsed.where(F.col("hook_event_name").isNotNull())


def route(events: DataFrame, name: str) -> DataFrame:
    """Events of one name that have all it requires; Stop events under way already are skipped."""
    if name not in EVENT_NAMES:
        raise ValueError(f"unknown event {name}")
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    own = events.where(F.col("hook_event_name") == name).where(given("session_id") & given("transcript_path"))
    if name == "UserPromptSubmit":
        own = own.where(given("prompt"))
    if name == "Stop":
        own = own.where(~F.coalesce("stop_hook_active", F.lit(False)))
    return own.withColumn("collection", collection(F.col("transcript_path")))


def rejected(events: DataFrame) -> DataFrame:
    """Events of an unknown name or without a required field, with the reason."""
    missing = lambda c: F.col(c).isNull() | (F.col(c) == "")
    reason = (
        F.when(~F.col("hook_event_name").isin(*EVENT_NAMES), "unknown event")
        .when(F.coalesce("stop_hook_active", F.lit(False)) & (F.col("hook_event_name") == "Stop"), "stop hook active")
        .when(missing("session_id"), "missing session_id")
        .when(missing("transcript_path"), "missing transcript_path")
        .when((F.col("hook_event_name") == "UserPromptSubmit") & missing("prompt"), "missing prompt")
    )
    return events.withColumn("reason", reason).where("reason is not null")
