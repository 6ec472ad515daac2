"""Summaries of sessions and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.turns import SESSION, assign_turns

ANSWER_CHARS = 1000


def session_summary(messages: DataFrame, keys: list[str] = SESSION) -> DataFrame:
    """keys, turn_count, message_count, first_prompt, first_pos, last_pos."""
    turned = assign_turns(messages, keys)
    asked = F.col("role") == "user"
    return turned.groupBy(*keys).agg(F.max("turn_no").alias("turn_count"), F.count("*").alias("message_count"), F.min_by(F.when(asked, F.substring("content", 8, 2147483647)), F.when(asked, F.col("pos"))).alias("first_prompt"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def qa_pairs(messages: DataFrame, keys: list[str] = SESSION, answer_chars: int = ANSWER_CHARS) -> DataFrame:
    """One row a turn: prompt, response (assistant texts in order), their lengths, and document `Q: ...\\nA: ...`."""
    turned = assign_turns(messages, keys).where("turn_no > 0")
    body = F.substring("content", 8, 2147483647)
    told = turned.groupBy(*keys, "turn_no").agg(
        F.min_by(F.when(F.col("msg_no") == 0, body), "msg_no").alias("prompt"),
        F.array_sort(F.collect_list(F.when((F.col("role") == "assistant") & F.col("content").startswith("[text]"), F.struct("msg_no", body.alias("t"))))).alias("a_"),
    )
    response = F.array_join(F.transform("a_", lambda x: x["t"]), "\n")
    out = told.withColumn("response", response)
    return out.select(*keys, "turn_no", "prompt", "response", F.length("prompt").alias("prompt_length"), F.length("response").alias("response_length"), F.concat(F.lit("Q: "), "prompt", F.lit("\nA: "), F.substring("response", 1, answer_chars)).alias("document"))
