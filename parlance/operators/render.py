"""Rendering of found chunks as a context block and as the hook's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before a context, and instead of one.
FOUND = "Retrieved relevant code:\n"
NOTHING = "No relevant internal code snippets were found for this query in the vector database."


def render(chunks: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """keys, context: the documents of each key in order, with file path or `snippet_<i>` as source. Null texts are empty."""
    rows = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text")))).alias("c_"))

    def document(x: Column, i: Column) -> Column:
        number = (i + 1).cast("string")
        source = F.when(x["path"] != "", x["path"]).otherwise(F.concat(F.lit("snippet_"), number))
        return F.concat(F.lit('<document index="'), number, F.lit('" source="'), source, F.lit('">\n'), x["text"], F.lit("\n</document>\n"))

    return rows.select(*keys, F.concat(F.lit("<context>\n"), F.array_join(F.transform("c_", document), ""), F.lit("</context>")).alias("context"))


def message(context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(FOUND), context)).otherwise(F.lit(NOTHING))


def answer(context: Column, event: str = "UserPromptSubmit") -> Column:
    """The JSON answer to an event. Characters outside ASCII stand as they are."""
    return F.to_json(F.struct(F.struct(F.lit(event).alias("hookEventName"), message(context).alias("additionalContext")).alias("hookSpecificOutput")))
