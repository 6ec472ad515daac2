"""Completion of prompts by a chat model that the caller brings."""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete(prompts: DataFrame, ask: Callable[[str], str] | None = None, prompt: str = "prompt") -> DataFrame:
    """Adds completion: what `ask` says to each prompt, or the error as text. Without a model every row says that there is none."""
    import pandas as pd

    @F.pandas_udf("string")
    def said(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch.fillna(""):
                try:
                    out.append(ask(text) if ask else "Error: no model")
                except Exception as e:  # any failure of the model
                    out.append(f"Error: {e}")
            yield pd.Series(out)

    return prompts.withColumn("completion", said(prompt))
