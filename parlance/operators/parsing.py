"""Transcript lines to messages.

A message's text is made of tagged blocks: `[text]`, `[tool_result]`, `[Image Attached]`,
`[thinking]` and `[<tool name>]` with one line for each input value. Lines that aren't JSON objects
with a message, messages of other roles and blank texts give no row.
"""

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _user(content) -> str:
    if isinstance(content, str):
        return f"[text]\n{content}"
    out = []
    for block in content if isinstance(content, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            out.append(f"[text]\n{block.get('text', '')}\n")
        elif kind == "tool_result":
            result = block.get("content", "")
            items = [result] if isinstance(result, str) else result if isinstance(result, list) else []
            out.append("[tool_result]\n" + "".join(f"{x}\n" for x in items))
        elif kind == "image":
            out.append("[Image Attached]\n")
    return "".join(out)


def _assistant(content) -> str:
    out = []
    for block in content if isinstance(content, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            out.append(f"[text]\n{block.get('text', '')}\n")
        elif kind == "thinking":
            out.append(f"[thinking]\n{block.get('thinking', '')}")
        elif kind == "tool_use":
            values = block.get("input", {})
            out.append(f"[{block.get('name')}]\n" + "".join(f"{v}\n" for v in (values.values() if isinstance(values, dict) else [])))
    return "".join(out)


def parse_line(line: str) -> tuple[str | None, str, str] | None:
    """(timestamp, role, content) of a line, or None."""
    try:
        data = json.loads(line)
    except (ValueError, RecursionError):
        return None
    message = data.get("message") if isinstance(data, dict) else None
    if not isinstance(message, dict):
        return None
    role, content = message.get("role"), message.get("content")
    text = (_user(content) if role == "user" else _assistant(content) if role == "assistant" else "").strip()
    if not text:
        return None
    stamp = data.get("timestamp")
    return (None if stamp is None else str(stamp), role, text)


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """All columns but the line, with timestamp, role and content; lines without a message are left out."""
    import pandas as pd

    @F.pandas_udf("timestamp string, role string, content string")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [parse_line(x) if x is not None else None for x in batch]
            yield pd.DataFrame([r or (None, None, None) for r in rows], columns=["timestamp", "role", "content"])

    rest = [c for c in lines.columns if c != column]
    return lines.withColumn("m_", parsed(column)).select(*rest, "m_.timestamp", "m_.role", "m_.content").where(F.col("role").isNotNull())


def parse_strings(lines: DataFrame, column: str = "line") -> DataFrame:
    """JVM-side parsing for transcripts whose message contents are plain strings (chat logs without blocks)."""
    m = F.from_json(column, "timestamp string, message struct<role:string,content:string>")
    rest = [c for c in lines.columns if c != column]
    from parlance.functions.text import strip

    rows = lines.withColumn("m_", m).select(*rest, "m_.timestamp", "m_.message.role", F.col("m_.message.content").alias("content"))
    return rows.where(F.col("role").isin("user", "assistant") & F.col("content").isNotNull()).withColumn("content", strip(F.concat(F.lit("[text]\n"), "content")))
