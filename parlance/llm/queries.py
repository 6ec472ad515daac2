"""Queries of the training-data operators, by the name under which they are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .decontaminate import op9_decontaminate
from .jaccard import op3_jaccard, op3_jaccard_links
from .lines import op8_lines
from .media import op10_media
from .packing import op7_packing
from .pii import op5_pii
from .quality import op2_quality
from .secrets import op4_secrets
from .toxicity import op1_toxicity
from .urls import op6_urls

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op3_jaccard_links": op3_jaccard_links,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_urls": op6_urls,
    "op7_packing": op7_packing,
    "op8_lines": op8_lines,
    "op9_decontaminate": op9_decontaminate,
    "op10_media": op10_media,
}


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_secrets that SQL can give."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_urls that SQL can give, and the verdict of the rules (null: none fits)."""
    return op6_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_media that SQL can give, from what is read back."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES |= {"secret_counts": secret_counts, "url_rules": url_rules, "media_payloads": media_payloads}
ORACLES: dict[str, str] = {"op3_jaccard": oracles.JACCARD, "op9_decontaminate": oracles.DECONTAMINATE, "secret_counts": oracles.SECRETS, "url_rules": oracles.URLS, "media_payloads": oracles.MEDIA}
