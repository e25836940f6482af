"""Queries on timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import timestamps
from paperloom.sources.tables import table


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.instants(table(spark, folder, "items", "ordinal", "source", "published_raw"), table(spark, folder, "articles", "article_id", "source", "published", "modified"), table(spark, folder, "feeds", "name", "tz", "region"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that name one instant, with it."""
    return _instants(spark, folder).filter(F.col("epoch_ms").isNotNull()).select("tab_name", "col_name", "row_id", "epoch_ms")


def p4_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw value with its instant, or null, and its ISO text."""
    return _instants(spark, folder).select("tab_name", "col_name", "row_id", "raw", F.date_format("instant", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc"))


QUERIES = {"p4_found": p4_found, "p4_normalised": p4_normalised}
ORACLES: dict[str, str] = {}
