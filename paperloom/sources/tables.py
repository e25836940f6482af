"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table; with columns, only those are read from the file."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def views(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Registers tables as views, so that spark.sql can name them."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
