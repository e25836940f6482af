"""Queries of drafts, questions, briefs and house style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import composition
from paperloom.sources.tables import table


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles", "article_id", "title", "text")


def q_drafts(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts of articles with their quality and confidence."""
    return composition.draft_rows(_articles(spark, folder), "article_id", "title", "text")


def q_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that articles ask or answer, with answers."""
    return composition.question_rows(_articles(spark, folder), "article_id", "text")


def q_briefs(spark: SparkSession, folder: str) -> DataFrame:
    """Short pages of articles."""
    return composition.brief_rows(_articles(spark, folder), "article_id", "title", "text")


def q_style(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of house style that articles break, and their score."""
    a = _articles(spark, folder)
    return a.select("article_id", F.array_join(composition.style_issues(F.col("text")), ", ").alias("issues"), composition.style_score(F.col("text")).cast("bigint").alias("score"))


_OWN = "regexp_replace(coalesce(text, ''), '\"[^\"]*\"|“[^”]*”', '', 'g')"
_BROKEN = ", ".join(f"CASE WHEN regexp_matches(own, '{p}') THEN '{n}' END" for n, p in composition.STYLE.items())
ORACLES = {"q_style": f"WITH o AS (SELECT article_id, {_OWN} AS own FROM articles), i AS (SELECT article_id, list_filter([{_BROKEN}], lambda x: x IS NOT NULL) AS l FROM o) SELECT article_id, array_to_string(l, ', ') AS issues, greatest(0, 100 - 12 * len(l)) AS score FROM i"}
_NAMED = (q_drafts, q_questions, q_briefs, q_style)
QUERIES = {f.__name__: f for f in _NAMED}
