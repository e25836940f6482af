"""Queries of sequential text operators and of page audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import pages, prose, sanitizing, terms
from paperloom.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def q_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of documents."""
    return prose.sentence_rows(_docs(spark, folder), "doc_id", "text")


def q_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotations with their speakers."""
    return prose.quote_rows(_docs(spark, folder), "doc_id", "text")


def q_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of documents with mentions and scores."""
    return prose.name_rows(_docs(spark, folder), "doc_id", "text")


def q_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Sentiment of summaries."""
    return prose.sentiment_rows(table(spark, folder, "items", "ordinal", "summary"), "ordinal", "summary")


def q_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Three central sentences of each article."""
    return prose.summary_rows(table(spark, folder, "articles", "article_id", "text"), "article_id", "text")


def q_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the vocabulary of titles with the words behind them."""
    t = terms.token_rows(table(spark, folder, "items", "ordinal", "title"), "ordinal", "title")
    return prose.stems(t).groupBy("stem").agg(F.count(F.lit(1)).alias("words"), F.min("token").alias("least"))


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "drafts", "draft_id", "body_html", "headline", "meta_description").filter(F.col("body_html").isNotNull())


def q_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of drafts."""
    return pages.headings(_drafts(spark, folder), "draft_id", "body_html")


def q_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of drafts."""
    return pages.links(_drafts(spark, folder), "draft_id", "body_html")


def q_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Markup balance, repeated ids and lengths of drafts."""
    d = _drafts(spark, folder)
    b = F.col("body_html")
    return d.select("draft_id", pages.unbalanced(b).cast("bigint").alias("unbalanced"), pages.duplicate_ids(b).cast("bigint").alias("repeated_ids"), F.length("headline").cast("bigint").alias("headline_chars"), F.coalesce(F.length("meta_description"), F.lit(0)).cast("bigint").alias("meta_chars"), F.length(pages.plain(b)).cast("bigint").alias("text_chars"))


def q_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts as safe markup."""
    return _drafts(spark, folder).select("draft_id", sanitizing.sanitize(F.col("body_html")).alias("body"))


_BALANCE = " + ".join(f"abs(len(regexp_extract_all(body_html, '<{t}(?:\\s[^>]*)?>')) - len(regexp_extract_all(body_html, '</{t}>')))" for t in pages.PAIRED)
ORACLES = {
    "q_headings": "SELECT draft_id, CAST(2 AS INTEGER) AS level, unnest(regexp_extract_all(body_html, '(?i)<h2[^>]*>([^<]*)</h2>', 1)) AS heading FROM drafts UNION ALL SELECT draft_id, 3, unnest(regexp_extract_all(body_html, '(?i)<h3[^>]*>([^<]*)</h3>', 1)) FROM drafts",
    "q_links": """SELECT draft_id, href, regexp_matches(href, '^https?://') AS external FROM (SELECT draft_id, unnest(regexp_extract_all(body_html, '<a [^>]*?href="([^"]*)"', 1)) AS href FROM drafts) t""",
    "q_audit": f"""SELECT draft_id, CAST({_BALANCE} AS BIGINT) AS unbalanced, CAST(len(regexp_extract_all(body_html, '\\sid="([^"]*)"', 1)) - len(list_distinct(regexp_extract_all(body_html, '\\sid="([^"]*)"', 1))) AS BIGINT) AS repeated_ids,
length(headline) AS headline_chars, coalesce(length(meta_description), 0) AS meta_chars, length(trim(regexp_replace(regexp_replace(body_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_chars FROM drafts WHERE body_html IS NOT NULL""",
}
_NAMED = (q_sentences, q_quotes, q_names, q_sentiment, q_summaries, q_stems, q_headings, q_links, q_audit, q_sanitized)
QUERIES = {f.__name__: f for f in _NAMED}
