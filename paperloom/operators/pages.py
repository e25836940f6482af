"""Audits of HTML bodies with built-in expressions: headings, links, tag balance, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags whose opening and closing are held against each other.
PAIRED = ("p", "div", "a", "ul", "ol", "li", "strong", "em")


def plain(markup: Column) -> Column:
    """Text of a markup, tags made spaces and white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def headings(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, level, heading) of h2 and h3."""
    every = F.array(*[F.struct(F.lit(n).alias("level"), F.regexp_extract_all(markup, F.lit(rf"(?i)<h{n}[^>]*>([^<]*)</h{n}>"), F.lit(1)).alias("found")) for n in (2, 3)])
    return docs.select(key, F.inline(every)).select(key, "level", F.explode("found").alias("heading"))


def links(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, href, external) of anchors."""
    return docs.select(key, F.explode(F.regexp_extract_all(markup, F.lit(r'<a [^>]*?href="([^"]*)"'), F.lit(1))).alias("href")).withColumn("external", F.col("href").rlike("^https?://"))


def unbalanced(markup: Column) -> Column:
    """Sum over paired tags of openings without closings and closings without openings."""
    return sum((F.abs(F.regexp_count(markup, F.lit(rf"<{t}(?:\s[^>]*)?>")) - F.regexp_count(markup, F.lit(f"</{t}>"))) for t in PAIRED[1:]), F.abs(F.regexp_count(markup, F.lit(r"<p(?:\s[^>]*)?>")) - F.regexp_count(markup, F.lit("</p>"))))


def duplicate_ids(markup: Column) -> Column:
    """Ids beyond the distinct ones."""
    found = F.regexp_extract_all(markup, F.lit(r'\sid="([^"]*)"'), F.lit(1))
    return F.size(found) - F.size(F.array_distinct(found))
