"""The named queries of the problems on text, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import boilerplate, encodings, increments, levels, mixing, packing, repeated_lines, residue, sql, tokens, truncation
from paperloom.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that a source repeats on many of its pages."""
    a = table(spark, folder, "articles", "article_id", "source", "text")
    return repeated_lines.repeated_lines(a, "article_id").select(F.col("row_id").alias("article_id"), F.col("line_no").cast("bigint").alias("line_no"))


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Articles without their repeated lines."""
    a = table(spark, folder, "articles", "article_id", "source", "text")
    return repeated_lines.without_repeats(a, "article_id").select("article_id", "clean_text", "lines_removed")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that are not part of their page's story."""
    a = table(spark, folder, "articles", "article_id", "source", "title", "html_paragraphs")
    return boilerplate.paragraphs(a).filter(~F.col("story")).select(F.col("page_id").alias("article_id"), F.col("par_no").cast("bigint").alias("par_no"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with template residue or filler, or with a notice in place of the story."""
    a = table(spark, folder, "articles", "article_id", "source", "title", "text")
    return residue.residue_pages(a).filter(F.col("reason") != "no story").select(F.col("page_id").alias("article_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Articles and drafts whose story is English prose of the most demanding grade."""
    return _levels(spark, folder).filter(F.col("level") == 4).select("tab_name", "row_id")


def p2_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The reading level of every article and draft."""
    return _levels(spark, folder)


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    return levels.every_level(table(spark, folder, "articles", "article_id", "text"), table(spark, folder, "drafts", "draft_id", "body_html"), table(spark, folder, "level_samples"))


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    values = encodings.values_of(table(spark, folder, "items", "ordinal", "language", "title", "summary"), table(spark, folder, "articles", "article_id", "language", "text"))
    return encodings.repair(values, encodings.corpus_model(values))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values with stretches decoded with another encoding than they were written in."""
    return _repaired(spark, folder).select("tab_name", "col_name", "row_id")


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled values with the chain of decodings and the text restored."""
    return _repaired(spark, folder).select("tab_name", "col_name", "row_id", "chain", "restored", "complete")


def p5_story(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's story: its paragraphs, in order."""
    a = table(spark, folder, "articles", "article_id", "source", "title", "html_paragraphs")
    kept = boilerplate.paragraphs(a).filter("story").groupBy("page_id").agg(F.array_sort(F.collect_set("par_no")).alias("kept"))
    story = F.transform("kept", lambda n: F.get("html_paragraphs", n - 1))
    return a.join(kept, F.col("article_id") == F.col("page_id"), "left").select("article_id", F.coalesce(F.array_join(story, "\n\n"), F.lit("")).alias("story"))


def p6_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Articles to leave out, with the reason."""
    return residue.residue_pages(table(spark, folder, "articles", "article_id", "source", "title", "text")).select(F.col("page_id").alias("article_id"), "reason")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items of later batches that repeat earlier items."""
    return increments.repeats(table(spark, folder, "items", "ordinal", "title", "url", "source", "batch_no")).select("ordinal_first", "ordinal_dup")


def p7_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    """New items and repeats of each batch."""
    items = table(spark, folder, "items", "ordinal", "title", "url", "source", "batch_no")
    found = increments.repeats(items)
    later = items.filter(F.col("batch_no") > 0).select("ordinal", "batch_no")
    return later.join(found, later["ordinal"] == found["ordinal_dup"], "left").groupBy("batch_no").agg(F.count(F.lit(1)).alias("items"), F.count("ordinal_dup").alias("repeats"))


def _capacities(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    return [(r["pack_id"], r["capacity_tokens"]) for r in table(spark, folder, "pack_sizes").orderBy("pack_id").collect()]


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.token_counts(table(spark, folder, "documents", "doc_id", "text")), _capacities(spark, folder))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Where each document lies in containers of each capacity."""
    return _packed(spark, folder)


def p8_use(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and the share of them used, by capacity."""
    return packing.use(_packed(spark, folder), _capacities(spark, folder))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    documents = table(spark, folder, "documents", "doc_id", "source", "text").join(targets.select("source").distinct(), "source", "left_semi")
    return mixing.mix(tokens.token_counts(documents), targets), targets


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture of sources, in order of finish time."""
    return _mixture(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.shares(*_mixture(spark, folder))


def _endings(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.endings(table(spark, folder, "documents", "doc_id", "source", "title", "text"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut before its end."""
    return _endings(spark, folder).filter("truncated").select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and cut ones by source."""
    return truncation.rates(_endings(spark, folder))


_NAMED = (
    p1_found, p1_cleaned, p2_found, p2_levels, p3_found, p3_restored, p5_found, p5_story, p6_found, p6_reasons,
    p7_found, p7_by_batch, p8_packed, p8_use, p9_mixture, p9_shares, p10_found, p10_rates,
)
QUERIES = {f.__name__: f for f in _NAMED}
ORACLES = sql.ORACLES
