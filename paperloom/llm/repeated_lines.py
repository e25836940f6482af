"""Lines that one source repeats on many of its pages.

A line's form is compared within its source and outside of it by the log-likelihood ratio, with control of the
false-discovery rate over all forms of all sources; lines in significant excess that are also frequent enough
are removed, and each text is put together again from its other lines by position.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

#: A line is excessive in a source from so many of its rows on, and from that share of them on.
MIN_ROWS, MIN_SHARE = 4, 0.02
#: Share of false discoveries among the lines taken for excessive.
FDR = 0.05
#: The ratio is binned in steps of 1 / BINS for the control; values beyond MOST share a bin. Both bound what the driver sees.
BINS, MOST = 8, 400


def form(line: Column) -> Column:
    """Lower case, with every run of other characters than letters made one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"\P{L}+", " "))


def _key(f: Column) -> Column:
    """A 96-bit key of a form; forms themselves can be long."""
    return F.struct(F.xxhash64(f).alias("a"), F.hash(f).alias("b"))


def lines(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(row_id, source, line_no, line, form) of every line, numbered from 1, blank ones counted."""
    parts = df.select(F.col(row_id).alias("row_id"), F.col(source).alias("source"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return parts.select("row_id", "source", (F.col("pos") + 1).alias("line_no"), "line", form(F.col("line")).alias("form"))


def _g2(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio of two counts, zero unless the first rate is the greater one."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)

    p = (k1 + k2) / (n1 + n2)
    both = part(k1, n1, p) + part(n1 - k1, n1, 1 - p) + part(k2, n2, p) + part(n2 - k2, n2, 1 - p)
    return F.when(k1 / n1 > k2 / n2, 2 * both).otherwise(0.0)


def _p_value(g2: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom, halved for the one-sided test."""
    return 0.5 * math.erfc(math.sqrt(max(g2, 0.0) / 2))


def excessive(df: DataFrame, row_id: str = "row_id", source: str = "source", text: str = "text", min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, fdr: float = FDR) -> DataFrame:
    """The lines in excess: (source, key, rows, share, g2), key being that of the form.

    The outside frequency of a form is its frequency in the sources that do not repeat it themselves, that is,
    where it stays under min_rows or min_share: a line such as "Advertisement" that many sources repeat is in
    excess in each of them. Where no such source is left, or so few rows of such sources that the ratio could not be
    significant by itself though none of them had the line, there is nothing to test against: min_rows and min_share
    decide, if the line is rarer outside.
    Rows without a source belong to no source and have no excessive lines.
    """
    known = df.filter(F.col(source).isNotNull())
    totals = known.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("total"))
    forms = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), form), lambda f: f != ""))
    counts = known.select(F.col(source).alias("source"), F.explode(forms).alias("form")).select("source", _key(F.col("form")).alias("key")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("rows"))
    counts = cut(counts.join(totals, "source").withColumn("repeats", (F.col("rows") >= min_rows) & (F.col("rows") >= min_share * F.col("total"))), "line-counts")
    every = totals.agg(F.sum("total").alias("every"))
    repeated = counts.filter("repeats")
    inside = repeated.groupBy("key").agg(F.sum("total").alias("repeating"))
    outside = counts.filter(~F.col("repeats")).join(inside.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("rows").alias("elsewhere"))
    tests = counts.count()
    need = NormalDist().inv_cdf(min(fdr / max(tests, 1), 0.5)) ** 2
    left = F.col("every") - F.col("repeating")
    n1, n2, k2 = F.col("total").cast("double"), F.greatest(left, F.lit(1)).cast("double"), F.coalesce("elsewhere", F.lit(0)).cast("double")
    few = (left == 0) | ((_g2(F.col("rows").cast("double"), n1, F.lit(0.0), n2) < need) & (k2 / n2 < F.col("rows") / n1))
    tested = repeated.join(inside, "key").join(outside, "key", "left").crossJoin(every).withColumn("g2", _g2(F.col("rows").cast("double"), n1, k2, n2)).withColumn("few", few)
    tested = cut(tested.select("source", "key", "rows", (F.col("rows") / F.col("total")).alias("share"), "g2", "few"), "line-tests")
    floor = _threshold(tested, tests, fdr)
    return tested.filter((F.col("g2") >= floor) | F.col("few")).drop("few")


def _threshold(tested: DataFrame, tests: int, fdr: float) -> float:
    """The least ratio that Benjamini and Hochberg's rule accepts; forms that were not tested count as tests without excess."""
    bins = tested.groupBy(F.least(F.floor(F.col("g2") * BINS), F.lit(MOST * BINS)).alias("bin")).count().collect()
    seen, floor = 0, math.inf
    for b, n in sorted(((r[0], r[1]) for r in bins), reverse=True):
        seen += n
        if _p_value(b / BINS) <= fdr * seen / tests:
            floor = b / BINS
    return floor


def repeated_lines(df: DataFrame, row_id: str = "row_id", source: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """(row_id, source, line_no, rows, share, g2) of every line that its source repeats in excess."""
    marks = cut(excessive(df, row_id, source, text, **limits).select("source", "key", "rows", "share", "g2"), "excess")
    every = lines(df.filter(F.col(source).isNotNull()), row_id, source, text).filter(F.col("form") != "")
    return every.select("row_id", "source", "line_no", _key(F.col("form")).alias("key")).join(marks, ["source", "key"]).select("row_id", "source", "line_no", "rows", "share", "g2")


def without_repeats(df: DataFrame, row_id: str = "row_id", source: str = "source", text: str = "text", **limits: float) -> DataFrame:
    """df with its text freed of the repeated lines, and the number of lines removed: columns clean_text, lines_removed.

    Other lines keep their order and their blank lines. Null texts stay null, empty ones empty; rows without a
    source are left as they are; a text of nothing but repeated lines becomes empty. Rows that stand twice are
    counted as two and both cleaned. Columns of df named clean_text or lines_removed are replaced.
    """
    marks = cut(excessive(df, row_id, source, text, **limits), "excess").select(F.col("source").alias("_source"), F.col("key").alias("_key"))
    base = cut(df.drop("clean_text", "lines_removed").withColumn("_uid", F.monotonically_increasing_id()), "texts")
    parts = F.split(F.col(text), "\n")
    each = base.filter(F.col(source).isNotNull()).select("_uid", F.col(source).alias("_source"), F.posexplode(parts).alias("_pos", "_line")).withColumn("_key", _key(form(F.col("_line"))))
    kept = each.join(marks, ["_source", "_key"], "left_anti")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_line"))), lambda x: x["_line"])
    again = kept.groupBy("_uid").agg(F.array_join(rows, "\n").alias("_text"), F.count(F.lit(1)).alias("_kept"))
    out = base.join(again, "_uid", "left")
    judged = F.col(text).isNotNull() & F.col(source).isNotNull()
    out = out.withColumn("clean_text", F.when(judged, F.coalesce("_text", F.lit(""))).otherwise(F.col(text))).withColumn("lines_removed", F.when(judged, F.size(parts) - F.coalesce("_kept", F.lit(0)).cast("int")).otherwise(0))
    return out.drop("_text", "_kept", "_uid")
