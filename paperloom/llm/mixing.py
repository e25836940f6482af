"""Mixing sources to target shares.

Weighted fair queueing: the documents of a source, in shuffled order, get virtual finish times, the tokens of the
source so far over its weight. Repeats of a source queue behind its first pass. The mixture is everything that
finishes within the budget, the largest for which every source still delivers its share, ordered by finish time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import cut

#: Parts that a source's queue is summed in, so that a large source is no single task's work.
PARTS = 512


def queues(documents: DataFrame, targets: DataFrame, seed: int = 11, doc_id: str = "doc_id", source: str = "source", tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """(documents with their source's tokens so far, sources with their totals and the mixture's budget)."""
    wanted = targets.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")).filter(F.col("tokens") > 0).join(wanted, "source")
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = cut(docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("turn", key).withColumn("part", F.shiftrightunsigned(key, 64 - (PARTS - 1).bit_length()).cast("int")), "mix-documents")
    sums = docs.groupBy("source", "part").agg(F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("before"))
    # The turn's sign bit would put the upper half of the parts first; order within a part is all that is needed.
    within = Window.partitionBy("source", "part").orderBy("turn", "uid").rowsBetween(Window.unboundedPreceding, 0)
    queued = docs.withColumn("so_far", F.sum("tokens").over(within)).join(before, ["source", "part"]).withColumn("so_far", F.col("before") + F.col("so_far")).drop("before", "part", "turn")
    totals = sums.groupBy("source").agg(F.sum("t").alias("total")).join(wanted, "source", "right").withColumn("total", F.coalesce("total", F.lit(0)))
    shares = wanted.agg(F.sum("target_share").alias("shares"))
    totals = totals.crossJoin(shares).withColumn("weight", F.col("target_share") / F.col("shares"))
    budget = totals.agg(F.min(F.col("total") * F.col("max_repeats") / F.col("weight")).alias("budget"))
    return queued, cut(totals.crossJoin(budget), "mix-sources")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 11, doc_id: str = "doc_id", source: str = "source", tokens: str = "tokens") -> DataFrame:
    """(source, doc_id, pass_no, tokens, finish): the mixture, each pass of a document a row, range-partitioned by finish time.

    targets: (source, target_share, max_repeats), shares being scaled to sum to 1. No document is used more than
    max_repeats times of its source; a source without tokens leaves an empty mixture, since no share of it can be
    reached. Documents of other sources, of none, or without tokens are not used. A document that stands twice counts
    as two. A source named twice in targets counts once, with its greatest share. The document at the border of the
    budget is taken if no more than half of it lies beyond, so that a source misses its share by half a document at most.
    """
    queued, sources = queues(documents, targets, seed, doc_id, source, tokens)
    limits = sources.select("source", "total", "weight", "budget")
    limits = limits.withColumn("allowed", F.col("budget") * F.col("weight") * (1 + 1e-12))
    rows = queued.join(limits, "source").withColumn("passes", F.floor((F.col("allowed") - F.col("so_far") + F.col("tokens") / 2) / F.col("total")) + 1).filter(F.col("passes") >= 1)
    each = rows.select("source", "doc_id", "tokens", "weight", "so_far", "total", F.explode(F.sequence(F.lit(1), F.least("passes", F.col("max_repeats")).cast("int"))).alias("pass_no"))
    finish = ((F.col("pass_no") - 1) * F.col("total") + F.col("so_far")) / F.col("weight")
    return each.select("source", "doc_id", "pass_no", "tokens", finish.alias("finish")).repartitionByRange("finish").sortWithinPartitions("finish", "source", "doc_id")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, uses, tokens, share, passes) actually reached."""
    got = mixture.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"), F.max("pass_no").alias("passes"))
    every = got.agg(F.sum("tokens").alias("every"))
    return targets.select("source", "target_share").join(got, "source", "left").crossJoin(every).select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("share"), F.coalesce("passes", F.lit(0)).alias("passes"))
