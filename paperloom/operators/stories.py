"""Selection of stories: filters, first-of-page, anti-joins, scores, clusters and capped top lists."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as X
from paperloom.functions import urls as U


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; min_by aggregates before the shuffle, where row_number would sort whole keys."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def filter_reason(title: Column, url: Column, age_hours: Column, blocked: list[str], most_hours: float) -> Column:
    """The first reason to leave an item out, null to keep it: words, blocked word, listing, address, age, language."""
    return (
        F.when(X.word_count(title) < 4, "too few words")
        .when(F.lower(title).rlike("|".join(blocked)), "blocked word")
        .when(F.lower(title).rlike(r"^\s*(?:watch|listen)\s*:|\bpodcast\b|\bsponsored\b|\bwebinar\b"), "listing")
        .when(~U.is_http(url), "address")
        .when(age_hours > most_hours, "too old")
        .when(~X.looks_english(title), "not English")
    )


def fingerprint(title: Column) -> Column:
    """Order-free key of a headline: its first twelve content words, sorted."""
    words = F.array_sort(F.array_distinct(F.filter(X.alphanumeric(title), lambda w: ~w.isin(*X.STOP_WORDS) & ((F.length(w) > 2) | w.rlike(r"^\d+$")))))
    return F.array_join(F.slice(words, 1, 12), " ")


def unseen(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Items whose canonical address and fingerprint are both new: two hash anti-joins, on columns of those names."""
    return items.join(accepted.select("canonical_key").distinct(), "canonical_key", "left_anti").join(accepted.select("fingerprint").distinct(), "fingerprint", "left_anti")


def score(age_hours: Column, weight: Column, outlets: Column, has_image: Column, summary_length: Column, half_life: float = 8.0) -> Column:
    """Freshness of 50 halving by half_life, outlet weight, coverage by outlets up to 30, picture and summary; no date counts as 12 hours."""
    fresh = 50 * F.pow(F.lit(0.5), F.coalesce(age_hours, F.lit(12.0)) / half_life)
    return fresh + 10 * (weight - 1) + F.least(F.lit(30.0), 9.0 * (outlets - 1)) + F.when(has_image, 3).otherwise(0) + F.when(summary_length > 200, 2).otherwise(0)


def leader_clusters(items: DataFrame, block: str, key: str, words: str, order: str, threshold: float = 0.55) -> DataFrame:
    """(key, leader): in order, an item joins the first leader of its block that it is like, else becomes one.

    Alike are word sets of a Jaccard of threshold, or of a containment of 0.75 with three words in common. Blocks
    are groups that no cluster crosses; their rows arrive sorted and in batches, and only leaders are held.

    In one fixed order of all words, sets of such a Jaccard have one of the first words of each in common, so many that the
    rest of a set is too few; of a containment, one of the smaller's first words is anywhere in the larger. Frequent words
    come last, so that few leaders are met. Which words count as frequent changes no row. Of equal sets the first is looked up.
    """
    schema = T.StructType([T.StructField(key, items.schema[key].dataType), T.StructField("leader", items.schema[key].dataType)])
    counts = items.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    # At most 2000 times as many words as a row has on average.
    often = {r.w: r.n for r in counts.filter(F.col("n") >= max(2, items.count() / 2000)).collect()}
    share = max(0.75, threshold + 0.15)
    sorted_rows = items.select(*dict.fromkeys((block, key, words, order))).repartition(block).sortWithinPartitions(block, order, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for b in batches:
            out = []
            for group, k, ws in zip(b[block], b[key], b[words]):
                if at is None or group != at:
                    at, leaders, known, first_words, least_words, all_words = group, [], {}, {}, {}, {}
                mine = frozenset(map(sys.intern, ws)) if ws is not None else frozenset()
                place = known.get(mine) if mine else None  # those without words are like none
                if place is None:
                    n = len(mine)
                    every = sorted(mine, key=lambda w: (often.get(w, 0), w))
                    first, least = (every[: n - math.ceil(s * n - 1e-9) + 1] for s in (threshold, share))
                    met = {i for index, ws in ((first_words, first), (least_words, every), (all_words, least)) for w in ws for i in index.get(w, ())}
                    for i in sorted(met):
                        other = leaders[i][1]
                        common = len(mine & other)
                        if common / (n + len(other) - common) >= threshold or (common >= 3 and common / min(n, len(other)) >= share):
                            place = i
                            break
                    if place is None:
                        place = len(leaders)
                        leaders.append((k, mine))
                        for index, ws in ((first_words, first), (least_words, least), (all_words, every)):
                            for w in ws:
                                index.setdefault(w, []).append(place)
                    known[mine] = place
                out.append((k, leaders[place][0]))
            yield pd.DataFrame(out, columns=schema.names)

    return sorted_rows.mapInPandas(run, schema)


def capped_top(items: DataFrame, order: list[Column], caps: dict[str, int], limit: int) -> DataFrame:
    """The first rows in order that respect every cap at once, greedily; a row that one cap skips uses up no other.

    Of the rows alike in all capped columns only the first, as many as the least cap, can be picked: each before them is
    picked too, or skipped by a cap that stays full. The ordered pass sees no others.
    """
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(*caps).orderBy(*order))).filter(F.col("_rank") <= min(caps.values())).drop("_rank")
    rows = ranked.repartition(1).sortWithinPartitions(*order)
    schema = T.StructType([*items.schema.fields, T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[tuple, int] = {}
        place = 0
        for b in batches:
            keep = []
            for i, row in enumerate(b[list(caps)].itertuples(index=False)):
                keys = list(zip(caps, row))
                if place < limit and all(used.get(k, 0) < caps[k[0]] for k in keys):
                    place += 1
                    keep.append((i, place))
                    for k in keys:
                        used[k] = used.get(k, 0) + 1
            out = b.iloc[[i for i, _ in keep]].copy()
            out["place"] = [p for _, p in keep]
            yield out.astype({"place": "int32"})

    return rows.mapInPandas(run, schema)
