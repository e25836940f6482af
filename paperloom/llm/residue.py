"""Template residue, filler, and error pages or notices in place of a story.

Lines that carry trusted marks (template delimiters, filler words, words of notices: residue_marks lists them) are the
labelled ones. Their labels pass on to near-duplicates: each distinct line has a SimHash of its tokens and pairs of
them, in a common dress, and meets others in tables partitioned by pairs of blocks of the hash; links are verified by
Hamming distance and by the similarity of five-word shingle sets, and labels follow them until no line is added,
so that each connected component with a trusted line is labelled. A page is then judged by its labelled lines and by
whether it has a story.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import boilerplate as pages_
from paperloom.llm import streams
from paperloom.llm.boilerplate import FILLED, NOTICED, TEMPLATE_IN, TEMPLATE_ONLY
from paperloom.session import cut

#: Blocks of a hash. Each pair of them keys a table, by 32 bits: hashes that differ in at most BLOCKS - 2 bits always
#: meet in one, and unrelated ones hardly ever do, however many lines there are.
BLOCKS = 4
#: Bits that the hashes of near-duplicates may differ in. A word in twenty turns about eight; unrelated lines differ in
#: about 32, with a standard deviation of 4.
DISTANCE = 16
#: Similarity of two lines' shingle sets from which on they are near-duplicates.
SIMILAR = 0.8


def simhash(features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of lists of features, given as one flat array with offsets."""
    x = streams.mix(features.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(offsets) - 1, np.uint64)
    for bit in range(64):
        up = np.concatenate([[0], np.cumsum(((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * 2 - 1)])
        out |= (up[offsets[1:]] > up[offsets[:-1]]).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def _hashed(lines: DataFrame) -> DataFrame:
    """(line, label, shingles, hash) of (line, label, shingles, feats)."""
    at = lines.columns.index("feats")
    keep = [i for i in range(len(lines.columns)) if i != at]
    fields = [lines.schema.fields[i] for i in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(simhash(lists.flatten().to_numpy(zero_copy_only=False), offsets))], names=[*(f.name for f in fields), "hash"])

    return lines.mapInArrow(run, T.StructType([*fields, T.StructField("hash", T.LongType())]))


def spread_labels(lines: DataFrame) -> DataFrame:
    """(line, label) of every line that carries a label or that a chain of near-duplicates joins to one.

    lines: (line, label, feats, shingles), one row a distinct line, label null where unknown. The SimHash tables alone
    would miss short lines, whose hashes move much with a single word: a table of the first shingles of each set, in
    the order of their keys, holds at least one in common of any two sets as alike as that. Each round looks the newly
    labelled lines up in the tables; a line is added once, whatever the number of its neighbours. Lines of equal
    shingles meet as one; those without any take no part.
    """
    width = 64 // BLOCKS
    block = lambda i: F.shiftrightunsigned("hash", i * width).bitwiseAND(F.lit((1 << width) - 1))
    # A key of a table has its number above the blocks; the shingles' own keys may meet it by chance, which the check sorts out.
    tables = F.array(*[F.lit(no << 2 * width) + F.shiftleft(block(i), width) + block(j) for no, (i, j) in enumerate(combinations(range(BLOCKS), 2))])
    size = F.size("shingles")
    first = F.slice(F.array_sort("shingles"), 1, (size - F.ceil(SIMILAR * size) + 1).cast("int"))
    tables = F.concat(tables, first)
    grouped = lines.filter(F.size("shingles") > 0).withColumn("shingles", F.array_distinct("shingles")).withColumn("group", F.xxhash64(F.array_sort("shingles")))
    base = cut(_hashed(grouped.groupBy(F.col("group").alias("line")).agg(F.max("label").alias("label"), F.first("shingles").alias("shingles"), F.first("feats").alias("feats"))), "line-hashes")
    known = base.filter(F.col("label").isNotNull())
    fresh, rest = known, base.filter(F.col("label").isNull())
    found = known.select("line", "label")
    shingles = lambda line, name: base.select(F.col("line").alias(line), F.col("shingles").alias(name))
    while True:  # each round takes lines from the rest, so that it ends
        # Only hashes go to the tables; the shingles follow for the lines whose hashes are near.
        left = fresh.select(F.col("line").alias("of"), "label", F.explode(tables).alias("key"), F.col("hash").alias("h"))
        right = rest.select("line", "hash", F.explode(tables).alias("key"))
        met = right.join(left, "key").filter(F.bit_count(F.col("h").bitwiseXOR(F.col("hash"))) <= DISTANCE).select("line", "of", "label").distinct()
        both = F.size(F.array_intersect("s", "shingles"))
        alike = met.join(shingles("of", "s"), "of").join(shingles("line", "shingles"), "line").filter(both >= SIMILAR * (F.size("s") + F.size("shingles") - both))
        added = cut(alike.groupBy("line").agg(F.max("label").alias("label")), "spread-labels")
        if added.isEmpty():
            break
        found = found.unionByName(added)
        fresh, rest = base.drop("label").join(added, "line"), cut(rest.join(added, "line", "left_anti"), "unlabelled")
    return grouped.select("line", "group").join(found.withColumnRenamed("line", "group"), "group").select("line", "label")


def residue_pages(articles: DataFrame, page_id: str = "article_id", site: str = "source", title: str = "title", text: str = "text") -> DataFrame:
    """(page_id, reason) of the pages to leave out, reason being template, filler, notice or no story.

    template: an unfilled template part anywhere in the text, unless it is shown in quotation marks; filler:
    filler text anywhere; notice: an error message, a demand or a notice on a page without a story. Null, empty and
    blank texts give no row; a page that stands twice gives a row each time. The columns paywalled and status are
    not read.
    """
    want = articles.select(F.col(page_id).cast("long").alias("page_id"), F.col(site).alias("source"), F.col(title).alias("title"), F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "").alias("pars"))
    return _judge(want)


def _judge(want: DataFrame) -> DataFrame:
    judged, lines = pages_.with_lines(want, "page_id", "source", "title", "pars", shingled=True)
    # Lines of stories take no labels.
    labels = spread_labels(lines.filter((F.col("score") > pages_.SURE_STORY) | (F.col("mark") != pages_.PLAIN)).select("line", F.when(F.col("mark") != pages_.PLAIN, F.col("mark")).alias("label"), "feats", "shingles"))
    marked = judged.join(labels, "line", "left")
    mark = F.coalesce(F.when(F.col("mark") != pages_.PLAIN, F.col("mark")), F.when(~F.col("story"), F.col("label")), F.lit(pages_.PLAIN))
    per = marked.groupBy("uid", "page_id").agg(
        F.max(F.when(mark.isin(TEMPLATE_IN, TEMPLATE_ONLY), 1).otherwise(0)).alias("template"),
        F.max(F.when((mark == FILLED) | ((F.col("bare")) & ~F.col("story")), 1).otherwise(0)).alias("filler"),
        F.max(F.when(F.col("story"), 1).otherwise(0)).alias("story"),
        F.max(F.when((mark == NOTICED) & ~F.col("story"), 1).otherwise(0)).alias("notice"))
    reason = F.when(F.col("template") == 1, "template").when(F.col("filler") == 1, "filler").when((F.col("story") == 0) & (F.col("notice") == 1), "notice").when(F.col("story") == 0, "no story")
    return per.select("page_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
