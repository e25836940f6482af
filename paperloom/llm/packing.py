"""Filling containers of fixed capacity with texts.

Shortest-pack-first over the histogram of lengths: lengths are placed longest first, each into the pack that is
shortest so far and still has room, whole groups of equal packs at a time, so that the work depends on the number of
lengths and not of documents. Documents then find their place by length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from paperloom.session import cut

#: Parts that the documents of one length are ranked in, so that a frequent length is no single task's work.
RANK_PARTS = 256


@dataclass
class Plan:
    """For each length, the ranks at which its places change pattern, and the container and offset of the first of each run."""

    capacity: int
    starts: dict[int, np.ndarray]
    containers: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    used: int


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> Plan:
    """Packs a histogram of lengths, none above the capacity.

    Groups of equal packs are kept by their length so far. A length goes to the shortest group; a group larger than
    what is left of the length is split. Packs that no length is left to fill stay as they are.
    """
    groups: dict[int, list[list[int]]] = {}  # length so far -> runs of containers [first, count]
    order: list[int] = []
    starts: dict[int, list[int]] = {}
    containers: dict[int, list[int]] = {}
    offsets: dict[int, list[int]] = {}
    made = 0

    def put(filled: int, first: int, count: int) -> None:
        if filled not in groups:
            groups[filled] = []
            bisect.insort(order, filled)
        groups[filled].append([first, count])

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, rank = histogram[length], 0
        s, c, o = starts.setdefault(length, []), containers.setdefault(length, []), offsets.setdefault(length, [])
        while left:
            filled = order[0] if order and order[0] + length <= capacity else None
            if filled is None:
                # As many new packs as hold what is left, each filled with equal lengths as far as they fit.
                each = max(1, capacity // length)
                packs = -(-left // each)
                first, made = made, made + packs
                rest = left
                for layer in range(each):
                    n = min(packs, rest)
                    if n <= 0:
                        break
                    s.append(rank)
                    c.append(first)
                    o.append(layer * length)
                    rank += n
                    rest -= n
                full, layers = (left % packs or packs), -(-left // packs)
                put(layers * length, first, full)
                if full < packs:
                    put((layers - 1) * length, first + full, packs - full)
                left = 0
                continue
            run = groups[filled][-1]
            n = min(left, run[1])
            s.append(rank)
            c.append(run[0])
            o.append(filled)
            put(filled + length, run[0], n)
            run[0] += n
            run[1] -= n
            if not run[1]:
                groups[filled].pop()
                if not groups[filled]:
                    del groups[filled]
                    order.pop(0)
            left -= n
            rank += n
    as_array = lambda d: {k: np.array(v, np.int64) for k, v in d.items()}
    return Plan(capacity, as_array(starts), as_array(containers), as_array(offsets), made)


def ranked(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """rows with the column rank, from 0 among the rows of equal key, by parts so that no key is one task's work."""
    part = F.pmod(F.xxhash64(F.col(order)), F.lit(RANK_PARTS)).cast("int")
    parts = rows.withColumn("_part", part)
    sizes = parts.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*key, "_part").orderBy(order)
    return parts.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, [*key, "_part"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def _before(rows: DataFrame) -> DataFrame:
    """rows (doc_id, uid, pieces) with the column before: the pieces of all rows before each, by parts of the uids, so that the numbers leave no gap
    and do not grow with the ids."""
    parts = rows.withColumn("_part", F.pmod(F.xxhash64("uid"), F.lit(RANK_PARTS)).cast("int"))
    sums = parts.groupBy("_part").agg(F.sum("pieces").alias("_sum"))
    start = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row a part
    own = F.coalesce(F.sum("pieces").over(Window.partitionBy("_part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(F.broadcast(start), "_part").select("doc_id", "uid", "pieces", (F.col("_start") + F.col("_own")).alias("before"))


def pack(lengths: DataFrame, capacities: list[tuple[int, int]], doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(pack_id, container, offset, doc_id, piece, first_token, tokens): where each document lies in containers of each capacity.

    capacities: (pack_id, capacity) pairs. A document is whole unless it alone exceeds the capacity; then its first
    pieces fill containers of their own and its last is placed as a document of that length. Documents without tokens
    take no place. Documents that stand twice under one id are placed twice. The driver sees the histogram of lengths
    up to each capacity, never a document.
    """
    docs = lengths.select(F.col(doc_id).alias("doc_id"), F.col(tokens).cast("long").alias("n")).filter(F.col("n") > 0)
    docs = cut(docs.withColumn("uid", F.monotonically_increasing_id()), "lengths")
    spark = lengths.sparkSession
    out = None
    for pack_id, capacity in capacities:
        if capacity is None or capacity < 1:
            continue
        tail = F.pmod(F.col("n") - 1, F.lit(capacity)) + 1
        rows = docs.select("doc_id", "uid", "n", tail.alias("tail"))
        histogram = {r["tail"]: r["count"] for r in rows.groupBy("tail").count().collect()}
        plan = shortest_pack_first(histogram, capacity)
        shared = spark.sparkContext.broadcast(plan)
        schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("tail", T.LongType()), T.StructField("container", T.LongType()), T.StructField("offset", T.LongType())])

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            plan = shared.value
            for b in batches:
                tails, ranks = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                container, offset = np.zeros(len(tails), np.int64), np.zeros(len(tails), np.int64)
                for t in np.unique(tails):
                    at = np.nonzero(tails == t)[0]
                    run = np.searchsorted(plan.starts[t], ranks[at], side="right") - 1
                    container[at] = plan.containers[t][run] + ranks[at] - plan.starts[t][run]
                    offset[at] = plan.offsets[t][run]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container), pa.array(offset)], names=schema.names)

        placed = ranked(rows, ["tail"], "uid").select("doc_id", "n", "tail", "rank").mapInArrow(place, schema)
        last = placed.select("doc_id", "container", "offset", ((F.col("n") - F.col("tail")) / capacity).cast("int").alias("piece"), (F.col("n") - F.col("tail")).alias("first_token"), F.col("tail").alias("tokens"))
        # Full pieces need no plan: their containers are numbered by document after those of the plan, counted downwards from -1.
        long = _before(rows.filter(F.col("n") > capacity).select("doc_id", "uid", ((F.col("n") - F.col("tail")) / capacity).cast("long").alias("pieces")))
        whole = long.select("doc_id", "before", F.explode(F.sequence(F.lit(0), F.col("pieces").cast("int") - 1)).alias("piece"))
        whole = whole.select("doc_id", (-1 - (F.col("before") + F.col("piece"))).alias("container"), F.lit(0).cast("long").alias("offset"), "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"))
        one = last.unionByName(whole).select(F.lit(pack_id).alias("pack_id"), "container", "offset", "doc_id", "piece", "first_token", "tokens")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.select(F.lit(0).alias("pack_id"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("offset"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n").toDF("pack_id", "container", "offset", "doc_id", "piece", "first_token", "tokens").filter(F.lit(False))
    return out


def use(packed: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """(pack_id, capacity, containers, tokens, share_used) of a packing."""
    sizes = F.create_map(*[F.lit(x) for pair in capacities for x in pair])
    totals = packed.groupBy("pack_id", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    return totals.withColumn("capacity", sizes[F.col("pack_id")]).withColumn("share_used", F.col("tokens") / (F.col("containers") * F.col("capacity")))
