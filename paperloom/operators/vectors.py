"""Vector search and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of query vectors that are sent to the tasks at once; more queries go in as many blocks as they fill.
BLOCK_BYTES = 64 << 20


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, embedding: str, k: int) -> DataFrame:
    """(query, neighbour, cosine): the k nearest rows of each stated query, the query itself left out, exactly.

    The queries are counted; a block of BLOCK_BYTES of them at most goes to the tasks at once, each of which multiplies its rows, as they
    are read, with the block, and keeps the k best of each query. Only these are shuffled for the final order.
    """
    q = queries.select(F.col(key).alias("q"), F.col(embedding).alias("v"))
    told = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-told["n"] * (told["d"] or 1) * 8 // BLOCK_BYTES))
    rows = vectors.select(F.col(key).alias("r"), F.col(embedding).alias("v"))
    schema = T.StructType([T.StructField("query", vectors.schema[key].dataType), T.StructField("neighbour", vectors.schema[key].dataType), T.StructField("cosine", T.DoubleType())])
    found = None
    for block in range(blocks):
        part = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).toPandas()  # a block's size at most, about
        if not len(part):
            continue
        ids, unit = part["q"].to_numpy(np.int64), _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
        shared = vectors.sparkSession.sparkContext.broadcast((ids, unit))
        one = rows.mapInArrow(_best(shared, k, schema.names), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _best(shared, k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit = shared.value
        best = np.full((len(ids), k), -2.0)
        whose = np.zeros((len(ids), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            like = unit @ _unit(flat.reshape(b.num_rows, -1)).T
            like[ids[:, None] == own[None, :]] = -2
            every, theirs = np.hstack([best, like]), np.hstack([whose, np.broadcast_to(own, like.shape)])
            # Of equal cosines the least key stays, whatever the batches.
            order = np.lexsort((theirs, -every), axis=1)[:, :k]
            best, whose = np.take_along_axis(every, order, 1), np.take_along_axis(theirs, order, 1)
        at = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at[0]]), pa.array(whose[at]), pa.array(best[at])], names=names)

    return run


def kmeans(vectors: DataFrame, key: str, embedding: str, k: int, seed: int = 11) -> DataFrame:
    """(key, cluster) by cosine k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, array_to_vector(F.col(embedding)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20, distanceMeasure="cosine").fit(rows)
    return model.transform(rows).select(key, F.col("prediction").alias("cluster"))


def topics(tokens: DataFrame, key: str, k: int = 8, vocabulary: int = 2000, seed: int = 17) -> DataFrame:
    """(key, topic, share): the strongest topic of each document by online LDA on content words. Its batches are drawn by
    partition, so topics and their numbers depend on the partitioning; a document without words of the vocabulary has an even share."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    docs = tokens.groupBy(key).agg(F.collect_list("token").alias("words"))
    features = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(docs).transform(docs)
    model = LDA(k=k, seed=seed, maxIter=5, optimizer="online").fit(features)
    shares = model.transform(features).select(key, vector_to_array("topicDistribution").alias("d"))
    return shares.select(key, (F.array_position("d", F.array_max("d")) - 1).cast("int").alias("topic"), F.array_max("d").alias("share"))
