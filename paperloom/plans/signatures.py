"""Queries on hashes and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators import hashing, terms, vectors
from paperloom.plans.text import _STOPS, _WORDS
from paperloom.session import cut
from paperloom.sources.tables import table

NEAREST = 5


def q_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """SimHashes of titles on content words."""
    t = terms.token_rows(table(spark, folder, "items", "ordinal", "title"), "ordinal", "title").filter(X.is_content(F.col("token")))
    return hashing.simhash(t, "ordinal")


def q_near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents of five-word shingle sets alike by 0.8 or more."""
    w = cut(table(spark, folder, "documents", "doc_id", "text").select("doc_id", X.words(F.col("text")).alias("w")), "words")
    five = F.arrays_zip(*[F.expr(f"slice(w, {i + 1}, greatest(size(w) - 4, 0))").alias(f"s{i}") for i in range(5)])
    rows = w.select("doc_id", F.when(F.size("w") >= 5, F.transform(five, lambda s: F.xxhash64(*[s[f"s{i}"] for i in range(5)]))).otherwise(F.array(F.xxhash64(F.array_join("w", " ")))).alias("shingles"))
    sets = cut(rows.select("doc_id", F.array_distinct("shingles").alias("shingles")), "shingles")
    each = sets.select("doc_id", F.explode("shingles").alias("shingle"))
    return hashing.near_duplicates(hashing.minhash(each, "doc_id"), sets, "doc_id")


def q_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest neighbours of every twentieth vector among all."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    return vectors.nearest(v, v.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", NEAREST).select("query", "neighbour", F.round("cosine", 5).alias("cosine"))


def q_vector_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Distances of each vector to the mean of its label."""
    v = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    mean = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("centre"))
    j = v.join(mean, "label")
    e, c = F.col("embedding"), F.col("centre")
    return j.select("vec_id", F.round(S.cosine(e, c), 5).alias("cosine"), F.round(S.euclidean(e, c), 5).alias("euclidean"), F.round(S.manhattan(e, c), 4).alias("manhattan"))


def q_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    """Ten clusters of vectors."""
    return vectors.kmeans(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 10)


def q_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest topic of each document."""
    t = terms.token_rows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").filter(X.is_content(F.col("token")))
    return vectors.topics(t, "doc_id")


_BITS = " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) > 0 THEN {1 << b}::BIGINT ELSE 0 END" for b in range(60))
ORACLES = {
    "q_simhash": f"WITH t AS (SELECT ordinal, unnest(regexp_extract_all(lower(title), '{_WORDS}')) AS token FROM items), c AS (SELECT ordinal, ('0x' || substr(md5(token), 1, 15))::BIGINT AS h FROM t WHERE token NOT IN ({_STOPS}) AND length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$')) SELECT ordinal, CAST({_BITS} AS BIGINT) AS simhash FROM c GROUP BY ordinal",
    "q_nearest_vectors": f"WITH p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) SELECT query, neighbour, round(c, 5) AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, neighbour) <= {NEAREST}",
    "q_vector_distances": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS c FROM e GROUP BY label, i), j AS (SELECT vec_id, x, c FROM e JOIN m USING (label, i)) SELECT vec_id, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 5) AS cosine, round(sqrt(sum((x - c) * (x - c))), 5) AS euclidean, round(sum(abs(x - c)), 4) AS manhattan FROM j GROUP BY vec_id",
}
_NAMED = (q_simhash, q_near_documents, q_nearest_vectors, q_vector_distances, q_kmeans, q_topics)
QUERIES = {f.__name__: f for f in _NAMED}
