"""Coherence of texts, novelty against a corpus, clusters of documents and their labels."""

from __future__ import annotations

import gc
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators.facts import _content
from paperloom.operators.prose import exploded, split_sentences
from paperloom.session import cut

_CASED = re.compile(r"[A-Za-z]+\d[A-Za-z0-9\-]*|[A-Za-z][A-Za-z'\-]*")
#: Cosine under which neighbours begin a new paragraph; sentences of a paragraph at most.
DIP, MOST = 0.06, 4


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    n = sum(a[w] * b[w] for w in a.keys() & b.keys())
    return n / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5


def _names(sentence: str) -> set[str]:
    return {t for t in _CASED.findall(sentence) if (t.isupper() and len(t) > 1) or (t[0].isupper() and len(t) > 2 and not t.isupper())}


def coherence(text: str, terms: list[str] | None = None) -> dict:
    """How well a text holds together: likeness of neighbours, to the whole, shared names, shared words, and sentences with a word of its
    topic (terms, or the five most frequent words), with a score from 0 to 100 and the sentences at which it breaks. A single
    sentence holds together."""
    sentences = split_sentences(text)
    if len(sentences) < 2:
        return {"local": 1.0, "overall": 1.0, "chain": 1.0, "flow": 1.0, "focus": 1.0, "score": 72, "weak": []}
    bags = [Counter(_content(s)) for s in sentences]
    names = [_names(s) for s in sentences]
    whole = sum(bags, Counter())
    topic = {w for t in terms or [] for w in t.lower().split()} or {w for w, _ in whole.most_common(5)}
    chain = [float(bool(a & b)) for a, b in zip(names, names[1:])]
    flow = [len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a or b else 0.0 for a, b in zip(bags, bags[1:])]
    alike = [1.0 if not a and not b else f for f, a, b in zip(flow, bags, bags[1:])]
    pairs = [0.5 * _cosine(a, b) + 0.32 * c + 0.18 * j for a, b, c, j in zip(bags, bags[1:], chain, alike)]
    local, chained, flowing = (float(np.mean(x)) for x in (pairs, chain, flow))
    overall = float(np.mean([_cosine(b, whole) for b in bags]))
    focus = float(np.mean([not topic.isdisjoint(b) for b in bags]))
    raw = 30 * min(1.0, 2.5 * local) + 20 * min(1.0, 1.6 * chained) + 20 * min(1.0, 1.3 * overall) + 12 * min(1.0, 4 * flowing) + 18 * focus
    return {"local": local, "overall": overall, "chain": chained, "flow": flowing, "focus": focus, "score": round(min(100.0, 1.7 * raw)), "weak": [i + 1 for i, v in enumerate(pairs) if v < 0.4 * (local or 1e-6)]}


def topic_drift(sentences: list[str]) -> list[float]:
    """Likeness of each sentence to the first."""
    bags = [Counter(_content(s)) for s in sentences]
    return [round(_cosine(bags[0], b), 4) for b in bags]


def best_place(existing: list[str], new: str) -> int:
    """The place behind the sentence that a new one is most like; the first of equal ones."""
    bag = Counter(_content(new))
    like = [_cosine(bag, Counter(_content(s))) for s in existing]
    return int(np.argmax(like)) + 1 if like else 0


# Words that tell how a sentence follows on the one before.
_RELATIONS = {"contrast": "but however yet still instead despite".split(), "cause": ["because", "so", "therefore", "as a result", "consequently"], "addition": "also additionally further moreover separately".split()}


def relation(before: str, after: str) -> str:
    """contrast, cause, addition, summary or sequence."""
    low, a, b = after.lower(), set(_content(before)), set(_content(after))
    told = next((r for r, ws in _RELATIONS.items() if any(w in low for w in ws)), None)
    return told or ("addition" if not a & b else "summary" if len(b) < len(a) else "sequence")


def paragraph_groups(sentences: list[str], most: int = MOST) -> list[list[str]]:
    """Sentences in paragraphs: a new one begins where a neighbour differs much, or after so many."""
    out: list[list[str]] = []
    bags = [Counter(_content(s)) for s in sentences]
    for i, s in enumerate(sentences):
        if not out or len(out[-1]) >= most or _cosine(bags[i - 1], bags[i]) < DIP:
            out.append([])
        out[-1].append(s)
    return out


def coherence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, local, overall, chain, flow, focus, score, weak): weak is the number of breaks."""
    names = ["local", "overall", "chain", "flow", "focus"]

    def rows(t: str) -> list[tuple]:
        c = coherence(t)
        return [(*(c[n] for n in names), c["score"], len(c["weak"]))]

    return exploded(docs, key, text, rows, [*((n, T.DoubleType()) for n in names), ("score", T.IntegerType()), ("weak", T.IntegerType())], [*[pa.float64()] * 5, pa.int32(), pa.int32()])


# Novelty


def _counts_alike(pairs: DataFrame, key: str) -> DataFrame:
    """(key, cosine, names, shingles) of (key, c, oc, shingles): the cosine of the counts of two lists of words, and their sets' Jaccard."""
    schema = T.StructType([pairs.schema[key], *(T.StructField(c, T.DoubleType()) for c in ("cosine", "names", "shingles"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosines, names = [], []
            for c, oc in zip(batch.column("c").to_pylist(), batch.column("oc").to_pylist()):
                a, b = Counter(c), Counter(oc)
                norm = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
                cosines.append(sum(n * b[t] for t, n in a.items() if t in b) / norm if norm else 0.0)
                names.append(len(a.keys() & b.keys()) / len(a.keys() | b.keys()) if a or b else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(cosines, pa.float64()), pa.array(names, pa.float64()), batch.column("shingles")], names=schema.names)

    return pairs.mapInArrow(run, schema)


def novelty(new: DataFrame, old: DataFrame, key: str, title: str, text: str, least: float = 0.42) -> DataFrame:
    """(key, title_likeness, body_likeness, hash_hit, new_share, score, novel) of new texts against old ones, both (key, title, text).

    The old text that counts is the one most like each new one by five-word shingles, among those with a shingle in common: texts
    without any are as new as can be. Frequent shingles (quoted or repeated by more than a thousandth of the old, ten at least) find
    no candidates, but count in the likeness. new_share is that of sentences none of whose shingles the old have.
    """
    from paperloom.operators import matching

    words = lambda df, *more: cut(df.select(key, X.words(F.col(text)).alias("w"), *more), "novelty-words")
    five = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])))
    n_words, o_words = words(new, F.col(text).alias("t")), words(old)
    total = o_words.count()
    # The shingles of the old are sent once, and looked at twice where they arrive: for candidates, and for what is known.
    by = Window.partitionBy("h")
    posted = o_words.select(F.col(key).alias("old"), F.explode(five(F.col("w"))).alias("h")).select("old", "h", F.count(F.lit(1)).over(by).alias("n"), (F.col("old") == F.min("old").over(by)).alias("one"))
    rare = posted.filter(F.col("n") <= max(10, total // 1000)).select("old", "h")
    met = n_words.select(key, F.explode(five(F.col("w"))).alias("h")).join(rare, "h").groupBy(key, "old").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy(key).agg(F.max_by("old", F.struct("shared", "old")).alias("old"))
    pair = best.join(o_words.select(F.col(key).alias("old"), F.col("w").alias("ow")), "old").join(n_words.select(key, "w"), key)
    shingled = pair.select(key, X.content_words(F.col("w")).alias("c"), X.content_words(F.col("ow")).alias("oc"), S.jaccard_or_one(five(F.col("w")), five(F.col("ow"))).alias("shingles"))
    body = 0.55 * F.col("cosine") + 0.25 * F.col("names") + 0.20 * F.col("shingles")
    bodies = _counts_alike(shingled, key).select(key, F.bround(body, 4).alias("body_likeness"), (F.col("shingles") >= 0.8).alias("hash_hit"))
    titles = matching.near_titles(new, old.withColumnRenamed(key, "_old"), key, title, "_old", 0.25, best=True).select(key, F.col("likeness").alias("title_likeness"))
    # What the headlines sent is let go: else it stays on disk until the driver happens to collect its garbage.
    gc.collect()
    new.sparkSession.sparkContext._jvm.System.gc()
    sents = n_words.select(key, F.posexplode(F.split("t", r"[.!?]+\s+|\n+")).alias("i", "x")).select(key, "i", X.words(F.col("x")).alias("w")).filter(F.size("w") >= 5)
    sents = cut(sents, "novelty-sentences").select(key, "i", F.explode(five(F.col("w"))).alias("h"))
    known = sents.join(posted.filter("one").select("h", F.lit(1).alias("known")), "h", "left").groupBy(key, "i").agg(F.max("known").alias("known"))
    share = known.groupBy(key).agg(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0)).alias("new_share"))
    out = new.select(key).join(titles, key, "left").join(bodies, key, "left").join(share, key, "left").fillna(0.0, ["title_likeness", "body_likeness"]).fillna(1.0, ["new_share"]).fillna(False, ["hash_hit"])
    score = 0.40 * (1 - F.col("title_likeness")) + 0.30 * (1 - F.col("body_likeness")) + F.when(F.col("hash_hit"), 0.0).otherwise(0.15) + 0.15 * F.col("new_share")
    return out.withColumn("score", F.round(score, 4)).withColumn("novel", F.col("score") >= least)


def angle_difference(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(key, difference): one less the greatest Jaccard of a title's words with one of those before it in the order of the keys. Titles meet on
    their words; the first has no others."""
    w = cut(titles.select(key, F.array_distinct(X.words(F.col(title))).alias("w")).filter(F.size("w") > 0), "angle-words")
    e = w.select(key, F.size("w").alias("n"), F.explode("w").alias("t"))
    a, b = e.alias("a"), e.alias("b")
    shared = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col(f"b.{key}") < F.col(f"a.{key}"))).groupBy(F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("o"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("c"))
    most = shared.groupBy(key).agg(F.max(F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("m"))
    return w.select(key).join(most, key, "left").select(key, F.round(1 - F.coalesce("m", F.lit(0.0)), 4).alias("difference"))


# Clusters


def agglomerate(vectors: np.ndarray, threshold: float = 0.62) -> np.ndarray:
    """Average-link clusters: the two most alike are joined as long as their mean cosine is above the threshold; labels go by first members."""
    v = np.asarray(vectors, float)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    sums = list(v / np.where(norm == 0, 1, norm))  # the mean cosine of two groups is the product of their mean unit vectors
    groups = [[i] for i in range(len(v))]
    like = np.array([[a @ b for b in sums] for a in sums]) if len(v) else np.empty((0, 0))
    np.fill_diagonal(like, -2)
    while len(groups) > 1:
        i, j = np.unravel_index(like.argmax(), like.shape)
        if like[i, j] <= threshold:
            break
        i, j = min(i, j), max(i, j)
        n, m = len(groups[i]), len(groups[j])
        sums[i] = (n * sums[i] + m * sums[j]) / (n + m)
        groups[i] += groups.pop(j)
        sums.pop(j)
        like = np.delete(np.delete(like, j, 0), j, 1)
        like[i] = like[:, i] = [s @ sums[i] for s in sums]
        like[i, i] = -2
    out = np.empty(len(v), int)
    for label, g in enumerate(groups):
        out[g] = label
    return out


def cluster_within(vectors: DataFrame, block: str, key: str, embedding: str, threshold: float = 0.62, most: int = 2000) -> DataFrame:
    """(block, key, cluster): average-link clusters within blocks, at most so many rows of one at a time: a larger block is cut into parts by
    neighbourhood first (buckets of random projections), so that no task holds more."""
    sizes = vectors.groupBy(block).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.transform(F.col(embedding), lambda x, j: x * F.when(F.xxhash64(i, j).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x) > 0)
    sign = F.aggregate(sides, F.lit(0), lambda s, b: s * 2 + b.cast("int"))
    parts = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_n") / (most / 2)))).cast("int")
    rows = vectors.join(sizes, block).withColumn("_part", F.floor(sign / F.pow(F.lit(2), 16 - F.least(F.lit(16), parts))).cast("int"))
    schema = T.StructType([T.StructField(block, vectors.schema[block].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.StringType())])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(key)
        out = []
        for start in range(0, len(df), most):
            part = df.iloc[start : start + most]
            labels = agglomerate(np.stack(part[embedding].to_numpy()), threshold)
            out.append(pd.DataFrame({block: part[block], key: part[key], "cluster": [f"{p}-{start}-{c}" for p, c in zip(part["_part"], labels)]}))
        return pd.concat(out)

    return rows.groupBy(block, "_part").applyInPandas(run, schema)


def cluster_labels(members: DataFrame, tokens: DataFrame, key: str, cluster: str, top: int = 3) -> DataFrame:
    """(cluster, label): the words of a cluster that are frequent in it and rare outside; "General News" where none stands twice."""
    per = members.select(key, cluster).join(tokens.select(key, "token"), key).filter(X.is_content(F.col("token"))).groupBy(cluster, "token").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("token").agg(F.sum("n").alias("all"))
    scored = per.filter(F.col("n") >= 2).join(whole, "token").withColumn("s", F.col("n") * F.col("n") / F.col("all"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("s").desc(), "token"))).filter(F.col("r") <= top)
    named = best.groupBy(cluster).agg(F.initcap(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "token"))), lambda x: x["token"]), " ")).alias("label"))
    return members.select(cluster).distinct().join(named, cluster, "left").select(cluster, F.coalesce("label", F.lit("General News")).alias("label"))


def cluster_sizes(members: DataFrame, cluster: str) -> DataFrame:
    return members.groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))


def largest_cluster(members: DataFrame, cluster: str) -> DataFrame:
    """The cluster with the most members, the least of equal ones, in one row."""
    return cluster_sizes(members, cluster).orderBy(F.col("members").desc(), cluster).limit(1)


# Word vectors


def word_vectors(pairs: DataFrame, dimensions: int = 32, vocabulary: int = 20_000) -> DataFrame:
    """(word, vector) from a table of PPMI (a, b, ppmi): the leading left singular vectors, scaled by the roots of their values.

    The matrix of a vocabulary (the words with the largest sums, at most so many: a documented bound of what the driver factors) is
    multiplied with random directions in the cluster, by joins and sums; the driver only sees vocabulary x dimensions
    numbers.
    """
    words = pairs.groupBy("a").agg(F.sum("ppmi").alias("s")).orderBy(F.col("s").desc(), "a").limit(vocabulary).select("a").orderBy("a")
    names = [r[0] for r in words.collect()]  # vocabulary of them at most
    index = {w: i for i, w in enumerate(names)}
    spark = pairs.sparkSession
    ids = spark.createDataFrame(list(index.items()), "w string, i int")
    m = cut(pairs.join(F.broadcast(ids).withColumnRenamed("w", "a").withColumnRenamed("i", "x"), "a").join(F.broadcast(ids).withColumnRenamed("w", "b").withColumnRenamed("i", "y"), "b").select("x", "y", "ppmi"), "ppmi-cells")
    k = min(dimensions + 8, max(1, len(names)))
    q = np.linalg.qr(np.random.default_rng(7).normal(size=(len(names), k)))[0] if names else np.empty((0, 0))

    def times(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            out = np.zeros(w.shape)
            for b in batches:
                x, y, p = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                np.add.at(out, x, w[y] * p[:, None])
            at = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(out[at]), pa.list_(pa.float64()))], names=["x", "v"])

        rows = m.mapInArrow(run, "x int, v array<double>").groupBy("x").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(k)]).collect()  # a row a word
        out = np.zeros((len(names), k))
        for r in rows:
            out[r["x"]] = r[1:]
        shared.unpersist()
        return out

    if not names:
        return spark.createDataFrame([], "word string, vector array<double>")
    for _ in range(4):  # subspace iteration on the symmetric matrix
        q = np.linalg.qr(times(q))[0]
    values, turn = np.linalg.eigh(q.T @ times(q))
    order = np.argsort(-np.abs(values))[:dimensions]
    vectors = (q @ turn[:, order]) * np.sqrt(np.abs(values[order]))
    return spark.createDataFrame([(w, [float(x) for x in vectors[i]]) for w, i in index.items()], "word string, vector array<double>")


def text_vectors(tokens: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, vector): unit sums of the vectors of a text's words; texts without a known word have none."""
    n = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).join(vectors.withColumnRenamed("word", "token"), "token")
    sums = n.select(key, "n", F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("n") * F.col("x")).alias("x"))
    v = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select(key, F.transform("v", lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm)).alias("vector"))


def related_terms(texts: DataFrame, tokens: DataFrame, vectors: DataFrame, key: str, top: int = 10, least: float = 0.1) -> DataFrame:
    """(key, word, cosine): the words nearest to each text's vector that it does not hold. Word vectors go along with the tasks, vocabulary x dimensions of them."""
    words = vectors.orderBy("word").collect()  # bounded by the vocabulary
    names = np.array([r["word"] for r in words], object)
    m = np.array([r["vector"] for r in words], float)
    m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n) if len(m) else np.empty((0, 1))
    shared = texts.sparkSession.sparkContext.broadcast((names, m.astype(np.float32)))
    own = tokens.groupBy(key).agg(F.collect_set("token").alias("own"))
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("word", T.StringType()), T.StructField("cosine", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        for b in batches:
            ids, rows = b.column(0), []
            v = np.array(b.column(1).to_pylist(), np.float32).reshape(b.num_rows, -1)
            like = v @ m.T if len(m) else np.zeros((b.num_rows, 0))
            for i, mine in enumerate(b.column(2).to_pylist()):
                held, found = set(mine or ()), 0
                for j in np.argsort(-like[i], kind="stable"):
                    if found >= top or like[i, j] <= least:
                        break
                    if names[j] not in held:
                        rows.append((i, names[j], float(like[i, j])))
                        found += 1
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=schema.names)

    return texts.join(own, key, "left").select(key, "vector", "own").mapInArrow(run, schema)


# Topics


def topic_words(model, vocabulary: list[str], spark, top: int = 10) -> DataFrame:
    """(topic, place, word, weight) of a fitted topic model, bounded by topics x top."""
    rows = model.describeTopics(top).collect()
    return spark.createDataFrame([(r["topic"], i + 1, vocabulary[t], float(w)) for r in rows for i, (t, w) in enumerate(zip(r["termIndices"], r["termWeights"]))], "topic int, place int, word string, weight double")


def topic_labels(words: DataFrame, top: int = 3) -> DataFrame:
    """(topic, label): the first words of each topic."""
    return words.filter(F.col("place") <= top).groupBy("topic").agg(F.initcap(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ")).alias("label"))


def topic_coherence(words: DataFrame, tokens: DataFrame, key: str, top: int = 8) -> DataFrame:
    """(topic, coherence): mean pointwise mutual information of pairs of a topic's first words, over the documents that hold both."""
    w = words.filter(F.col("place") <= top).select("topic", "word")
    held = tokens.select(key, F.col("token").alias("word")).distinct()
    total = held.select(key).distinct().count()
    mine = held.join(F.broadcast(w), "word")  # topics x top rows
    df = held.join(F.broadcast(w.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    a, b = mine.alias("a"), mine.alias("b")
    both = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.topic") == F.col("b.topic")) & (F.col("a.word") < F.col("b.word"))).groupBy(F.col("a.topic").alias("topic"), F.col("a.word").alias("x"), F.col("b.word").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    pmi = both.join(df.withColumnRenamed("word", "x").withColumnRenamed("n", "nx"), "x").join(df.withColumnRenamed("word", "y").withColumnRenamed("n", "ny"), "y").withColumn("pmi", F.log(F.col("c") * total / (F.col("nx") * F.col("ny"))))
    return pmi.groupBy("topic").agg(F.round(F.avg("pmi"), 4).alias("coherence"))


def classify_topics(tokens: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, topic, share): the topic whose words' shares, summed over a text's tokens, are greatest; texts without a known word have none."""
    p = words.withColumn("p", F.col("weight") / F.sum("weight").over(Window.partitionBy("word")))
    sums = tokens.select(key, F.col("token").alias("word")).join(F.broadcast(p.select("word", "topic", "p")), "word").groupBy(key, "topic").agg(F.sum("p").alias("s"))
    return sums.groupBy(key).agg(F.max(F.struct("s", (-F.col("topic")).alias("t"))).alias("m"), F.sum("s").alias("all")).select(key, (-F.col("m.t")).alias("topic"), F.round(F.col("m.s") / F.col("all"), 4).alias("share"))
