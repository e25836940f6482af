"""Term statistics over corpora: frequencies, weights, BM25, co-occurrence, phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X


def token_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token), positions from 0."""
    return docs.select(F.col(key), F.posexplode(X.words(F.col(text))).alias("pos", "token"))


def term_counts(tokens: DataFrame, key: str) -> DataFrame:
    """(key, token, n, first): counts and first positions by document; aggregates before the shuffle."""
    return tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


def term_weights(counts: DataFrame, key: str) -> DataFrame:
    """Relative, logarithmic, augmented and positional frequency of each term of a document."""
    doc = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    return counts.join(doc, key).select(key, "token", (F.col("n") / F.col("total")).alias("tf"), (1 + F.log("n")).alias("log_tf"), (0.5 + 0.5 * F.col("n") / F.col("top")).alias("aug_tf"), F.pow(F.lit(0.9), F.col("first")).alias("positional"))


def idf(counts: DataFrame, documents: int) -> DataFrame:
    """(token, df, idf), smoothed: ln((N + 1) / (df + 1)) + 1."""
    df = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(documents) + 1.0) / (F.col("df") + 1)) + 1)


def tfidf(counts: DataFrame, idfs: DataFrame) -> DataFrame:
    """Logarithmic frequency times idf."""
    return counts.join(idfs, "token").withColumn("tfidf", (1 + F.log("n")) * F.col("idf"))


def bm25(docs: DataFrame, query: list[str], key: str, text: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents that hold a query term; a term named twice counts twice.

    The query's terms are counted in each text's tokens as they are read: nothing but their document frequencies, the number of documents
    and the mean length (of those with tokens) is shuffled.
    """
    terms = sorted(set(query))
    w = docs.select(F.col(key), X.words(F.col(text)).alias("w"))
    tf = [F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = w.select(key, F.size("w").alias("length"), *tf)
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    rows = counted.filter(F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0).crossJoin(F.broadcast(stats))  # one row
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean"))
    part = lambda i, t: query.count(t) * (F.log((F.col("n") + 1.0) / (F.col(f"df{i}") + 1)) + 1) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + norm)
    return rows.select(key, sum((part(i, t) for i, t in enumerate(terms)), F.lit(0.0)).alias("score"))


def _equals(term: str):
    return lambda x: x == term


def cooccurrence(tokens: DataFrame, key: str, window: int = 5) -> DataFrame:
    """(a, b, weight): symmetric counts of neighbours, weighted by 1 / distance. No self-join: each token meets those after it by lead."""
    order = Window.partitionBy(key).orderBy("pos")
    ahead = tokens.select(F.col("token").alias("a"), *[F.lead("token", i).over(order).alias(f"b{i}") for i in range(1, window + 1)])
    pairs = ahead.select("a", F.explode(F.array(*[F.struct(F.col(f"b{i}").alias("b"), F.lit(1.0 / i).alias("w")) for i in range(1, window + 1)])).alias("x")).filter(F.col("x.b").isNotNull()).select("a", F.col("x.b").alias("b"), F.col("x.w").alias("w"))
    one = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """(a, b, ppmi): positive pointwise mutual information of a symmetric co-occurrence table."""
    sums = pairs.groupBy("a").agg(F.sum("weight").alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    out = pairs.join(sums.withColumnRenamed("s", "sa"), "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b").crossJoin(total)
    return out.withColumn("ppmi", F.log(F.col("weight") * F.col("t") / (F.col("sa") * F.col("sb")))).filter(F.col("ppmi") > 0).select("a", "b", "ppmi")


# Words that end a candidate phrase.
PHRASE_STOPS = "a an the and or but of in on at to for with by from as is was were are been be has have had will would can could may might should must it its this that these those he she they them his her their which who whom what when where why how not no".split()


def candidate_phrases(docs: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, phrase): runs of words between stop words, punctuation and digits, of at most so many words of two letters or more."""
    pieces = docs.select(key, F.explode(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), r"[^\w\s]|[0-9]+")).alias("piece"))
    parts = pieces.select(key, F.explode(F.split("piece", r"\b(?:" + "|".join(PHRASE_STOPS) + r")\b")).alias("phrase")).withColumn("phrase", F.trim("phrase"))
    return parts.filter((F.col("phrase") != "") & F.col("phrase").rlike(rf"^\S{{2,}}(?: \S{{2,}}){{0,{most - 1}}}$"))


def rake(phrases: DataFrame, key: str) -> DataFrame:
    """(key, phrase, score): sum of (degree + frequency) / frequency of its words over the root of their number."""
    found = phrases.withColumn("w", F.split("phrase", " "))
    scores = found.select(key, F.explode("w").alias("word"), (F.size("w") - 1).alias("d")).groupBy(key, "word").agg(((F.sum("d") + F.count(F.lit(1))) / F.count(F.lit(1))).alias("s"))
    distinct = found.select(key, "phrase", "w").dropDuplicates([key, "phrase"])
    each = distinct.select(key, "phrase", F.size("w").alias("k"), F.explode("w").alias("word")).join(scores, [key, "word"])
    return each.groupBy(key, "phrase", "k").agg(F.sum("s").alias("s")).select(key, "phrase", (F.col("s") / F.sqrt("k")).alias("score"))


def numbers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, found): money, percentages, multipliers and ISO dates of a text, in any order."""
    families = {
        "money": r"[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:billion|million|thousand|bn|[kmb])\b)?",
        "percent": r"[0-9]+(?:\.[0-9]+)?\s?(?:%|percent)",
        "multiplier": r"\b[0-9]+(?:\.[0-9]+)?\s?(?:x|×|times)\b",
        "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    }
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(0)).alias("found")) for k, p in families.items()])
    return docs.select(key, F.inline(every)).select(key, "kind", F.explode("found").alias("found"))
