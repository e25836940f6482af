"""Queries that select, compare and rank stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.functions import urls as U
from paperloom.operators import stories
from paperloom.sources.tables import table

#: Clock of the queries, so that they repeat.
NOW = "2025-06-01 00:00:00"
BLOCKED = ["horoscope", "giveaway", "recalls"]
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _items(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "items", "ordinal", "title", "url", "host", "source", "category", "published", "summary", "image", "feed_weight", "batch_no")
    return i.withColumn("canonical_key", U.canonical_url(F.col("url"))).withColumn("fingerprint", stories.fingerprint(F.col("title"))).withColumn("age", (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("published")) / 3600.0)


def q_canonical_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical addresses, hosts and short hashes."""
    i = table(spark, folder, "items", "ordinal", "url")
    return i.select("ordinal", U.canonical_url(F.col("url")).alias("page"), U.host_of(F.col("url")).alias("site"), U.short_hash(U.canonical_url(F.col("url"))).alias("key"), U.is_http(F.col("url")).alias("web"))


def q_filter_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many items each filter leaves out, and how many stay."""
    i = _items(spark, folder).filter(F.col("title").isNotNull())
    reason = F.coalesce(stories.filter_reason(F.col("title"), F.col("url"), F.coalesce(F.col("age"), F.lit(0.0)), BLOCKED, 24.0 * 365), F.lit("kept"))
    return i.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("items"))


def q_first_of_page(spark: SparkSession, folder: str) -> DataFrame:
    """The first item of each page."""
    return stories.first_of(_items(spark, folder).select("canonical_key", "ordinal", "title"), "canonical_key", "ordinal")


def q_select_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Later items whose page and headline are both new to the history."""
    i = _items(spark, folder).select("ordinal", "canonical_key", "fingerprint", "batch_no").filter(F.col("fingerprint").isNotNull())
    return stories.unseen(i.filter("batch_no > 0"), i.filter("batch_no = 0")).select("ordinal")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    i = table(spark, folder, "items", "ordinal", "title", "host", "category", "published", "summary", "image", "feed_weight").withColumn("fingerprint", stories.fingerprint(F.col("title"))).filter(F.length("fingerprint") > 0)
    row = F.struct("ordinal", "title", "host", "category", "published", "feed_weight", F.col("image").isNotNull().alias("pictured"), F.coalesce(F.length("summary"), F.lit(0)).alias("summed"))
    # The first of each outlet, then of each headline: outlets are counted on the way, and no text goes along.
    per = i.groupBy("fingerprint", "host").agg(F.min_by(row, "ordinal").alias("r"))
    j = per.groupBy("fingerprint").agg(F.min_by("r", "r.ordinal").alias("r"), F.count("host").alias("outlets")).select("fingerprint", "outlets", "r.*")
    age = (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("published")) / 3600.0
    return j.withColumn("score", stories.score(F.greatest(age, F.lit(0.0)), F.col("feed_weight"), F.col("outlets"), F.col("pictured"), F.col("summed"), 24.0 * 30))


def q_rank_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score of each headline's first item."""
    return _scored(spark, folder).select("ordinal", "outlets", F.round("score", 4).alias("score"))


def q_ranked_stories(spark: SparkSession, folder: str) -> DataFrame:
    """The five best stories of each outlet, and the twenty best of these."""
    from pyspark.sql import Window

    best = Window.partitionBy("host").orderBy(F.col("score").desc(), "ordinal")
    rows = _scored(spark, folder).withColumn("score", F.round("score", 4)).withColumn("place", F.row_number().over(best)).filter("place <= 5")
    return rows.orderBy(F.col("score").desc(), "ordinal").limit(20).select("ordinal", "host", "title", "score")


def q_capped_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty best stories, at most two of an outlet and six of a category at once."""
    rows = _scored(spark, folder).select("ordinal", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("category", F.lit("")).alias("category"), "score")
    return stories.capped_top(rows, [F.col("score").desc(), F.col("ordinal")], {"host": 2, "category": 6}, 30)


def q_story_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy clusters of headlines within a category."""
    i = table(spark, folder, "items", "ordinal", "title", "category").filter(F.col("title").isNotNull())
    rows = i.select("ordinal", F.coalesce("category", F.lit("")).alias("category"), X.content_words(X.words(F.col("title"))).alias("words"))
    return stories.leader_clusters(rows, "category", "ordinal", "words", "ordinal")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Headline pairs that share a page: what redelivered items have to be compared."""
    i = _items(spark, folder).filter(F.col("title").isNotNull()).select("ordinal", "canonical_key", "title")
    one = stories.first_of(i, "canonical_key", "ordinal").select("canonical_key", F.col("ordinal").alias("first"), F.col("title").alias("title_a"))
    return i.join(one, "canonical_key").filter(F.col("ordinal") > F.col("first")).select("first", "ordinal", "title_a", F.col("title").alias("title_b"))


def q_set_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Set similarities of headlines that share a page."""
    p = _pairs(spark, folder).select("ordinal", X.alphanumeric(F.col("title_a")).alias("a"), X.alphanumeric(F.col("title_b")).alias("b"))
    f = {"jaccard": S.jaccard, "dice": S.dice, "overlap": S.overlap, "containment": S.containment}
    return p.select("ordinal", *[F.round(g(F.col("a"), F.col("b")), 6).alias(n) for n, g in f.items()])


def q_edit_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Edit distances of headlines that share a page."""
    p = _pairs(spark, folder)
    return p.select("ordinal", F.levenshtein("title_a", "title_b").cast("bigint").alias("distance"), F.round(S.edit_similarity(F.col("title_a"), F.col("title_b")), 6).alias("similarity"))


def q_jaro_winkler(spark: SparkSession, folder: str) -> DataFrame:
    """Jaro and Jaro-Winkler similarity of part names and their types."""
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(S.jaro(F.col("p_name"), F.col("p_type")), 6).alias("jaro"), F.round(S.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("jaro_winkler"))


_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', ''), ':(?:80|443)$', '')"
_PATH = r"regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/amp(?:\.html)?$', '/'), '/+$', '')"
_QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.') AND NOT regexp_matches(lower(p), '^(?:utm_[^=]*|" + "|".join(U.TRACKING) + r")='))), '&')"
_PAGE = f"('https://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END)"
_FP = rf"array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: w NOT IN ({_STOPS}) AND (length(w) > 2 OR regexp_matches(w, '^[0-9]+$'))))), 1, 12), ' ')"
_SCORED = f"""base AS (SELECT *, {_PAGE} AS page, {_FP} AS fp, (epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch(published))) / 3600.0 AS age FROM items),
outl AS (SELECT fp, count(DISTINCT host) AS outlets FROM base WHERE length(fp) > 0 GROUP BY fp),
fst AS (SELECT * FROM base WHERE length(fp) > 0 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ordinal) = 1),
scored AS (SELECT f.*, outlets, 50 * pow(0.5, coalesce(greatest(age, 0.0), CASE WHEN age IS NULL THEN 0.0 END) / 720.0) + 10 * (feed_weight - 1) + least(30.0, 9.0 * (outlets - 1)) + CASE WHEN image IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN coalesce(length(summary), 0) > 200 THEN 2 ELSE 0 END AS score FROM fst f JOIN outl USING (fp))"""
_PAIRS = f"i AS (SELECT ordinal, {_PAGE} AS page, title FROM items WHERE title IS NOT NULL), o AS (SELECT page, min(ordinal) AS first FROM i GROUP BY page), p AS (SELECT i.ordinal, a.title AS ta, i.title AS tb FROM i JOIN o USING (page) JOIN i a ON a.ordinal = o.first WHERE i.ordinal > o.first)"

ORACLES = {
    "q_filter_reasons": rf"""WITH i AS (SELECT *, len(regexp_extract_all(title, '\p{{L}}')) AS letters, len(regexp_extract_all(title, '[^\P{{L}}\x{{0000}}-\x{{024F}}]')) AS alien FROM items WHERE title IS NOT NULL)
SELECT CASE WHEN len(regexp_extract_all(title, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{M}}\p{{N}}_''’\-]*')) < 4 THEN 'too few words' WHEN regexp_matches(lower(title), '{"|".join(BLOCKED)}') THEN 'blocked word' WHEN regexp_matches(lower(title), '^\s*(?:watch|listen)\s*:|\bpodcast\b|\bsponsored\b|\bwebinar\b') THEN 'listing'
WHEN NOT coalesce(regexp_matches(trim(url), '^https?://[^/?#\s]+'), false) THEN 'address' WHEN (epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch(published))) / 3600.0 > 24.0 * 365 THEN 'too old' WHEN letters = 0 OR alien * 5 >= letters THEN 'not English' ELSE 'kept' END AS reason, count(*) AS items FROM i GROUP BY 1""",
    "q_canonical_urls": f"SELECT ordinal, {_PAGE} AS page, {_HOST} AS site, substr(sha1({_PAGE}), 1, 16) AS key, regexp_matches(trim(url), '^https?://[^/?#\\s]+') AS web FROM items",
    "q_first_of_page": f"WITH i AS (SELECT {_PAGE} AS canonical_key, ordinal, title FROM items) SELECT canonical_key, ordinal, title FROM i QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY ordinal) = 1",
    "q_select_antijoin": f"WITH i AS (SELECT ordinal, batch_no, {_PAGE} AS page, {_FP} AS fp FROM items WHERE title IS NOT NULL) SELECT ordinal FROM i WHERE batch_no > 0 AND page NOT IN (SELECT page FROM i WHERE batch_no = 0) AND fp NOT IN (SELECT fp FROM i WHERE batch_no = 0)",
    "q_rank_score": f"WITH {_SCORED} SELECT ordinal, outlets, round(score, 4) AS score FROM scored",
    "q_ranked_stories": f"WITH {_SCORED} SELECT ordinal, host, title, score FROM (SELECT ordinal, host, title, round(score, 4) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY host ORDER BY round(score, 4) DESC, ordinal) <= 5) t ORDER BY score DESC, ordinal LIMIT 20",
    "q_set_similarity": f"""WITH {_PAIRS}, s AS (SELECT ordinal, list_distinct(regexp_extract_all(lower(ta), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(tb), '[a-z0-9]+')) AS b FROM p),
n AS (SELECT ordinal, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c FROM s)
SELECT ordinal, round(CASE WHEN na + nb - c = 0 THEN 0.0 ELSE c / (na + nb - c) END, 6) AS jaccard, round(CASE WHEN na + nb = 0 THEN 1.0 ELSE 2 * c / (na + nb) END, 6) AS dice,
round(CASE WHEN least(na, nb) = 0 THEN 0.0 ELSE c / least(na, nb) END, 6) AS overlap, round(CASE WHEN na = 0 THEN 0.0 ELSE c / na END, 6) AS containment FROM n""",
    "q_jaro_winkler": "WITH j AS (SELECT p_partkey, p_name, p_type, jaro_similarity(p_name, p_type) AS j, jaro_similarity(lower(p_name), lower(p_type)) AS k, lower(p_name) AS a, lower(p_type) AS b FROM part) SELECT p_partkey, round(j, 6) AS jaro, round(k + (1 - k) * 0.1 * (CASE WHEN left(a, 1) = left(b, 1) THEN 1 ELSE 0 END + CASE WHEN left(a, 2) = left(b, 2) AND length(a) > 1 THEN 1 ELSE 0 END + CASE WHEN left(a, 3) = left(b, 3) AND length(a) > 2 THEN 1 ELSE 0 END + CASE WHEN left(a, 4) = left(b, 4) AND length(a) > 3 THEN 1 ELSE 0 END), 6) AS jaro_winkler FROM j",
}
_NAMED = (q_canonical_urls, q_filter_reasons, q_first_of_page, q_select_antijoin, q_rank_score, q_ranked_stories, q_capped_topk, q_story_clusters, q_set_similarity, q_edit_distance, q_jaro_winkler)
QUERIES = {f.__name__: f for f in _NAMED}
