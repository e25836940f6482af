"""Queries on the texts of documents and titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import terms
from paperloom.session import cut
from paperloom.sources.tables import table

_WORDS = X.WORD_PATTERN.replace("'", "''")
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = f"tok AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents) d)"
_COUNTS = f"{_TOKENS}, cnt AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first FROM tok GROUP BY ALL)"
#: Terms that the sample search asks for.
SEARCH = ["hospital", "software", "battery", "strike", "council"]


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text")


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_counts(terms.token_rows(_docs(spark, folder), "doc_id", "text"), "doc_id")


def q_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts and first positions."""
    return _counts(spark, folder).select("doc_id", "token", "n", F.col("first").cast("bigint").alias("first"))


def q_content_words(spark: SparkSession, folder: str) -> DataFrame:
    """Content words by document."""
    return _counts(spark, folder).filter(X.is_content(F.col("token"))).select("doc_id", "token", "n")


def q_lexical_variety(spark: SparkSession, folder: str) -> DataFrame:
    """Type-token ratio and share of words used once."""
    return _counts(spark, folder).groupBy("doc_id").agg(F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("unique_ratio"), F.round(F.count_if(F.col("n") == 1) / F.count(F.lit(1)), 6).alias("hapax_ratio"))


def q_term_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Term frequencies in four scalings."""
    w = terms.term_weights(_counts(spark, folder), "doc_id")
    return w.select("doc_id", "token", *[F.round(c, 6).alias(c) for c in ("tf", "log_tf", "aug_tf", "positional")])


def q_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies and inverse ones."""
    n = _docs(spark, folder).count()
    return terms.idf(_counts(spark, folder), n).select("token", "df", F.round("idf", 6).alias("idf"))


def q_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """tf-idf of every term of every document."""
    counts = cut(_counts(spark, folder), "term-counts")  # texts are cut into tokens once
    return terms.tfidf(counts, terms.idf(counts, _docs(spark, folder).count())).select("doc_id", "token", F.round("tfidf", 6).alias("tfidf"))


def q_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """Documents scored for a search."""
    return terms.bm25(_docs(spark, folder), SEARCH, "doc_id", "text").select("doc_id", F.round("score", 6).alias("score"))


def q_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of neighbouring words over all documents."""
    w = _docs(spark, folder).select(X.words(F.col("text")).alias("w"))
    return w.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("x")).groupBy(F.concat_ws(" ", "x.a", "x.b").alias("gram")).agg(F.count(F.lit(1)).alias("n"))


def q_char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Character trigrams of titles."""
    t = table(spark, folder, "items", "title").filter(F.col("title").isNotNull())
    return t.select(F.explode(X.char_ngrams(F.col("title"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def q_text_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Small projections of titles: escaped, cut to 40 characters, length class."""
    t = table(spark, folder, "items", "ordinal", "title").filter(F.col("title").isNotNull())
    return t.select("ordinal", X.escape_html(F.col("title")).alias("escaped"), F.length("title").cast("bigint").alias("chars"), F.size(X.alphanumeric(F.col("title"))).cast("bigint").alias("runs"))


def q_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of summaries by script and function words."""
    t = table(spark, folder, "items", "ordinal", "summary").filter(F.col("summary").isNotNull())
    return t.select("ordinal", X.language(F.col("summary")).alias("lang"))


def q_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric facts by kind."""
    return terms.numbers(_docs(spark, folder), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("found").alias("least"))


def q_rake(spark: SparkSession, folder: str) -> DataFrame:
    """Key phrases of summaries with their scores."""
    t = table(spark, folder, "items", "ordinal", "summary").filter(F.col("summary").isNotNull())
    return terms.rake(terms.candidate_phrases(t, "ordinal", "summary"), "ordinal").select("ordinal", "phrase", F.round("score", 6).alias("score"))


def _title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    t = terms.token_rows(table(spark, folder, "items", "ordinal", "title"), "ordinal", "title")
    return t.filter(X.is_content(F.col("token")))


def q_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    """Content words of titles that stand near each other."""
    return terms.cooccurrence(_title_tokens(spark, folder), "ordinal").select("a", "b", F.round("weight", 6).alias("weight"))


def q_ppmi(spark: SparkSession, folder: str) -> DataFrame:
    """Positive mutual information of those words."""
    return terms.ppmi(terms.cooccurrence(_title_tokens(spark, folder), "ordinal")).select("a", "b", F.round("ppmi", 5).alias("ppmi"))


def q_readability(spark: SparkSession, folder: str) -> DataFrame:
    """Readability formulas of documents: sentences by their ends, words by letters."""
    d = _docs(spark, folder).filter(F.length("text") > 0)
    w = d.select("doc_id", F.greatest(F.lit(1), F.regexp_count("text", F.lit(r"[.!?]+(?:\s|$)"))).alias("sentences"), F.length("text").alias("chars"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)).alias("w"))
    per = w.select("doc_id", "sentences", "chars", F.explode_outer("w").alias("word")).groupBy("doc_id", "sentences", "chars").agg(F.greatest(F.lit(1), F.count("word")).alias("words"), F.coalesce(F.sum(F.when(F.col("word").isNotNull(), X.syllables(F.col("word")))), F.lit(0)).alias("syllables"), F.count_if(F.col("word").isNotNull() & (X.syllables(F.col("word")) >= 3)).alias("poly"))
    ease = 206.835 - 1.015 * F.col("words") / F.col("sentences") - 84.6 * F.col("syllables") / F.col("words")
    fog = 0.4 * (F.col("words") / F.col("sentences") + 100 * F.col("poly") / F.col("words"))
    ari = 4.71 * F.col("chars") / F.col("words") + 0.5 * F.col("words") / F.col("sentences") - 21.43
    return per.select("doc_id", "words", "syllables", F.round(ease, 6).alias("ease"), F.round(fog, 6).alias("fog"), F.round(ari, 6).alias("ari"))


_SQL_SYL = """CASE WHEN length(z) = 0 THEN 0 WHEN length(z) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(z2, '[aeiouy]+')) -
  CASE WHEN regexp_matches(z2, 'e$') AND NOT regexp_matches(z2, '[^aeiouy]le$|ee$|ie$|ye$|oe$') AND len(regexp_extract_all(z2, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END"""
_PHRASE = r"\b(?:" + "|".join(terms.PHRASE_STOPS) + r")\b"
_COOC = f"""tt AS (SELECT ordinal, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (SELECT ordinal, regexp_extract_all(lower(title), '{_WORDS}') AS w FROM items) i),
ct AS (SELECT ordinal, token, row_number() OVER (PARTITION BY ordinal ORDER BY pos) AS p FROM tt WHERE token NOT IN ({_STOPS}) AND length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$')),
pr AS (SELECT x.token AS a, y.token AS b, 1.0 / (y.p - x.p) AS w FROM ct x JOIN ct y ON x.ordinal = y.ordinal AND y.p BETWEEN x.p + 1 AND x.p + 5),
co AS (SELECT a, b, sum(w::DOUBLE) AS weight FROM (SELECT a, b, w FROM pr UNION ALL SELECT b, a, w FROM pr) u GROUP BY a, b)"""

ORACLES = {
    "q_token_counts": f"WITH {_COUNTS} SELECT doc_id, token, n, first FROM cnt",
    "q_content_words": f"WITH {_COUNTS} SELECT doc_id, token, n FROM cnt WHERE token NOT IN ({_STOPS}) AND length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$')",
    "q_lexical_variety": f"WITH {_COUNTS} SELECT doc_id, round(count(*) / sum(n), 6) AS unique_ratio, round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS hapax_ratio FROM cnt GROUP BY doc_id",
    "q_term_weights": f"WITH {_COUNTS} SELECT doc_id, token, round(n / sum(n) OVER d, 6) AS tf, round(1 + ln(n), 6) AS log_tf, round(0.5 + 0.5 * n / max(n) OVER d, 6) AS aug_tf, round(pow(0.9, first), 6) AS positional FROM cnt WINDOW d AS (PARTITION BY doc_id)",
    "q_idf": f"WITH {_COUNTS} SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM cnt GROUP BY token",
    "q_tfidf": f"WITH {_COUNTS}, f AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM cnt GROUP BY token) SELECT doc_id, token, round((1 + ln(n)) * idf, 6) AS tfidf FROM cnt JOIN f USING (token)",
    "q_bm25": f"""WITH {_COUNTS}, f AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1 AS idf FROM cnt GROUP BY token),
len AS (SELECT doc_id, sum(n)::DOUBLE AS l FROM cnt GROUP BY doc_id), m AS (SELECT avg(l) AS mean FROM len)
SELECT doc_id, round(sum(idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * l / mean))), 6) AS score FROM cnt JOIN f USING (token) JOIN len USING (doc_id), m WHERE token IN ({", ".join(f"'{t}'" for t in SEARCH)}) GROUP BY doc_id""",
    "q_bigrams": f"WITH {_TOKENS}, g AS (SELECT token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM tok) SELECT token || ' ' || nxt AS gram, count(*) AS n FROM g WHERE nxt IS NOT NULL GROUP BY gram",
    "q_char_ngrams": "WITH t AS (SELECT ' ' || lower(title) || ' ' AS s FROM items WHERE title IS NOT NULL), g AS (SELECT substr(s, i, 3) AS gram FROM (SELECT s, unnest(range(1, length(s) - 1)) AS i FROM t) x) SELECT gram, count(*) AS n FROM g GROUP BY gram",
    "q_text_columns": """SELECT ordinal, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped, length(title) AS chars, len(regexp_extract_all(lower(title), '[a-z0-9]+')) AS runs FROM items WHERE title IS NOT NULL""",
    "q_numbers": r"""WITH f AS (
SELECT doc_id, 'money' AS kind, unnest(regexp_extract_all(lower(text), '[$€£]\s?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:billion|million|thousand|bn|[kmb])\b)?')) AS found FROM documents UNION ALL
SELECT doc_id, 'percent', unnest(regexp_extract_all(lower(text), '[0-9]+(?:\.[0-9]+)?\s?(?:%|percent)')) FROM documents UNION ALL
SELECT doc_id, 'multiplier', unnest(regexp_extract_all(lower(text), '\b[0-9]+(?:\.[0-9]+)?\s?(?:x|×|times)\b')) FROM documents UNION ALL
SELECT doc_id, 'date', unnest(regexp_extract_all(lower(text), '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b')) FROM documents)
SELECT doc_id, kind, count(*) AS n, min(found) AS least FROM f GROUP BY doc_id, kind""",
    "q_language": "WITH t AS (SELECT ordinal, summary, list_distinct(regexp_extract_all(lower(summary), '[a-zà-ÿ'']+')) AS w FROM items WHERE summary IS NOT NULL), s AS (SELECT ordinal, "
    + ", ".join(f"len(regexp_extract_all(summary, '{p}')) AS s_{k}" for k, p in X.SCRIPTS.items())
    + ", length(summary) AS n, "
    + ", ".join("len(list_intersect(w, [" + ", ".join(f"'{x}'" for x in ws) + f"])) AS f_{k}" for k, ws in X.FUNCTION_WORDS.items())
    + " FROM t), g AS (SELECT *, greatest("
    + ", ".join(f"s_{k}" for k in X.SCRIPTS)
    + ") AS top, greatest("
    + ", ".join(f"f_{k}" for k in X.FUNCTION_WORDS)
    + ") AS best FROM s) SELECT ordinal, CASE WHEN top >= greatest(3.0, n * 0.05) THEN CASE "
    + " ".join(f"WHEN s_{k} = top THEN '{k}'" for k in X.SCRIPTS)
    + " END WHEN best > 0 THEN CASE "
    + " ".join(f"WHEN f_{k} = best THEN '{k}'" for k in sorted(X.FUNCTION_WORDS, reverse=True))
    + " END ELSE 'en' END AS lang FROM g",
    "q_rake": f"""WITH p AS (SELECT ordinal, trim(x) AS phrase FROM (SELECT ordinal, unnest(string_split_regex(piece, '{_PHRASE}')) AS x FROM (SELECT ordinal, unnest(string_split_regex(regexp_replace(lower(summary), '\\s+', ' ', 'g'), '[^\\w\\s]|[0-9]+')) AS piece FROM items WHERE summary IS NOT NULL) q) t),
c AS (SELECT ordinal, phrase, string_split(phrase, ' ') AS w FROM p WHERE regexp_matches(phrase, '^\\S{{2,}}(?: \\S{{2,}}){{0,4}}$')),
s AS (SELECT ordinal, word, (sum(d) + count(*)) / count(*) AS s FROM (SELECT ordinal, unnest(w) AS word, len(w) - 1 AS d FROM c) e GROUP BY ordinal, word),
u AS (SELECT DISTINCT ordinal, phrase, len(w) AS k, w FROM c)
SELECT ordinal, phrase, round(sum(s) / sqrt(k), 6) AS score FROM (SELECT ordinal, phrase, k, unnest(w) AS word FROM u) e JOIN s USING (ordinal, word) GROUP BY ordinal, phrase, k""",
    "q_cooccurrence": f"WITH {_COOC} SELECT a, b, round(weight, 6) AS weight FROM co",
    "q_ppmi": f"WITH {_COOC}, t AS (SELECT a, sum(weight) AS s FROM co GROUP BY a), z AS (SELECT sum(s) AS t FROM t) SELECT co.a, co.b, round(ln(weight * z.t / (x.s * y.s)), 5) AS ppmi FROM co JOIN t x ON co.a = x.a JOIN t y ON co.b = y.a, z WHERE ln(weight * z.t / (x.s * y.s)) > 0",
    "q_readability": f"""WITH d AS (SELECT doc_id, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\\s|$)'))) AS sentences, length(text) AS chars, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, regexp_replace(word, '[^a-z]', '', 'g') AS z FROM (SELECT doc_id, unnest(w) AS word FROM d) x),
y AS (SELECT doc_id, z, CASE WHEN regexp_matches(z, '[^td]ed$') AND length(z) > 3 THEN regexp_replace(z, 'ed$', '') ELSE z END AS z2 FROM e),
c AS (SELECT doc_id, {_SQL_SYL} AS syl FROM y), g AS (SELECT doc_id, count(*) AS words, sum(syl)::BIGINT AS syllables, count(*) FILTER (WHERE syl >= 3) AS poly FROM c GROUP BY doc_id),
a AS (SELECT d.doc_id, sentences, chars, greatest(1, coalesce(words, 0)) AS words, coalesce(syllables, 0) AS syllables, coalesce(poly, 0) AS poly FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, words, syllables, round(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 6) AS ease, round(0.4 * (words / sentences + 100 * poly / words), 6) AS fog, round(4.71 * chars / words + 0.5 * words / sentences - 21.43, 6) AS ari FROM a""",
}
_NAMED = (q_token_counts, q_content_words, q_lexical_variety, q_term_weights, q_idf, q_tfidf, q_bm25, q_bigrams, q_char_ngrams, q_text_columns, q_language, q_numbers, q_rake, q_cooccurrence, q_ppmi, q_readability)
QUERIES = {f.__name__: f for f in _NAMED}
