"""Queries on forms, tags, facts and scores of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import morphology as M
from paperloom.functions import normal as N
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators import facts, matching, prose, scores, tagging, terms
from paperloom.operators.pages import plain
from paperloom.plans.stories import _PAIRS, _pairs
from paperloom.plans.text import _SQL_SYL, _STOPS, _WORDS, _docs
from paperloom.session import cut
from paperloom.sources.tables import table

#: The phrase that keyword queries ask about, the terms that titles are matched with, and categories by their words.
PHRASE = "data storage"
TERMS = ["battery recycling", "port security", "vaccine storage", "recalls", "open inquiry into satellite launches", "hospital"]
LEXICON = {"Transport": "rail tickets|port|trains|road|truck fleets|shipping fees", "Health": "vaccine storage|hospitals|hospital budgets|doctors|clinics", "Technology": "software|chip|battery pack|laptop|data storage|camera", "Politics": "inquiry|regulators|council|auditors|lawmakers", "Sport": "football transfers|fans|runners"}


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items", "ordinal", "title").filter(F.col("title").isNotNull())


def q_folded_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles with plain punctuation in one line."""
    return _titles(spark, folder).select("ordinal", F.trim(F.regexp_replace(N.fold_quotes(F.col("title")), r"\s+", " ")).alias("folded"))


def q_normal_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles in normal form, cleaned as headlines, and as slugs."""
    t = F.col("title")
    return _titles(spark, folder).select("ordinal", N.squish(t).alias("normal"), N.clean_headline(t).alias("headline"), N.slugify(t).alias("slug"), F.length(N.strip_accents(t)).alias("letters"))


def q_word_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Plurals, measures and contractions of the vocabulary of titles."""
    w = terms.token_rows(_titles(spark, folder), "ordinal", "title").select("token").distinct()
    t = F.col("token")
    return w.select("token", M.pluralize(t).alias("plural"), M.measure(t).cast("bigint").alias("measure"), F.array_join(M.expand_contractions(t), " ").alias("parts"))


def q_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Stems and lemmas of the vocabulary of documents."""
    return terms.token_rows(_docs(spark, folder), "doc_id", "text").select("token").distinct().select("token", M.stem_column("token").alias("stem"), M.lemma_column("token").alias("lemma"))


def q_time_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events by night and day at a place six hours east, and the share of a day's quota open by then."""
    e = table(spark, folder, "events", "ts", "event_type").withColumn("at", F.col("ts").cast("timestamp"))
    zone = "Asia/Dhaka"
    e = e.select("event_type", N.in_time_window(F.col("at"), "22:00-06:00", zone).alias("night"), N.paced_allowance(24, F.col("at"), zone).alias("allowed"), N.today_key(F.col("at"), zone).alias("day"))
    return e.groupBy("event_type", "night").agg(F.count(F.lit(1)).alias("n"), F.sum("allowed").alias("allowed"), F.count_distinct("day").alias("days"))


def q_readability_full(spark: SparkSession, folder: str) -> DataFrame:
    """All readability formulas of documents."""
    c = scores.text_counts(_docs(spark, folder), "doc_id", "text")
    return c.select("doc_id", "letters", "long_words", "complex_words", "stopwords", *[F.round(f(), 6).alias(n) for n, f in scores.FORMULAS.items()])


def q_reading_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Reading scores and bands of documents."""
    d = _docs(spark, folder)
    return scores.readability(scores.text_counts(d, "doc_id", "text"), scores.rhythm(d, "doc_id", "text"), "doc_id").select("doc_id", F.round("average_grade", 4).alias("average_grade"), "band", "score")


def q_rhythm(spark: SparkSession, folder: str) -> DataFrame:
    """Words of paragraphs and sentences of documents."""
    r = scores.rhythm(_docs(spark, folder), "doc_id", "text")
    return r.select("doc_id", F.col("paragraphs").cast("bigint").alias("paragraphs"), F.col("most_sentence_words").cast("bigint").alias("longest"), *[F.round(c, 6).alias(c) for c in ("paragraph_words", "sentence_words", "short_share", "long_share")])


def q_keyword_placement(spark: SparkSession, folder: str) -> DataFrame:
    """Where and how often a phrase stands in documents."""
    d = _docs(spark, folder).filter(F.col("text").isNotNull()).select("doc_id", "text", X.words(F.col("text")).alias("w"))
    d = cut(d, "words").withColumn("at", scores.placement(F.col("text"), F.col("w"), PHRASE))
    return d.select("doc_id", F.col("at.hits").cast("bigint").alias("hits"), F.round("at.density", 6).alias("density"), F.round("at.first", 6).alias("first"), F.round("at.spread", 6).alias("spread"), F.round(scores.prominence(F.col("at")), 6).alias("prominence"), F.round(scores.keyword_density(F.col("w"), PHRASE), 6).alias("share"), F.round(scores.saturation(F.col("text"), PHRASE), 6).alias("saturation"))


def q_bait(spark: SparkSession, folder: str) -> DataFrame:
    """How much titles are bait."""
    t = _titles(spark, folder).select("ordinal", "title", X.words(F.col("title")).alias("w"))
    return t.select("ordinal", F.round(scores.bait_score(F.col("title"), F.col("w")), 6).alias("bait"), F.size(scores.bait_reasons(F.col("title"), F.col("w"))).cast("bigint").alias("reasons"))


def _lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, w) for i, (c, ws) in enumerate(LEXICON.items()) for w in ws.split("|")], "place int, category string, word string")


def q_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of items by a lexicon."""
    i = table(spark, folder, "items", "ordinal", "title", "summary").select("ordinal", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))
    return scores.categories(i, "ordinal", "title", "summary", _lexicon(spark)).select("ordinal", "category", "score")


def q_title_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """Cosines of the word counts of headlines that share a page."""
    p = cut(_pairs(spark, folder).select("ordinal", X.alphanumeric(F.col("title_a")).alias("a"), X.alphanumeric(F.col("title_b")).alias("b")), "title-words")
    return p.select("ordinal", F.round(S.cosine_lists(F.col("a"), F.col("b")), 6).alias("cosine"))


def q_title_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness of headlines that share a page, by keywords and by lemmas."""
    p = _pairs(spark, folder).select("ordinal", "title_a", "title_b")
    k = p.withColumn("ka", matching.keywords(F.col("title_a"))).withColumn("kb", matching.keywords(F.col("title_b")))
    k = k.withColumn("la", matching.lemma_set(X.content_words(X.words(F.col("title_a"))))).withColumn("lb", matching.lemma_set(X.content_words(X.words(F.col("title_b")))))
    k = cut(k, "title-keywords")
    return k.select("ordinal", F.round(S.headline_similarity(F.col("ka"), F.col("kb")), 6).alias("headline"), S.title_similarity(F.col("title_a"), F.col("title_b"), F.col("la"), F.col("lb")).alias("title"))


def _fours(c: str):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 3, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(4)), " ")))


def q_draft_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How much of a draft's four-word runs its article has."""
    d = table(spark, folder, "drafts", "draft_id", "article_id", "body_html").filter(F.col("body_html").isNotNull())
    a = table(spark, folder, "articles", "article_id", "text").filter(F.col("text").isNotNull()).groupBy("article_id").agg(F.min("text").alias("text"))
    w = cut(d.join(a, "article_id").select("draft_id", X.alphanumeric(plain(F.col("body_html"))).alias("dw"), X.alphanumeric(F.col("text")).alias("aw")), "draft-words")
    s = cut(w.filter((F.size("dw") >= 4) & (F.size("aw") >= 4)).select("draft_id", _fours("dw").alias("d"), _fours("aw").alias("a")), "draft-shingles")
    return s.select("draft_id", F.round(S.containment(F.col("d"), F.col("a")), 6).alias("overlap"), S.unique_elements(F.col("d"), F.col("a")).cast("bigint").alias("own"))


def q_draft_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of drafts that their articles lack."""
    d = table(spark, folder, "drafts", "draft_id", "article_id", "body_html").filter(F.col("body_html").isNotNull())
    a = table(spark, folder, "articles", "article_id", "text").groupBy("article_id").agg(F.min("text").alias("text"))
    return d.join(a, "article_id").select("draft_id", F.size(S.unsupported_numbers(plain(F.col("body_html")), F.coalesce("text", F.lit("")))).alias("unsupported"))


def q_similar_headlines(spark: SparkSession, folder: str) -> DataFrame:
    """Later items whose headline is like an accepted one's, with the first such."""
    i = table(spark, folder, "items", "ordinal", "title", "batch_no").filter(F.col("title").isNotNull())
    return matching.near_titles(i.filter("batch_no = 1"), i.filter("batch_no = 0").withColumnRenamed("ordinal", "old"), "ordinal", "title", "old").select("ordinal", "other", F.round("likeness", 6).alias("likeness"))


def q_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that match a term asked for."""
    return matching.trend_matches(_titles(spark, folder), "ordinal", "title", spark.createDataFrame(list(enumerate(TERMS)), "place int, term string"))


def q_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Outlets named in articles."""
    names = [(r[0], r[0], "OUTLET") for r in table(spark, folder, "feeds", "name").collect()]  # a fixed table
    return matching.mentions(table(spark, folder, "articles", "article_id", "text"), "article_id", "text", matching.Gazetteer(names))


def q_related_links(spark: SparkSession, folder: str) -> DataFrame:
    """Items that articles should link to."""
    a = table(spark, folder, "articles", "article_id", "text", "url").filter(F.col("text").isNotNull())
    return matching.link_candidates(a, table(spark, folder, "items", "title", "url").filter("title is not null and url is not null"), "article_id", "text").select("article_id", "url", "place", "relevance")


def q_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Nouns, names and verbs of the sentences of summaries."""
    s = table(spark, folder, "items", "ordinal", "summary")
    return tagging.sentence_profile(tagging.tag_rows(s, "ordinal", "summary"), "ordinal")


def q_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Noun phrases of summaries."""
    return tagging.phrase_rows(table(spark, folder, "items", "ordinal", "summary"), "ordinal", "summary")


def q_number_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of documents with values and units."""
    return facts.number_rows(_docs(spark, folder), "doc_id", "text")


def q_number_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Figures of documents in one row each."""
    return facts.number_summary(facts.number_rows(_docs(spark, folder), "doc_id", "text"), "doc_id")


def q_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Names of summaries with their kinds."""
    return facts.entity_rows(table(spark, folder, "items", "ordinal", "summary"), "ordinal", "summary")


def q_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of articles."""
    return facts.fact_rows(table(spark, folder, "articles", "article_id", "text"), "article_id", "text")


def q_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Search terms of summaries."""
    return facts.keyword_rows(table(spark, folder, "items", "ordinal", "summary"), "ordinal", "summary")


def q_sentence_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of documents that mention a figure's word."""
    return facts.sentences_mentioning(prose.sentence_rows(_docs(spark, folder), "doc_id", "text"), "percent").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_FOLD = "replace(replace(replace(replace(replace(translate(regexp_replace(title, '[\ufeff\u200b\u200c\u200d\u2060]', '', 'g'), '‘’‛‹›“”‟«»–−⁃\u00a0\u2007\u202f\u2009\u200a•·●▪‣', '''''''''''\"\"\"\"\"---     *****'), '—', ' - '), '―', ' - '), '…', '...'), '½', '1/2'), '¼', '1/4')"
_T = "FROM items WHERE title IS NOT NULL"
_DCOUNTS = f"""d AS (SELECT doc_id, text, greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\\s|$)'))) AS sentences, length(text) AS characters, regexp_extract_all(lower(text), '{_WORDS}') AS w, regexp_extract_all(lower(text), '[a-z'']+') AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, regexp_replace(word, '[^a-z]', '', 'g') AS z FROM (SELECT doc_id, unnest(l) AS word FROM d) x), y AS (SELECT doc_id, z, CASE WHEN regexp_matches(z, '[^td]ed$') AND length(z) > 3 THEN regexp_replace(z, 'ed$', '') ELSE z END AS z2 FROM e),
g AS (SELECT doc_id, sum(syl)::BIGINT AS syl, count(*) FILTER (WHERE syl >= 3) AS poly FROM (SELECT doc_id, {_SQL_SYL} AS syl FROM y) c GROUP BY doc_id),
n AS (SELECT doc_id, sentences, characters, greatest(1, len(w)) AS words, len(l) AS letters, coalesce(syl, 0) AS syl, coalesce(poly, 0) AS poly, len(list_filter(w, lambda t: length(t) > 7)) AS long_words, len(list_filter(w, lambda t: length(t) > 2 AND regexp_matches(t, '{scores.COMPLEX}'))) AS complex_words, len(list_filter(w, lambda t: t IN ({_STOPS}))) AS stopwords FROM d LEFT JOIN g USING (doc_id))"""
_PARTS = f"lambda p: len(regexp_extract_all(lower(p), '{_WORDS}'))"
_LEX = ", ".join(f"({i}, '{c}', '{w}')" for i, (c, ws) in enumerate(LEXICON.items()) for w in ws.split("|"))
_P, (_A, _B) = PHRASE, PHRASE.split()
_CNT = lambda x, w: f"len(list_filter({x}, lambda t: t = '{w}'))"

ORACLES = {
    "q_folded_titles": f"SELECT ordinal, trim(regexp_replace(replace({_FOLD}, '¾', '3/4'), '\\s+', ' ', 'g')) AS folded {_T}",
    "q_word_forms": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '{_WORDS}')) AS token FROM items) SELECT token, CASE WHEN regexp_matches(token, '(?:s|x|z|ch|sh)$') THEN token || 'es' WHEN regexp_matches(token, '[^aeiou]y$') THEN token[:-2] || 'ies' WHEN regexp_matches(token, 'fe?$') THEN regexp_replace(token, 'fe?$', 'ves') ELSE token || 's' END AS plural,
len(regexp_extract_all(token, '[aeiouy]+[^aeiouy]+')) AS measure, CASE WHEN suffix(token, 'n''t') THEN token[:-4] || ' not' ELSE regexp_replace(token, '''(?:s|re|ve|ll|d|m)$', '') END AS parts FROM w""",
    "q_time_windows": "WITH e AS (SELECT event_type, ts::TIMESTAMP + INTERVAL 6 HOUR AS l FROM events), m AS (SELECT event_type, l, hour(l) * 60 + minute(l) AS m FROM e) SELECT event_type, (m >= 1320 OR m < 360) AS night, count(*) AS n, sum(least(24, greatest(1, ceil(24 * (m + 90) / 1440.0)::INT)))::BIGINT AS allowed, count(DISTINCT l::DATE) AS days FROM m GROUP BY 1, 2",
    "q_readability_full": f"""WITH {_DCOUNTS} SELECT doc_id, letters, long_words, complex_words, stopwords, round(206.835 - 1.015 * words / sentences - 84.6 * syl / words, 6) AS ease, round(0.39 * words / sentences + 11.8 * syl / words - 15.59, 6) AS grade, round(0.4 * (words / sentences + 100 * poly / words), 6) AS fog,
round(CASE WHEN sentences < 3 THEN 0.0 ELSE 1.0430 * sqrt(poly * 30 / sentences) + 3.1291 END, 6) AS smog, round(4.71 * characters / words + 0.5 * words / sentences - 21.43, 6) AS ari, round(5.88 * letters / words - 29.6 * sentences / words - 15.8, 6) AS liau, round(15.79 * long_words / words + 0.0496 * words / sentences + 3.6365, 6) AS chall,
round(CASE WHEN letters = 0 THEN 0.0 ELSE syl / letters END, 6) AS syllables_a_word FROM n""",
    "q_rhythm": f"""WITH d AS (SELECT doc_id, list_transform(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: length(trim(p)) > 0), {_PARTS}) AS p, list_filter(list_transform(string_split_regex(text, '[.!?]+\\s+|\\n+'), {_PARTS}), lambda n: n > 0) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(p) AS paragraphs, coalesce(list_max(s), 0) AS longest, round(CASE WHEN len(p) = 0 THEN 0.0 ELSE list_sum(p) / len(p) END, 6) AS paragraph_words, round(CASE WHEN len(s) = 0 THEN 0.0 ELSE list_sum(s) / len(s) END, 6) AS sentence_words, round(CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_filter(s, lambda n: n <= 14)) / len(s) END, 6) AS short_share,
round(CASE WHEN len(s) = 0 THEN 0.0 ELSE len(list_filter(s, lambda n: n >= 28)) / len(s) END, 6) AS long_share FROM d""",
    "q_keyword_placement": f"""WITH d AS (SELECT doc_id, lower(text) AS low, text, regexp_extract_all(lower(text), '{_WORDS}') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, len(regexp_extract_all(low, '\\b{_P}\\b')) AS h0, greatest(1, length(low)) AS size, position('{_P}' IN low) AS place, length(low) - position('{_P[::-1]}' IN reverse(low)) - {len(_P)} + 1 AS last FROM d),
m AS (SELECT *, CASE WHEN h0 > 0 THEN h0 ELSE least({_CNT("w", _A)}, {_CNT("w", _B)}) END AS hits, CASE WHEN place > 0 THEN (place - 1) / size ELSE 1.0 END AS first, CASE WHEN place > 0 THEN (last - (place - 1)) / size ELSE 0.0 END AS spread, list_transform(list_filter(list_transform(string_split_regex(text, '\\n{{2,}}|</p>'), lambda p: regexp_extract_all(lower(p), '{_WORDS}')), lambda q: len(q) >= 8), lambda q: len(list_filter(q, lambda t: t IN ('{_A}', '{_B}'))) / len(q)) AS r FROM h)
SELECT doc_id, hits, round(hits / greatest(1, len(w)) * 100, 6) AS density, round(first, 6) AS first, round(spread, 6) AS spread, round(CASE WHEN hits = 0 THEN 0.0 ELSE 0.6 * (1 - least(1.0, first)) + 0.4 * least(1.0, ln(1 + hits) / ln(9)) END, 6) AS prominence,
round(CASE WHEN len(w) = 0 THEN 0.0 ELSE ((length(array_to_string(w, ' ')) - length(replace(array_to_string(w, ' '), '{_P}', ''))) / {len(_P)})::INT * 2 / len(w) END, 6) AS share, round(least(1.0, greatest(0.0, (coalesce(list_max(r), 0.0) - 0.12) * 4)), 6) AS saturation FROM m""",
    "q_bait": f"""WITH t AS (SELECT ordinal, title, lower(title) AS low, regexp_extract_all(lower(title), '{_WORDS}') AS w {_T}), v(word, x) AS (VALUES {", ".join(f"('{k}', {x}::DOUBLE)" for k, x in scores.HYPE.items())}),
h AS (SELECT ordinal, sum(x) AS hype FROM (SELECT ordinal, unnest(w) AS word FROM t) u JOIN v USING (word) GROUP BY ordinal),
f AS (SELECT ordinal, title, low, len(w) AS n, coalesce(hype, 0.0) AS hype, len(list_filter([{_quoted(scores.CURIOSITY)}], lambda p: contains(low, p))) > 0 AS cur, len(list_filter([{_quoted(scores.URGENCY)}], lambda p: contains(low, p))) > 0 AS urg, regexp_matches(title, '{scores.LISTICLE}') AS lis, len(regexp_extract_all(title, '\\b[A-Z]{{4,}}\\b')) AS caps, len(title) - len(replace(title, '!', '')) AS ex, regexp_matches(title, '\\?\\s*$') AND NOT regexp_matches(title, '[0-9]') AS ask FROM t LEFT JOIN h USING (ordinal))
SELECT ordinal, round(CASE WHEN title = '' THEN 1.0 ELSE least(1.0, CASE WHEN cur THEN 0.34 ELSE 0 END + 0.22 * hype + CASE WHEN urg THEN 0.2 ELSE 0 END + CASE WHEN lis THEN 0.18 ELSE 0 END + least(0.25, 0.12 * caps) + 0.12 * ex + CASE WHEN ask THEN 0.08 ELSE 0 END + CASE WHEN n > 22 THEN 0.1 ELSE 0 END + CASE WHEN n < 4 THEN 0.12 ELSE 0 END) END, 6) AS bait,
cur::BIGINT + (hype > 0)::BIGINT + urg::BIGINT + lis::BIGINT + (caps > 0)::BIGINT + (ex > 0)::BIGINT + ask::BIGINT + (n > 22)::BIGINT + (n < 4)::BIGINT AS reasons FROM f""",
    "q_categories": f"""WITH x(place, category, word) AS (VALUES {_LEX}), t AS (SELECT ordinal, ' ' || array_to_string(regexp_extract_all(lower(coalesce(title, '')), '{_WORDS}'), ' ') || ' ' AS a, ' ' || array_to_string(regexp_extract_all(lower(coalesce(summary, '')), '{_WORDS}'), '  ') || ' ' AS b FROM items),
s AS (SELECT ordinal, place, category, sum(CASE WHEN contains(a, ' ' || word || ' ') THEN 3.0 ELSE 0.0 END + 0.5 * least(3, ((length(b) - length(replace(b, ' ' || replace(word, ' ', '  ') || ' ', ''))) / (length(replace(word, ' ', '  ')) + 2))::INT)) AS s FROM t, x GROUP BY ALL)
SELECT ordinal, category, s::DOUBLE AS score FROM s WHERE s >= 2 QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY s DESC, place) = 1""",
    "q_title_cosines": f"""WITH {_PAIRS}, a AS (SELECT ordinal, t, count(*)::DOUBLE AS n FROM (SELECT ordinal, unnest(regexp_extract_all(lower(ta), '[a-z0-9]+')) AS t FROM p) u GROUP BY ALL), b AS (SELECT ordinal, t, count(*)::DOUBLE AS n FROM (SELECT ordinal, unnest(regexp_extract_all(lower(tb), '[a-z0-9]+')) AS t FROM p) u GROUP BY ALL),
d AS (SELECT ordinal, sum(a.n * b.n) AS d FROM a JOIN b USING (ordinal, t) GROUP BY ordinal), na AS (SELECT ordinal, sqrt(sum(n * n)) AS x FROM a GROUP BY ordinal), nb AS (SELECT ordinal, sqrt(sum(n * n)) AS y FROM b GROUP BY ordinal) SELECT ordinal, round(coalesce(d / (x * y), 0.0), 6) AS cosine FROM p LEFT JOIN d USING (ordinal) LEFT JOIN na USING (ordinal) LEFT JOIN nb USING (ordinal)""",
    "q_draft_overlap": """WITH a AS (SELECT article_id, min(text) AS text FROM articles WHERE text IS NOT NULL GROUP BY article_id), w AS (SELECT draft_id, regexp_extract_all(lower(trim(regexp_replace(regexp_replace(body_html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), '[a-z0-9]+') AS dw, regexp_extract_all(lower(text), '[a-z0-9]+') AS aw FROM drafts JOIN a USING (article_id) WHERE body_html IS NOT NULL),
s AS (SELECT draft_id, list_distinct(list_transform(range(1, len(dw) - 2), lambda i: array_to_string(dw[i:i + 3], ' '))) AS d, list_distinct(list_transform(range(1, len(aw) - 2), lambda i: array_to_string(aw[i:i + 3], ' '))) AS a FROM w WHERE len(dw) >= 4 AND len(aw) >= 4) SELECT draft_id, round(len(list_intersect(d, a)) / len(d), 6) AS overlap, len(d) - len(list_intersect(d, a)) AS own FROM s""",
}
_NAMED = (
    q_folded_titles, q_normal_titles, q_word_forms, q_vocabulary, q_time_windows, q_readability_full, q_reading_scores, q_rhythm, q_keyword_placement, q_bait, q_categories, q_title_cosines, q_title_likeness, q_draft_overlap,
    q_draft_numbers, q_similar_headlines, q_trends, q_mentions, q_related_links, q_tags, q_phrases, q_number_facts, q_number_summary, q_entities, q_facts, q_keywords, q_sentence_numbers,
)
QUERIES = {f.__name__: f for f in _NAMED}
