"""Queries on pages: extraction, audits, sitemaps, robots rules, reports, and what is new in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import coherence, extraction, publishing, seo, terms, vectors
from paperloom.operators.pages import plain
from paperloom.plans.stories import NOW
from paperloom.session import cut
from paperloom.sources.tables import table

ROBOTS = "User-agent: *\nDisallow: /cars\nAllow: /cars/open\nDisallow: /*print=\n\nUser-agent: slowbot\nDisallow: /\n"
SITEMAP_CHUNK = 5000


def _now():
    return F.lit(NOW).cast("timestamp")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts as HTML pages with addresses."""
    d = table(spark, folder, "drafts", "draft_id", "headline", "body_html", "meta_description").filter(F.col("body_html").isNotNull())
    safe = lambda c: X.escape_html(F.coalesce(c, F.lit("")))
    head = F.concat(F.lit('<html lang="en"><head><title>'), safe("headline"), F.lit('</title><meta name="description" content="'), safe("meta_description"), F.lit('"></head><body><nav><p>Home and all the other pages of this site for you</p></nav><article>'))
    return d.select("draft_id", F.concat(F.lit("https://site.example/p/"), F.col("draft_id")).alias("url"), F.concat(head, "body_html", F.lit("</article></body></html>")).alias("html"))


def q_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Articles out of the pages of drafts."""
    return extraction.articles(_pages(spark, folder), "draft_id", "url", "html").select("draft_id", "title", "text", "description", "canonical", "paywalled", F.size("paragraphs").alias("paragraphs"))


def q_page_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of the pages of drafts."""
    p = extraction.parsed(_pages(spark, folder), "html")
    return extraction.fit_images(extraction.images(p, "draft_id", "url")).select("draft_id", "place", "url", "score")


def q_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Articles without the lines that belong to no story."""
    return table(spark, folder, "articles", "article_id", "text").select("article_id", extraction.clean_text(F.col("text")).alias("text"))


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items", "url", "title", "image", "published").filter(F.col("url").isNotNull())


def q_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemap files of items, by their digests."""
    return publishing.sitemap(_posts(spark, folder), _now(), SITEMAP_CHUNK).select(F.col("file").cast("bigint").alias("file"), "urls", F.md5("document").alias("digest"))


def q_sitemap_extras(spark: SparkSession, folder: str) -> DataFrame:
    """Problems and sizes of the news and image sitemaps."""
    p = _posts(spark, folder)
    latest = p.agg(F.max("published")).first()[0]  # one value
    n, i = publishing.news_sitemap(p, F.lit(latest), "Site"), publishing.image_sitemap(p)
    both = n.withColumn("kind", F.lit("news")).unionByName(i.withColumn("kind", F.lit("image")))
    return both.groupBy("kind").agg(F.sum("urls").alias("urls"), F.max(F.length("document")).alias("longest"))


def q_robots(spark: SparkSession, folder: str) -> DataFrame:
    """Items that robots may read, by host."""
    files = table(spark, folder, "feeds", "host").distinct().select("host", F.lit(ROBOTS).alias("text"))
    rules = publishing.robots_rules(files, "host", "text")
    paths = table(spark, folder, "items", "host", "url").filter(F.col("host").isNotNull() & F.col("url").isNotNull()).select("host", F.regexp_replace("url", "^[A-Za-z]+://[^/]*", "").alias("path"))
    return publishing.allowed(paths, rules, "host").groupBy("host").agg(F.count(F.lit(1)).alias("paths"), F.count_if("allowed").alias("allowed"))


def q_run_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of drafts by day with their outcomes and health."""
    d = table(spark, folder, "drafts", "created_at", "quality_score", "words", "body_html")
    status = F.when(F.col("body_html").isNull(), "failed").when(F.col("quality_score") >= 55, "published").otherwise("skipped")
    o = d.select(F.date_format("created_at", "yyyy-MM-dd").alias("run_id"), status.alias("status"), "words", F.col("quality_score").alias("quality"))
    return publishing.healthy(publishing.report(o))


def q_slug_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs of items' addresses and what is right with them."""
    i = table(spark, folder, "items", "ordinal", "url").filter(F.col("url").isNotNull()).withColumn("slug", seo.slug_of_url(F.col("url")))
    return i.select("ordinal", "slug", *[c.alias(n) for n, c in seo.slug_checks(F.col("slug")).items()])


def q_slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs of headlines, each once."""
    d = cut(table(spark, folder, "items", "ordinal", "title").filter(F.col("title").isNotNull()).withColumn("slug", seo.slug(F.col("title"))), "slugs")
    return seo.unique_slugs(d, "ordinal", "slug", d.sparkSession.createDataFrame([], "slug string"))


def q_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Title tags and their scores."""
    t = table(spark, folder, "items", "ordinal", "title", "category").filter(F.col("title").isNotNull())
    tag = seo.title_tag(F.col("title"), F.lit(""), "Site", F.col("category"))
    return t.select("ordinal", tag.alias("tag"), F.round(seo.length_score(tag), 6).alias("length"), F.round(seo.stuffing_score(F.col("title"), []), 6).alias("stuffing"), seo.differs(tag, F.col("title")).alias("differs"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "drafts", "draft_id", "body_html").filter(F.col("body_html").isNotNull())


def q_heading_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Heading structure of drafts."""
    h = seo.heading_checks(seo.all_headings(_bodies(spark, folder), "draft_id", "body_html"), "draft_id")
    return h.select("draft_id", "h1", "h2", "skipped", F.col("longest").cast("bigint").alias("longest"), "generic")


def q_outline(spark: SparkSession, folder: str) -> DataFrame:
    """Depths of the headings of drafts."""
    return seo.outline(seo.all_headings(_bodies(spark, folder), "draft_id", "body_html"), "draft_id")


def q_link_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Links of drafts and their anchors."""
    return seo.link_checks(seo.link_rows(_bodies(spark, folder), "draft_id", "body_html"), "draft_id")


def q_page_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All checks of drafts in scores."""
    d = table(spark, folder, "drafts", "draft_id", "headline", "body_html", "meta_description").dropDuplicates(["draft_id"])
    d = cut(d.withColumn("slug", seo.slug(F.coalesce("headline", F.lit("")))), "audit-drafts").withColumn("tag", seo.with_brand(F.col("headline"), "Site"))
    return seo.audit_scores(seo.audit(d, "draft_id", "tag", "headline", "meta_description", "slug", "body_html"), "draft_id")


def q_article_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """Structured data of articles and what it lacks."""
    a = table(spark, folder, "articles", "article_id", "title", "description", "url", "author", "published", "modified", "keywords", "text", "language", "images")
    image = F.get("images", F.lit(0))["url"]
    doc = seo.article_schema(F.col("title"), F.col("description"), F.col("url"), image, F.col("published"), F.col("modified"), F.col("author"), "Site", F.lit("News"), F.col("keywords"), X.word_count(F.col("text")), F.col("language"))
    return a.select("article_id", doc.alias("document")).select("article_id", "document", F.size(seo.schema_problems(F.col("document"))).alias("problems"))


def q_social_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions and social tags of articles."""
    a = table(spark, folder, "articles", "article_id", "title", "description", "url", "author", "published", "text")
    d = seo.fitted_description(F.col("description"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.col("title"))
    return a.select("article_id", d.alias("description"), F.size(seo.open_graph(F.col("title"), d, F.col("url"), F.lit(""), "Site", F.col("published"), F.col("author"))).alias("tags"))


def q_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """How well articles hold together."""
    return coherence.coherence_rows(table(spark, folder, "articles", "article_id", "text"), "article_id", "text")


def q_novelty(spark: SparkSession, folder: str) -> DataFrame:
    """How new drafts are against articles."""
    d = table(spark, folder, "drafts", "draft_id", "headline", "body_html").dropDuplicates(["draft_id"]).select(F.col("draft_id").alias("id"), F.coalesce("headline", F.lit("")).alias("title"), plain(F.coalesce("body_html", F.lit(""))).alias("text"))
    a = table(spark, folder, "articles", "article_id", "title", "text").dropDuplicates(["article_id"]).select(F.col("article_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return coherence.novelty(d, a, "id", "title", "text")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return terms.token_rows(table(spark, folder, "items", "ordinal", "title"), "ordinal", "title").filter(X.is_content(F.col("token")))


def _word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return coherence.word_vectors(terms.ppmi(terms.cooccurrence(_tokens(spark, folder), "ordinal")), 16)


def q_word_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the words of titles."""
    return _word_vectors(spark, folder)


def q_related_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Words near each title's that it lacks."""
    t, v = _tokens(spark, folder), _word_vectors(spark, folder)
    return coherence.related_terms(coherence.text_vectors(t, v, "ordinal"), t, v, "ordinal", 5)


def q_agglomerative(spark: SparkSession, folder: str) -> DataFrame:
    """Average-link clusters of vectors within their labels."""
    return coherence.cluster_within(table(spark, folder, "embeddings", "vec_id", "embedding", "label"), "label", "vec_id", "embedding")


def q_topic_words(spark: SparkSession, folder: str) -> DataFrame:
    """First words of topics with their coherence and labels."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    t = cut(_tokens(spark, folder), "title-tokens")
    docs = t.groupBy("ordinal").agg(F.collect_list("token").alias("words"))
    counted = CountVectorizer(inputCol="words", outputCol="features", minDF=2).fit(docs)
    model = LDA(k=6, seed=17, maxIter=5, optimizer="online").fit(counted.transform(docs))
    words = coherence.topic_words(model, counted.vocabulary, spark)
    return words.join(coherence.topic_coherence(words, t, "ordinal"), "topic", "left").join(coherence.topic_labels(words), "topic")


_ENTRY = "'  <url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</loc><lastmod>' || strftime(ts0 AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') || '</lastmod><changefreq>' || CASE WHEN d <= 1 THEN 'hourly' WHEN d <= 7 THEN 'daily' WHEN d <= 30 THEN 'weekly' WHEN d <= 180 THEN 'monthly' ELSE 'yearly' END || '</changefreq><priority>' || CASE WHEN d <= 1 THEN '0.9' WHEN d <= 7 THEN '0.8' WHEN d <= 30 THEN '0.6' ELSE '0.4' END || '</priority></url>'"
_HEADINGS = """h AS (SELECT draft_id, unnest(f) AS raw, generate_subscripts(f, 1) AS no FROM (SELECT draft_id, regexp_extract_all(body_html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS f FROM drafts WHERE body_html IS NOT NULL) x),
g AS (SELECT draft_id, no, raw[3:3]::INT AS level, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS heading FROM h)"""

ORACLES = {
    "q_sitemap": f"""WITH p AS (SELECT url, coalesce(published, TIMESTAMPTZ '{NOW}+00') AS ts0 FROM items WHERE url IS NOT NULL AND length(trim(url)) > 0), e AS (SELECT url, ts0, greatest(0.0, (epoch(TIMESTAMPTZ '{NOW}+00') - floor(epoch(ts0))) / 86400.0) AS d FROM p),
x AS (SELECT *, row_number() OVER (ORDER BY ts0 DESC, url) AS n, (ts0 = max(ts0) OVER () AND url = max(url) OVER (PARTITION BY ts0)) AS f FROM e), z AS (SELECT n, (n - 1) // {SITEMAP_CHUNK} AS file, CASE WHEN f THEN replace(replace(replace(replace(s, '<priority>0.9', '<priority>1.0'), '<priority>0.8', '<priority>0.9'), '<priority>0.6', '<priority>0.7'), '<priority>0.4', '<priority>0.5') ELSE s END AS s FROM (SELECT *, {_ENTRY} AS s FROM x) y)
SELECT file, count(*) AS urls, md5('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' || string_agg(s, '\n' ORDER BY n) || '\n</urlset>\n') AS digest FROM z GROUP BY file""",
    "q_robots": "WITH p AS (SELECT host, regexp_replace(url, '^[A-Za-z]+://[^/]*', '') AS path FROM items WHERE host IS NOT NULL AND url IS NOT NULL) SELECT host, count(*) AS paths, count(*) FILTER (WHERE host NOT IN (SELECT host FROM feeds) OR CASE WHEN starts_with(path, '/cars/open') THEN true WHEN regexp_matches(path, '^/.*print=') THEN false ELSE NOT starts_with(path, '/cars') END) AS allowed FROM p GROUP BY host",
    "q_run_reports": """WITH o AS (SELECT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS run_id, CASE WHEN body_html IS NULL THEN 'failed' WHEN quality_score >= 55 THEN 'published' ELSE 'skipped' END AS s, words, quality_score FROM drafts),
r AS (SELECT run_id, count(*) FILTER (WHERE s = 'published') AS published, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) FILTER (WHERE s = 'failed') AS failed, sum(coalesce(words, 0))::BIGINT AS words, round(avg(quality_score), 4) AS quality FROM o GROUP BY run_id) SELECT *, NOT (published = 0 AND (failed > 0 OR published + failed + skipped >= 4)) AS ok FROM r""",
    "q_slug_checks": f"""WITH s AS (SELECT ordinal, lower(replace(regexp_replace(regexp_extract(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1), '\\.html$', ''), '_', '-')) AS slug FROM items WHERE url IS NOT NULL)
SELECT ordinal, slug, length(slug) BETWEEN 1 AND 60 AS slug_length, slug = lower(slug) AS slug_lowercase, NOT regexp_matches(slug, '[ _]') AS slug_separators, len(list_filter(string_split(slug, '-'), lambda p: p IN ({", ".join(f"'{w}'" for w in X.STOP_WORDS)}))) = 0 AS slug_stopwords, NOT regexp_matches(slug, '[^\\x00-\\x7F]') AS slug_ascii, len(string_split(slug, '-')) BETWEEN 2 AND 9 AS slug_words FROM s""",
    "q_heading_checks": f"""WITH {_HEADINGS}, b AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY draft_id ORDER BY no), 1) AS before FROM g WHERE heading <> '')
SELECT draft_id, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level = 2) AS h2, count(*) FILTER (WHERE level > before + 1) AS skipped, max(length(heading)) AS longest, count(*) FILTER (WHERE level = 2 AND regexp_replace(lower(heading), '[:?.]+$', '') IN ({", ".join(f"'{w}'" for w in seo.GENERIC)})) AS generic FROM b GROUP BY draft_id""",
    "q_link_checks": f"""WITH l AS (SELECT draft_id, unnest(regexp_extract_all(body_html, '(?is)<a\\s+[^>]*href="[^"]+"[^>]*>.*?</a>')) AS raw FROM drafts WHERE body_html IS NOT NULL),
a AS (SELECT draft_id, regexp_matches(regexp_extract(raw, '(?i)href="([^"]+)"', 1), '^https?://') AS external, lower(trim(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS anchor FROM l)
SELECT draft_id, count(*) AS links, count(*) FILTER (WHERE external) AS external, count(*) FILTER (WHERE anchor = '') AS empty, count(*) FILTER (WHERE regexp_matches(anchor, '{seo.ANCHORS}')) AS generic, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE count(DISTINCT anchor) / count(*) END, 3) AS variety FROM a GROUP BY draft_id""",
}
_NAMED = (
    q_pages, q_page_images, q_clean_text, q_sitemap, q_sitemap_extras, q_robots, q_run_reports, q_slug_checks, q_slugs, q_titles, q_heading_checks, q_outline, q_link_checks, q_page_audit, q_article_schemas, q_social_tags,
    q_coherence, q_novelty, q_word_vectors, q_related_terms, q_agglomerative, q_topic_words,
)
QUERIES = {f.__name__: f for f in _NAMED}
