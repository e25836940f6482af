"""Parts of a published page: slugs, titles, descriptions, headings, links, social tags, structured data, and their audit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import normal as N
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators import pages

# Bengali letters, vowel signs and digits by what stands for them in Latin letters.
BENGALI = {
    latin: letters.split()
    for latin, letters in {
        "o": "অ", "a": "আ া", "i": "ই ঈ ি ী", "u": "উ ঊ ু ূ", "ri": "ঋ ৃ ৄ", "e": "এ ে", "oi": "ঐ ৈ", "ou": "ঔ ৌ", "k": "ক", "kh": "খ", "g": "গ", "gh": "ঘ", "ng": "ঙ ং", "ch": "চ", "chh": "ছ", "j": "জ য", "jh": "ঝ", "n": "ঞ ণ ন ঁ",
        "t": "ট ত ৎ", "th": "ঠ থ", "d": "ড দ", "dh": "ঢ ধ", "p": "প", "f": "ফ", "b": "ব", "v": "ভ", "m": "ম", "r": "র ড়", "rh": "ঢ়", "l": "ল", "sh": "শ ষ", "s": "স", "h": "হ ঃ", "y": "য়",
        "0": "০", "1": "১", "2": "২", "3": "৩", "4": "৪", "5": "৫", "6": "৬", "7": "৭", "8": "৮", "9": "৯", "": "্",
    }.items()
}
BENGALI["o"].append("ো")
BENGALI["o"].append("ও")
_LATIN = {sign: latin for latin, signs in BENGALI.items() for sign in signs}
_PAIRED = re.compile("|".join(sorted(map(re.escape, _LATIN), key=len, reverse=True)))
#: Words and characters of a slug, characters of a title, of a description and of a heading.
SLUG_WORDS, SLUG_CHARS = 7, 60
TITLE_LEAST, TITLE_IDEAL, TITLE_MOST = 30, 60, 65
META_LEAST, META_MOST = 120, 160
HEADING_MOST, H2_LEAST, H2_MOST = 70, 2, 8
# Headings that say nothing, words that no title may end with, anchors that tell nothing.
GENERIC = "introduction|overview|summary|conclusion|details|more|background|about|general|other|misc|notes|info|information|update|updates|news|story|article|content|read more|see also|related|final thoughts|wrapping up".split("|")
DANGLING = "as|and|or|but|to|of|in|on|at|by|for|with|from|after|over|amid|about|against|during|under|between|the|a|an|says|said|while|that|which|it|its"
ANCHORS = "^(?:read more|click here|this article|here|link|more|source)$"


@F.pandas_udf(T.StringType())
def _romanised(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else _PAIRED.sub(lambda m: _LATIN[m[0]], t))


def transliterate(text: Column) -> Column:
    """Bengali and accented Latin letters in ASCII; other signs than letters and digits become spaces."""
    bengali = F.when(text.rlike("[\\x{0980}-\\x{09FF}]"), _romanised(text)).otherwise(text)
    plain = F.regexp_replace(bengali, r"[^\p{L}\p{M}\p{N}\x00-\x7F]", " ")
    return F.trim(F.regexp_replace(N.to_ascii(plain), r"\s+", " "))


def slug_words(text: Column) -> Column:
    """Distinct words of a slug: no stop words, two characters at least."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(transliterate(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 1) & ~w.isin(*X.STOP_WORDS)))


def slug(title: Column, keyword: Column | None = None) -> Column:
    """The words of a title joined by hyphens, those of the keyword first, as many as fit; "article" where there is none. Expects materialised
    columns."""
    w = slug_words(title)
    if keyword is not None:
        k = F.array_intersect(slug_words(keyword), w)
        w = F.concat(k, F.array_except(w, k))
    w = F.slice(w, 1, SLUG_WORDS)
    # The longest beginning that fits: lengths only grow.
    cut = F.aggregate(w, F.lit(""), lambda s, x: F.when((s == "") & (F.length(x) <= SLUG_CHARS), x).when((s != "") & ~s.endswith("|") & (F.length(s) + F.length(x) + 1 <= SLUG_CHARS), F.concat(s, F.lit("-"), x)).otherwise(F.when(s.endswith("|"), s).otherwise(F.concat(s, F.lit("|")))))
    out = F.regexp_replace(cut, r"\|$", "")
    return F.when(out == "", "article").otherwise(out)


def unique_slugs(posts: DataFrame, key: str, slug_col: str, taken: DataFrame) -> DataFrame:
    """(key, slug): each slug as it is if it is free, else with the next free number behind it, in the order of the keys. taken: (slug)."""
    stem = F.regexp_replace("slug", r"-\d+$", "")
    used = taken.select(F.lower(F.col("slug")).alias("slug")).distinct()
    most = used.withColumn("stem", stem).withColumn("n", F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"), F.lit(1)))
    top = most.groupBy("stem").agg(F.max("n").alias("top"))
    whole = used.withColumn("held", F.lit(True))
    rows = posts.select(key, F.col(slug_col).alias("slug")).withColumn("i", F.row_number().over(Window.partitionBy("slug").orderBy(key)))
    rows = rows.join(whole, "slug", "left").join(top.withColumnRenamed("stem", "slug"), "slug", "left")
    number = F.greatest(F.coalesce("top", F.lit(1)), F.lit(1)) + F.when(F.col("held"), F.col("i")).otherwise(F.col("i") - 1)
    return rows.select(key, F.when(F.col("held").isNull() & (F.col("i") == 1), F.col("slug")).otherwise(F.concat("slug", F.lit("-"), number)).alias("slug"))


def slug_of_url(url: Column) -> Column:
    """The last part of an address's path, without .html."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), "/+$", "")
    return F.lower(F.translate(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.html$", ""), "_", "-"))


def slug_checks(s: Column) -> dict[str, Column]:
    parts = F.split(s, "-")
    return {"slug_length": F.length(s).between(1, SLUG_CHARS), "slug_lowercase": s == F.lower(s), "slug_separators": ~s.rlike("[ _]"), "slug_stopwords": ~F.exists(parts, lambda p: p.isin(*X.STOP_WORDS)), "slug_ascii": ~s.rlike(r"[^\x00-\x7F]"), "slug_words": F.size(parts).between(2, SLUG_WORDS + 2)}


# Titles


def clean_title(title: Column) -> Column:
    """A title without markup, filler behind it, doubled words and rare signs."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), "<[^>]+>", " "), r"\s+", " ")
    t = F.regexp_replace(t, r"(?i)\s*[-|–—:]\s*(?:read more|full story|details|update\d*|news|latest)\s*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[^\w\s\-–—:,'\"&.?%$/€£৳\p{L}]", " "), r"(?i)\b(\w+)\s+\1\b", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-–—:|]+|[ \-–—:|]+$", "")


def trim_dangling(text: Column) -> Column:
    """A title cut back to its last word that means something."""
    bare = F.regexp_replace(text, "[ ,;:-]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, rf"(?i)(?:\s+(?:{DANGLING}))+$", ""), "[ ,;:-]+$", "")


def keyword_first(title: Column, keyword: Column) -> Column:
    """A title whose keyword stands behind its first 40 percent, turned so that it leads."""
    t, k = clean_title(title), F.trim(F.coalesce(keyword, F.lit("")))
    at = F.instr(F.lower(t), F.lower(k)) - 1
    head = F.regexp_replace(F.substr(t, F.lit(1), F.greatest(at, F.lit(0))), "^[ ,;:-]+|[ ,;:-]+$", "")
    turned = F.regexp_replace(F.substring(F.concat(F.regexp_replace(F.trim(F.substr(t, at + 1)), r"\.+$", ""), F.lit(" - "), head), 1, TITLE_MOST), "^[ -]+|[ -]+$", "")
    return F.when((k == "") | (at <= 8) | (at <= F.length(t) * 0.4) | (head == ""), t).otherwise(turned)


def with_brand(title: Column, site: str, limit: int = TITLE_MOST) -> Column:
    """A title with the site's name behind it, as far as both fit."""
    t, tail = clean_title(title), f" | {site}"
    room = limit - len(tail)
    short = F.regexp_replace(F.substring(t, 1, max(room, 1)), r"[ ,-][^ ,-]*$", "")
    fitted = F.concat(trim_dangling(short), F.lit(tail)) if room >= TITLE_LEAST else trim_dangling(F.substring(t, 1, limit))
    return F.substring(t, 1, limit) if not site else F.when(F.length(t) + len(tail) <= limit, F.concat(t, F.lit(tail))).otherwise(fitted)


def title_tag(headline: Column, keyword: Column, site: str, category: Column) -> Column:
    """A page's title: the keyword early, the category behind a short one, the site's name if it fits."""
    t = keyword_first(headline, keyword)
    t = F.when((F.length(t) < TITLE_LEAST) & (F.length(F.coalesce(category, F.lit(""))) > 0), F.substring(F.concat(t, F.lit(" - "), category), 1, TITLE_MOST)).otherwise(t)
    return with_brand(t, site)


def title_candidates(headline: Column, keyword: Column, site: str, category: Column) -> Column:
    """Titles to choose from, each once."""
    plain = clean_title(headline)
    labelled = F.when(F.length(keyword) > 0, with_brand(F.concat(F.initcap(keyword), F.lit(": "), plain), site))
    return F.array_distinct(F.filter(F.array(title_tag(headline, keyword, site, category), with_brand(plain, site), F.substring(plain, 1, TITLE_MOST), labelled), lambda t: t.isNotNull() & (t != "")))


def differs(title: Column, h1: Column, least: float = 0.9) -> Column:
    """Whether a title is no copy of the first heading."""
    a, b = F.lower(clean_title(title)), F.lower(clean_title(h1))
    words = lambda t: F.array_distinct(F.split(t, " "))
    return (a == "") | (b == "") | ((a != b) & (S.jaccard(words(a), words(b)) < least))


def length_score(title: Column) -> Column:
    n = F.length(clean_title(title))
    return F.when(n.between(TITLE_LEAST, TITLE_IDEAL), 1.0).when(n < TITLE_LEAST, F.greatest(F.lit(0.2), n / TITLE_LEAST)).when(n <= TITLE_MOST, 0.85).otherwise(F.greatest(F.lit(0.2), 1 - (n - TITLE_MOST) / 60))


def stuffing_score(title: Column, keywords: list[str]) -> Column:
    """From 0 to 1: repeated words, and keywords that make up more than half."""
    w = F.regexp_extract_all(F.lower(clean_title(title)), F.lit("[a-z0-9]+"), F.lit(0))
    n = F.greatest(F.lit(1), F.size(w))
    total = 0.12 * (F.size(w) - F.size(F.array_distinct(w)))
    for k in keywords:
        parts = k.lower().split()
        total = total + F.when(F.size(F.filter(w, lambda t: t.isin(*parts))) / n > 0.5, 0.25).otherwise(0.0)  # noqa: B023
    return F.least(F.lit(1.0), total)


def fitted_description(*candidates: Column, least: int = META_LEAST, most: int = META_MOST) -> Column:
    """The first candidate that fits, whole or cut at a clause that loses no figure; else the first one cut."""
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "")

    def fit(c: Column) -> Column:
        t = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"\.+$", "")
        piece = F.regexp_replace(F.regexp_extract(F.substring(t, 1, most - 1), r"^(.*)(?:[,;] |\.\s)", 1), "[ ,;:-]+$", "")
        words = trim_dangling(F.regexp_replace(F.substring(t, 1, most), r"\s\S*$", ""))
        good = lambda p: (F.length(p) >= least - 25) & (digits(p) == digits(F.substring(t, 1, most)))
        return F.when(F.length(t).between(least, most), t).when((F.length(t) > most) & good(piece), piece).when((F.length(t) > most) & good(words), words)

    first = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates], F.lit(""))
    out = F.coalesce(*[fit(c) for c in candidates], F.regexp_replace(F.substring(first, 1, most), "[ ,;:-]+$", ""))
    return F.when((out == "") | out.rlike(r"[.!?]$"), out).otherwise(F.concat(out, F.lit(".")))


def robots_meta(index: bool = True, follow: bool = True, archive: bool = True, snippet: bool = True, most_snippet: int = -1, image: str = "large", after: str = "") -> str:
    parts = ["index" if index else "noindex", "follow" if follow else "nofollow", "" if archive else "noarchive", "" if snippet else "nosnippet", f"max-snippet:{most_snippet}" if most_snippet >= 0 else "", f"max-image-preview:{image}" if image else "", f"unavailable_after: {after}" if after else ""]
    return ", ".join(p for p in parts if p)


def _map(**pairs: Column) -> Column:
    rows = [x for k, v in pairs.items() for x in (F.lit(k.replace("__", ":")), F.coalesce(v.cast("string"), F.lit("")))]
    return F.map_filter(F.create_map(*rows), lambda k, v: v != "")


def open_graph(title: Column, description: Column, url: Column, image: Column, site: str, published: Column, author: Column) -> Column:
    """Open Graph tags as a map, empty ones left out."""
    has = F.length(F.coalesce(image, F.lit(""))) > 0
    return _map(og__type=F.lit("article"), og__title=F.substring(title, 1, 95), og__description=F.substring(description, 1, 200), og__url=url, og__site_name=F.lit(site), og__locale=F.lit("en_US"), og__image=image, **{"og__image__alt": F.when(has, F.substring(title, 1, 125)), "og__image__width": F.when(has, F.lit("1200")), "og__image__height": F.when(has, F.lit("630"))}, article__published_time=published, article__author=author)


def twitter_card(title: Column, description: Column, image: Column, handle: str = "") -> Column:
    who = f"@{handle.lstrip('@')}" if handle else ""
    return _map(twitter__card=F.lit("summary_large_image"), twitter__title=F.substring(title, 1, 70), twitter__description=F.substring(description, 1, 200), twitter__image=image, twitter__site=F.lit(who), twitter__creator=F.lit(who))


def bare_address(url: Column) -> Column:
    """An address without query and fragment; that of a host alone ends with a slash."""
    u = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    return F.when(u == "", u).when(F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) <= 2, F.concat(F.regexp_replace(u, "/+$", ""), F.lit("/"))).otherwise(u)


def image_alt(headline: Column, keyword: Column, caption: Column, most: int = 120) -> Column:
    base = F.coalesce(F.nullif(F.trim(caption), F.lit("")), F.trim(headline))
    fits = (F.length(keyword) > 0) & ~F.contains(F.lower(base), F.lower(keyword)) & (F.length(base) + F.length(keyword) < most)
    return F.regexp_replace(F.substring(F.when(fits, F.concat(base, F.lit(" - "), keyword)).otherwise(base), 1, most), "[ .,-]+$", "")


# Headings and links


def all_headings(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, no, level, heading) of h1 to h6 in the order of the page; empty ones are left out."""
    found = F.regexp_extract_all(markup, F.lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>"), F.lit(0))
    rows = docs.select(key, F.posexplode(found).alias("no", "raw"))
    rows = rows.select(key, "no", F.substring("raw", 3, 1).cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", ""), r"\s+", " ")).alias("heading"))
    return rows.filter(F.col("heading") != "")


def outline(headings: DataFrame, key: str) -> DataFrame:
    """headings with their depth: how many headings of lower levels they stand under. A heading stands under the last one before it of each level
    lower than its own, unless one lower still has come between."""
    order = Window.partitionBy(key).orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.col("no"))).over(order) for n in range(1, 7)]
    d = headings.select("*", *[x.alias(f"_l{n}") for n, x in enumerate(last, 1)])
    open_ = lambda n: F.col(f"_l{n}").isNotNull() & (F.col("level") > n) & F.coalesce(F.col(f"_l{n}") > F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(f"_l{m}", F.lit(-1)) for m in range(1, n)]), F.lit(False))
    depth = sum((F.when(open_(n), 1).otherwise(0) for n in range(2, 7)), F.when(open_(1), 1).otherwise(0))
    return d.withColumn("depth", depth).drop(*[f"_l{n}" for n in range(1, 7)])


def heading_checks(headings: DataFrame, key: str) -> DataFrame:
    """(key, h1, h2, skipped, longest, generic, questions): numbers of headings, of levels passed over, of headings that say nothing or ask."""
    order = Window.partitionBy(key).orderBy("no")
    d = headings.withColumn("before", F.coalesce(F.lag("level").over(order), F.lit(1)))
    n = lambda c: F.count_if(c)
    bare = F.regexp_replace(F.lower("heading"), "[:?.]+$", "")
    asks = F.col("heading").endswith("?") & F.col("heading").rlike(r"(?i)\b(?:what|why|how|when|where|which|who|is|are|does|can|should)\b")
    return d.groupBy(key).agg(n(F.col("level") == 1).alias("h1"), n(F.col("level") == 2).alias("h2"), n(F.col("level") > F.col("before") + 1).alias("skipped"), F.max(F.length("heading")).alias("longest"), n((F.col("level") == 2) & bare.isin(*GENERIC)).alias("generic"), n(asks).alias("questions"))


def keyword_headings(headings: DataFrame, key: str, keyword: str) -> DataFrame:
    """(key, hits): how often the headings name a keyword."""
    return headings.groupBy(key).agg(F.sum((F.length("heading") - F.length(F.replace(F.lower("heading"), F.lit(keyword.lower()), F.lit("")))) / len(keyword)).cast("long").alias("hits"))


def strengthened(heading: Column, subject: Column) -> Column:
    """A heading that says nothing, made to name the subject; others stay."""
    bare = F.regexp_replace(F.lower(F.trim(heading)), "[:?.]+$", "")
    named = {"details": ("What ", " confirmed"), "overview": ("", " at a glance"), "summary": ("", " in brief"), "background": ("Why ", " matters"), "introduction": ("", " explained"), "conclusion": ("What happens next for ", ""), "update": ("Latest on ", ""), "news": ("", ": what we know")}
    out = F.concat(subject, F.lit(": "), heading)
    for k, (a, b) in named.items():
        out = F.when(bare == k, F.concat(F.lit(a), subject, F.lit(b))).otherwise(out)
    return F.when(bare.isin(*GENERIC) & (F.length(subject) > 0), out).otherwise(F.trim(heading))


def link_rows(docs: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, no, url, anchor, external, nofollow) of all anchors."""
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(markup, F.lit(r'(?is)<a\s+[^>]*href="[^"]+"[^>]*>.*?</a>'), F.lit(0))).alias("no", "raw"))
    return rows.select(key, "no", F.regexp_extract("raw", r'(?i)href="([^"]+)"', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]+>", ""), r"\s+", " ")).alias("anchor"), F.regexp_extract("raw", r'(?i)href="([^"]+)"', 1).rlike("^https?://").alias("external"), F.contains(F.lower("raw"), F.lit("nofollow")).alias("nofollow"))


def link_checks(links: DataFrame, key: str) -> DataFrame:
    """(key, links, external, empty, generic, variety): variety is the share of different anchors, 1 where there is one."""
    low = F.lower("anchor")
    return links.groupBy(key).agg(F.count(F.lit(1)).alias("links"), F.count_if("external").alias("external"), F.count_if(F.col("anchor") == "").alias("empty"), F.count_if(low.rlike(ANCHORS)).alias("generic"), F.round(F.when(F.count(F.lit(1)) < 2, 1.0).otherwise(F.count_distinct(low) / F.count(F.lit(1))), 3).alias("variety"))


def related_box(posts: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """(key, html): a list of links to the first posts (url, title) of each key."""
    p = posts.filter((F.length("url") > 0) & (F.length("title") > 0)).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, "url"))).filter(F.col("_r") <= most)
    item = F.concat(F.lit('<li><a href="'), X.escape_html(F.col("url")), F.lit('" rel="bookmark">'), X.escape_html(F.col("title")), F.lit("</a></li>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", item.alias("i")))), lambda x: x["i"]), "")
    return p.groupBy(key).agg(F.concat(F.lit("<h3>Related coverage</h3><ul>"), body, F.lit("</ul>")).alias("html"))


# Structured data


def _text(c: Column, most: int) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, most), F.lit(""))


def article_schema(headline: Column, description: Column, url: Column, image: Column, published: Column, modified: Column, author: Column, publisher: str, section: Column, keywords: Column, words: Column, language: Column) -> Column:
    """JSON-LD of an article; null without a headline or an address. A change before publication counts as at it; empty properties are left out."""
    named = lambda t, n: F.when(n.isNotNull(), F.struct(F.lit(t).alias("@type"), n.alias("name")))
    node = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("NewsArticle").alias("@type"), F.struct(F.lit("WebPage").alias("@type"), url.alias("@id")).alias("mainEntityOfPage"), _text(headline, 110).alias("headline"), _text(description, 300).alias("description"),
        published.alias("datePublished"), F.greatest(F.coalesce(modified, published), published).alias("dateModified"), language.alias("inLanguage"), words.alias("wordCount"), F.nullif(image, F.lit("")).alias("image"), named("Person", _text(author, 200)).alias("author"),
        named("NewsMediaOrganization", F.lit(publisher)).alias("publisher"), _text(section, 100).alias("articleSection"), F.nullif(F.array_join(F.slice(keywords, 1, 12), ", "), F.lit("")).alias("keywords"))
    return F.when(_text(headline, 110).isNotNull() & (F.length(F.trim(url)) > 0), F.to_json(node))


def schema_problems(document: Column) -> Column:
    """What an article's JSON-LD lacks."""
    at = lambda p: F.get_json_object(document, f"$.{p}")
    tests = [(document.isNull(), "no node"), *((document.isNotNull() & at(p).isNull(), f"no {p}") for p in ("headline", "datePublished", "dateModified", "image")), (document.isNotNull() & at("author").isNull() & at("publisher").isNull(), "no author or publisher"), (F.length(at("headline")) > 110, "long headline")]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))


def list_schema(items: Column, kind: str) -> Column:
    """JSON-LD of a list of (name, url) structs: breadcrumbs (six at most, the last without an address) or a list of pages."""
    crumbs = kind == "BreadcrumbList"
    kept = F.filter(items, lambda x: F.length(x["name" if crumbs else "url"]) > 0)
    kept = F.slice(kept, 1, 6) if crumbs else kept
    n = F.size(kept)
    element = lambda x, i: F.struct(F.lit("ListItem").alias("@type"), (i + 1).alias("position"), _text(x["name"], 110).alias("name"), F.when((i + 1 < n) if crumbs else F.lit(True), x["url"]).alias("item" if crumbs else "url"))
    return F.when(n > 0, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), F.transform(kept, element).alias("itemListElement"))))


def faq_schema(items: Column, most: int = 10, least: int = 6) -> Column:
    """JSON-LD of questions with answers of so many words, from (question, answer) structs."""
    good = F.filter(items, lambda x: (F.length(F.trim(x["question"])) > 0) & (F.size(F.split(F.trim(x["answer"]), r"\s+")) >= least))
    rows = F.transform(F.slice(good, 1, most), lambda x: F.struct(F.lit("Question").alias("@type"), F.substring(x["question"], 1, 200).alias("name"), F.struct(F.lit("Answer").alias("@type"), x["answer"].alias("text")).alias("acceptedAnswer")))
    return F.when(F.size(good) > 0, F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), rows.alias("mainEntity"))))


def organization_schema(name: Column, url: Column, logo: Column) -> Column:
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("NewsMediaOrganization").alias("@type"), _text(name, 110).alias("name"), F.nullif(url, F.lit("")).alias("url"), F.when(F.length(logo) > 0, F.struct(F.lit("ImageObject").alias("@type"), logo.alias("url"))).alias("logo"))
    return F.when(_text(name, 110).isNotNull(), F.to_json(node))


def website_schema(name: Column, url: Column, search: str = "") -> Column:
    action = F.struct(F.lit("SearchAction").alias("@type"), F.lit(search).alias("target"), F.lit("required name=search_term_string").alias("query-input")) if "{search_term_string}" in search else F.lit(None).cast("string")
    return F.when(_text(name, 110).isNotNull(), F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebSite").alias("@type"), _text(name, 110).alias("name"), F.nullif(url, F.lit("")).alias("url"), action.alias("potentialAction"))))


def schema_graph(*documents: Column) -> Column:
    """Several documents in one graph, those that are null left out."""
    bare = [F.regexp_replace(d, r'^\{"@context":"https://schema.org",', "{") for d in documents]
    return F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.concat_ws(",", *bare), F.lit("]}"))


def script_tag(document: Column) -> Column:
    """The script element of a document, in which no sign can end it."""
    safe = F.replace(F.replace(document, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    return F.when(F.length(document) > 0, F.concat(F.lit('<script type="application/ld+json">'), safe, F.lit("</script>"))).otherwise("")


# The audit of a page

# Weights of the kinds of checks.
KINDS = {"title": 1.4, "meta": 1.2, "url": 1.0, "headings": 1.1, "content": 1.0, "links": 0.9, "technical": 0.9}


def audit(docs: DataFrame, key: str, title: str, headline: str, description: str, slug_col: str, markup: str, floor: int = 350) -> DataFrame:
    """(key, kind, name, ok): the checks of a page's title, description, slug, headings, text, links and markup, a row each."""
    t, h, d, s, b = (F.coalesce(F.col(c), F.lit("")) for c in (title, headline, description, slug_col, markup))
    text = pages.plain(b)
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    paragraphs = F.transform(F.regexp_extract_all(b, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.size(F.split(F.trim(F.regexp_replace(p, "<[^>]+>", " ")), r"\s+")))
    heads = heading_checks(all_headings(docs.select(key, F.when(F.lower(b).contains("<h1"), b).otherwise(F.concat(F.lit("<h1>"), h, F.lit("</h1>"), b)).alias("m")), key, "m"), key)
    links = link_checks(link_rows(docs, key, markup), key).withColumnRenamed("generic", "plain_anchors")
    x = docs.select(key, t.alias("t"), h.alias("h"), d.alias("d"), s.alias("s"), b.alias("b"), words.alias("words"), paragraphs.alias("pars")).join(heads, key, "left").join(links, key, "left").fillna(0, ["h1", "h2", "skipped", "longest", "generic", "links", "external", "empty", "plain_anchors"]).fillna(1.0, ["variety"])
    c = F.col
    checks = {
        "title": {"title_present": c("t") != "", "title_length": F.length("t").between(TITLE_LEAST, TITLE_MOST), "title_differs_from_h1": differs(c("t"), c("h")), "title_not_stuffed": stuffing_score(c("t"), []) <= 0.25},
        "meta": {"meta_present": c("d") != "", "meta_length": F.length("d").between(META_LEAST, META_MOST), "meta_unique": F.lower(F.trim("d")) != F.lower(F.trim("h")), "meta_ends_sentence": (c("d") == "") | c("d").rlike(r"[.!?]$")},
        "url": {"slug_present": c("s") != "", **slug_checks(c("s"))},
        "headings": {"single_h1": c("h1") == 1, "h2_count": c("h2").between(H2_LEAST, H2_MOST), "no_skipped_levels": c("skipped") == 0, "heading_length": c("longest") <= HEADING_MOST, "no_generic_headings": c("generic") == 0},
        "content": {"word_count_floor": c("words") >= floor, "word_count_ceiling": c("words") <= 2600, "paragraph_length": ~F.exists("pars", lambda n: n > 90), "has_lists": c("b").rlike("<(?:ul|ol|table)"), "no_filler": ~F.lower("b").rlike("lorem ipsum|todo:|placeholder text")},
        "links": {"has_links": c("links") > 0, "has_external_source": c("external") > 0, "anchor_text_present": c("empty") == 0, "anchor_text_descriptive": c("plain_anchors") == 0, "anchor_variety": c("variety") >= 0.6, "link_count": c("links") <= 60},
        "technical": {"no_inline_scripts": ~F.regexp_replace("b", r'(?s)<script type="application/ld\+json">.*?</script>', "").contains("<script"), "escaped_markup": ~c("b").rlike(r"&(?!#\d+;|#x[0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]{1,31};)"), "no_duplicate_ids": pages.duplicate_ids(c("b")) == 0, "closed_tags": pages.unbalanced(c("b")) == 0},
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, own in checks.items() for n, v in own.items()])
    return x.select(key, F.inline(rows))


def audit_scores(checks: DataFrame, key: str) -> DataFrame:
    """(key, checks, failed, score, weighted): scores from 0 to 100, plain and by the weights of the kinds."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    d = checks.withColumn("w", weight)
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("ok")).alias("failed"), F.round(100 * F.count_if("ok") / F.count(F.lit(1))).cast("int").alias("score"), F.round(100 * F.sum(F.when(F.col("ok"), F.col("w")).otherwise(0.0)) / F.sum("w"), 2).alias("weighted"))


def audit_actions(checks: DataFrame, key: str) -> DataFrame:
    """(key, place, action): failed checks, the kinds that weigh most first."""
    order = {k: i for i, k in enumerate(("title", "meta", "url", "headings", "content", "links", "technical"))}
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("kind"))
    failed = checks.filter(~F.col("ok"))
    return failed.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(rank, "name"))).select(key, "place", F.concat("kind", F.lit("/"), "name").alias("action"))
