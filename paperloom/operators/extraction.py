"""Articles out of HTML pages: main text, metadata, structured data, images.

A page is parsed once, in an Arrow batch, into its raw parts (meta tags, JSON-LD, paragraphs, image candidates, title,
language, canonical link); all choices between them are column expressions. The main text is what the paragraphs of the
article's element hold, or JSON-LD's body where that is longer.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import normal as N
from paperloom.functions import text as X
from paperloom.functions import urls as U

# Types of structured data that are articles; marks of a page behind a wall; parts of addresses of images that
# are no pictures; words of paths that tell the same; beginnings of lines that belong to no story.
ARTICLE_TYPES = frozenset("newsarticle article reportagenewsarticle blogposting techarticle analysisnewsarticle reviewnewsarticle".split())
WALLS = "subscribe to continue|subscribers only|to continue reading|paywall|already a subscriber|sign in to read|this article is for subscribers"
JUNK_PARTS = ["/ads/", "adserver", "doubleclick", "banner-ad", "1x1", "spacer.", "blank.gif", "gravatar", "favicon", "sprite", "feedburner", "/assets/brand", "wp-includes", "data:image", ".svg", ".gif"]
JUNK_WORDS = "avatar avatars logo logos icon icons badge badges button buttons tracker tracking pixel emoji placeholder lazyload headshot headshots profile profiles author authors newsletter subscribe sponsor sponsored advert advertisement mugshot".split()
JUNK_LINES = r"(?i)^(?:advertisement|related:|read more|see also|sign up|subscribe|share this|follow us|image credit|photo credit|getty images|© ?\d{4}|all rights reserved)"
ORIGINS = {"og": 40, "jsonld": 35, "feed": 30, "article": 20, "openverse": 15, "page": 5}
#: Words a text needs before JSON-LD's body is preferred to it; words of a paragraph that counts.
ENOUGH, PARAGRAPH = 150, 8

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIPPED = frozenset("script style nav aside footer form noscript iframe".split())
_LAZY = ("data-src", "data-lazy-src", "data-original", "data-url", "src")


def best_of_srcset(srcset: str) -> tuple[str, int]:
    """(address, width) of the widest candidate; the last of equal ones, a missing width being 0."""
    best = ("", 0)
    for part in srcset.split(","):
        bits = part.split()
        if bits:
            width = int(re.sub(r"\D", "", bits[1])[:5] or 0) if len(bits) > 1 and bits[1].endswith("w") else 0
            best = (bits[0], width) if width >= best[1] else best
    return best


class _Page(HTMLParser):
    """One pass over a page. Elements that are never closed end with the element around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.scripts: list[str] = []
        self.title = self.lang = self.canonical = ""
        self.paragraphs: list[tuple[bool, str]] = []
        self.images: list[dict] = []
        self.stack: list[str] = []
        self.scope = 0  # elements of an article that are open
        self._text: list[str] | None = None
        self._caption: list[str] | None = None
        self._figure: dict | None = None
        self._sources = ""
        self._data = False  # within structured data

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name", "")).lower()
            if name and a.get("content", "").strip():
                self.meta.setdefault(name, a["content"])
        elif tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "link" and "canonical" in a.get("rel", "").split():
            self.canonical = self.canonical or a.get("href", "")
        elif tag == "source":
            self._sources = self._sources or a.get("srcset", "")
        elif tag == "img":
            self._image(a)
        if tag in _VOID:
            return
        if tag == "p":
            self._close_paragraph()
            self._text = []
        elif tag == "script":
            self._data = "ld+json" in a.get("type", "").lower()
            self.scripts += [""] * self._data
        elif tag in ("figure", "picture"):
            self._sources = ""
            self._figure = {} if tag == "figure" else self._figure
        elif tag == "figcaption":
            self._caption = []
        elif tag == "title" and not self.title:
            self._text = []
        scoped = tag in ("article", "main") or a.get("itemprop") == "articleBody"
        self.scope += scoped
        self.stack.append(tag + "+" * scoped)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self._text is not None and not self.title:
            self.title, self._text = " ".join("".join(self._text).split()), None
        if tag == "p":
            self._close_paragraph()
        if tag == "figcaption" and self._caption is not None:
            if self._figure is not None:
                self._figure["caption"] = " ".join("".join(self._caption).split())
            self._caption = None
        names = [s.rstrip("+") for s in self.stack]
        if tag in names:
            at = len(names) - 1 - names[::-1].index(tag)
            self.scope -= sum(s.endswith("+") for s in self.stack[at:])
            del self.stack[at:]
        if tag == "figure":
            self._figure = None

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].rstrip("+") == "script":
            if self._data:
                self.scripts[-1] += data
            return
        if self._caption is not None:
            self._caption.append(data)
        if self._text is not None and not any(s.rstrip("+") in _SKIPPED for s in self.stack):
            self._text.append(data)

    def _close_paragraph(self) -> None:
        if self._text is not None and "title" not in [s.rstrip("+") for s in self.stack]:
            text = " ".join("".join(self._text).split())
            if text and not any(s.rstrip("+") in _SKIPPED for s in self.stack):
                self.paragraphs.append((self.scope > 0, text))
            self._text = None

    def _image(self, a: dict) -> None:
        url = next((a[k] for k in _LAZY if a.get(k) and not a[k].startswith("data:")), "")
        width = int(re.sub(r"\D", "", a.get("width", ""))[:5] or 0)
        best, wide = best_of_srcset(a.get("srcset") or a.get("data-srcset") or self._sources)
        if best and wide >= width:
            url, width = best, wide
        if url:
            figure = self._figure if self._figure is not None else {}
            self.images.append({"url": url, "alt": a.get("alt", "")[:200], "width": width, "height": int(re.sub(r"\D", "", a.get("height", ""))[:5] or 0), "origin": "article" if self.scope else "page", "figure": figure})


def jsonld_objects(scripts: list[str]) -> list[dict]:
    """Every object of JSON-LD scripts, those of lists and graphs included; what is no JSON is passed over."""
    out: list[dict] = []
    for raw in scripts:
        try:
            todo = [json.loads(raw)]
        except ValueError:
            continue
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo.extend(x)
            elif isinstance(x, dict):
                out.append(x)
                if isinstance(x.get("@graph"), list):
                    todo.extend(x["@graph"])
    return out


def article_node(objects: list[dict]) -> dict:
    """The first object that is an article, or an empty one."""
    types = lambda o: {str(t).lower() for t in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type", "")])}
    return next((o for o in objects if not ARTICLE_TYPES.isdisjoint(types(o))), {})


def _first(x) -> str:
    x = x[0] if isinstance(x, list) and x else x
    return str(x.get("name", "") if isinstance(x, dict) else x or "")


_IMAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "alt", "caption", "origin")] + [T.StructField(n, T.IntegerType()) for n in ("width", "height")])
_PARTS = T.StructType([
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("node", T.MapType(T.StringType(), T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("inside", T.ArrayType(T.StringType())), T.StructField("outside", T.ArrayType(T.StringType())),
    T.StructField("images", T.ArrayType(_IMAGE)), T.StructField("title", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("canonical", T.StringType()),
])


def page_parts(markup: str) -> dict:
    """The raw parts of a page."""
    p = _Page()
    p.feed(markup)
    p.close()
    p._close_paragraph()
    node = article_node(jsonld_objects(p.scripts))
    words = node.get("keywords") or []
    images = []
    for name in ("og:image:secure_url", "og:image", "twitter:image", "twitter:image:src"):
        if p.meta.get(name):
            images.append({"url": p.meta[name], "alt": p.meta.get("og:image:alt", ""), "caption": "", "origin": "og", "width": int(re.sub(r"\D", "", p.meta.get("og:image:width", ""))[:5] or 0), "height": int(re.sub(r"\D", "", p.meta.get("og:image:height", ""))[:5] or 0)})
            break
    for i in node.get("image") if isinstance(node.get("image"), list) else [node.get("image")]:
        d = i if isinstance(i, dict) else {"url": i}
        url = d.get("url") or d.get("contentUrl")
        if isinstance(url, str) and url:
            size = lambda k: int(re.sub(r"\D", "", str(d.get(k, "")))[:5] or 0)  # noqa: B023, E731
            images.append({"url": url, "alt": "", "caption": str(d.get("caption", ""))[:200], "origin": "jsonld", "width": size("width"), "height": size("height")})
    images += [{**{k: i[k] for k in ("url", "alt", "origin", "width", "height")}, "caption": i["figure"].get("caption", "")[:240]} for i in p.images]
    body = node.get("articleBody")
    fields = {"headline": node.get("headline"), "author": _first(node.get("author")), "published": node.get("datePublished"), "modified": node.get("dateModified"), "description": node.get("description"), "body": re.sub("<[^>]+>", " ", html.unescape(body)) if isinstance(body, str) else "", "free": node.get("isAccessibleForFree")}
    return {
        "meta": list(p.meta.items()), "node": [(k, str(v)) for k, v in fields.items() if v not in (None, "")], "keywords": [w.strip() for w in (words.split(",") if isinstance(words, str) else words) if isinstance(w, str) and w.strip()],
        "inside": [t for s, t in p.paragraphs if s], "outside": [t for s, t in p.paragraphs if not s], "images": images, "title": p.title, "lang": p.lang, "canonical": p.canonical,
    }


def parsed(pages: DataFrame, markup: str) -> DataFrame:
    """pages with the raw parts of their markup in the column parts, in place of the markup; null for a null or empty one."""
    keep = [c for c in pages.columns if c not in (markup, "parts")]
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("parts", _PARTS)])
    at, place = pages.columns.index(markup), [pages.columns.index(c) for c in keep]
    text = pa.string()
    kind = pa.struct([("meta", pa.map_(text, text)), ("node", pa.map_(text, text)), ("keywords", pa.list_(text)), ("inside", pa.list_(text)), ("outside", pa.list_(text)), ("images", pa.list_(pa.struct([*((n, text) for n in ("url", "alt", "caption", "origin")), ("width", pa.int32()), ("height", pa.int32())]))), ("title", text), ("lang", text), ("canonical", text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in place), pa.array([page_parts(m) if m else None for m in b.column(at).to_pylist()], kind)], names=schema.names)

    return pages.mapInArrow(run, schema)


def clean_text(text: Column) -> Column:
    """Lines of a text that belong to its story, as far as their beginnings tell; short ones that end with a colon go too."""
    lines = F.transform(F.split(N.normalize_space(text), "\n"), F.trim)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(JUNK_LINES) & ~((F.length(x) < 25) & x.endswith(":"))), "\n")


def is_junk(url: Column, alt: Column) -> Column:
    """Whether an image is none of a story: by parts and words of its address, a tiny width in it, or its text."""
    low = F.lower(url)
    path = F.split_part(F.regexp_replace(low, "^https?://[^/]+", ""), F.lit("?"), F.lit(1))
    parts = F.lit(False)
    for p in JUNK_PARTS:
        parts = parts | F.contains(low, F.lit(p))
    return parts | F.arrays_overlap(F.split(path, "[^a-z0-9]+"), F.array(*map(F.lit, JUNK_WORDS))) | low.rlike(r"[?&/](?:w|width)=?\d{1,2}(?:\D|$)") | F.lower(F.coalesce(alt, F.lit(""))).rlike(r"\b(?:logo|avatar|icon)\b")


def image_score(origin: Column, url: Column, width: Column, height: Column, caption: Column, alt: Column) -> Column:
    """Where an image comes from, its format, width, shape and texts; a width of 0 says nothing."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv]), origin), F.lit(0))
    size = F.when(width == 0, 0).when(width >= 1000, 15).when(width >= 600, 8).when(width < 300, -25).otherwise(0)
    ratio = F.try_divide(width.cast("double"), height.cast("double"))
    shape = F.when((width > 0) & (height > 0) & ((ratio < 0.6) | (ratio > 3.2)), -20).otherwise(0)
    one = lambda c, n: F.when(c, n).otherwise(0)
    return base + one(url.rlike(r"(?i)\.(?:jpe?g|png|webp|avif)(?:[?#]|$)"), 5) + size + shape + one(F.length(caption) > 0, 4) + one(F.length(alt) > 0, 2)


def images(pages: DataFrame, key: str, base: str, most: int = 12) -> DataFrame:
    """(key, place, url, origin, width, height, alt, caption, score): the images of parsed pages, best first; of one address the first counts."""
    each = pages.select(key, base, F.posexplode("parts.images").alias("no", "i")).select(key, "no", N.absolutize(F.col("i.url"), F.col(base)).alias("url"), "i.alt", "i.caption", "i.origin", "i.width", "i.height")
    each = each.filter((F.col("url") != "") & ~is_junk(F.col("url"), F.col("alt"))).withColumn("bare", F.regexp_replace("url", "[?#].*$", ""))
    one = each.groupBy(key, "bare").agg(F.min_by(F.struct("no", "url", "alt", "caption", "origin", "width", "height"), "no").alias("i")).select(key, "i.*")
    one = one.withColumn("score", image_score(F.col("origin"), F.col("url"), F.col("width"), F.col("height"), F.col("caption"), F.col("alt")))
    return one.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("score").desc(), "no"))).filter(F.col("place") <= most).drop("no")


def fit_images(found: DataFrame, least_width: int = 480) -> DataFrame:
    """Images wide enough and of a usual shape, as far as their sizes are known."""
    w, h = F.col("width"), F.col("height")
    return found.filter(((w == 0) | (w >= least_width)) & ((w == 0) | (h == 0) | F.try_divide(w.cast("double"), h.cast("double")).between(0.5, 3.5)))


def articles(pages: DataFrame, key: str, url: str, markup: str) -> DataFrame:
    """(key, title, text, author, published, modified, sitename, description, language, canonical, keywords, paragraphs, paywalled) of HTML
    pages. Each field takes the first source that tells: structured data, meta tags, the page itself. Null and empty
    pages give no rows."""
    p = parsed(pages.select(key, url, markup, F.lower(markup).rlike(WALLS).alias("walled")), markup).filter(F.col("parts").isNotNull())
    at = lambda m, *names: F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col(f"parts.{m}"), F.lit(n))), F.lit("")) for n in names], F.lit(""))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    long = lambda ps: F.filter(ps, lambda x: (X.word_count(x) >= PARAGRAPH) & ~x.rlike("(?i)cookie|subscribe|newsletter|sign up|advertis"))
    own = F.array_join(F.when(F.size("parts.inside") > 0, long(F.col("parts.inside"))).otherwise(long(F.col("parts.outside"))), "\n")
    p = p.withColumn("own", own).withColumn("body", at("node", "body"))
    text = F.when((X.word_count(F.col("own")) < ENOUGH) & (X.word_count(F.col("body")) > X.word_count(F.col("own"))), F.col("body")).otherwise(F.col("own"))
    words = F.when(F.size("parts.keywords") > 0, F.col("parts.keywords")).otherwise(F.filter(F.transform(F.split(at("meta", "news_keywords", "keywords"), ","), lambda w: F.trim(w)), lambda w: w != ""))
    out = p.select(
        key, first(at("node", "headline"), at("meta", "og:title", "twitter:title"), F.col("parts.title")).alias("title"), clean_text(text).alias("text"), first(at("node", "author"), at("meta", "author", "article:author")).alias("author"),
        first(at("node", "published"), at("meta", "article:published_time")).alias("published"), first(at("node", "modified"), at("meta", "article:modified_time", "og:updated_time")).alias("modified"), at("meta", "og:site_name", "application-name").alias("sitename"),
        first(at("node", "description"), at("meta", "og:description", "description", "twitter:description")).alias("description"), F.col("parts.lang").alias("language"),
        first(N.absolutize(F.col("parts.canonical"), F.col(url)), U.canonical_url(F.col(url))).alias("canonical"), F.slice(words, 1, 15).alias("keywords"), (F.col("walled") | (F.lower(at("node", "free")) == "false")).alias("paywalled"))
    return out.withColumn("paragraphs", F.filter(F.split("text", "\n"), lambda x: x != ""))


def fetched(responses: DataFrame) -> DataFrame:
    """responses (status, content_type, body) with the columns fit and final: whether a page can be parsed, and whether what it is not will
    stay so. Gone pages and other types are final, other failures are not."""
    gone, page = F.col("status").isin(404, 410), F.lower(F.coalesce("content_type", F.lit("text/html"))).rlike("html|xml")
    ok = (F.col("status") == 200) & (F.length(F.coalesce("body", F.lit(""))) > 0)
    return responses.withColumn("fit", F.coalesce(ok & page, F.lit(False))).withColumn("final", F.coalesce(gone | (ok & ~page), F.lit(False)))


def proxied(url: Column, service: str, width: int = 1200) -> Column:
    """The address of an image by way of a resizing service, a pattern with {url} and {width}; empty ones and the service's own stay."""
    head, tail = service.replace("{width}", str(width)).split("{url}")
    return F.when((url == "") | url.startswith(head.split("?")[0]), url).otherwise(F.concat(F.lit(head), F.url_encode(url), F.lit(tail)))


def source_links(posts: DataFrame, content: str, mark: str) -> DataFrame:
    """posts with the column source: the address of the first anchor whose class is mark; posts without one are left out."""
    tag = F.regexp_extract(content, rf'(?i)<a[^>]*class="[^"]*\b{mark}\b[^"]*"[^>]*>', 0)
    return posts.withColumn("source", N.unescape(F.regexp_extract(tag, r'(?i)href="([^"]+)"', 1))).filter(F.col("source") != "")
