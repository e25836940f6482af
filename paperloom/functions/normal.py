"""Normal forms of text and small projections: punctuation, entities, white space, accents, slugs, times, headlines."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic signs by what stands for them in ASCII; bullets become stars, invisible signs go.
FOLDED = {"'": "‘’‛‹›", '"': "“”‟«»", "-": "–−⁃", " - ": "—―", " ": "\u00a0\u2007\u202f\u2009\u200a", "...": "…", "1/2": "½", "1/4": "¼", "3/4": "¾", "*": "•·●▪‣", "": "\ufeff\u200b\u200c\u200d\u2060"}
_ENTITY = re.compile(r"&(amp|lt|gt|quot|apos|nbsp|#\d{1,5}|#x[0-9a-fA-F]{1,5});")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Times that entities are decoded, since they may be escaped more than once.
ROUNDS = 3


def decode_entities(text: str) -> str:
    """The entities of feeds decoded, again where the result is one."""
    for _ in range(ROUNDS):
        new = _ENTITY.sub(lambda m: _NAMED.get(m[1]) or chr(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:])), text)
        if new == text:
            break
        text = new
    return text


def _mapped(f):
    """A text function as an Arrow-backed column function; nulls stay."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return run


_decoded = _mapped(decode_entities)
_nfkc = _mapped(lambda t: unicodedata.normalize("NFKC", t))
_unescaped = _mapped(html.unescape)
strip_accents = _mapped(lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
to_ascii = _mapped(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())
casefold = _mapped(str.casefold)


def fold_quotes(text: Column) -> Column:
    """Typographic signs made plain: one for one by translation, the others by replacement."""
    single = {c: to for to, signs in FOLDED.items() if len(to) == 1 for c in signs}
    out = F.translate(F.regexp_replace(text, f"[{FOLDED['']}]", ""), "".join(single), "".join(single.values()))
    for to, signs in FOLDED.items():
        if len(to) > 1:
            out = F.regexp_replace(out, f"[{signs}]", to)
    return out


def unescape(text: Column) -> Column:
    """Entities decoded; rows without an ampersand never reach Python's decoder twice."""
    return F.when(F.instr(text, "&") == 0, text).otherwise(_decoded(text))


def normalize(text: Column, fold_case: bool = False, accents: bool = False) -> Column:
    """Plain punctuation, decoded entities, no invisible signs, single spaces, at most one empty line in a row."""
    out = F.regexp_replace(unescape(fold_quotes(F.coalesce(text, F.lit("")))), "[\u200b-\u200f\u2060\ufeff]", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "\r\n?", "\n"), "[ \t]{2,}", " "), "\n{3,}", "\n\n")
    out = strip_accents(out) if accents else out
    out = casefold(out) if fold_case else out
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def squish(text: Column) -> Column:
    """The normal form in one line."""
    return F.trim(F.regexp_replace(normalize(text), r"\s+", " "))


def paragraphs(text: Column) -> Column:
    """Paragraphs in one line each, empty ones left out."""
    return F.filter(F.transform(F.split(normalize(text), "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def normalize_space(text: Column) -> Column:
    """Compatibility forms, single spaces, no spaces around line ends, at most one empty line in a row."""
    out = F.regexp_replace(_nfkc(F.coalesce(text, F.lit(""))), "[ \t\u00a0\u2000-\u200b\u202f\u205f\u3000]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{3,}", "\n\n"))


def strip_tags(markup: Column) -> Column:
    """Text of a markup: tags made spaces, entities decoded, white space normal."""
    return normalize_space(_unescaped(F.regexp_replace(F.coalesce(markup, F.lit("")), "<[^>]+>", " ")))


def slugify(text: Column, most: int = 70) -> Column:
    """Lower-case ASCII words joined by hyphens, cut at a hyphen; "post" for what has none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(to_ascii(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), "^-|-$", "")
    cut = F.regexp_replace(F.substring(s, 1, most), "-[^-]*$", "")
    s = F.when(F.length(s) > most, cut).otherwise(s)
    return F.when(s == "", "post").otherwise(s)


@F.pandas_udf(T.StringType())
def absolutize(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """(address, base) to an absolute web address; an empty text for what is none."""

    def one(url: str | None, base: str | None) -> str:
        url = html.unescape((url or "").strip())
        url = f"https:{url}" if url.startswith("//") else url
        try:
            url = urljoin(base, url) if url and base else url
        except ValueError:
            return ""
        return url if re.match(r"https?://[^/?#\s]", url) else ""

    for urls, bases in batches:
        yield pd.Series([one(u, b) for u, b in zip(urls, bases)])


def json_for_html(value: Column) -> Column:
    """JSON of a struct, map or array in which no sign can end a script element."""
    out = F.to_json(value)
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(sign), F.lit(code))
    return out


def strip_markdown(text: Column) -> Column:
    """Headings, strong and emphasised parts of Markdown as HTML."""
    out = F.regexp_replace(text, r"(?m)^#{1,6}\s+(.+)$", "<h2>$1</h2>")
    return F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>")


# Times


def hours_since(ts: Column, now: Column) -> Column:
    """Age in hours, never below 0; no time is a thousand million hours old."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9
    return F.when(age.isNull(), F.lit(1e9)).otherwise(F.greatest(F.lit(0.0), age))


def local_minutes(ts: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def in_time_window(ts: Column, window: str, zone: str) -> Column:
    """Whether the local time lies in a window such as 22:00-06:00, which may go past midnight; a malformed or empty one holds nothing."""
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*", window or "")
    if not m:
        return F.lit(False)
    a, b = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    at = local_minutes(ts, zone)
    return F.lit(False) if a == b else ((at >= a) & (at < b) if a < b else (at >= a) | (at < b))


def paced_allowance(most: int, ts: Column, zone: str, lead: int = 90) -> Column:
    """How many of a day's quota may be used up by a local time: evenly, lead minutes ahead, one at least."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.lit(most) * (local_minutes(ts, zone) + lead) / 1440).cast("int")))


def next_midnight(ts: Column, zone: str) -> Column:
    """The instant of the next local midnight."""
    return F.to_utc_timestamp(F.date_add(F.to_date(F.from_utc_timestamp(ts, zone)), 1).cast("timestamp"), zone)


def today_key(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


# Headlines and descriptions


def truncate(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """Text in normal white space, cut at the last space within the limit, the ellipsis included."""
    t = normalize_space(text)
    head = F.substring(t, 1, limit - len(ellipsis))
    head = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(head, "[ ,;:\\-–—]+$", ""), F.lit(ellipsis)))


def clean_headline(title: Column, most: int = 100) -> Column:
    """A headline without an outlet's name after it or a label before it, capitals throughout made small, cut at most."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    t = F.regexp_replace(t, r"\s+[|–—-]\s+[A-Z][\w.&' ]{1,30}$", "")
    t = F.regexp_replace(t, r"(?i)^(?:breaking|exclusive|update|watch|live)\s*[:|-]\s*", "")
    t = F.when((t == F.upper(t)) & (F.length(t) > 12), F.initcap(F.lower(t))).otherwise(t)
    return truncate(t, most)


def meta_description(candidate: Column, fallback: Column, limit: int = 158, least: int = 70) -> Column:
    """The candidate where it is long enough, else the fallback, cut to the limit."""
    return truncate(F.when(F.length(F.trim(F.coalesce(candidate, F.lit("")))) >= least, candidate).otherwise(F.coalesce(fallback, F.lit(""))), limit)


def sentence_words(text: Column) -> Column:
    """Runs of Latin letters, digits, apostrophes, hyphens and dollar signs."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9'’\-$]+")), F.lit(0))


def reading_time(words: Column, per_minute: int = 225) -> Column:
    """Minutes, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(words / per_minute).cast("int"))


def money_phrase(value: Column, symbol: str = "$") -> Column:
    """An amount as news write it: 1.2bn, 3.4m, 5k, 1,999."""
    at = lambda power, unit: F.concat(F.lit(symbol), F.format_string("%.1f", value / power), F.lit(unit))
    plain = F.when(value >= 1000, F.format_number(F.bround(value), 0)).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.when(value >= 1e12, at(1e12, "tn")).when(value >= 1e9, at(1e9, "bn")).when(value >= 1e6, at(1e6, "m")).when((value >= 1e3) & (value % 1e3 == 0), F.concat(F.lit(symbol), (value / 1e3).cast("long").cast("string"), F.lit("k"))).otherwise(F.concat(F.lit(symbol), plain))


def publisher_name(url: Column, feed_title: Column) -> Column:
    """A publisher's name: the feed's title without a trailing address, else the first part of the host."""
    title = F.trim(F.regexp_replace(F.coalesce(feed_title, F.lit("")), r"(?i)\s*[-|–]\s*(?:www\.)?[a-z0-9\-]+\.(?:com|org|net|io|co|news|dev|blog)$", ""))
    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(title != "", title).otherwise(F.initcap(F.translate(F.split_part(host, F.lit("."), F.lit(1)), "-_", "  ")))
