"""Mixed timestamp texts to UTC instants.

A text is reduced to a shape mask (digits to 9, letter runs to a). Each distinct mask is given a parser once;
all texts of a mask are then parsed together with array arithmetic. Local readings are converted through
transition tables of the zones, built on the driver from one release of the time-zone database.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names by language (English, French, German, Spanish, Bengali) and their short forms.
MONTHS = {
    1: "january jan janvier janv januar jänner enero ene জানুয়ারি জানুয়ারী জানু",
    2: "february feb février fevrier févr fév februar febr febrero ফেব্রুয়ারি ফেব্রুয়ারী ফেব্রু",
    3: "march mar mars märz maerz mär marzo মার্চ",
    4: "april apr avril avr abril abr এপ্রিল",
    5: "may mai mayo মে",
    6: "june jun juin juni junio জুন",
    7: "july jul juillet juil juli julio জুলাই",
    8: "august aug août aout agosto ago আগস্ট অগাস্ট",
    9: "september sep sept septembre septiembre setiembre সেপ্টেম্বর সেপ্ট",
    10: "october oct octobre oktober okt octubre অক্টোবর অক্টো",
    11: "november nov novembre noviembre নভেম্বর নভে",
    12: "december dec décembre decembre déc dezember dez diciembre dic ডিসেম্বর ডিসে",
}
# Names of universal time; names of a zone that leave summer time open; words after a clock reading;
# RFC 2822 zone names in hours.
UNIVERSAL = {"z", "utc", "gmt", "ut", "zulu"}
GENERAL = {"et", "ct", "mt", "pt"}
CLOCK_WORDS = {"h", "uhr", "hrs", "hs"}
MAIL_ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

_MONTH_OF = {unicodedata.normalize("NFC", w): m for m, ws in MONTHS.items() for w in ws.split()}
#: Years outside this range are taken for noise.
YEARS = (1900, 2200)
_DAY = 86400


@dataclass(frozen=True)
class ZoneTables:
    """UTC transition seconds, offsets and abbreviations of named zones, from one release of the database."""

    version: str
    zones: dict

    @staticmethod
    def release() -> str:
        """The release of the database in use, as far as it says."""
        from zoneinfo import TZPATH

        for folder in TZPATH:
            try:
                with open(f"{folder}/tzdata.zi", encoding="utf-8") as f:
                    return f.readline().split()[-1]
            except OSError:
                continue
        try:
            from importlib.metadata import version

            return version("tzdata")
        except Exception:  # noqa: BLE001
            return "unknown"

    @classmethod
    def build(cls, names: list[str]) -> ZoneTables:
        """Tables for the given zone names; unknown names are left out. Their number is bounded by the database's own list."""
        return cls(cls.release(), {n: t for n in sorted(set(names)) if (t := _zone(n)) is not None})


@functools.lru_cache(maxsize=1024)
def _zone(name: str):
    from zoneinfo import ZoneInfo

    try:
        tz = ZoneInfo(name)
    except Exception:  # noqa: BLE001  not a zone
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def at(s: int) -> tuple[int, str]:
        d = (epoch + timedelta(seconds=s)).astimezone(tz)
        return int(d.utcoffset().total_seconds()), d.tzname()

    first, last, step = -2208988800, 4102444800, 14 * _DAY
    cuts, offsets, names = [], [at(first)[0]], [at(first)[1]]
    lo, here = first, at(first)
    for hi in range(first + step, last, step):
        there = at(hi)
        a = lo
        while there != here:  # a change lies in (a, hi]
            x, y = a, hi
            while y - x > 1:
                mid = (x + y) // 2
                if at(mid) == here:
                    x = mid
                else:
                    y = mid
            here = at(y)
            cuts.append(y)
            offsets.append(here[0])
            names.append(here[1])
            a = y
        lo = hi
    abbreviations: dict[str, list[int]] = {}
    for n, o, end in zip(names, offsets, [*cuts, last]):
        if end > 0 and n and n[0].isalpha() and o not in (seen := abbreviations.setdefault(n.lower(), [])):
            seen.insert(0, o)  # the latest use comes first
    return np.array(cuts, np.int64), np.array(offsets, np.int64), abbreviations


def offset_at(table, utc: np.ndarray) -> np.ndarray:
    """The zone's offset at UTC seconds."""
    return table[1][np.searchsorted(table[0], utc, side="right")]


def local_to_utc(table, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of clock readings, and which of them the clock showed exactly once."""
    before, after = offset_at(table, local - _DAY), offset_at(table, local + _DAY)
    a, b = local - before, local - after
    ok_a, ok_b = offset_at(table, a) == before, offset_at(table, b) == after
    same = before == after
    return np.where(ok_a, a, b), np.where(same, ok_a, ok_a ^ ok_b)


class _Shape(dict):
    """Translation of characters for masks: digits to 9, letters and marks to a."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        kind = unicodedata.category(ch)
        out = "9" if kind == "Nd" else "a" if kind[0] in "LM" else ch
        self[c] = out
        return out


_SHAPE = _Shape()
_RUN = re.compile("a+")


def shape(text: str) -> str:
    """The character-class mask of a text."""
    return _RUN.sub("a", text.translate(_SHAPE))


# Parts of the mask grammar. A zone is a word, an offset, or a word followed by an offset (GMT+5:30).
_TIME = r"(?P<hh>9{1,2})(?::|a)(?P<mi>99)(?::(?P<ss>99)(?:[.,](?P<frac>9+))?)?"
_HALF = r"(?:\s?(?P<half>a\.a\.|a))?"
_ZONE = r"(?:\s?(?P<zone>a?[+\-−]9{1,2}(?::?9{2})?|a)(?:\[[^\]]+\])?(?:\s?\(a\))?)?"
_LEAD = r"(?:a\.?,?\s)?"
_FORMS = {
    "ymd": r"(?P<y>9999)(?P<sep>[-/.])(?P<mo>9{1,2})[-/.](?P<d>9{1,2})(?:a|,?\s)" + _TIME + _HALF + _ZONE,
    "packed": r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?:a|\s)?(?P<hh>99)(?P<mi>99)(?P<ss>99)(?P<zone>a|[+\-]9999)?",
    "dmy-name": _LEAD + r"(?P<d>9{1,2})(?:\.|a)?[\s-](?:a\s)?(?P<name>a\.?)(?:\sa)?[\s-](?P<y>9999),?\s(?:a\s)?" + _TIME + _HALF + _ZONE,
    "mdy-name": _LEAD + r"(?P<name>a\.?)\s(?P<d>9{1,2})a?,?\s(?P<y>9999),?\s(?:a\s)?" + _TIME + _HALF + _ZONE,
    "slash": r"(?P<p>9{1,2})/(?P<q>9{1,2})/(?P<y>9999),?\s(?:a\s)?" + _TIME + _HALF + _ZONE,
    "dotted": r"(?P<d>9{1,2})\.(?P<mo>9{1,2})\.(?P<y>9999),?\s(?:a\s)?" + _TIME + r"(?:\sa)?",
    "seconds": r"(?P<n>9{9,11})(?:\.(?P<frac>9+))?",
    "millis": r"(?P<n>9{12,13})",
    "micros": r"(?P<n>9{16})",
    "nanos": r"(?P<n>9{19})",
}
_COMPILED = {k: re.compile(v) for k, v in _FORMS.items()}


@functools.lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, dict] | None:
    """The parser of a mask: a form's name and where its parts lie, by pieces of the mask; None where no form fits."""
    for name in ("seconds", "millis", "micros", "nanos", "packed", "ymd", "slash", "dotted", "dmy-name", "mdy-name"):
        if m := _COMPILED[name].fullmatch(mask):
            parts = {k: v for k, v in m.groupdict().items() if v is not None}
            return name, {k: m.start(k) for k in parts}
    return None


def _pattern(mask: str, starts: dict[str, int]) -> re.Pattern:
    """A pattern over the text itself, with the mask's parts as groups."""
    form = _COMPILED[parser_of(mask)[0]].fullmatch(mask)
    names: dict[int, str] = {}
    ends: dict[int, int] = {}
    for k in starts:
        names[form.start(k)] = k
        ends[form.end(k)] = 1
    out = []
    for i, c in enumerate(mask):
        if i in ends and i > 0:
            out.append(")")
        if i in names:
            out.append(f"(?P<{names[i]}>")
        out.append(r"\d" if c == "9" else r"[^\d\s.,:;/\[\]()+\-−]+" if c == "a" else re.escape(c))
    if len(mask) in ends:
        out.append(")")
    return re.compile("".join(out))


@functools.lru_cache(maxsize=4096)
def _compiled(mask: str) -> tuple[str, re.Pattern] | None:
    found = parser_of(mask)
    return (found[0], _pattern(mask, found[1])) if found else None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_LENGTHS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
_SPACE = re.compile(r"\s+")
_WORD_OFFSET = re.compile(r"([^\d\s+\-−]*)(?:([+\-−])(\d{1,2}):?(\d{2})?)?")
_NONE = np.iinfo(np.int64).min


def _zone_kind(text: str, table) -> tuple[str, int | list[int]]:
    """What a zone text means: a fixed offset in seconds, the local clock, or nothing that is known."""
    word, sign, hours, minutes = _WORD_OFFSET.fullmatch(text).groups() if _WORD_OFFSET.fullmatch(text) else (text, None, None, None)
    if sign:
        if word and word not in UNIVERSAL:
            return "bad", 0
        h, m = int(hours), int(minutes or 0)
        if len(hours) == 1 and minutes and not text.count(":"):
            return "bad", 0
        if h > 15 or m > 59:
            return "bad", 0
        return "fixed", (1 if sign == "+" else -1) * (h * 3600 + m * 60)
    if word in UNIVERSAL:
        return "fixed", 0
    if word in GENERAL or word in CLOCK_WORDS:
        return "local", 0
    if table is not None and word in table[2]:
        own = table[2][word]
        return ("fixed", own[0]) if len(own) == 1 else ("any", own)
    if word in MAIL_ZONES:
        return "fixed", MAIL_ZONES[word] * 3600
    return "bad", 0


def parse_batch(texts: list, zones: list, month_first: list, tables: ZoneTables) -> np.ndarray:
    """Milliseconds since 1970 UTC of each text; the least int64 where it names no single instant."""
    n = len(texts)
    out = np.full(n, _NONE, np.int64)
    groups: dict[str, list[tuple[int, str]]] = {}
    for i, raw in enumerate(texts):
        if not raw:
            continue
        s = _SPACE.sub(" ", unicodedata.normalize("NFC", raw)).strip().lower()
        if s:
            groups.setdefault(shape(s), []).append((i, s))
    for mask, members in groups.items():
        compiled = _compiled(mask)
        if compiled is None:
            continue
        form, pattern = compiled
        rows, found = [], []
        for i, s in members:
            if m := pattern.fullmatch(s):
                rows.append(i)
                found.append(m.groupdict())
        if not rows:
            continue
        at = np.array(rows)
        if "n" in found[0]:
            whole = np.array([int(g["n"]) for g in found], np.int64)
            scale = {"seconds": (1000, 1), "millis": (1, 1), "micros": (1, 1000), "nanos": (1, 1000000)}[form]
            ms = whole * scale[0] // scale[1]
            if "frac" in found[0]:
                ms = ms + np.array([int((g["frac"] + "00")[:3]) for g in found], np.int64)
            out[at] = ms
            continue
        good = np.ones(len(rows), bool)

        def number(k: str, default: int = 0, found=found) -> np.ndarray:
            return np.array([int(g[k]) if g.get(k) else default for g in found], np.int64)

        y, hh, mi, ss = number("y"), number("hh"), number("mi"), number("ss")
        if form == "slash":
            first = np.array([bool(month_first[i]) for i in rows])
            p, q = number("p"), number("q")
            mo, d = np.where(first, p, q), np.where(first, q, p)
        elif "name" in found[0]:
            mo, d = np.array([_MONTH_OF.get(g["name"].rstrip("."), 0) for g in found], np.int64), number("d")
        else:
            mo, d = number("mo"), number("d")
        zone_text = [g.get("zone") or "" for g in found]
        if "half" in found[0]:
            halves = [g["half"].replace(".", "") for g in found]
            is_half = np.array([h in ("am", "pm") for h in halves])
            good &= ~is_half | ((hh >= 1) & (hh <= 12))
            hh = np.where(is_half, hh % 12 + np.array([12 * (h == "pm") for h in halves]), hh)
            for k, h in enumerate(halves):
                if not is_half[k]:
                    if zone_text[k]:  # a word before the zone: GMT before an offset, or a clock word
                        good[k] &= h in CLOCK_WORDS or (h in UNIVERSAL and zone_text[k][0] in "+-−")
                    else:
                        zone_text[k] = h
        else:
            for k, z in enumerate(zone_text):
                if z in ("am", "pm"):
                    good[k] &= 1 <= hh[k] <= 12
                    hh[k] = hh[k] % 12 + 12 * (z == "pm")
                    zone_text[k] = ""
        good &= (y >= YEARS[0]) & (y <= YEARS[1]) & (mo >= 1) & (mo <= 12) & (hh <= 23) & (mi <= 59) & (ss <= 59)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        safe = np.where((mo >= 1) & (mo <= 12), mo, 1)
        good &= (d >= 1) & (d <= _LENGTHS[safe] + ((safe == 2) & leap))
        local = _days(y, safe, np.maximum(d, 1)) * _DAY + hh * 3600 + mi * 60 + ss
        utc = np.zeros(len(rows), np.int64)
        pending: dict[str, list[int]] = {}
        for k, i in enumerate(rows):
            name = zones[i]
            table = tables.zones.get(name) if name else None
            kind, value = ("local", 0) if not zone_text[k] else _zone_kind(zone_text[k], table)
            if kind == "fixed":
                utc[k] = local[k] - value
            elif kind == "any":
                fits = [o for o in value if int(offset_at(table, np.array([local[k] - o]))[0]) == o]
                utc[k] = local[k] - (fits or value)[0]
            elif kind == "local" and table is not None:
                pending.setdefault(name, []).append(k)
            else:
                good[k] = False
        for name, ks in pending.items():
            ks = np.array(ks)
            value, once = local_to_utc(tables.zones[name], local[ks])
            utc[ks] = value
            good[ks] &= once
        ms = utc * 1000
        if "frac" in found[0]:
            ms = ms + np.array([int((g["frac"] + "00")[:3]) for g in found], np.int64)
        out[at] = np.where(good, ms, _NONE)
    return out


def normalise(df: DataFrame, value: str, zone: str, month_first: str, tables: ZoneTables, out: str = "epoch_ms") -> DataFrame:
    """df with the column out: milliseconds since 1970 UTC named by the text in value, null where it names no single instant.

    zone: column with the zone of the clock that texts without a zone were read from, null where unknown.
    month_first: boolean column, whether slash dates put the month first; null counts as false.
    Null and empty texts, dates without a time of day, relative phrases, impossible dates, and readings that the
    clock showed twice or never give null. Rows are kept one for one, repeated ones too. A column of df with the
    name out is replaced. No shuffle.
    """
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in keep]).schema.fields, T.StructField(out, T.LongType())])
    place = [df.columns.index(c) for c in keep]
    v, z, m = (df.columns.index(c) for c in (value, zone, month_first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = parse_batch(b.column(v).to_pylist(), b.column(z).to_pylist(), b.column(m).to_pylist(), tables)
            columns = [b.column(i) for i in place] + [pa.array(got, pa.int64(), mask=got == _NONE)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return df.mapInArrow(run, schema)


def with_clock(df: DataFrame, feeds: DataFrame, source: str = "source") -> tuple[DataFrame, ZoneTables]:
    """df with clock_zone and month_first of its feed, and the zone tables the feeds need.

    Slash dates are month-first on feeds of the region US. A feed listed twice counts once, by its least zone;
    rows whose source is null or unknown get no zone. The zones collected are at most the database's own names.
    """
    one = feeds.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias("_feed")).agg(F.min("tz").alias("clock_zone"), F.max(F.coalesce(F.col("region") == "US", F.lit(False))).alias("month_first"))
    names = [r[0] for r in feeds.select("tz").filter(F.col("tz").isin(*sorted(zoneinfo.available_timezones()))).distinct().collect()]
    joined = df.join(one, F.col(source) == F.col("_feed"), "left").drop("_feed")
    return joined, ZoneTables.build(names)


def instants(items: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every published or modified text of items and articles with the instant it names:
    (tab_name, col_name, row_id, raw, epoch_ms, instant)."""
    a = articles.select("source", F.col("article_id").alias("row_id"), F.inline(F.array(F.struct(F.lit("published").alias("col_name"), F.col("published").alias("raw")), F.struct(F.lit("modified").alias("col_name"), F.col("modified").alias("raw")))))
    i = items.select("source", F.col("ordinal").alias("row_id"), F.lit("published_raw").alias("col_name"), F.col("published_raw").alias("raw"))
    every = i.withColumn("tab_name", F.lit("items")).unionByName(a.withColumn("tab_name", F.lit("articles"))).filter(F.length(F.trim("raw")) > 0)
    joined, tables = with_clock(every, feeds)
    done = normalise(joined.select("tab_name", "col_name", "row_id", "raw", "clock_zone", "month_first"), "raw", "clock_zone", "month_first", tables)
    return done.select("tab_name", "col_name", "row_id", "raw", "epoch_ms", F.timestamp_millis("epoch_ms").alias("instant"))
