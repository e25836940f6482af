"""Texts that were cut before their end.

Words of all texts make up the vocabulary; its trie is a table of proper prefixes. A text is cut if it bears a mark
put in place of its rest, if its final token is an unknown proper prefix of known words, or if it stops without an
ending in what elsewhere opens sentences that do end; its length adds evidence where it is one at which its source
cuts many texts. Titles, headings, credits, list items and sign-offs open lines that end bare elsewhere too.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut

#: Tokens of an opening at most; openings seen less often than this say nothing; share of ended ones that makes an opening one of sentences.
OPENING, OPENING_SEEN, ENDED = 5, 3, 0.5
#: A length is one at which a source cuts from so many of its texts on, and from so many times its usual count a length on.
LENGTH_TEXTS, LENGTH_TIMES = 6, 12
#: Words after the last sentence that no headline or credit has.
LONG = 18
#: Characters at a text's end that a mark lies within; the rest of the text is read for all else.
MARK_CHARS = 80
#: Texts shorter than this are stubs.
STUB = 12

# Marks put in place of a text's rest.
_MARK = re.compile(
    r"(?:…|\.\.\.|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\(…\))?\s*[\[(]?\s*\+?\s?\d[\d,.]*\s*(?:more\s*)?(?:chars?|characters|words|signs|bytes|zeichen|caractères|mots|caracteres|palabras|more)(?:\s*more)?\s*[\])]\s*$"
    r"|(?:…|\.\.\.)\s*(?:read more|continue reading|read on|more|weiterlesen|mehr lesen|lire la suite|leer más|seguir leyendo|আরও পড়ুন)\s*[»>›→…]*\s*$"
    r"|(?<=\S)\s*(?:\[\s*(?:…|\.\.\.|cut|truncated|more)\s*\]|\(\s*(?:…|\.\.\.|cut|truncated|more)\s*\))\s*$"
    r"|\b(?:read more|continue reading)\s*[»>›→]+\s*$",
    re.IGNORECASE,
)
_DOTS = re.compile(r"(?:…|\.\.\.)\s*$")
_END = re.compile(r"[.!?।][”\"»’)\]]*$")
_BREAK = re.compile(r"(?<=[.!?।])[”\"»’)]*\s+(?=\S)")
_TOKEN = re.compile(r"[^\s\"“”„«»()\[\]{}<>|]+")
_CLOSERS = "”\"»’)] \t"
_BRACKETS = "\"“”„«»()[]{}<>|"
_STRIP = ".,;:!?…।'’‘-–—/&#*"


def _key(text: str) -> int:
    """A signed 64-bit key."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@functools.lru_cache(maxsize=1 << 16)
def _token(t: str) -> str:
    if any(c.isdigit() for c in t):
        return "0"
    core = t.strip(_STRIP)
    if not core:
        return t
    return "#" * (t[0] == "#") + ("N" if core[0].isupper() else core.lower()) + (t[-1] if t[-1] in ":," else "")


def head(fragment: str) -> str:
    """The first OPENING tokens of a line or sentence, capitalised words and figures masked, after the first as it stands."""
    toks = [x for t in fragment.split(None, OPENING)[:OPENING] if (x := t.strip(_BRACKETS))]
    return " ".join([toks[0].lower(), *map(_token, toks)]) if toks else ""


def openings(told: str) -> list[int]:
    """Keys of the first one to OPENING tokens of a head; that of a single token is of the token as it stands."""
    first, *masked = told.split(" ") if told else [""]
    return [_key(first if n == 1 else " ".join(masked[:n])) for n in range(1, len(masked) + 1)]


def words_of(text: str) -> list[str]:
    return [w for t in _TOKEN.findall(text) if (w := t.strip(_STRIP)) and not any(c.isdigit() for c in w)]


_PASS = T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("chars", T.IntegerType()), T.StructField("words_left", T.IntegerType()), T.StructField("inline", T.BooleanType()), T.StructField("second", T.BooleanType()),
    T.StructField("evidence", T.ByteType()), T.StructField("token", T.StringType()), T.StructField("fragment", T.LongType()), T.StructField("tokens", T.IntegerType()), T.StructField("openings", T.ArrayType(T.LongType())),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("seen", T.ArrayType(T.IntegerType())), T.StructField("ended", T.ArrayType(T.IntegerType())),
])
#: Kinds of rows: a text's end, the statistics of a batch.
ENDING, STATISTICS = 0, 1
#: What a text's end shows by itself: a proper ending, a mark, a broken character, an open end, dots, a number's point.
PROPER, MARKED, BROKEN, OPEN, DOTTED, POINT = 0, 1, 2, 3, 4, 5


def end_of(text: str, title: str | None) -> tuple[int, str, str]:
    """(evidence, final token, the fragment after the last sentence boundary of the last line)."""
    body = text.rstrip()
    if _MARK.search(body[-MARK_CHARS:]):
        return MARKED, "", ""
    if body.endswith("�"):
        return BROKEN, "", ""
    last = body[body.rfind("\n") + 1 :].strip()
    dotted = _DOTS.search(last)
    bare = _DOTS.sub("", last)
    parts = [p for p in _BREAK.split(bare) if p]
    fragment = parts[-1] if parts else bare
    final = (_TOKEN.findall(bare) or [""])[-1]
    if dotted:
        return DOTTED, final, fragment
    if _END.search(last):
        return (POINT if re.search(r"\d\.$", last) else PROPER), final, fragment
    return OPEN, final, fragment


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, title, text) to the rows of _PASS."""
    types = [pa.int8(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int8(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    schema = pa.schema([(f.name, t) for f, t in zip(_PASS.fields, types)])
    for b in batches:
        rows: list[tuple] = []
        raw: Counter = Counter()
        heads: tuple[Counter, Counter] = (Counter(), Counter())
        for doc, source, title, text in zip(*(c.to_pylist() for c in b.columns)):
            body = text.rstrip()
            raw.update(body.split()[:-1])
            if title:
                raw.update(title.split())
            evidence, final, fragment = end_of(text, title)
            units = [s for line in body.split("\n") if line.strip() for s in _BREAK.split(line.strip())]
            if evidence in (PROPER, OPEN, POINT) or not units:
                pass
            else:
                units.pop()  # a marked end says nothing of how such sentences end
            for k, s in enumerate(units):
                if len(units) > 1 and k == len(units) - 1 and evidence == OPEN:
                    continue  # what is to be decided is no evidence; bare endings are counted by their own lines below
                heads[s.rstrip(_CLOSERS)[-1:] in ".!?।"][head(s)] += 1
            keys = openings(head(fragment))
            chars = len(text)
            inline = bool(fragment) and not body.split("\n")[-1].strip().startswith(fragment)
            stub = len(body) < STUB
            if title and len(body) < len(title.strip()) and title.strip().startswith(body) and not stub:
                evidence = MARKED  # the beginning of its own title
            elif title and body == title.strip():
                evidence = PROPER
            toks = [_token(t) for t in _TOKEN.findall(fragment)]
            second = len(toks) > 1 and toks[1][:1] not in ("N", "0")
            rows.append((ENDING, doc, source, chars, len(toks), inline, second, PROPER if stub else evidence, final.strip(_STRIP) or None, _key(" ".join(toks)), len(keys), keys, None, None, None, None, None))
        vocabulary: Counter = Counter()
        for w, n in raw.items():
            for x in words_of(w):
                vocabulary[x] += n
        seen: Counter = Counter()
        ended: Counter = Counter()
        for end, counter in enumerate(heads):
            for told, n in counter.items():
                for key in openings(told):
                    seen[key] += n
                    ended[key] += n * end
        keys = list(seen)
        rows.append((STATISTICS, None, None, None, None, None, None, None, None, None, None, None, list(vocabulary), list(vocabulary.values()), keys, [seen[k] for k in keys], [ended[k] for k in keys]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)


def endings(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", title: str = "title", text: str = "text") -> DataFrame:
    """(doc_id, source, truncated, reason) of every document that has a text.

    reason: mark, broken character, partial word, open sentence, length, or null. Null, empty and stub texts are
    never cut. Documents that stand twice are judged alike; a null source has its own lengths. Columns other than
    those named are not read. Whole texts are read.
    """
    want = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(title).alias("title"), F.col(text).alias("text")).filter(F.length(F.trim("text")) > 0)
    first = cut(want.mapInArrow(_first_pass, _PASS), "text-ends")
    ends = first.filter(F.col("kind") == ENDING)
    stats = first.filter(F.col("kind") == STATISTICS)
    x = F.col("x")
    vocabulary = cut(stats.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(x["words"].alias("word")).agg(F.sum(x["counts"]).alias("times")), "vocabulary")
    heads = stats.select(F.explode(F.arrays_zip("keys", "seen", "ended")).alias("x")).groupBy(x["keys"].alias("key")).agg(F.sum(x["seen"]).alias("seen"), F.sum(x["ended"]).alias("ended"))
    heads = heads.filter(F.col("seen") >= OPENING_SEEN).withColumn("share", F.col("ended") / F.col("seen"))
    # The trie: proper prefixes of words seen at least twice, as far as some text ends in them.
    open_ends = ends.filter(F.col("evidence").isin(OPEN, DOTTED, POINT))
    finals = open_ends.filter(F.col("token").isNotNull()).select("token").distinct()
    unknown = finals.join(vocabulary.select(F.col("word").alias("token")), "token", "left_anti")
    prefixes = vocabulary.filter(F.col("times") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda n: F.substring("word", F.lit(1), n))).alias("token"))
    partial = unknown.join(prefixes, "token", "left_semi").withColumn("partial", F.lit(True))
    # The longest known opening of each open end.
    tried = open_ends.select("doc_id", "tokens", F.posexplode("openings").alias("place", "key")).join(heads, "key")
    known = tried.groupBy("doc_id").agg(F.max_by("share", "place").alias("share"), (F.max("place") + 1).alias("depth"))
    lengths = ends.groupBy("source", "chars").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.when(F.col("evidence") != PROPER, 1).otherwise(0)).alias("unended"))
    usual = ends.groupBy("source").agg((F.count(F.lit(1)) / F.count_distinct("chars")).alias("usual"))
    spikes = lengths.join(usual, lengths["source"].eqNullSafe(usual["source"])).filter((F.col("texts") >= LENGTH_TEXTS) & (F.col("texts") >= LENGTH_TIMES * F.col("usual")) & (F.col("unended") * 2 >= F.col("texts"))).select(lengths["source"].alias("s"), F.col("chars").alias("n"), F.lit(True).alias("spike"))
    rows = ends.join(partial, "token", "left").join(known.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left").join(spikes, ends["source"].eqNullSafe(F.col("s")) & (F.col("chars") == F.col("n")), "left")
    stocks = open_ends.filter(F.col("words_left") >= 2).groupBy("fragment").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OPENING_SEEN).select(F.col("fragment").alias("f"), F.lit(True).alias("stock"))
    rows = rows.join(stocks, F.col("fragment") == F.col("f"), "left")
    no = F.lit(False)
    is_partial, is_spike = F.coalesce("partial", no), F.coalesce("spike", no)
    # An opening tells from three tokens on, or where it is all that there is. A shorter one tells unless the same
    # fragment ends other texts too, as a stock ending does; so does the mere length of what follows the last sentence.
    opens = F.coalesce(F.col("share") >= ENDED, no)
    strong = opens & ((F.col("depth") >= 3) | (F.col("depth") == F.col("tokens")))
    weak = (F.col("inline") & ((F.col("tokens") <= 2) | (opens & (F.col("depth") >= 2)))) | (opens & (F.col("tokens") == 2)) | (opens & F.col("second") & (F.col("depth") >= 2)) | (F.col("words_left") >= LONG)
    stock = F.coalesce("stock", no)
    sentence = strong | (F.coalesce(weak, no) & ~stock)
    reason = (
        F.when(F.col("evidence") == MARKED, "mark")
        .when(F.col("evidence") == BROKEN, "broken character")
        .when((F.col("evidence") == OPEN) & sentence, "open sentence")
        .when(F.col("evidence").isin(OPEN, DOTTED) & is_partial & ~stock & (F.coalesce("share", F.lit(1.0)) > 0.05), "partial word")
        .when((F.col("evidence") == DOTTED) & ((strong & ~stock & (F.col("tokens") >= 2)) | (F.col("words_left") >= LONG)), "open sentence")
        .when(F.col("evidence").isin(OPEN, DOTTED, POINT) & is_spike, "length")
    )
    return rows.select("doc_id", ends["source"], reason.isNotNull().alias("truncated"), reason.alias("reason"))


def rates(judged: DataFrame) -> DataFrame:
    """(source, texts, cut, rate) by source."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("truncated").cast("long")).alias("cut"), F.avg(F.col("truncated").cast("double")).alias("rate"))
