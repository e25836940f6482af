"""Text decoded with the wrong character encoding: finding it and restoring the original.

A suspicious text is tried with chains of steps, each the inverse of one wrong decoding (or of what was done to its
result: entities, compatibility forms, lost spaces). Each candidate is compressed with a zstandard dictionary per
language, made by counts over all values; the chain with the least description length, its own cost included, wins, and a text stays as it is
where no chain gains.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.session import cut

# Encodings in which UTF-8 bytes are commonly read by mistake.
SINGLE = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8_r", "cp866", "iso8859_2")
DOUBLE = ("gb18030", "shift_jis", "big5", "euc_kr")
#: Languages that have a dictionary of their own, the others having one together; bytes of a dictionary.
LANGUAGES, DICTIONARY = 8, 16384
#: Characters of a word beyond which it is counted by all its runs of PIECE characters: scripts without spaces have such.
LONG_WORD, PIECE = 24, 4
#: Bytes that a piece of a dictionary costs where it stands for the piece.
REFERENCE = 2
#: Different pieces that a task counts before it sends the counts on.
HELD = 1 << 18
#: Share of all values from which on a character is a usual one.
USUAL = 1 / 3200
#: Bytes that a step of a chain costs, that an unusual character costs, and steps of a chain at most.
STEP_COST, STRANGE_COST, DEPTH = 1, 5, 4

_TABLES: dict[str, tuple[dict[str, int], re.Pattern]] = {}
# Inverses of the compatibility forms that normalisation makes of signs in garbled text.
_COMPAT = {"3⁄4": "¾", "1⁄4": "¼", "1⁄2": "½", " ̈": "¨", " ̄": "¯", " ̧": "¸", " ́": "´", " ̃": "˜", "TM": "™", "...": "…"}
_COMPAT_RE = re.compile("|".join(map(re.escape, _COMPAT)))
_RAISED = {"1": "¹", "2": "²", "3": "³", "a": "ª", "o": "º", "μ": "µ"}
_RAISED_RE = re.compile(r"(?<=[ÃÂ])[123aoμ]|(?<=à[¦§¥])[123aoμ]")
_SUSPECT = re.compile(
    "[^\x00-\x7fঀ-৿।‌‍]{2,}|[⺀-鿿가-힯豈-﫿︰-﹯�\x80-\x9f─-◿Ѐ-ԯ]|[ÃÂ][ 123aoμ̧̃̄̈]|&#?\\w{2,8};|\\w\\?\\w"
)
#: A few signs alone in quotation marks are shown on purpose.
_SHOWN = re.compile(r"(?<=[“\"«`‘'])[^\x00-\x7f]{1,8}(?=[”\"»`’'])")
_WRONG = re.compile("[\x80-\x84\x86-\x9f�]")


def _table(codec: str) -> tuple[dict[str, int], re.Pattern]:
    """The byte of each character of an encoding, and a pattern of UTF-8 sequences as they look in it."""
    if codec not in _TABLES:
        chars = {}
        for b in range(128, 256):
            try:
                chars[b] = bytes([b]).decode(codec)
            except UnicodeDecodeError:
                chars[b] = chr(b)
        of = {c: b for b, c in chars.items()}
        if codec == "cp1252":  # readers mix it with Latin-1
            of |= {chr(b): b for b in range(128, 160)}

        def cls(lo: int, hi: int) -> str:
            return "[" + "".join(re.escape(c) for c, b in of.items() if lo <= b <= hi) + "]"

        more = cls(0x80, 0xBF)
        _TABLES[codec] = of, re.compile(f"(?:{cls(0xC2, 0xDF)}{more}|{cls(0xE0, 0xEF)}{more}{more}|{cls(0xF0, 0xF4)}{more}{more}{more})+")
    return _TABLES[codec]


def _single(codec: str, text: str) -> str:
    of, pattern = _table(codec)

    def back(m: re.Match) -> str:
        try:
            return bytes(of[c] for c in m.group()).decode()
        except UnicodeDecodeError:
            return bytes(of[c] for c in m.group()).decode(errors="ignore") or m.group()

    return pattern.sub(back, text)


_RUN = re.compile(r"[^\x00-\x7f]+")


def _double(codec: str, text: str) -> str:
    def back(m: re.Match) -> str:
        out = []
        for part in re.split("(�)", m.group()):
            try:
                raw = part.encode(codec)
                new = raw.decode(errors="replace")
                out.append(new if new.count("�") * 3 <= len(new) else part)
            except UnicodeEncodeError:
                out.append(part)
        return "".join(out)

    return _RUN.sub(back, text)


def _entities(text: str) -> str:
    out = html.unescape(text)
    return out if any(ord(c) > 127 for c in out) else text


def _compat(text: str) -> str:
    return _RAISED_RE.sub(lambda m: _RAISED[m.group()], _COMPAT_RE.sub(lambda m: _COMPAT[m.group()], text))


def _spaces(text: str) -> str:
    """Gives back the no-break spaces that were made plain ones inside sequences."""
    return re.sub("(?<=Ã) |(?<=Â) |(?<=à[¦§¥]) |(?<=â€) ", "\xa0", text)


def steps(text: str) -> Iterator[tuple[str, str]]:
    """(name, result) of every step that changes the text."""
    for name, f in (*((c, lambda t, c=c: _single(c, t)) for c in SINGLE), *((c, lambda t, c=c: _double(c, t)) for c in DOUBLE)):
        if (out := f(text)) != text:
            yield name, out
    for prefix, f in (("entities", _entities), ("compat", _compat), ("spaces", _spaces)):
        if (mid := f(text)) != text:
            if (out := _single("cp1252", mid)) != mid:
                yield f"{prefix}+cp1252", out
            elif prefix == "entities" and (again := _single("cp1252", _compat(_spaces(mid)))) != mid:
                yield "entities+compat+cp1252", again


@dataclass
class Model:
    """Dictionaries by language and the usual characters."""

    dictionaries: dict[str, bytes]
    known: frozenset[str]

    def __post_init__(self) -> None:
        self._ready: list | None = None

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "known": self.known, "_ready": None}

    def cost(self, text: str) -> int:
        """Bytes of the text under the dictionary that suits it best."""
        if self._ready is None:
            self._ready = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dictionaries.values() if d] or [zstandard.ZstdCompressor(level=3)]
        raw = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(raw)) for c in self._ready) + STRANGE_COST * sum(ord(c) > 127 and c not in self.known for c in text)

    def best(self, text: str) -> tuple[list[str], str]:
        """The chain of the least description length and what it makes of the text; an empty chain where none gains."""
        chain: list[str] = []
        here = self.cost(text)
        for _ in range(DEPTH):
            found = min(((self.cost(out) + STEP_COST, name, out) for name, out in steps(text)), default=None)
            if found is None or found[0] >= here:
                break
            here, text = found[0], found[2]
            chain.append(found[1])
        return chain, text


def suspicious(text: str) -> bool:
    """Whether a text has runs of signs that a wrong decoding may have made. Most texts have none."""
    return _SUSPECT.search(text) is not None


def _sound(text: str) -> bool:
    """Whether a text has neither wrong characters nor sequences that a wrong decoding makes."""
    return text.isascii() or not suspicious(text) or (not _WRONG.search(text) and all(_single(c, text) == text for c in SINGLE[:4]))


def _pieces(text: str) -> Iterator[str]:
    """What a text brings to its dictionary: each word after its space, long ones by all their runs of PIECE characters."""
    for word in text.split():
        if len(word) <= LONG_WORD:
            yield " " + word
        else:
            yield from (word[i : i + PIECE] for i in range(len(word) - PIECE + 1))


def _dictionary(counts: dict[str, int]) -> bytes:
    """The pieces that save the most bytes, as many as there is room for; the most useful stand last, where references are short."""
    out, size = [], 0
    for piece, _ in sorted(counts.items(), key=lambda x: (-x[1] * (len(x[0].encode("utf-8", "surrogatepass")) - REFERENCE), x[0].encode("utf-8", "surrogatepass"))):
        raw = piece.encode("utf-8", "surrogatepass")
        size += len(raw)
        if size > DICTIONARY:
            break
        out.append(raw)
    return b"".join(reversed(out))


def train(texts: list[tuple[str | None, str]], known: frozenset[str] | None = None) -> Model:
    """A model from (language, text), suspicious texts among them left out; known are the characters that count as usual, by default
    those of two of the texts."""
    pieces: dict[str, Counter] = {}
    seen: Counter = Counter()
    for language, text in texts:
        if text and _sound(text):
            pieces.setdefault(language or "", Counter()).update(_pieces(text))
            seen.update(set(c for c in text if ord(c) > 127))
    return Model({language: _dictionary(n) for language, n in sorted(pieces.items())}, known if known is not None else _usual(seen))


def _usual(seen: dict[str, int]) -> frozenset[str]:
    """Characters that two texts have, if they are assigned ones."""
    return frozenset(c for c, n in seen.items() if n >= 2 and unicodedata.category(c) not in ("Cc", "Co", "Cn"))


_COUNTED = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("language", T.StringType()), T.StructField("unit", T.StringType()), T.StructField("n", T.LongType())])
#: Kinds of counts: texts of a language; its pieces in sound texts; texts that have a character, suspicious ones left out.
TEXTS, PIECES, CHARACTERS = 0, 1, 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to the rows of _COUNTED, several for a unit."""
    held: Counter = Counter()

    def emit() -> pa.RecordBatch:
        columns = ([k[i] for k in held] for i in range(3))
        out = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, (pa.int8(), pa.string(), pa.string()))), pa.array(held.values(), pa.int64())], names=_COUNTED.names)
        held.clear()
        return out

    for b in batches:
        pieces: dict[str, Counter] = {}
        characters: Counter = Counter()
        for language, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[TEXTS, language, ""] += 1
            if _sound(t):
                pieces.setdefault(language, Counter()).update(_pieces(t))
            if not t.isascii() and not suspicious(t):
                characters.update(c for c in set(t) if ord(c) > 127)
        for language, own in pieces.items():
            for unit, n in own.items():
                held[PIECES, language, unit] += n
        for c, n in characters.items():
            held[CHARACTERS, "", c] += n
        if len(held) >= HELD:
            yield emit()
    yield emit()


def corpus_model(values: DataFrame, language: str = "language", text: str = "text", languages: int = LANGUAGES) -> Model:
    """A model of all the values: usual characters and the pieces of the dictionaries by counts over every one of them. What comes
    to the driver is bounded by the characters there are, and by the bytes of the dictionaries."""
    some = values.filter(F.length(text) > 0).select(F.coalesce(F.col(language), F.lit("")).alias("language"), F.col(text).alias("text"))
    counted = cut(some.mapInArrow(_counts, _COUNTED).groupBy("kind", "language", "unit").agg(F.sum("n").alias("n")), "value-counts")
    texts = counted.filter(F.col("kind") == TEXTS)
    total = texts.agg(F.sum("n")).first()[0] or 0
    own = [r["language"] for r in texts.orderBy(F.col("n").desc(), "language").limit(languages).collect()]
    pieces = counted.filter((F.col("kind") == PIECES) & (F.octet_length("unit") <= DICTIONARY))
    mine = [(name, pieces.filter(F.col("language") == name).select("unit", "n")) for name in own]
    mine.append(("other languages", pieces.filter(~F.col("language").isin(own)).groupBy("unit").agg(F.sum("n").alias("n"))))
    dictionaries = {}
    for name, df in mine:
        # A piece has two bytes at least; of those that may have room only the ones that do come to the driver.
        best = df.withColumn("gain", F.col("n") * (F.octet_length("unit") - REFERENCE)).orderBy(F.col("gain").desc(), "unit").limit(DICTIONARY // 2)
        room = F.sum(F.octet_length("unit")).over(Window.orderBy(F.col("gain").desc(), "unit").rowsBetween(Window.unboundedPreceding, 0))
        dictionaries[name] = _dictionary({r["unit"]: r["n"] for r in best.withColumn("room", room).filter(F.col("room") <= DICTIONARY).collect()})
    points = counted.filter((F.col("kind") == CHARACTERS) & (F.col("n") >= max(2, USUAL * total))).collect()
    return Model(dictionaries, _usual({r["unit"]: r["n"] for r in points}))


def examine(text: str, model: Model) -> tuple[bool, list[str], str]:
    """(garbled, chain, restored): lines are examined one by one, so that a stretch does not hide in a long text."""
    garbled, used, out = False, [], []
    for line in text.split("\n"):
        if not suspicious(line):
            out.append(line)
            continue
        shown: list[str] = []

        def hide(m: re.Match, shown=shown) -> str:
            shown.append(m.group())
            return "\x00"

        plain = _SHOWN.sub(hide, line)
        if suspicious(plain):
            chain, new = model.best(plain)
            garbled |= bool(chain) or _WRONG.search(plain) is not None
            used.extend(c for c in chain if c not in used)
            plain = new
        for s in shown:
            plain = plain.replace("\x00", s, 1)
        out.append(plain)
    return garbled, used, "\n".join(out)


def repair(values: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The garbled rows of values, with the columns chain (steps joined by spaces, empty where nothing could be
    restored), restored (the text as far as it could be) and complete (no wrong character is left).

    Rows whose text is null, empty or sound give no row; a text's characters count, not its declared language. Each
    row is examined for itself, so that repeated rows are each given. Columns of values with the names of the three
    are replaced. Whole texts are examined, of any length.
    """
    keep = [c for c in values.columns if c not in ("chain", "restored", "complete")]
    at, place = values.columns.index(text), [values.columns.index(c) for c in keep]
    schema = T.StructType([*values.select(*keep).schema.fields, T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("complete", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, t in enumerate(b.column(at).to_pylist()):
                if t and suspicious(t):
                    garbled, chain, new = examine(t, model)
                    if garbled:
                        rows.append(i)
                        found.append((" ".join(chain), new, _WRONG.search(new) is None))
            picked = b.take(pa.array(rows, pa.int32()))
            extra = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(picked.column(i) for i in place), *extra], names=[*keep, "chain", "restored", "complete"])

    # Rows without anything but ASCII and no entity are sound; they need not reach Python.
    return values.filter(F.col(text).rlike(r"[^\x00-\x7F]|&#?\w{2,8};")).mapInArrow(run, schema)


def values_of(items: DataFrame, articles: DataFrame) -> DataFrame:
    """(tab_name, col_name, row_id, language, text) of the text columns of items and articles."""
    i = items.select(F.lit("items").alias("tab_name"), F.col("ordinal").alias("row_id"), "language", F.inline(F.array(F.struct(F.lit("title").alias("col_name"), F.col("title").alias("text")), F.struct(F.lit("summary").alias("col_name"), F.col("summary").alias("text")))))
    a = articles.select(F.lit("articles").alias("tab_name"), F.col("article_id").alias("row_id"), "language", F.lit("text").alias("col_name"), "text")
    return i.unionByName(a).select("tab_name", "col_name", "row_id", "language", "text")


def quick(text: str) -> str:
    """A text with what is UTF-8 read as one of the commonest encodings put right, without weighing chains; for features only."""
    for _ in range(2):
        new = next((out for c in SINGLE[:4] if (out := _single(c, text)) != text and len(out) < len(text)), text)
        if new == text:
            break
        text = new
    return text
