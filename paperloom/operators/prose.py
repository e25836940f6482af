"""Sequential text operators as Arrow-backed functions: sentences, quotes, names, sentiment, stems, summaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import STOP_WORDS, WORD_PATTERN

_WORD = re.compile(WORD_PATTERN)
_STOP = frozenset(STOP_WORDS)
# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof st sr jr vs etc inc ltd co corp no fig al approx dept est gov gen rep sen jan feb mar apr jun jul aug sep sept oct nov dec".split())
_BOUNDARY = re.compile(r"([.!?।]+[”\"’')\]]*)\s+(?=[“\"‘'(\[]?[^\sa-z])")


def split_sentences(text: str, least: int = 12) -> list[str]:
    """Sentences of a text, line by line; abbreviations and initials end none, short pieces join the sentence before."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        line = " ".join(line.split())
        start = 0
        first = len(out)
        for m in _BOUNDARY.finditer(line):
            word = line[start : m.start(1)].rsplit(" ", 1)[-1].strip("(“\"'").lower()
            if m.group(1)[0] == "." and (word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or re.fullmatch(r"(?:[a-z]\.)+[a-z]", word)):
                continue
            out.append(line[start : m.end(1)])
            start = m.end()
        if start < len(line):
            out.append(line[start:])
        i = first + 1
        while i < len(out):
            if len(out[i]) < least:
                out[i - 1 : i + 1] = [f"{out[i - 1]} {out[i]}"]
            else:
                i += 1
    return out


# Verbs that attribute a quotation.
_SAID = r"(?:said|says|told|added|adds|asked|wrote|noted|explained|argued|warned)"
_QUOTE = re.compile(r"[“\"«]([^”\"»“«]{8,600})[”\"»]")
_SPEAKER = re.compile(rf"^\s*,?\s*(?:{_SAID})\s+((?:[A-Z][^\s,.;]*\s?){{1,4}})|^\s*,?\s*((?:[A-Z][^\s,.;]*\s?){{1,4}})\s+{_SAID}")


def quotes(text: str) -> list[tuple[int, str, str, int]]:
    """(position, quotation, speaker, words) of quoted spans of three words or more."""
    out = []
    for m in _QUOTE.finditer(text or ""):
        n = len(m.group(1).split())
        if n >= 3:
            s = _SPEAKER.search(text[m.end() : m.end() + 80])
            out.append((m.start(), m.group(1).strip(" ,"), (s.group(1) or s.group(2)).strip() if s else "", n))
    return out


_NAME = re.compile(r"(?<![.!?]\s)(?<!^)(?<=[\s(“\"‘])((?:[A-Z][\w’'\-]*)(?:\s+(?:[A-Z][\w’'\-]*|\d+)){0,4})")


def names(text: str, top: int = 25) -> list[tuple[str, int, float]]:
    """(name, mentions, score) of capitalised runs within sentences; a surname counts for the full name before it."""
    found, first = Counter(), {}
    length = max(1, len(text or ""))
    for m in _NAME.finditer(text or ""):
        name = m.group(1).removesuffix("’s")
        if name.lower() in _STOP or len(name) < 2:
            continue
        found[name] += 1
        first.setdefault(name, m.start() / length)
    full = {n.rsplit(" ", 1)[-1]: n for n in found if " " in n}
    for n in [n for n in found if " " not in n and n in full]:
        found[full[n]] += found.pop(n)
    scored = [(n, c, 2.2 * float(np.log1p(c)) + 1.4 * (1 - first[n])) for n, c in found.items()]
    return sorted(scored, key=lambda x: (-x[2], x[0]))[:top]


# Polarity of some words of news prose; negations, intensifiers and words of contrast.
POLARITY = {w: v for v, ws in ((1.5, "excellent great breakthrough success best"), (1.0, "good strong growth gain gains rise rose improve improved win wins won profit easy safe welcomed warm fun"), (-1.0, "bad weak slow delay delays delayed cut fall fell drop loss lost cracked faulty loose suffered underestimated cheap"), (-1.5, "crash crisis disaster fail failed failure fault breach leak attack fraud scandal outage recall recalls hackers strike floods")) for w in ws.split()}
NEGATIONS = frozenset("not no never none neither nor without hardly cannot don't doesn't didn't isn't wasn't won't".split())
INTENSITY = {"very": 1.5, "really": 1.4, "extremely": 1.8, "highly": 1.5, "sharply": 1.5, "slightly": 0.6, "somewhat": 0.7, "quite": 1.2}
CONTRAST = frozenset("but however although though yet despite".split())


def sentiment(text: str) -> tuple[float, int, int]:
    """(score, positive words, negative words): a negation turns the next three words, a contrast dampens what follows."""
    total, plus, minus = 0.0, 0, 0
    for s in split_sentences(text):
        depth, damp, before = 0, 1.0, ""
        for w in _WORD.findall(s.lower()):
            if w in CONTRAST:
                damp = 0.55
            elif w in NEGATIONS:
                depth = 3
            elif v := POLARITY.get(w):
                v = (-0.85 * v if depth else v) * INTENSITY.get(before, 1.0) * damp
                total += v
                plus, minus = plus + (v > 0), minus + (v < 0)
                depth = max(0, depth - 1)
            else:
                depth = max(0, depth - 1)
            before = w
    return total / (1 + abs(total)), plus, minus


# Suffixes of derivation with what replaces them, longest first.
_SUFFIXES = (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("iveness", "ive"), ("ousness", "ous"), ("biliti", "ble"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("ation", "ate"), ("entli", "ent"), ("ousli", "ous"), ("alli", "al"), ("izer", "ize"), ("ator", "ate"), ("abli", "able"), ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""), ("ance", ""), ("ence", ""), ("ical", "ic"), ("ing", ""), ("ion", ""), ("ed", ""), ("ly", ""), ("er", ""))


def stem(word: str) -> str:
    """A stem of an English word: plurals, then one suffix that leaves a vowel and three letters."""
    w = word.lower()
    if len(w) < 4:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-3] + "i"
    elif w.endswith("s") and w[-2] not in "su":
        w = w[:-1]
    if w.endswith("y") and w[-2] not in "aeiou":
        w = w[:-1] + "i"
    for tail, new in _SUFFIXES:
        head = w[: -len(tail)]
        if w.endswith(tail) and len(head) >= 3 and any(c in "aeiouy" for c in head):
            w = head + new
            if not new and len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    return w


def _bags(sentences: list[str]) -> np.ndarray:
    """Unit rows of content-word counts."""
    index: dict[str, int] = {}
    rows = [[index.setdefault(w, len(index)) for w in _WORD.findall(s.lower()) if w not in _STOP and len(w) > 2] for s in sentences]
    m = np.zeros((len(rows), max(1, len(index))))
    for i, ws in enumerate(rows):
        np.add.at(m[i], ws, 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def pagerank(weights: np.ndarray, damping: float = 0.85, rounds: int = 60, tolerance: float = 1e-7) -> np.ndarray:
    """Damped power iteration; rows without weight spread evenly."""
    n = len(weights)
    sums = weights.sum(1)
    out = np.full(n, 1 / n)
    move = np.divide(weights, sums[:, None], out=np.full((n, n), 1 / n), where=sums[:, None] > 0)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * out @ move
        if np.abs(new - out).sum() < tolerance:
            return new
        out = new
    return out


def summary(text: str, count: int = 3, weight: float = 0.72) -> list[tuple[int, str, float]]:
    """(index, sentence, score): the most central sentences that repeat each other least, in the text's order."""
    sentences = split_sentences(text)
    if not sentences:
        return []
    m = _bags(sentences)
    like = m @ m.T
    np.fill_diagonal(like, 0)
    rank = pagerank(like)
    rank = rank / rank.max() if rank.max() else rank
    picked: list[int] = []
    while len(picked) < min(count, len(sentences)):
        mmr = weight * rank - (1 - weight) * (like[:, picked].max(1) if picked else 0)
        mmr[picked] = -np.inf
        picked.append(int(mmr.argmax()))
    return [(i, sentences[i], float(rank[i])) for i in sorted(picked)]


def exploded(docs: DataFrame, key: str, text: str, f: Callable, fields: list[tuple[str, T.DataType]], arrow: list[pa.DataType]) -> DataFrame:
    """(key, *fields): the rows that f gives for each text; null and empty texts give none."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            at, rows = [], []
            for i, t in enumerate(texts):
                if t:
                    got = f(t)
                    at += [i] * len(got)
                    rows += got
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow)] if rows else [pa.array([], t) for t in arrow]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *columns], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def sentence_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence)."""
    return exploded(docs, key, text, lambda t: list(enumerate(split_sentences(t))), [("idx", T.IntegerType()), ("sentence", T.StringType())], [pa.int32(), pa.string()])


def quote_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, quotation, speaker, words)."""
    return exploded(docs, key, text, quotes, [("at", T.IntegerType()), ("quotation", T.StringType()), ("speaker", T.StringType()), ("words", T.IntegerType())], [pa.int32(), pa.string(), pa.string(), pa.int32()])


def name_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, mentions, score)."""
    return exploded(docs, key, text, names, [("name", T.StringType()), ("mentions", T.IntegerType()), ("score", T.DoubleType())], [pa.string(), pa.int32(), pa.float64()])


def sentiment_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, score, positive, negative)."""
    return exploded(docs, key, text, lambda t: [sentiment(t)], [("score", T.DoubleType()), ("positive", T.IntegerType()), ("negative", T.IntegerType())], [pa.float64(), pa.int32(), pa.int32()])


def summary_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, sentence, score)."""
    return exploded(docs, key, text, summary, [("idx", T.IntegerType()), ("sentence", T.StringType()), ("score", T.DoubleType())], [pa.int32(), pa.string(), pa.float64()])


@F.pandas_udf(T.StringType())
def stem_column(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda w: stem(w) if w else w)


def stems(counts: DataFrame) -> DataFrame:
    """(token, stem) of the distinct vocabulary, so that each word is stemmed once."""
    return counts.select("token").distinct().withColumn("stem", stem_column("token"))
