"""Reading level of documents.

A smoothed unigram language model for each grade is trained on graded passages. Each sentence of a document's prose
gets the grade of the highest posterior likelihood; the document's level is the grade of most of its words.
"""

from __future__ import annotations

import html
import re

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Graded passages that the models are trained on at most.
SAMPLES = 20000
#: Count added to each word of a model; words of prose a level needs.
SMOOTHING, LEAST_WORDS = 0.2, 12
#: Share of held-out graded sentences that may lie under the floors (of likelihood, of words known) of what counts as prose.
TAIL = 0.02

_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])[”\"’»)]*\s+")
_END = re.compile(r"[.!?][”\"’»)\s]*$")
_DROP = re.compile(r"(?is)<(script|style|figure|figcaption|noscript|template|svg|table|form|h[1-6])\b.*?</\1\s*>|<!--.*?-->")
_BREAK = re.compile(r"(?i)</?(?:p|li|ul|ol|div|br|blockquote|section|article|hr|tr|td|dd|dt)\b[^>]*>")
_TAG = re.compile(r"<[^>]*>")


def html_lines(markup: str) -> list[str]:
    """The lines of running text of an HTML body, without headings, captions, scripts and styles."""
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub("\n", markup))))
    return [x for x in (" ".join(y.split()) for y in text.split("\n")) if x]


def sentences(line: str) -> list[str]:
    """Sentences of a line that ends as sentences do; a bare line has none."""
    return _SENTENCE.split(line) if _END.search(line) else []


@dataclass
class Levels:
    """Word log-likelihoods by grade. Row 0 stands for all words the passages lack."""

    grades: list[int]
    words: dict[str, int]
    weight: np.ndarray
    floor: float
    known: float

    @classmethod
    def train(cls, samples: list[tuple[str, int]]) -> Levels:
        """Models of the graded passages; the floors come from passages held out in turn."""
        grades = sorted({g for _, g in samples})
        units = [(g, k, _WORD.findall(s.lower())) for k, (t, g) in enumerate(samples) for line in t.split("\n") for s in (sentences(line) or [line])]
        units = [u for u in units if len(u[2]) >= 3]
        best = []
        for fold in range(5):
            held = [u for u in units if u[1] % 5 == fold]
            if not held or len(held) == len(units):
                continue
            model = cls._fit(grades, [u for u in units if u[1] % 5 != fold])
            best += [(x.max(), known) for x, known in (model.likelihood(u[2]) for u in held)]
        model = cls._fit(grades, units)
        if best:
            model.floor, model.known = (float(x) for x in np.quantile(best, TAIL, axis=0))
        return model

    @classmethod
    def _fit(cls, grades: list[int], units: list[tuple[int, int, list[str]]]) -> Levels:
        # A word of a single passage says nothing of the grade: it shares the row of the unknown ones.
        spread: dict[str, set[int]] = {}
        for _, k, ws in units:
            for w in ws:
                spread.setdefault(w, set()).add(k)
        words = {w: i for i, w in enumerate(sorted(w for w, ks in spread.items() if len(ks) >= 2), 1)}
        counts = np.zeros((len(words) + 1, len(grades)))
        for g, _, ws in units:
            column = grades.index(g)
            for w in ws:
                counts[words.get(w, 0), column] += 1
        counts[0] = counts[0].mean()  # names and figures are no evidence
        counts += SMOOTHING
        return cls(grades, words, np.log(counts / counts.sum(0)), -1e9, 0.5)

    def likelihood(self, ws: list[str]) -> tuple[np.ndarray, float]:
        """Mean log-likelihood of the words by grade, and the share of words that are known."""
        at = [self.words.get(w, 0) for w in ws]
        return self.weight[at].mean(0), sum(i > 0 for i in at) / len(at)

    def judge(self, lines: list[str]) -> tuple[int | None, float, int]:
        """(level, its share of the prose, words of prose). Lines that are no sentences of such prose don't count."""
        ws, ends = [], []
        get = self.words.get
        for line in lines:
            for s in sentences(line):
                ws.extend(get(w, 0) for w in _WORD.findall(s.lower()))
                ends.append(len(ws))
        if not ws:
            return None, 0.0, 0
        at = np.array(ws)
        edges = np.array([0, *ends])
        size = np.diff(edges)
        sums = np.vstack([np.zeros(len(self.grades)), np.cumsum(self.weight[at], 0)])
        known = np.concatenate([[0], np.cumsum(at > 0)])
        score = sums[edges[1:]] - sums[edges[:-1]]
        fits = (size >= 3) & (np.diff(known[edges]) >= self.known * size) & (score.max(1) >= self.floor * np.maximum(size, 1))
        total = int(size[fits].sum())
        if total < LEAST_WORDS:
            return None, 0.0, total
        votes = np.bincount(score[fits].argmax(1), weights=size[fits], minlength=len(self.grades))
        top = int(votes.argmax())
        return self.grades[top], float(votes[top] / total), total


def train(samples: DataFrame, limit: int = SAMPLES) -> Levels:
    """Models of at most limit graded passages (text, grade), those with the least hashes."""
    rows = samples.filter(F.col("grade").isNotNull() & (F.length("text") > 0)).select("text", "grade").orderBy(F.xxhash64("text"), "text").limit(limit).collect()
    return Levels.train([(r["text"], r["grade"]) for r in rows])


def levels(documents: DataFrame, model: Levels, text: str, markup: bool = False) -> DataFrame:
    """documents with the columns level, share (of the words of prose that have it) and prose_words.

    level is null for null and empty texts, for texts of other languages and for those without enough prose (page
    parts, error pages, filler). Equal shares go to the lower grade. markup: the text is an HTML body. Rows are kept
    one for one; columns of documents with the names of the three are replaced. Whole texts are read. No shuffle.
    """
    keep = [c for c in documents.columns if c not in ("level", "share", "prose_words")]
    at, place = documents.columns.index(text), [documents.columns.index(c) for c in keep]
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("level", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("prose_words", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.judge(html_lines(t) if markup else t.split("\n")) if t else (None, 0.0, 0) for t in b.column(at).to_pylist()]
            extra = [pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.float64(), pa.int32()))] if found else [pa.array([], t) for t in (pa.int32(), pa.float64(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in place), *extra], names=[*keep, "level", "share", "prose_words"])

    return documents.mapInArrow(run, schema)


def every_level(articles: DataFrame, drafts: DataFrame, samples: DataFrame) -> DataFrame:
    """(tab_name, row_id, level, share, prose_words) of all articles and drafts."""
    model = train(samples)
    a = levels(articles.select(F.col("article_id").alias("row_id"), "text"), model, "text").select(F.lit("articles").alias("tab_name"), "row_id", "level", "share", "prose_words")
    d = levels(drafts.select(F.col("draft_id").alias("row_id"), "body_html"), model, "body_html", markup=True).select(F.lit("drafts").alias("tab_name"), "row_id", "level", "share", "prose_words")
    return a.unionByName(d)


