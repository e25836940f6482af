"""Drafts made of what a text states: headlines, outline, lead, sections, lists, questions, rewriting, style and checks.

Sentences are chosen, cut and restated from the text; nothing is added to it. The functions work on one text and run in
Arrow batches through draft_rows; house style is a set of built-in columns.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.text import STOP_WORDS, WORD_PATTERN
from paperloom.operators import facts as E
from paperloom.operators.prose import exploded, split_sentences

_WORD = re.compile(WORD_PATTERN)
_STOP = frozenset(STOP_WORDS)


def _bag(text: str) -> Counter:
    return Counter(w for w in _WORD.findall(text.lower()) if w not in _STOP)


def likeness(a: str, b: str) -> float:
    """Cosine of content-word counts; 0 where one has none."""
    x, y = _bag(a), _bag(b)
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(n * y[w] for w, n in x.items()) / norm if norm else 0.0


def _unlike(texts, most: float, taken=()) -> list[str]:
    """The texts in order, but for those more like an earlier or taken one than most."""
    out: list[str] = []
    for t in texts:
        if t and all(likeness(t, o) <= most for o in (*taken, *out)):
            out.append(t)
    return out


def _words(text: str) -> int:
    return len(text.split())


# Headlines

_BOUNDARY = re.compile(r"\s*(?:,|;|:| [-–—]) | (?=(?:as|after|amid|while|because|and|but|when|despite)\b)")


def shorten(title: str, limit: int = 62, least: int = 30, keyword: str = "") -> list[str]:
    """Up to three cuts of a title at a boundary, of least to limit characters: with the keyword first, then the longest."""
    cuts = {title[: m.start()].strip() for m in _BOUNDARY.finditer(title)} | {title[m.end() :].strip() for m in _BOUNDARY.finditer(title)}
    fit = [c for c in cuts if least <= len(c) <= limit]
    return sorted(fit, key=lambda c: (keyword.lower() not in c.lower(), -len(c), c))[:3]


def headline_choices(title: str, keyword: str = "", names: tuple = (), figures: tuple = ()) -> list[tuple[str, str]]:
    """(origin, headline): the title itself, its cuts, and forms led by keyword, name or figure; each once."""
    short = shorten(title, keyword=keyword)
    lead = short[0] if short else title
    out = [("source", title), *(("shortened", s) for s in short)]
    if keyword and keyword.lower() not in title.lower():
        out.append(("keyword", f"{keyword[:1].upper()}{keyword[1:]}: {lead}"))
    out += [("name", f"{n}: {lead}") for n in names[:1] if n.lower() not in title.lower()]
    out += [("figure", f"{lead} ({f})") for f in figures[:1] if f not in title]
    seen: set[str] = set()
    return [(o, h) for o, h in out if h and not (h.lower() in seen or seen.add(h.lower()))]


def headline_score(headline: str, keyword: str = "", names: tuple = (), figures: tuple = (), published: tuple = ()) -> float:
    """Share of what speaks for a headline, 0 to 1: length, keyword, its place, a name, a figure, calm signs, and being new."""
    low, n = headline.lower(), len(headline)
    at = low.find(keyword.lower()) if keyword else -1
    new = 1 - max((likeness(headline, p) for p in published), default=0.0)
    parts = ((0.22, 1.0 if 40 <= n <= 70 else 0.5 if 25 <= n <= 90 else 0.0), (0.2, float(at >= 0)), (0.1, float(0 <= at <= n // 2)), (0.13, float(any(x.lower() in low for x in names))), (0.1, float(any(f in headline for f in figures))), (0.1, float(not re.search(r"[!?]|\b[A-Z]{5,}\b", headline))), (0.15, max(0.0, new)))
    return round(sum(w * v for w, v in parts), 4)


def best_headline(title: str, keyword: str = "", names: tuple = (), figures: tuple = (), published: tuple = (), limit: int = 70) -> str:
    """The choice of the best score, the source's own favoured by a tenth and a question held back; cut at a word if longer than limit."""
    ranked = sorted(headline_choices(title, keyword, names, figures), key=lambda c: (-(headline_score(c[1], keyword, names, figures, published) + 0.1 * (c[0] == "source") - 0.04 * c[1].endswith("?")), len(c[1]), c[1]))
    best = ranked[0][1] if ranked else ""
    return best if len(best) <= limit else best[: limit + 1].rsplit(" ", 1)[0].rstrip(" ,;:-")[:limit]


# Outline

#: Sections in the order they are printed, and their share of the words.
SHARES = {"lead": 0.14, "details": 0.32, "figures": 0.14, "context": 0.16, "quotes": 0.12, "outlook": 0.08, "questions": 0.04}
_AHEAD = re.compile(r"\b(?:will|plans? to|expects?|expected|next (?:week|month|year)|later this|due to|aims? to|scheduled)\b", re.I)
_WHY = re.compile(r"\b(?:because|since|after|following|earlier|previously|last (?:week|month|year)|due to|in response)\b", re.I)


@dataclass
class Section:
    kind: str
    heading: str
    words: int
    facts: list[int] = field(default_factory=list)


def heading_of(kind: str, subject: str) -> str:
    """A heading that names the subject."""
    s = title_case(subject) if subject else "the story"
    return {"lead": "", "details": f"What is known about {s}", "figures": f"{s} in figures", "context": f"Behind {s}", "quotes": "In their words", "outlook": f"What comes next for {s}", "questions": f"Questions about {s}"}[kind]


def outline(found: list[E.Fact], quotes: list[E.Quote], subject: str, target: int = 650) -> list[Section]:
    """Sections that there is evidence for. Every fact stands in one: the lead's are the first two, then figures, what lies ahead,
    what lies behind, and the rest in details."""
    at: dict[str, list[int]] = {k: [] for k in SHARES}
    for i, f in enumerate(found):
        kind = "lead" if i < 2 else "outlook" if _AHEAD.search(f.text) else "figures" if f.figures else "context" if _WHY.search(f.text) else "details"
        at[kind].append(i)
    if len(at["figures"]) < 2:
        at["details"] = sorted(at["details"] + at.pop("figures"))
    kept = [k for k in SHARES if at.get(k) or (k == "quotes" and quotes) or (k == "questions" and len(found) >= 4)]
    return word_budgets([Section(k, heading_of(k, subject), round(target * SHARES[k]), at.get(k, [])) for k in kept], target)


def word_budgets(sections: list[Section], target: int) -> list[Section]:
    """Budgets scaled to the target; what rounding leaves goes to the largest."""
    total = sum(s.words for s in sections)
    if total:
        for s in sections:
            s.words = s.words * target // total
        max(sections, key=lambda s: s.words).words += target - sum(s.words for s in sections)
    return sections


def in_order(sections: list[Section]) -> list[Section]:
    """Sections in printing order; unknown kinds last."""
    rank = {k: i for i, k in enumerate(SHARES)}
    return sorted(sections, key=lambda s: rank.get(s.kind, len(rank)))


# Lead, paragraphs, lists


def lead(found: list[E.Fact], headline: str = "", most: int = 60, alike: float = 0.72) -> str:
    """One to three facts, no more than most words, none restating the headline or another."""
    out: list[str] = []
    for t in _unlike([f.text for f in found], alike, (headline,)) or [f.text for f in found[:1]]:
        if len(out) < 3 and (not out or sum(map(_words, out)) + _words(t) <= most):
            out.append(t)
    return " ".join(out)


def dek(found: list[E.Fact], first: str, most: int = 26, alike: float = 0.62) -> str:
    """The first short fact that the lead doesn't tell, quotations left out."""
    return next((f.text for f in found if f.words <= most and '"' not in f.text and "“" not in f.text and f.text not in first and likeness(f.text, first) <= alike), "")


def paragraphs_of(sentences: list[str], budget: int = 70) -> list[str]:
    """Paragraphs of up to three sentences and, but for single sentences, budget words."""
    out: list[list[str]] = []
    for s in sentences:
        if out and len(out[-1]) < 3 and sum(map(_words, out[-1])) + _words(s) <= budget:
            out[-1].append(s)
        else:
            out.append([s])
    return [" ".join(p) for p in out]


def split_long(paragraphs: list[str], limit: int = 80) -> list[str]:
    """Paragraphs beyond the limit, cut between sentences; a sentence longer than it is kept whole."""
    return [q for p in paragraphs for q in (paragraphs_of(split_sentences(p, 1) or [p], limit) if _words(p) > limit else [p])]


def key_numbers(found: list[E.Fact], most: int = 6) -> list[str]:
    """Facts with figures, headed by the first of them."""
    return [f"{f.figures[0]}: {f.text}" for f in found if f.figures][:most]


def at_a_glance(found: list[E.Fact], most: int = 4) -> list[str]:
    return [f.text for f in found if '"' not in f.text and "“" not in f.text][:most]


def comparisons(found: list[E.Fact], most: int = 4) -> list[str]:
    return [f.text for f in found if f.kind == "comparison" or re.search(r"\b(?:than|versus|compared (?:with|to)|(?:up|down) from)\b", f.text, re.I)][:most]


def measures(text: str, most: int = 6) -> list[tuple[str, str]]:
    """(label, value) of measured figures: the words before a figure in its sentence name it."""
    out: dict[str, str] = {}
    for s in split_sentences(text, 1):
        for form, kind, *_ in E.numbers(s):
            before = [w for w in _WORD.findall(s[: s.find(form)].lower()) if w not in _STOP and w.isalpha()][-2:]
            if kind in ("measure", "money", "percent", "multiplier") and before:
                out.setdefault(" ".join(before), form)
    return list(out.items())[:most]


def takeaways(found: list[E.Fact], first: str = "", most: int = 4) -> list[str]:
    """Facts like neither the lead (0.85) nor each other (0.62)."""
    return _unlike([f.text for f in found if likeness(f.text, first) <= 0.85], 0.62)[:most]


# Questions

#: Questions about a subject, and what a sentence must have to answer one.
ASKED = (("When did {s} happen?", r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|june|july|august|september|october|november|december|20\d\d)\b"), ("How much does {s} cost?", r"[$€£]\s?\d|\b(?:dollars|euros|pounds)\b"), ("Why does {s} matter?", r"\b(?:because|so that|means|in order)\b"), ("What happens next with {s}?", _AHEAD.pattern), ("Who is behind {s}?", r"\b(?:led by|owned by|founded by|run by|according to)\b"))


def questions(text: str, subject: str = "", most: int = 8) -> list[str]:
    """Questions the text asks, then those on the subject that one of its sentences can answer."""
    sentences = split_sentences(text, 1)
    own = [s for s in sentences if s.rstrip().endswith("?") and 4 <= _words(s) <= 25]
    told = [q.format(s=subject) for q, need in ASKED if subject and any(re.search(need, s, re.I) and subject.lower().split()[-1] in s.lower() for s in sentences)]
    return list(dict.fromkeys([*own, *told]))[:most]


def answer(question: str, sentences: list[str], least: float = 0.3, most: int = 55) -> str:
    """Up to three sentences that are most like the question, in their order, within most words; none from least on is an empty answer."""
    need = next((n for q, n in ASKED if re.fullmatch(re.escape(q).replace(re.escape("{s}"), ".+"), question)), None)
    score = lambda s: likeness(question, s) + (0.3 if need and re.search(need, s, re.I) else 0.0)
    ranked = sorted((i for i, s in enumerate(sentences) if s != question and not s.endswith("?") and score(s) >= least), key=lambda i: (-score(sentences[i]), i))
    kept: list[int] = []
    for i in ranked[:3]:
        if sum(_words(sentences[j]) for j in kept) + _words(sentences[i]) <= most:
            kept.append(i)
    return " ".join(sentences[i] for i in sorted(kept))


def answered(text: str, subject: str, most: int = 4) -> list[tuple[str, str]]:
    """(question, answer) pairs; questions without an answer and answers given before are left out."""
    sentences, seen, out = split_sentences(text, 1), set(), []
    for q in questions(text, subject):
        a = answer(q, sentences)
        if a and a not in seen:
            seen.add(a)
            out.append((q, a))
    return out[:most]


# Rewriting

#: Long words and forms by plain ones.
PLAIN = {"utilise": "use", "utilize": "use", "commence": "start", "terminate": "end", "purchase": "buy", "assist": "help", "attempt": "try", "endeavour": "try", "sufficient": "enough", "numerous": "many", "approximately": "about", "prior to": "before", "subsequent to": "after", "in order to": "to", "due to the fact that": "because", "at this point in time": "now", "in the event that": "if", "with regard to": "about", "a large number of": "many", "the majority of": "most", "demonstrate": "show", "facilitate": "help", "additional": "more", "obtain": "get", "require": "need", "inform": "tell"}
_PLAIN = re.compile(r"\b(?:" + "|".join(sorted(PLAIN, key=len, reverse=True)) + r")\b", re.I)
_SPOKEN = re.compile(r'"[^"]*"|“[^”]*”')
_DIGITS = "zero one two three four five six seven eight nine".split()
_SMALL = frozenset("a an the and or but for of on in at to with by from as vs".split())


def outside_quotes(text: str, change) -> str:
    """The text with a change made everywhere but in quotations."""
    out, at = [], 0
    for m in _SPOKEN.finditer(text):
        out += [change(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, change(text[at:])])


def plain_words(text: str) -> str:
    """Long words by plain ones, capitals kept, quotations left alone."""

    def plain(m: re.Match) -> str:
        w = PLAIN[m.group().lower()]
        return w[:1].upper() + w[1:] if m.group()[0].isupper() else w

    return outside_quotes(text, lambda t: _PLAIN.sub(plain, t))


def restate_numbers(text: str) -> str:
    """Percent signs and scale letters written out, and back from words where they were written out."""
    said = {"m": "million", "bn": "billion", "k": "thousand", "tn": "trillion"}
    return outside_quotes(text, lambda t: re.sub(r"(?<![\w.])([$€£]\d[\d,.]*?)(bn|tn|m|k)\b", lambda m: f"{m[1]} {said[m[2]]}", re.sub(r"(\d)\s?%", r"\1 percent", t)))


def move_attribution(sentence: str) -> str:
    """'X, Y said.' as 'Y said that X.': plain statements of one speaker at the end, quotations left alone."""
    m = re.fullmatch(r"([A-Z][^\"“”]+), ((?:[A-Z][\w'’-]+ ?){1,4}|(?:the|a) [\w ]{3,40}?) (said|says|added|confirmed|reported)\.", sentence)
    if not m:
        return sentence
    first, rest = m[1].split(" ", 1) if " " in m[1] else (m[1], "")
    begin = first if first[1:] != first[1:].lower() or first not in ("The", "A", "An", "It", "This", "That", "These", "They", "There", "In", "On") else first.lower()
    return f"{m[2][:1].upper()}{m[2][1:].rstrip()} {m[3]} that {begin} {rest}".rstrip() + "."


def reorder_clauses(sentence: str) -> str:
    """A closing clause of time, reason or contrast put first, in sentences that begin with a stop word (another may be a name)."""
    m = re.fullmatch(r"([A-Z][^,;\"“”]{15,}?),? ((?:although|because|while|when|after|before) [^,;\"“”]{8,})\.", sentence)
    if not m or m[1].split(" ", 1)[0].lower() not in _STOP:
        return sentence
    return f"{m[2][:1].upper()}{m[2][1:]}, {m[1][:1].lower()}{m[1][1:]}."


def paraphrase(text: str, least: float = 0.62) -> tuple[str, list[str]]:
    """(text, changes): each sentence restated as far as it stays like itself (least) and keeps its figures and names."""
    out, changes = [], []
    for s in split_sentences(text, 1):
        for name, change in (("numbers", restate_numbers), ("attribution", move_attribution), ("clauses", reorder_clauses), ("words", plain_words)):
            new = change(s)
            same = re.findall(r"\d[\d,.]*\d|\d", new) == re.findall(r"\d[\d,.]*\d|\d", s) or name == "clauses" and sorted(re.findall(r"\d+", new)) == sorted(re.findall(r"\d+", s))
            if new != s and same and likeness(new, s) >= least:
                s = new
                changes.append(name)
        out.append(s)
    return " ".join(out), changes


def unique_against(text: str, others: list[str], most: float = 0.82) -> tuple[str, bool]:
    """The text, restated where it is more like another than most; and whether it then is unlike all."""
    far = lambda t: all(likeness(t, o) < most for o in others)
    if far(text):
        return text, True
    new, _ = paraphrase(text)
    return new, far(new)


def shorter_sentences(text: str, most: int = 26) -> list[str]:
    """Sentences; those of more than most words are cut at ', and', ', but' or ';' where both sides have six words or more."""
    out: list[str] = []
    for s in split_sentences(text, 1):
        m = next((m for m in re.finditer(r"(?:, (?:and|but)|;) ", s) if _words(s[: m.start()]) >= 6 and _words(s[m.end() :]) >= 6), None)
        if _words(s) > most and m and not _SPOKEN.search(s):
            rest = s[m.end() :]
            out += [s[: m.start()] + ".", *shorter_sentences(rest[:1].upper() + rest[1:], most)]
        else:
            out.append(s)
    return out


def simplify(text: str, most: int = 26) -> str:
    """Plain words in short sentences."""
    return " ".join(shorter_sentences(plain_words(text), most))


def title_case(text: str) -> str:
    """Each word capitalised but for small ones within; words with capitals are kept."""
    parts = text.split()
    return " ".join(w if w != w.lower() or (i and w in _SMALL) else w[:1].upper() + w[1:] for i, w in enumerate(parts))


def numbers_to_words(text: str) -> str:
    """Lone digits as words; in figures, dates, amounts and names they are kept."""
    return re.sub(r"(?<![\w$€£.,:/-])\d(?![\w%:/-]|[.,]\d| (?:percent|million|billion|am|pm)\b)", lambda m: _DIGITS[int(m.group())], text)


def restore_case(text: str, names: list[str]) -> str:
    """Names written as given, wherever they stand as whole words; longer ones first."""
    if not names:
        return text
    by = {n.lower(): n for n in names}
    return re.sub(r"\b(?:" + "|".join(re.escape(n) for n in sorted(by, key=len, reverse=True)) + r")\b", lambda m: by[m.group().lower()], text, flags=re.I)


# House style, by columns

#: What house style objects to, by pattern.
STYLE = {"first person": r"\b(?:I|[Ww]e|[Uu]s|[Oo]ur|[Mm]y)\b", "second person": r"\b(?:[Yy]ou|[Yy]our|[Yy]ours)\b", "exclamation": r"!", "capitals": r"\b[A-Z]{6,}\b", "selling": r"(?i)\b(?:buy now|order today|limited time|best deal|click here|subscribe now)\b", "hedging": r"(?i)\b(?:reportedly|allegedly|apparently|possibly|perhaps|arguably)\b", "spaces": r"\S  +\S", "worn": r"(?i)\b(?:game[- ]changer|at the end of the day|think outside the box|needless to say)\b"}
_SIGNS = r"\"[^\"]*\"|“[^”]*”"


def style_issues(text: Column) -> Column:
    """Names of the rules a text breaks outside quotations, in the order of STYLE; of none for no text."""
    own = F.regexp_replace(text, _SIGNS, "")
    return F.coalesce(F.array_compact(F.array(*[F.when(own.rlike(p), F.lit(n)) for n, p in STYLE.items()])), F.array().cast("array<string>"))


def style_score(text: Column) -> Column:
    """100 less 12 a broken rule."""
    return F.greatest(F.lit(0), 100 - 12 * F.size(style_issues(text)))


def style_fixed(text: Column) -> Column:
    """Exclamation marks as full stops, runs of signs and spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"!+", "."), r"([.,?])\1+", "$1"), r"[ \t]{2,}", " "))


# Drafts


@dataclass
class Draft:
    headline: str
    dek: str
    lead: str
    sections: list[tuple[str, str, list[str]]]
    takeaways: list[str]
    questions: list[tuple[str, str]]
    tags: list[str]
    description: str

    @property
    def body(self) -> str:
        return "\n".join([self.lead, *(p for _, _, ps in self.sections for p in ps)])


def description(first: str, second: str = "", least: int = 120, most: int = 160) -> str:
    """Whole sentences of least to most characters if they give that, else the text cut at a word."""
    whole = " ".join(x for x in (first, second) if x)
    out = ""
    for s in split_sentences(whole, 1):
        if len(out) + len(s) + bool(out) > most:
            break
        out = f"{out} {s}".strip()
    return out if len(out) >= least or len(whole) <= most else whole[:most].rsplit(" ", 1)[0].rstrip(" ,;:-") + "…"


def tags_of(keyword: str, names: list[str], secondary: list[str], most: int = 8) -> list[str]:
    """Keyword, names and three further phrases, each once whatever its case."""
    seen: set[str] = set()
    return [t for t in [keyword, *names, *secondary[:3]] if t and not (t.lower() in seen or seen.add(t.lower()))][:most]


def write(title: str, text: str, target: int = 650, published: tuple = ()) -> Draft:
    """A draft of a text. An empty text gives an empty draft."""
    found = E.distinct_facts(E.facts(text))
    names = [e.name for e in E.entities(text)][:5]
    plan = E.keyword_plan(text, title, names)
    quotes = E.best_quotes(text)
    figures = tuple(f for x in found for f in x.figures)[:5]
    headline = best_headline(title or (found[0].text if found else ""), plan["primary"], tuple(names), figures, published)
    first = lead(found, headline)
    used, parts = set(split_sentences(first, 1)), []
    for s in outline(found, quotes, plan["primary"], target):
        if s.kind == "quotes":
            told = [f"“{q.text.rstrip(',')}”, said {q.speaker}." for q in quotes if q.speaker]
        elif s.kind in ("lead", "questions"):
            continue
        else:
            told = [found[i].text for i in sorted(s.facts, key=lambda i: found[i].sentence) if found[i].text not in used]
        kept: list[str] = []
        for t in told:  # a section's first sentence stands whatever its length
            if not kept or sum(map(_words, kept)) + _words(t) <= s.words:
                kept.append(t)
        if kept:
            parts.append((s.kind, s.heading, split_long(paragraphs_of(kept))))
            used.update(kept)
    second = dek(found, first)
    return Draft(headline, second, first, parts, takeaways(found, first), answered(text, plan["primary"]), tags_of(plan["primary"], names, list(plan.get("secondary") or [])), description(first, second))


def extend(draft: Draft, text: str, need: int) -> list[str]:
    """Sentences of the text that the draft doesn't tell yet, the most telling first, until need words are there."""
    out: list[str] = []
    for f in E.distinct_facts(E.facts(text)):
        if sum(map(_words, out)) >= need:
            break
        if f.text not in draft.body and all(likeness(f.text, o) <= 0.62 for o in out):
            out.append(f.text)
    return out


def checks(d: Draft, text: str) -> list[tuple[str, bool]]:
    """(name, ok): what a draft must fulfil against its source."""
    figures = set(re.findall(r"\d[\d,.]*\d|\d", text))
    body = d.body
    said = [q for q in re.findall(r"“([^”]+)”", body)]
    ps = [p for _, _, x in d.sections for p in x]
    return [("headline length", 20 <= len(d.headline) <= 70), ("lead", 0 < _words(d.lead) <= 60), ("sections", len(d.sections) >= 1), ("figures grounded", all(f in figures for f in re.findall(r"\d[\d,.]*\d|\d", body))), ("quotations grounded", all(q.rstrip(",.") in text for q in said)), ("paragraphs short", all(_words(p) <= 80 or len(split_sentences(p, 1)) == 1 for p in ps)), ("nothing twice", len(ps) == len(set(ps))), ("headline not the lead", likeness(d.headline, d.lead) < 0.95), ("description length", 50 <= len(d.description) <= 161), ("tags", len(d.tags) >= 2), ("long enough", _words(body) >= 60)]


def quality(d: Draft, text: str) -> float:
    c = checks(d, text)
    return round(sum(ok for _, ok in c) / len(c), 4)


def revise(d: Draft, text: str) -> Draft:
    """A draft with what its failed checks ask for: further facts where it is short, doubled paragraphs left out."""
    failed = {n for n, ok in checks(d, text) if not ok}
    if failed & {"long enough", "sections"} and (more := extend(d, text, 60)):
        d.sections = [*d.sections, ("details", heading_of("details", d.tags[0] if d.tags else ""), paragraphs_of(more))]
    if "nothing twice" in failed:
        seen: set[str] = set()
        d.sections = [(k, h, [p for p in ps if not (p in seen or seen.add(p))]) for k, h, ps in d.sections]
    return d


def confidence(d: Draft, text: str) -> float:
    """0 to 1: half the quality, and up to an eighth each for facts told, sources quoted, tags, and length."""
    told = sum(len(ps) for _, _, ps in d.sections)
    return round(0.5 * quality(d, text) + 0.125 * (min(1, told / 4) + min(1, sum(k == "quotes" for k, _, _ in d.sections)) + min(1, len(d.tags) / 5) + min(1, _words(d.body) / 200)), 4)


def draft_rows(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, headline, dek, lead, body, sections, takeaways, questions, tags, description, words, quality, confidence); null and empty texts give no rows."""

    def rows(both: str):
        t, body = both.split("\x1f", 1)
        if not body.strip():
            return []
        d = revise(write(t, body), body)
        return [(d.headline, d.dek, d.lead, d.body, len(d.sections), len(d.takeaways), len(d.questions), d.tags, d.description, _words(d.body), quality(d, body), confidence(d, body))]

    s, i, f = T.StringType(), T.IntegerType(), T.DoubleType()
    fields = [("headline", s), ("dek", s), ("lead", s), ("body", s), ("sections", i), ("takeaways", i), ("questions", i), ("tags", T.ArrayType(s)), ("description", s), ("words", i), ("quality", f), ("confidence", f)]
    arrow = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.list_(pa.string()), pa.string(), pa.int32(), pa.float64(), pa.float64()]
    joined = docs.select(key, F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\x1f"), F.col(text)).alias("_both"))
    return exploded(joined, key, "_both", rows, fields, arrow)


def question_rows(docs: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """(key, question, answer) on the chief keyword of each text."""
    return exploded(docs, key, text, lambda t: answered(t, E.keyword_plan(t)["primary"], most), [("question", T.StringType()), ("answer", T.StringType())], [pa.string(), pa.string()])


def brief(title: str, text: str) -> str:
    """A short page: two sentences to lead, three in a list, two more; ranked by place, likeness to the title and to the rest, figures and
    quotations."""
    sentences = [s for s in split_sentences(text) if 8 <= _words(s) <= 60 and not E.is_noise(s)]
    rank = E.rank_sentences(sentences) if sentences else []
    score = [float(r) + 0.15 * likeness(s, title) + 0.05 * bool(re.search(r"\d", s)) + 0.03 * bool(_SPOKEN.search(s)) + 0.1 / (1 + i) for i, (s, r) in enumerate(zip(sentences, rank))]
    top = sorted(range(len(sentences)), key=lambda i: (-score[i], i))[:7]
    safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    order = [safe(sentences[i]) for i in (*sorted(top[:2]), *sorted(top[2:5]), *sorted(top[5:]))]
    out = f"<p>{' '.join(order[:2])}</p>" if order else ""
    out += "<ul>" + "".join(f"<li>{s}</li>" for s in order[2:5]) + "</ul>" if order[2:5] else ""
    return out + (f"<p>{' '.join(order[5:])}</p>" if order[5:] else "")


def brief_rows(docs: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, brief); null texts give no rows, texts without a fit sentence an empty brief."""
    joined = docs.select(key, F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\x1f"), F.col(text)).alias("_both"))
    return exploded(joined, key, "_both", lambda both: [(brief(*both.split("\x1f", 1)),)], [("brief", T.StringType())], [pa.string()])
