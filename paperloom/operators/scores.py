"""Scores of texts and headlines as columns: readability, keyword placement, bait, categories, rhythm of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X

#: Sentences end at these signs before white space or the text's end; what Spark and other engines can both tell.
SENTENCE_END = r"[.!?]+(?:\s|$)"
# Endings of words that tell complex ones.
COMPLEX = "(?:tion|sion|ment|ance|ence|ity)$"


def text_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sentences, words, letters, syllables, polysyllables, characters, long_words, complex_words, stopwords); one at least of
    sentences and words. letters counts runs of letters, as the formulas here expect."""
    d = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), X.words(F.col(text)).alias("w"), F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0)).alias("l"))
    own = lambda c: F.coalesce(F.sum(c), F.lit(0))
    syl = d.select(key, F.explode("l").alias("x")).groupBy(key, "x").agg(F.count(F.lit(1)).alias("n")).withColumn("s", X.syllables(F.col("x"))).groupBy(key).agg(own(F.col("n") * F.col("s")).alias("syllables"), own(F.when(F.col("s") >= 3, F.col("n")).otherwise(0)).alias("polysyllables"))
    count = lambda f: F.size(F.filter("w", f))
    base = d.select(key, F.greatest(F.lit(1), F.regexp_count("t", F.lit(SENTENCE_END))).alias("sentences"), F.greatest(F.lit(1), F.size("w")).alias("words"), F.size("l").alias("letters"), F.length("t").alias("characters"),
        count(lambda t: F.length(t) > 7).alias("long_words"), count(lambda t: (F.length(t) > 2) & t.rlike(COMPLEX)).alias("complex_words"), count(lambda t: t.isin(*X.STOP_WORDS)).alias("stopwords"))
    return base.join(syl, key, "left").fillna(0, ["syllables", "polysyllables"])


def flesch_reading_ease() -> Column:
    return 206.835 - 1.015 * F.col("words") / F.col("sentences") - 84.6 * F.col("syllables") / F.col("words")


def flesch_kincaid_grade() -> Column:
    return 0.39 * F.col("words") / F.col("sentences") + 11.8 * F.col("syllables") / F.col("words") - 15.59


def gunning_fog() -> Column:
    return 0.4 * (F.col("words") / F.col("sentences") + 100 * F.col("polysyllables") / F.col("words"))


def smog() -> Column:
    """0 where fewer than three sentences tell."""
    return F.when(F.col("sentences") < 3, 0.0).otherwise(1.0430 * F.sqrt(F.col("polysyllables") * 30 / F.col("sentences")) + 3.1291)


def automated_index() -> Column:
    return 4.71 * F.col("characters") / F.col("words") + 0.5 * F.col("words") / F.col("sentences") - 21.43


def coleman_liau() -> Column:
    return 5.88 * F.col("letters") / F.col("words") - 29.6 * F.col("sentences") / F.col("words") - 15.8


def dale_chall() -> Column:
    """Long words stand for unfamiliar ones."""
    return 15.79 * F.col("long_words") / F.col("words") + 0.0496 * F.col("words") / F.col("sentences") + 3.6365


def average_syllables() -> Column:
    return F.when(F.col("letters") == 0, 0.0).otherwise(F.col("syllables") / F.col("letters"))


FORMULAS = {"ease": flesch_reading_ease, "grade": flesch_kincaid_grade, "fog": gunning_fog, "smog": smog, "ari": automated_index, "liau": coleman_liau, "chall": dale_chall, "syllables_a_word": average_syllables}


def grade_band(grade: Column) -> Column:
    return F.when(grade <= 6, "very easy").when(grade <= 9, "easy").when(grade <= 12, "standard").when(grade <= 16, "difficult").otherwise("academic")


def readability(counts: DataFrame, rhythm: DataFrame, key: str) -> DataFrame:
    """(key, formulas, average_grade, band, score): the score from 0 to 100 rewards ease, a grade near 9.5, short paragraphs and sentences."""
    d = counts.join(rhythm, key).select(key, *[f().alias(n) for n, f in FORMULAS.items()], "paragraph_words", "short_share", "long_share")
    grades = F.filter(F.array("grade", "fog", "ari", "liau"), lambda g: g > 0)
    average = F.when(F.size(grades) == 0, 0.0).otherwise(F.aggregate(grades, F.lit(0.0), lambda s, g: s + g) / F.size(grades))
    d = d.withColumn("average_grade", average)
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    paragraph = F.when(F.col("paragraph_words") <= 70, 15.0).otherwise(F.greatest(F.lit(0.0), 15 - 0.3 * (F.col("paragraph_words") - 70)))
    score = clip((F.col("ease") - 20) * 0.9, 0.0, 45.0) + F.greatest(F.lit(0.0), 20 - 2.2 * F.abs(F.col("average_grade") - 9.5)) + paragraph + 12 * F.col("short_share") + 8 * (1 - F.least(F.lit(1.0), 3 * F.col("long_share")))
    return d.withColumn("band", grade_band(F.col("average_grade"))).withColumn("score", F.round(clip(score, 0.0, 100.0)).cast("int")).drop("paragraph_words", "short_share", "long_share")


def rhythm(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraphs, paragraph_words, most_paragraph_words, sentence_words, most_sentence_words, short_share, long_share): words of
    paragraphs (between blank lines) and sentences, and the shares of those of 14 words or fewer and of 28 or more."""
    d = docs.filter(F.col(text).isNotNull())
    parts = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), lambda p: F.when(F.length(F.trim(p)) > 0, F.size(F.regexp_extract_all(F.lower(p), F.lit(X.WORD_PATTERN), F.lit(0)))).otherwise(-1)), lambda n: n >= 0)
    sents = F.filter(F.transform(F.split(F.col(text), r"[.!?]+\s+|\n+"), lambda p: F.size(F.regexp_extract_all(F.lower(p), F.lit(X.WORD_PATTERN), F.lit(0)))), lambda n: n > 0)
    d = d.select(key, parts.alias("p"), sents.alias("s"))
    mean = lambda c: F.when(F.size(c) == 0, 0.0).otherwise(F.aggregate(c, F.lit(0), lambda a, n: a + n) / F.size(c))
    share = lambda c, f: F.when(F.size(c) == 0, 0.0).otherwise(F.size(F.filter(c, f)) / F.size(c))
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0))
    return d.select(key, F.size("p").alias("paragraphs"), mean("p").alias("paragraph_words"), most("p").alias("most_paragraph_words"), mean("s").alias("sentence_words"), most("s").alias("most_sentence_words"), share("s", lambda n: n <= 14).alias("short_share"), share("s", lambda n: n >= 28).alias("long_share"))


# Keyword placement


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, both in lower case, without overlap."""
    return F.when(F.length(phrase) > 0, ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("int")).otherwise(0)


def keyword_density(tokens: Column, phrase: str) -> Column:
    """Share of a text's tokens that a phrase makes up."""
    ws = phrase.lower().split()
    hits = F.size(F.filter(tokens, lambda t: t == ws[0])) if len(ws) == 1 else occurrences(F.array_join(tokens, " "), F.lit(" ".join(ws)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(hits * len(ws) / F.size(tokens))


def placement(text: Column, tokens: Column, phrase: str) -> Column:
    """A struct (hits, density in percent, first, spread): places go from 0 to 1, first being 1 where there is none."""
    low, p = F.lower(text), phrase.lower().strip()
    hits = F.regexp_count(low, F.lit(rf"(?<!\w){p}(?!\w)"))
    count = lambda w: F.size(F.filter(tokens, lambda t: t == w))
    least = F.least(*[count(w) for w in p.split()], F.lit(1 << 30))
    hits = F.when(hits > 0, hits).otherwise(F.when(least < 1 << 30, least).otherwise(0))
    size = F.greatest(F.lit(1), F.length(low))
    first = F.instr(low, p)
    last = F.length(low) - F.instr(F.reverse(low), p[::-1]) - len(p) + 1
    return F.struct(hits.alias("hits"), (hits / F.greatest(F.lit(1), F.size(tokens)) * 100).alias("density"), F.when(first > 0, (first - 1) / size).otherwise(1.0).alias("first"), F.when(first > 0, (last - (first - 1)) / size).otherwise(0.0).alias("spread"))


def prominence(at: Column) -> Column:
    """From 0 to 1: how early and how often, of what placement gives."""
    frequent = F.least(F.lit(1.0), F.log1p(at["hits"]) / F.log(F.lit(9.0)))
    return F.when(at["hits"] == 0, 0.0).otherwise(0.6 * (1 - F.least(F.lit(1.0), at["first"])) + 0.4 * frequent)


def proximity(tokens: Column, phrase: str, window: int = 12) -> Column:
    """From 0 to 1: how often all other words of a phrase stand soon after its first."""
    ws = phrase.lower().split()
    if len(ws) < 2:
        return F.array_contains(tokens, ws[0]).cast("double") if ws else F.lit(0.0)
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t == ws[0], i)), lambda i: i.isNotNull())
    near = F.filter(places, lambda i: F.size(F.array_except(F.array(*map(F.lit, ws[1:])), F.slice(tokens, i + 2, F.lit(window - 1)))) == 0)
    return F.least(F.lit(1.0), F.size(near) / len(ws))


def saturation(text: Column, phrase: str) -> Column:
    """From 0 to 1: how far beyond an eighth of a paragraph's words a phrase's words go in the worst paragraph of eight words or more."""
    ws = phrase.lower().split()
    words = F.transform(F.split(text, r"\n{2,}|</p>"), lambda p: F.regexp_extract_all(F.lower(p), F.lit(X.WORD_PATTERN), F.lit(0)))
    ratio = F.transform(F.filter(words, lambda w: F.size(w) >= 8), lambda w: F.size(F.filter(w, lambda t: t.isin(*ws))) / F.size(w))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.coalesce(F.array_max(ratio), F.lit(0.0)) - 0.12) * 4))


def ngram_coverage(text: Column, phrases: list[str]) -> Column:
    """Occurrences over words, by phrase."""
    return F.create_map(*[x for p in phrases for x in (F.lit(p), occurrences(F.lower(text), F.lit(p.lower())) / max(1, len(p.split())))])


def placement_score(density: Column, prominent: Column, in_title: Column, in_first: Column, headings: Column, in_meta: Column, in_url: Column) -> Column:
    """From 0 to 100: density between 0.4 and 2 percent, prominence, and the places that hold the phrase; stuffing costs."""
    base = F.when(density.between(0.4, 2.0), 22).when(density > 3.2, -12).when(density > 2.0, 12).when(density > 0, 10).otherwise(0)
    one = lambda c, n: F.when(c, n).otherwise(0)
    total = base + 20 * prominent + one(in_title, 20) + one(in_first, 14) + F.least(F.lit(12), 4 * headings) + one(in_meta, 8) + one(in_url, 6)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).cast("int")


def stuffing_risk(tokens: Column, phrases: list[str]) -> Column:
    """The phrases whose words are more than 6 percent of all and more than six."""
    hits = lambda p: F.size(F.filter(tokens, lambda t: t.isin(*p.lower().split())))
    return F.array_compact(F.array(*[F.when((hits(p) > 6) & (hits(p) / F.greatest(F.lit(1), F.size(tokens)) > 0.06), F.lit(p)) for p in phrases]))


# Headlines

# Phrases that hold something back, words that exaggerate with their weight, phrases that press.
CURIOSITY = "you won't believe|you will not believe|this one trick|one weird trick|shocking|shocked|unbelievable|insane|mind-blowing|mind blowing|jaw-dropping|jaw dropping|you need to see|wait until|wait till|the reason why|here's why|here is why|here's what|what happens next|this is what|no one expected|nobody expected|did not see that coming|secret|secrets|hidden truth|the truth about|exposed|revealed:|leaked:|what they don't|what they do not|don't tell|do not tell".split("|")
HYPE = {w: v for v, ws in {1.0: "insane unbelievable shocking bombshell", 0.9: "apocalyptic", 0.8: "crazy epic catastrophic doomed terrifying", 0.7: "incredible revolutionary colossal explosive stunning devastating nightmare panic", 0.6: "groundbreaking unprecedented wild absurd ridiculous brutal disaster killer deadly urgent", 0.5: "amazing massive enormous dead scary greatest ultimate warning", 0.4: "huge historic fear perfect", 0.3: "breaking exclusive"}.items() for w in ws.split()}
URGENCY = "now|today only|limited time|act fast|hurry|before it's gone|before it is gone|last chance|don't miss|do not miss|ends soon|hours left|minutes left|immediately|right now|asap".split("|")
LISTICLE = r"(?i)^\s*\d{1,3}\s*(?:\+|ways|things|tips|tricks|reasons|facts|photos|pictures|secrets|mistakes|apps|gadgets|deals)\b"


def hype(tokens: Column) -> Column:
    """Sum of the weights of exaggerating words."""
    weights = F.create_map(*[F.lit(x) for kv in HYPE.items() for x in kv])
    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(weights, t), F.lit(0.0)))


def bait_reasons(title: Column, tokens: Column) -> Column:
    """The reasons for a bait score, those that apply."""
    low = F.lower(title)
    tests = (
        (_holds(low, CURIOSITY), "curiosity"), (hype(tokens) > 0, "hype"), (_holds(low, URGENCY), "urgency"), (title.rlike(LISTICLE), "list"), (F.regexp_count(title, F.lit(r"\b[A-Z]{4,}\b")) > 0, "capitals"),
        (F.instr(title, "!") > 0, "exclamation"), (title.rlike(r"\?\s*$") & ~title.rlike(r"\d"), "question"), (F.size(tokens) > 22, "long"), (F.size(tokens) < 4, "vague"))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))


def _holds(low: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def bait_score(title: Column, tokens: Column) -> Column:
    """From 0 to 1: how much a headline is bait; an empty one wholly."""
    low, one = F.lower(title), lambda c, n: F.when(c, n).otherwise(0.0)
    capitals = F.regexp_count(title, F.lit(r"\b[A-Z]{4,}\b"))
    total = one(_holds(low, CURIOSITY), 0.34) + 0.22 * hype(tokens) + one(_holds(low, URGENCY), 0.2) + one(title.rlike(LISTICLE), 0.18) + F.least(F.lit(0.25), 0.12 * capitals) + 0.12 * F.regexp_count(title, F.lit("!"))
    total = total + one(title.rlike(r"\?\s*$") & ~title.rlike(r"\d"), 0.08) + one(F.size(tokens) > 22, 0.1) + one(F.size(tokens) < 4, 0.12)
    return F.when(F.length(F.coalesce(title, F.lit(""))) == 0, 1.0).otherwise(F.least(F.lit(1.0), total))


def is_bait(title: Column, tokens: Column, least: float = 0.55) -> Column:
    return bait_score(title, tokens) >= least


def body_bait(text: Column, tokens: Column, sentences: Column) -> Column:
    """A struct (hype_load, question_share, thin, exclamations) of a text: loads are by 100 words."""
    n = F.greatest(F.lit(1), F.size(tokens))
    asked = F.regexp_count(text, F.lit(r"\?(?:\s|$)"))
    return F.struct((hype(tokens) / n * 100).alias("hype_load"), (asked / F.greatest(F.lit(1), sentences)).alias("question_share"), (F.size(tokens) < 180).alias("thin"), (F.regexp_count(text, F.lit("!")) / n * 100).alias("exclamations"))


# Categories


def categories(docs: DataFrame, key: str, title: str, text: str, lexicon: DataFrame, least: float = 2.0) -> DataFrame:
    """(key, category, score): the category of a lexicon (place, category, word) whose words a title (3 each) and a text (a half each,
    three times at most) hold most; the first of equal ones, none under least. Single words meet tokens; phrases are looked for in the
    joined tokens of the texts that hold their first word."""
    d = docs.select(key, X.words(F.col(title)).alias("tw"), X.words(F.col(text)).alias("bw"))
    words = lexicon.select("place", "category", F.lower("word").alias("word")).withColumn("head", F.split_part("word", F.lit(" "), F.lit(1)))
    # A lexicon is a dimension: its heads go to the texts, of which only those that hold one are repeated, once for each.
    heads = F.broadcast(words.agg(F.collect_set("head").alias("heads")))
    held = d.crossJoin(heads).select(key, "tw", "bw", F.array_intersect(F.array_union("tw", "bw"), "heads").alias("held")).filter(F.size("held") > 0)
    joined = held.select(key, F.array_join("tw", " ").alias("t"), F.array_join("bw", " ").alias("b"), F.explode("held").alias("head"))
    each = joined.join(F.broadcast(words), "head")
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    here = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    # Doubled spaces within let neighbouring occurrences each have their own around.
    wide = lambda c: F.concat(F.lit(" "), F.replace(F.col(c), F.lit(" "), F.lit("  ")), F.lit(" "))
    number = occurrences(wide("b"), wide("word"))
    score = F.when(F.contains(padded("t"), here), 3.0).otherwise(0.0) + 0.5 * F.least(F.lit(3), number)
    per = each.select(key, "place", "category", score.alias("s")).groupBy(key, "place", "category").agg(F.sum("s").alias("s"))
    best = per.groupBy(key).agg(F.max(F.struct("s", (-F.col("place")).alias("p"), "category")).alias("m"))
    return best.filter(F.col("m.s") >= least).select(key, F.col("m.category").alias("category"), F.col("m.s").alias("score"))
