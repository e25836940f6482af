"""Text columns: tokens, n-grams, counts and small projections, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token shapes of lower-cased text - names with digits, words, figures, dollar amounts.
WORD_PATTERN = r"[a-z]+\d[a-z0-9\-]*|[a-z][a-z'\-]*|\d[\d,\.]*%?|\$[\d,\.]+[mbnk]?"
# General English stop words.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself me more most my myself no nor not "
    "of off on once only or other ought our ours out over own same she should so some such than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why with would you your yours"
).split()
# Function words by language for detection.
FUNCTION_WORDS = {
    "en": "the and of to in is that for with as was on be by it".split(),
    "es": "de la que el en y a los del se las por un para con".split(),
    "fr": "le de et à les des en un du une que est pour qui dans".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im".split(),
}
#: Scripts told by their code points, first match wins.
SCRIPTS = {"bn": r"[\x{0980}-\x{09FF}]", "hi": r"[\x{0900}-\x{097F}]", "ar": r"[\x{0600}-\x{06FF}]", "ru": r"[\x{0400}-\x{04FF}]", "zh": r"[\x{4E00}-\x{9FFF}]"}


def words(text: Column) -> Column:
    """Lower-cased word tokens; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def alphanumeric(text: Column) -> Column:
    """Runs of a-z and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def is_content(token: Column) -> Column:
    """Whether a token is no stop word, longer than two characters and no bare number."""
    return ~token.isin(*STOP_WORDS) & (F.length(token) > 2) & ~token.rlike(r"^\d+$")


def content_words(tokens: Column) -> Column:
    """Content tokens, duplicates kept."""
    return F.filter(tokens, is_content)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens, joined by spaces; fewer tokens give none. Expects a materialised array column."""
    size = F.size(tokens)
    parts = F.arrays_zip(*[F.slice(tokens, F.lit(i + 1), F.greatest(size - (n - 1), F.lit(0))) for i in range(n)])
    return F.transform(parts, lambda s: F.concat_ws(" ", *[s[str(i)] for i in range(n)]))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text between spaces."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words, hyphens and apostrophes joining them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_][\p{L}\p{M}\p{N}_'’\-]*")), F.lit(0))


def truncate(text: Column, limit: int, ellipsis: str = "…") -> Column:
    """Text cut at the last space within the limit, the ellipsis included; shorter text is kept."""
    head = F.substring(text, 1, limit - len(ellipsis))
    cut = F.when(head.rlike(r"\s"), F.regexp_replace(head, r"\s\S*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.\-]+$", ""), F.lit(ellipsis)))


def escape_html(text: Column) -> Column:
    """The five characters that HTML escapes."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def looks_english(text: Column) -> Column:
    """Whether less than a fifth of the letters is foreign to Latin script; text without letters is not."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    foreign = F.regexp_count(text, F.lit(r"[^\P{L}\x{0000}-\x{024F}]"))
    return F.coalesce((letters > 0) & (foreign * 5 < letters), F.lit(False))


def script_of(text: Column) -> Column:
    """The commonest script other than Latin, from three signs and a twentieth of the text on; else an empty text."""
    counts = [F.regexp_count(text, F.lit(p)) for p in SCRIPTS.values()]
    top = F.greatest(*counts)
    name = F.coalesce(*[F.when(c == top, F.lit(k)) for k, c in zip(SCRIPTS, counts)])
    return F.when(top >= F.greatest(F.lit(3.0), F.length(text) * 0.05), name).otherwise("")


def language(text: Column) -> Column:
    """Language by script, else by function words; ties go to the greater code, and no evidence to English."""
    tokens = F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ']+"), F.lit(0)), F.array().cast("array<string>")))
    scored = F.array_max(F.array(*[F.struct(F.size(F.array_intersect(tokens, F.array(*map(F.lit, ws)))).alias("n"), F.lit(k).alias("k")) for k, ws in FUNCTION_WORDS.items()]))
    return F.when(script_of(text) != "", script_of(text)).when(scored["n"] > 0, scored["k"]).otherwise("en")


def syllables(word: Column) -> Column:
    """Syllables of a lower-case English word by vowel groups; short words have one."""
    w = F.regexp_replace(word, "[^a-z]", "")
    w2 = F.when(w.rlike("[^td]ed$") & (F.length(w) > 3), F.regexp_replace(w, "ed$", "")).otherwise(w)
    groups = F.regexp_count(w2, F.lit("[aeiouy]+"))
    silent = w2.rlike("e$") & ~w2.rlike("[^aeiouy]le$|ee$|ie$|ye$|oe$") & (groups > 1)
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), groups - F.when(silent, 1).otherwise(0)))
