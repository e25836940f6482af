"""Page boilerplate: which paragraphs of a page belong to its story.

1. Host suffix array. The paragraphs of a page make one token stream, with a mark at the end of each. Suffixes of the
   streams start at the mark before a line and at each of its tokens but the first; each is kept to its first LINE_DEPTH
   tokens behind the key of its host (longer substrings are those whose suffixes follow one another). All are
   range-sorted, so that equal beginnings lie side by side; neighbours give the longest beginning of each suffix that
   stands on REPEATED pages, across the borders of the sorted ranges too. Tokens that such substrings cover, line ends
   crossed, are repeated text.
2. Long running prose is no exception: covered by substrings of LONG tokens that stand under REPEATED headlines it is a
   notice, a legal text or an author's note, and goes. Stories share short phrases, so that shorter substrings tell nothing
   there. Prose that is not covered is a unique run and stays. As in lines, a token is covered if a repeated substring
   starts at it, and every token is looked at. The substring of LONG tokens there goes by the GRAM tokens of it with the
   least hash, which are the same in equal substrings, and is counted among those that have these in common. Where they
   stand under fewer headlines, no substring with them can be repeated.
3. Lines are short and vary from page to page. Covered ones, and bare lines outside the pages' cores of unique prose,
   teach a model of tokens and pairs of them what page parts look like; unique prose and uncovered lines within the
   cores teach it stories. It decides the lines. A page all of whose prose has words of notices has no unique prose.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import residue_marks as marks_
from paperloom.llm import streams
from paperloom.llm.encodings import quick, suspicious
from paperloom.session import cut

#: Tokens a repeated substring of lines has at least, and of prose. A substring that runs to the end of its line may be
#: shorter; in prose, where fewer than SHORT tokens are left, the substring of the last SHORT ones tells.
SHORT, LONG = 5, 20
#: Tokens that are kept of a suffix.
LINE_DEPTH = 6
#: Tokens of a substring of prose that it goes by.
GRAM = 8
#: Different pages of a host (headlines, for prose) that a repeated substring must be found on. Told by the least, the
#: greatest and another one, so that it is three.
REPEATED = 3
#: Share of a paragraph of prose, and of a line, that repeated substrings must cover. Names are not masked in prose:
#: stories of one pattern differ in their names, notices don't.
STANDING, COVERED = 0.9, 0.5
#: Words from which on a paragraph of three sentences or more, of two, or of one, is running prose.
PROSE_WORDS = (20, 30, 45)
#: Scores from which on a line is a page part or a story for certain; between them its place on the page decides.
SURE_PART, SURE_STORY = 14.0, -8.0
#: Score that a line must reach to be taken for a story's on a page without prose.
LONE_STORY = -30.0
# Some of the most frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was on with as at by a an but not has have will they you we this "
    "le la les des du de et un une est que pour dans sur à en au aux ne pas se "
    "der die das und zu den von mit für ein eine ist im dem auf nicht sich des "
    "el los las y una por con del se su para al no".split()
)
#: Bits of the model's features. The model has two counts for each of their values, whatever the corpus.
BITS = 20
BUCKETS = 1 << BITS
#: Order of a suffix's bytes as they are sorted: two tokens stand amid the host's key, so that the eight bytes which a sort
#: compares first tell suffixes of one host apart. Suffixes with two tokens in common still lie by host.
_SENT = np.array([0, 1, 2, 3, 8, 9, 10, 11, 4, 5, 6, 7, *range(12, 8 + 2 * LINE_DEPTH)])
#: Bytes of pages that are taken at once.
BATCH = 3 << 20
#: Rows of a sorted range that are held against each other at once. Rows of one key beyond CROWD are left to Spark.
CHUNK, CROWD = 100_000, 1_000_000

_CLOSERS = "”\"»’) \t\r\n\xa0"
_SENTENCE = re.compile(r"(?<=[.!?।])[”\"»’)]*\s+")
_WORDS = re.compile(r"[^\W\d_]+")
_ENDS = "[.!?।][”\"»’) \\t\\r\\n ]*$"
_NAME, _SITE, _START, _END = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0x4444444444444444))
_FUNCTION_KEYS = np.sort(np.array([streams.key_of(w) for w in FUNCTION_WORDS], np.uint64))
_EDGE_KEYS = np.sort(np.array([streams.key_of(w) for w in ("|", "/", ">", "*", "–", "—", "-", "…", "’")], np.uint64))
_NO = np.uint64(0)

#: Kinds of rows of the first pass: a paragraph; token counts of unique prose, and of headlines.
PARAGRAPH, COUNTS, HEADLINES = 0, 1, 2
#: Marks of a paragraph: none, a template part in it, nothing but template parts, filler, empty, a notice.
PLAIN, TEMPLATE_IN, TEMPLATE_ONLY, FILLED, EMPTY, NOTICED = 0, 1, 2, 3, 4, 5

_ANCHOR = T.StructType([T.StructField("suffix", T.BinaryType()), T.StructField("gap", T.IntegerType()), T.StructField("room", T.IntegerType()), T.StructField("rest", T.IntegerType())])
_GRAM = T.StructType([T.StructField("key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("marks", T.BinaryType())])
_PASS = T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("uid", T.LongType()), T.StructField("page_id", T.LongType()), T.StructField("par_no", T.IntegerType()), T.StructField("line", T.LongType()), T.StructField("size", T.IntegerType()),
    T.StructField("zone", T.ByteType()), T.StructField("ends", T.BooleanType()), T.StructField("bare", T.BooleanType()), T.StructField("mark", T.ByteType()), T.StructField("prose", T.BooleanType()), T.StructField("who", T.LongType()), T.StructField("sent", T.BooleanType()),
    T.StructField("feats", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("anchors", T.ArrayType(_ANCHOR)), T.StructField("grams", T.ArrayType(_GRAM)),
])
_ARROW = {"kind": pa.int8(), "uid": pa.int64(), "page_id": pa.int64(), "par_no": pa.int32(), "line": pa.int64(), "size": pa.int32(), "zone": pa.int8(), "ends": pa.bool_(), "bare": pa.bool_(), "mark": pa.int8(), "prose": pa.bool_(), "who": pa.int64(), "sent": pa.bool_()}


@functools.lru_cache(maxsize=1 << 14)
def _hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def bare_words(text: str) -> bool:
    """Whether a text is sentences of Latin letters without one function word, name or figure, as filler is."""
    if not text.isascii() or not FUNCTION_WORDS.isdisjoint(text.lower().split()):
        return False
    w = _WORDS.findall(text)
    return len(w) >= 6 and FUNCTION_WORDS.isdisjoint(x.lower() for x in w) and sum(x[0].isupper() for x in w) <= len(_SENTENCE.split(text.strip())) and not any(c.isdigit() for c in text)


def _bools(a: pa.Array) -> np.ndarray:
    return np.asarray(a.to_numpy(zero_copy_only=False), bool)


def _where(texts: list[str], candidates: np.ndarray, test) -> np.ndarray:
    """test of the texts that are candidates; the others don't pass it."""
    out = np.zeros(len(texts), bool)
    for i in np.flatnonzero(candidates):
        out[i] = test(texts[i])
    return out


def _any_of(flags: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    return np.bincount(unit, weights=flags, minlength=units)[:units] > 0


def _sites(tok: streams.Tokens, page: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens that begin the name of their page's site, tokens that continue it)."""
    distinct = sorted({n for n in names if n})
    begins, follows = np.zeros(len(tok.key), bool), np.zeros(len(tok.key), bool)
    if not distinct or not len(tok.key):
        return begins, follows
    own = streams.tokens(pa.array(distinct))
    first = np.searchsorted(own.text, np.arange(len(distinct) + 1))
    length = np.diff(first)
    of = {n: i for i, n in enumerate(distinct)}
    site = np.array([of.get(n, -1) for n in names])[page]
    n = len(tok.key)
    fits = (site >= 0) & (length[site] > 0)
    for j in range(int(length.max(initial=0))):
        at = np.arange(n) + j
        inside = at < n
        at = np.minimum(at, n - 1)
        want = own.key[np.minimum(first[site] + j, len(own.key) - 1)]
        fits &= (j >= length[site]) | (inside & (tok.text[at] == tok.text) & (tok.key[at] == want))
    begins = fits
    for i in np.flatnonzero(fits):
        follows[i + 1 : i + length[site[i]]] = True
    return begins, follows


def _lists(values: np.ndarray, unit: np.ndarray, units: int, kind: pa.DataType, present: np.ndarray | None = None) -> pa.Array:
    """Lists of values by unit, which is sorted; null where present is false."""
    offsets = np.searchsorted(unit, np.arange(units + 1)).astype(np.int32)
    mask = None if present is None else pa.array(np.append(~present, False))
    off = pa.array(offsets) if mask is None else pa.Array.from_pandas(offsets, mask=np.append(~present, False), type=pa.int32())
    return pa.ListArray.from_arrays(off, values if isinstance(values, pa.Array) else pa.array(values, kind))


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def _pairs(keys: np.ndarray, unit: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, unit) of the tokens of each unit and of their neighbouring pairs, the ends included; units are those asked for."""
    first = np.concatenate([[True], unit[1:] != unit[:-1]]) if len(unit) else np.empty(0, bool)
    before = np.concatenate([[_START], keys[:-1]]).astype(np.uint64) if len(keys) else keys
    before = np.where(first, _START, before)
    last = np.concatenate([unit[1:] != unit[:-1], [True]]) if len(unit) else np.empty(0, bool)
    present = np.zeros(int(max(units.max(initial=0), unit.max(initial=0))) + 1, bool)
    present[unit] = True
    empty = units[~present[units]]
    none = np.full(len(empty), streams.join(np.array([_START]), np.array([_END]))[0], np.uint64)
    key = np.concatenate([keys, streams.join(before, keys), streams.join(keys[last], np.full(int(last.sum()), _END)), none])
    return key, np.concatenate([unit, unit, unit[last], empty])


def _pass_batch(b: pa.RecordBatch, base: int, shingled: bool) -> pa.RecordBatch:
    """Rows of _PASS of a batch of (page_id, site, title, paragraphs)."""
    pages, names, titles = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
    lists = b.column(3)
    page = np.repeat(np.arange(len(names)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    texts = pc.fill_null(lists.flatten(), "").to_pylist()
    n = len(texts)
    flat = pa.array(texts, pa.string())
    for i in np.flatnonzero(~_bools(pc.string_is_ascii(flat))):
        if suspicious(texts[i]):
            texts[i] = quick(texts[i])
    flat = pa.array(texts, pa.string())
    tok = streams.tokens(flat)
    size = np.bincount(tok.text, minlength=n)
    edges = np.searchsorted(page, np.arange(len(names) + 1))
    par_no = np.arange(n) - edges[page] + 1
    # Marks: cheap searches first, exact ones on what they find.
    order = np.lexsort((tok.key, tok.text))
    new = np.ones(len(order), bool)
    new[1:] = (tok.key[order][1:] != tok.key[order][:-1]) | (tok.text[order][1:] != tok.text[order][:-1])
    distinct = np.bincount(tok.text[order], weights=new, minlength=n)
    low = pc.utf8_lower(flat)
    filled = _where(texts, _bools(pc.match_substring_regex(low, marks_.FILLER_HINT)) | ((size >= 4) & (distinct * 2 <= size + 1)), marks_.filler)
    holds = _where(texts, _bools(pc.match_substring_regex(low, marks_.RESIDUE_HINT)), lambda t: marks_.residue(t) is not None)
    only = _where(texts, holds, marks_.only_template)
    noticed = _where(texts, _bools(pc.match_substring_regex(low, marks_.NOTICE_HINT)), marks_.notice)
    empty = _bools(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(flat)), 0))
    mark = np.select([empty, filled, only, holds, noticed], [EMPTY, FILLED, TEMPLATE_ONLY, TEMPLATE_IN, NOTICED], PLAIN)
    # Running prose, as a prior: long, of sentences, with function words.
    ends = _bools(pc.match_substring_regex(flat, _ENDS))
    words = pc.count_substring(flat, " ").to_numpy(zero_copy_only=False) + 1
    at = np.minimum(np.searchsorted(_FUNCTION_KEYS, tok.key), len(_FUNCTION_KEYS) - 1)
    function = _any_of(_FUNCTION_KEYS[at] == tok.key, tok.text, n)
    ascii_ = _bools(pc.string_is_ascii(flat))
    breaks = pc.count_substring_regex(flat, "[.!?।][”\"»)]? ").to_numpy(zero_copy_only=False)
    least = np.array(PROSE_WORDS)[np.maximum(0, 2 - breaks)]
    prose = (words >= np.minimum(least, PROSE_WORDS[2])) & ends & ~filled & (function | ~ascii_) & ~empty
    sound = _any_of(prose & (mark != NOTICED), page, len(names)) if n else np.zeros(len(names), bool)
    prose &= sound[page] if n else prose
    bare = _where(texts, ~prose & ends & ascii_ & ~function & (size >= 4), bare_words)
    where = np.arange(n)
    core_first = np.full(len(names), n)
    np.minimum.at(core_first, page[prose], where[prose])
    core_last = np.full(len(names), -1)
    np.maximum.at(core_last, page[prose], where[prose])
    zone = np.where(core_last[page] < 0, 0, np.where((where > core_first[page]) & (where < core_last[page]), 2, 1)) if n else where
    # Masked tokens: the site's name, other names; signs at the ends of lines dropped. A line's first word is no name.
    site, follow = _sites(tok, page[tok.text] if n else page, names)
    at = np.minimum(np.searchsorted(_EDGE_KEYS, tok.key), len(_EDGE_KEYS) - 1)
    edge = _EDGE_KEYS[at] == tok.key
    inner = np.flatnonzero(~edge)
    first_inner, last_inner = np.full(n, len(edge)), np.full(n, -1)
    np.minimum.at(first_inner, tok.text[inner], inner)
    np.maximum.at(last_inner, tok.text[inner], inner)
    k = np.arange(len(edge))
    outer = (k < first_inner[tok.text]) | (k > last_inner[tok.text])
    masked = np.where(site, _SITE, np.where(tok.name & (k > first_inner[tok.text]), _NAME, tok.key))
    of_prose = prose[tok.text] if n else np.empty(0, bool)
    mine = ~follow & (of_prose | ~outer)
    m_key, m_text, m_fresh, m_prose = masked[mine], tok.text[mine], tok.fresh[mine], of_prose[mine]
    # The stream: prose as it stands, lines masked.
    kept = of_prose | mine
    s_key, s_text = np.where(of_prose, tok.key, masked)[kept], tok.text[kept]
    s_size = np.bincount(s_text, minlength=n)
    host = np.array([_hash64(x or "") for x in names], np.uint64)
    line = streams.sequence_keys(s_key, s_text, n)
    line = streams.join(streams.join(line, host[page]), (mark * 4 + ends * 2 + prose).astype(np.uint64)) if n else line
    heads = np.array([_hash64(" ".join(t.lower().split())) if t else base + i for i, t in enumerate(titles)], np.uint64)
    uid = base + np.arange(len(names))
    who = np.where(prose, heads[page].view(np.int64), uid[page]) if n else np.empty(0, np.int64)
    sent = _first_of(line, who)
    # Suffixes and features of lines that are sent, substrings of such prose; counts of prose by sentence, and of headlines.
    told = ~prose & sent
    anchors = _anchors(s_key, s_text, page, host, told)
    grams = _grams(tok.key, tok.text, host[page] if n else host, prose & sent)
    of_line = told[m_text] if n else ~m_prose
    asked = np.flatnonzero(told)
    f_key, f_text = _pairs(m_key[of_line], m_text[of_line], asked)
    sizes = np.bincount(m_text[of_line], minlength=n)
    extra = streams.mix(np.concatenate([ends[asked].astype(np.uint64) + np.uint64(101), (np.minimum(sizes[asked], 40) // 4).astype(np.uint64) + np.uint64(211)]))
    both = streams.unique(np.concatenate([f_text, asked, asked]) << BITS | _bucket(np.concatenate([f_key, extra])))
    feats = _lists((both & (BUCKETS - 1)).astype(np.int32), both >> BITS, n, pa.int32(), told)
    if shingled:
        w_key, w_text = streams.windows(m_key[of_line], m_text[of_line], SHORT)
        by = np.lexsort((w_key, w_text))
        w_key, w_text = w_key[by], w_text[by]
        new = np.append(True, (w_key[1:] != w_key[:-1]) | (w_text[1:] != w_text[:-1]))[: len(w_key)]
        shingles = _lists(w_key[new].view(np.int64), w_text[new], n, pa.int64(), told)
    else:
        shingles = pa.nulls(n, pa.list_(pa.int64()))
    sentence = np.cumsum(m_fresh[m_prose])
    said, units = np.zeros((2, BUCKETS), np.int64), [0, 0]
    p_key, _ = _pairs(m_key[m_prose], sentence, np.empty(0, np.int64))
    said[0] = np.bincount(_bucket(p_key), minlength=BUCKETS)
    units[0] = int(m_fresh[m_prose].sum())
    known = [i for i, t in enumerate(titles) if t]
    if known:
        h = streams.tokens(pa.array([titles[i] for i in known]))
        begins, follows = _sites(h, h.text, [names[i] for i in known])
        h_key = np.where(begins, _SITE, np.where(h.name, _NAME, h.key))
        t_key, t_text = _pairs(h_key[~follows], h.text[~follows], np.arange(len(known)))
        said[1] = np.bincount(streams.unique(t_text << BITS | _bucket(t_key)) & (BUCKETS - 1), minlength=BUCKETS)
        units[1] = len(known)
    columns = {"kind": np.zeros(n), "uid": uid[page], "page_id": None, "par_no": par_no, "line": line.view(np.int64), "size": s_size + 1, "zone": zone, "ends": ends, "bare": bare, "mark": mark, "prose": prose, "who": who, "sent": sent}
    ids = pages.take(pa.array(page))
    rows = {c: pa.array(v, mask=None).cast(_ARROW[c]) if c != "page_id" else ids for c, v in columns.items()}
    at = [np.flatnonzero(x) for x in said]
    tail = {c: pa.nulls(2, t) for c, t in _ARROW.items()} | {"kind": pa.array([COUNTS, HEADLINES], pa.int8()), "par_no": pa.array(units, pa.int32())}
    fields = [pa.concat_arrays([rows[c], tail[c]]) for c in _ARROW]
    none = pa.nulls(n, pa.list_(pa.int32()))
    fields.append(pa.concat_arrays([feats, pa.array([x.tolist() for x in at], pa.list_(pa.int32()))]))
    fields.append(pa.concat_arrays([none, pa.array([said[i][x].tolist() for i, x in enumerate(at)], pa.list_(pa.int32()))]))
    fields.append(pa.concat_arrays([shingles, pa.nulls(2, pa.list_(pa.int64()))]))
    fields += [pa.concat_arrays([x, pa.nulls(2, x.type)]) for x in (anchors, grams)]
    return pa.RecordBatch.from_arrays(fields, names=_PASS.names)


def _first_of(line: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether a paragraph is among the first REPEATED of a batch, counted by who, that are the same line. They tell for the
    others: what covers a line depends on its tokens and its end alone, and so many suffices to make them repeated."""
    order = np.lexsort((who, line))
    a, b = line[order], who[order]
    new_line = np.ones(len(a), bool)
    new_line[1:] = a[1:] != a[:-1]
    new = new_line.copy()
    new[1:] |= b[1:] != b[:-1]
    number = np.cumsum(new)
    rank = number - np.maximum.accumulate(np.where(new_line, number, 0)) if len(a) else number
    out = np.zeros(len(a), bool)
    out[order] = new & (rank < REPEATED)
    return out


def _anchors(key: np.ndarray, text: np.ndarray, page: np.ndarray, host: np.ndarray, sent: np.ndarray) -> pa.Array:
    """Lists, by line that is sent, of the suffixes that start in it: their first tokens behind the host's key, the
    tokens to the next start or the line's end, those to the line's end, and those to the page's. The mark before a line
    counts as its first token."""
    total, n = len(key), len(sent)
    k = np.arange(total)
    # Place in the stream: a mark before each page and after each paragraph, LINE_DEPTH marks more after each page.
    place = k + text + 1 + page[text] * (LINE_DEPTH + 1) if n else k
    stream = np.zeros(total + n + (int(page[-1]) + 1 if n else 0) * (LINE_DEPTH + 1) + LINE_DEPTH, ">u2")
    stream[place] = np.maximum(key >> np.uint64(48), np.uint64(1)).astype(np.uint16)
    begins = np.concatenate([[True], text[1:] != text[:-1]]) if total else np.empty(0, bool)
    chosen = np.flatnonzero(sent[text]) if n else k
    par, mark = text[chosen], begins[chosen]
    end = np.searchsorted(text, par, side="right")
    room = end - chosen + mark
    after = np.append(chosen[1:], total) if len(chosen) else chosen
    gap = np.minimum(after, end) - chosen + mark
    last = np.searchsorted(page, page[par], side="right") - 1 if n else par
    rest = np.searchsorted(text, last, side="right") + last - (chosen + par) + 1 + mark
    width = 8 + 2 * LINE_DEPTH
    data = np.empty((len(chosen), width), np.uint8)
    if len(chosen):
        data[:, :8] = host[page[par]].astype(">u8").view(np.uint8).reshape(-1, 8)
        data[:, 8:] = stream[(place[chosen] - mark)[:, None] + np.arange(LINE_DEPTH)].view(np.uint8).reshape(-1, 2 * LINE_DEPTH)
        data = data[:, _SENT]
    offsets = (np.arange(len(chosen) + 1) * width).astype(np.int32)
    suffix = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    ints = [pa.array(np.minimum(x, most).astype(np.int32)) for x, most in ((gap, 1 << 30), (room, 1 << 30), (rest, LINE_DEPTH))]
    return _lists(pa.StructArray.from_arrays([suffix, *ints], _ANCHOR.names), par, n, None, sent)


def _grams(key: np.ndarray, text: np.ndarray, host: np.ndarray, sent: np.ndarray) -> pa.Array:
    """Lists, by paragraph of prose that is sent, of all its substrings of LONG tokens and the shorter ones, down to SHORT
    and the mark, that run to its end. Substrings side by side that go by the same GRAM tokens stand together: (key of these and the
    host, place of the first substring, a hash of four bytes of each). The marks before and after a paragraph count as
    its tokens. A paragraph shorter than LONG is one substring, which goes by its end as those that run to it."""
    n, asked = len(sent), np.flatnonzero(sent)
    size = np.bincount(text, minlength=n)[asked] + 2
    edge = np.append(0, np.cumsum(size))
    total = int(edge[-1])
    first, end = edge[:-1], edge[1:]
    stream = np.full(total, _END)
    inner = np.ones(total, bool)
    inner[first] = inner[end - 1] = False
    stream[inner] = key[sent[text]] if n else key
    up, down = streams.powers(total + 1)
    sums = np.append(_NO, np.cumsum(streams.mix(stream) * up[:total], dtype=np.uint64))
    hashed = lambda a, b: streams.mix((sums[b] - sums[a]) * down[a])
    k = np.arange(total)
    par = np.repeat(np.arange(len(asked)), size)
    at = k[k + LONG <= end[par]]
    # The least of the grams within each substring, and the first of equal ones: a gram's place stands in the low bits of its hash.
    low = np.uint64((1 << 30) - 1)
    least = hashed(k[: max(0, total - GRAM + 1)], k[GRAM - 1 :] + 1) & ~low | k[: max(0, total - GRAM + 1)].astype(np.uint64)
    reach, wide = 1, LONG - GRAM + 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    by = (np.minimum(least[at], least[at + wide - reach]) & low).astype(np.int64)
    # Substrings to the end: those shorter than LONG, down to SHORT and the mark, and shorter paragraphs as a whole.
    tails = np.maximum(1, np.minimum(LONG - 1, size) - SHORT)
    tail = np.repeat(end - np.minimum(LONG - 1, size), tails) + np.arange(int(tails.sum())) - np.repeat(np.cumsum(tails) - tails, tails)
    end_of = np.repeat(end, tails)
    starts = np.concatenate([at, tail])
    go_by = np.concatenate([hashed(by, by + GRAM), ~hashed(np.maximum(end_of - SHORT - 1, first[par[tail]]), end_of)])
    mark = (hashed(starts, np.concatenate([at + LONG, end_of])) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(np.concatenate([par[at] * 2, par[tail] * 2 + 1]), kind="stable")
    starts, go_by, mark, of = starts[order], go_by[order], mark[order], par[starts[order]]
    new = np.ones(len(starts), bool)
    group = np.concatenate([by, -1 - par[tail]])[order]
    new[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(new)
    offsets = np.append(head, len(starts)).astype(np.int32) * np.int32(4)
    marks = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(mark.tobytes())])
    keys = streams.join(go_by[head], host[asked[of[head]]]).view(np.int64)
    rows = pa.StructArray.from_arrays([pa.array(keys), pa.array((starts[head] - first[of[head]]).astype(np.int32)), marks], _GRAM.names)
    return _lists(rows, asked[of[head]], n, None, sent)


def _first_pass(shingled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + 1) << 36
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.nbytes for x in held) >= BATCH:
                one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield _pass_batch(one, base, shingled)
                base, held = base + one.num_rows, []
        if held:
            yield _pass_batch(pa.Table.from_batches(held).combine_chunks().to_batches()[0], base, shingled)

    return run


_SORTED = T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("line", T.LongType()), T.StructField("cov", T.IntegerType()), T.StructField("prefix", T.BinaryType()), T.StructField("who", T.LongType()),
    T.StructField("level", T.IntegerType()), T.StructField("gap", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("row", T.LongType()),
])
#: Kinds of rows of the sorted pass: tokens covered; a beginning at a range's border; a suffix whose length hangs on one.
SPAN, BORDER, HANGING = 0, 1, 2


def common(data: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Tokens that each of the sorted suffixes has in common with the next, none where the hosts differ."""
    tok = data[:, 8:].view(">u2")
    same = tok[1:] == tok[:-1]
    lcp = np.where(same.all(1), LINE_DEPTH, same.argmin(1))
    lcp = np.where((data[1:, :8] == data[:-1, :8]).all(1), lcp, 0)
    return np.minimum(lcp, np.minimum(rest[1:], rest[:-1]))


def lengths(lcp: np.ndarray, who: np.ndarray) -> np.ndarray:
    """The longest beginning of each sorted suffix that REPEATED different values of who share, from two tokens on."""
    out = np.zeros(len(who), np.int32)
    alive = np.arange(len(who))
    for level in range(2, LINE_DEPTH + 1):
        if len(alive) < REPEATED:
            break
        joined = np.zeros(len(alive), bool)
        joined[1:] = (alive[1:] == alive[:-1] + 1) & (lcp[alive[:-1]] >= level) if len(lcp) else False
        starts = np.flatnonzero(~joined)
        group = np.cumsum(~joined) - 1
        w = who[alive]
        least, most = np.minimum.reduceat(w, starts), np.maximum.reduceat(w, starts)
        other = (w != least[group]) & (w != most[group])
        alive = alive[np.logical_or.reduceat(other, starts)[group]]
        out[alive] = level
    return out


def _sorted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of (suffix, who, line, gap, room, rest) to the rows of _SORTED."""
    width = 8 + 2 * LINE_DEPTH
    task = (TaskContext.get().partitionId() + 1) << 40
    made = 0
    held: list[tuple] = []

    def emit(kind: int, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        types = {"line": pa.int64(), "cov": pa.int32(), "prefix": pa.binary(), "who": pa.int64(), "level": pa.int32(), "gap": pa.int32(), "need": pa.int32(), "row": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int8()), *(pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items())], names=_SORTED.names)

    def read(b: pa.RecordBatch) -> tuple:
        s = b.column(0)
        ends = np.frombuffer(s.buffers()[1], np.int32)[s.offset : s.offset + len(s) + 1]
        data = np.frombuffer(s.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width)
        data = np.ascontiguousarray(data[:, np.argsort(_SENT)])
        return (data, *(b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6)))

    def work(rows: tuple, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        data, who, line, gap, room, rest = rows
        lcp = common(data, rest)
        size = lengths(lcp, who)
        need = np.minimum(SHORT, room + 1)
        # A beginning that the range's first or last row shares may go on in the neighbouring range.
        for at_end in ((False,) if first else ()) + ((True,) if last else ()):
            chain = np.minimum.accumulate(np.concatenate([[LINE_DEPTH], lcp if not at_end else lcp[::-1]]))
            chain[0] = min(LINE_DEPTH, int(rest[-1 if at_end else 0]))
            shared = np.minimum(chain if not at_end else chain[::-1], LINE_DEPTH)
            row = data[-1 if at_end else 0].tobytes()
            near = np.flatnonzero(shared >= 2)
            border = [(row[: 8 + 2 * level], int(w)) for level in range(2, int(shared[near].max(initial=1)) + 1) for w in np.unique(who[near][shared[near] >= level])[:REPEATED]]
            if border:
                yield emit(BORDER, prefix=[p for p, _ in border], who=[w for _, w in border])
            open_ = near[shared[near] > size[near]]
            hanging = [(i, level) for i in open_ for level in range(max(2, size[i] + 1), shared[i] + 1)]
            if hanging:
                i = np.array([h[0] for h in hanging])
                yield emit(HANGING, line=line[i], cov=size[i], prefix=[row[: 8 + 2 * level] for _, level in hanging], level=[h[1] for h in hanging], gap=gap[i], need=need[i], row=task + made + i)
        made += len(who)
        cov = np.where(size >= need, np.minimum(size, gap), 0)
        lines, at = np.unique(line[cov > 0], return_inverse=True)
        yield emit(SPAN, line=lines, cov=np.bincount(at, weights=cov[cov > 0], minlength=len(lines)).astype(np.int64))

    first = True
    for b in batches:
        if not b.num_rows:
            continue
        held.append(read(b))
        if sum(len(x[1]) for x in held) < CHUNK:
            continue
        rows = tuple(np.concatenate(c) for c in zip(*held))
        # What shares two tokens with the last row waits for the rows to come.
        lcp = common(rows[0], rows[5])
        breaks = np.flatnonzero(lcp < 2) + 1
        if not len(breaks):
            held = [rows]
            continue
        at = int(breaks[-1])
        yield from work(tuple(c[:at] for c in rows), first, False)
        first, held = False, [tuple(c[at:] for c in rows)]
    if held:
        yield from work(tuple(np.concatenate(c) for c in zip(*held)), first, True)


def covered_tokens(first: DataFrame) -> DataFrame:
    """(line, cov): tokens that repeated substrings cover, summed over the places of a line that sent suffixes; from the sorted ones."""
    a = first.filter((F.col("kind") == PARAGRAPH) & ~F.col("prose")).select("who", "line", F.explode("anchors").alias("a"))
    rows = a.select("a.suffix", "who", "line", "a.gap", "a.room", "a.rest")
    ranged = rows.repartitionByRange("suffix", "who").sortWithinPartitions("suffix", "who")
    found = cut(ranged.mapInArrow(_sorted_pass, _SORTED), "suffix-array")
    across = found.filter(F.col("kind") == BORDER).groupBy("prefix").agg(F.count_distinct("who").alias("n")).filter(F.col("n") >= REPEATED)
    hanging = found.filter(F.col("kind") == HANGING).join(across, "prefix", "left_semi").groupBy("row").agg(F.max("level").alias("level"), F.first("line").alias("line"), F.first("cov").alias("had"), F.first("gap").alias("gap"), F.first("need").alias("need"))
    of = lambda c: F.when(F.col(c) >= F.col("need"), F.least(c, "gap")).otherwise(0)
    more = hanging.select("line", (of("level") - of("had")).alias("cov")).filter(F.col("cov") > 0)
    return found.filter(F.col("kind") == SPAN).select("line", "cov").unionByName(more).groupBy("line").agg(F.sum("cov").alias("cov"))


#: Rows of prose: tokens from lo to hi at which repeated substrings start; where key is told, a substring that is still to be counted.
_SPANS = T.StructType([T.StructField("line", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("mark", T.IntegerType()), T.StructField("who", T.LongType())])


def _repeated(group: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Whether REPEATED different values of who stand in the group of each row."""
    order = np.lexsort((who, group))
    g, w = group[order], who[order]
    start = np.ones(len(g), bool)
    start[1:] = g[1:] != g[:-1]
    new = start.copy()
    new[1:] |= w[1:] != w[:-1]
    number = np.cumsum(start) - 1
    out = np.zeros(len(g), bool)
    out[order] = (np.bincount(number, weights=new) >= REPEATED)[number] if len(g) else False
    return out


def _gram_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, who, line, size, start, marks) sorted by key to those of _SPANS."""
    types = {"line": pa.int64(), "size": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "key": pa.int64(), "mark": pa.int32(), "who": pa.int64()}

    def emit(**columns) -> pa.RecordBatch:
        size = len(columns["line"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in types.items()], names=_SPANS.names)

    def to(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(at >= size - SHORT, size, at + 1)

    def work(t: pa.Table, whole: bool) -> pa.RecordBatch:
        """whole: the rows of each key are all here."""
        if whole:
            t = t.filter(pa.array(_repeated(t["key"].to_numpy(), t["who"].to_numpy())))
        key, who, line, size, start = (t[c].to_numpy() for c in ("key", "who", "line", "size", "start"))
        marks = t["marks"].combine_chunks()
        times = pc.binary_length(marks).to_numpy(zero_copy_only=False) // 4
        row = np.repeat(np.arange(len(key)), times)
        mark = np.frombuffer(b"".join(marks.to_pylist()), np.int32)
        at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        if not whole:
            return emit(line=line[row], size=size[row], lo=at, hi=to(at, size[row]), key=key[row], mark=mark, who=who[row])
        group = (np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else key)[row] << 32 | mark.view(np.uint32)
        found = np.flatnonzero(_repeated(group, who[row]))
        row, at = row[found], at[found]
        new = np.ones(len(found) + 1, bool)
        new[1:-1] = (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])
        head, last = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
        return emit(line=line[row[head]], size=size[row[head]], lo=at[head], hi=to(at[last], size[row[head]]))

    held: list[pa.RecordBatch] = []
    crowded = None  # a key of which some rows were left to Spark, so that the others must be too
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < CHUNK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t["key"].to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        passed = int(np.searchsorted(key, crowded, side="right")) if crowded is not None else 0
        if passed:
            yield work(t[:passed], False)
        if last > passed:
            yield work(t[passed:last], True)
        t = t[max(last, passed) :]
        if t.num_rows >= CROWD:
            yield work(t, False)
            crowded, t = int(key[-1]), t[:0]
        held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        passed = int(np.searchsorted(t["key"].to_numpy(), crowded, side="right")) if crowded is not None else 0
        if passed:
            yield work(t[:passed], False)
        yield work(t[passed:], True)


def covered_prose(first: DataFrame) -> DataFrame:
    """(line, size, cov): tokens of paragraphs of prose, all of them looked at, at which repeated substrings start."""
    g = first.filter((F.col("kind") == PARAGRAPH) & F.col("prose")).select("who", "line", "size", F.explode("grams").alias("g"))
    rows = g.select("g.key", "who", "line", "size", "g.start", "g.marks").repartition("key").sortWithinPartitions("key")
    found = cut(rows.mapInArrow(_gram_pass, _SPANS), "prose-spans")
    open_ = found.filter(F.col("key").isNotNull())
    more = open_.join(open_.groupBy("key", "mark").agg(F.count_distinct("who").alias("n")).filter(F.col("n") >= REPEATED), ["key", "mark"], "left_semi")
    spans = found.filter(F.col("key").isNull()).select("line", "size", "lo", "hi").unionByName(more.select("line", "size", "lo", "hi"))
    union = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["to"]))).alias("n"), F.greatest(a["to"], x["hi"]).alias("to")), lambda a: a["n"])
    return spans.groupBy("line").agg(F.first("size").alias("size"), F.collect_set(F.struct("lo", "hi")).alias("spans")).select("line", "size", union.alias("cov"))


def _collect_counts(df: DataFrame) -> tuple[np.ndarray, tuple[float, float]]:
    """A (2, BUCKETS) array of story and part counts from (bucket, story, part) rows, and the units of both, told in
    bucket -1; at most BUCKETS + 1 rows come to the driver."""
    t = df.groupBy("bucket").agg(F.sum("story").alias("story"), F.sum("part").alias("part")).toPandas()
    units = t[t["bucket"] < 0]
    t = t[t["bucket"] >= 0]
    out = np.zeros((2, BUCKETS))
    out[0, t["bucket"]], out[1, t["bucket"]] = t["story"], t["part"]
    return out, (float(units["story"].sum()), float(units["part"].sum()))


_COUNTED = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("story", T.DoubleType()), T.StructField("part", T.DoubleType())])


def _teach(lines: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """(bucket, story, part) of what the lines teach: by their places at first, by the model's scores later.

    Lines that stand on pages without any core teach nothing of stories; what they are is what is asked.
    """
    shared = None if ratio is None else lines.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, units = np.zeros((2, BUCKETS)), np.zeros(2)
        for b in batches:
            x = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            flat, ends = x["feats"].flatten().to_numpy(zero_copy_only=False), x["feats"].offsets.to_numpy()
            size = np.diff(ends)
            if shared is None:
                taught = [x[n].to_numpy(zero_copy_only=False).astype(float) for n in ("story", "part")]
            else:
                score = _sums(shared.value[flat], ends)
                void, times, inside, placed = (x[n].to_numpy(zero_copy_only=False) for n in ("void", "times", "inside", "placed"))
                taught = [np.where(void, 0, np.where(score < SURE_STORY, placed, np.where(score < SURE_PART, inside, 0))), np.where(void | (score > SURE_PART), times, 0)]
            for k, w in enumerate(taught):
                sums[k] += np.bincount(flat, weights=np.repeat(w, size), minlength=BUCKETS)
                units[k] += w.sum()
        at = np.nonzero(sums.any(0))[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([units[0], *sums[0, at]]), pa.array([units[1], *sums[1, at]])], names=_COUNTED.names)

    return lines.mapInArrow(run, _COUNTED)


def _sums(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of a flat array that ends delimits."""
    total = np.concatenate([[0.0], np.cumsum(flat, dtype=np.float64)])
    return total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]


def log_ratio(counts: np.ndarray, units: tuple[float, float]) -> np.ndarray:
    """By feature, the log of its odds for page parts, half freed of the classes' sizes; rare features say nothing."""
    a = 0.5
    r = np.log(counts[1] + a) - np.log(counts[0] + a) - 0.5 * np.log((units[1] + 1) / (units[0] + 1))
    r[counts.sum(0) < 3] = 0
    return np.clip(r, -6, 6).astype(np.float32)


def _score(lines: DataFrame, ratio: np.ndarray) -> DataFrame:
    """lines with a score: above zero for page parts."""
    shared = lines.sparkSession.sparkContext.broadcast(ratio)
    at = lines.columns.index("feats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for b in batches:
            lists = b.column(at)
            score = _sums(weight[lists.flatten().to_numpy(zero_copy_only=False)], lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "score"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("score", T.DoubleType())]))


def paragraphs(pages: DataFrame, page_id: str = "article_id", site: str = "source", title: str = "title", pars: str = "html_paragraphs", rounds: int = 2) -> DataFrame:
    """(uid, page_id, par_no, line, story, prose, mark, score) of every paragraph, numbered from 1.

    uid tells rows of pages apart that share an id. story is false for page parts, filler, empty paragraphs and
    paragraphs of nothing but template parts. Null paragraph lists and empty ones give no rows. A page without a
    site is held against the other pages without one. Pages fetched twice count as two pages. Columns of pages
    other than those named are not read.
    """
    return with_lines(pages, page_id, site, title, pars, rounds)[0].drop("bare")


def with_lines(pages: DataFrame, page_id: str, site: str, title: str, pars: str, rounds: int = 2, shingled: bool = False) -> tuple[DataFrame, DataFrame]:
    """What paragraphs() gives, with the column bare, and the distinct lines that are no prose: (line, mark, feats, score), and their
    shingles if asked for."""
    want = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(site).cast("string").alias("site"), F.col(title).cast("string").alias("title"), F.col(pars).alias("pars")).filter(F.size("pars") > 0)
    first = cut(want.mapInArrow(_first_pass(shingled), _PASS), "page-lines")
    par = first.filter(F.col("kind") == PARAGRAPH)
    covered = covered_tokens(first)
    share = F.coalesce(F.col("cov") / (F.col("sent") * F.col("size")), F.lit(0.0))
    sent = F.count_if("sent").alias("sent")
    standing = cut(covered_prose(first).filter(F.col("cov") >= STANDING * F.col("size")).select("line"), "standing-prose")
    # The cores of pages with standing paragraphs are those of their other prose.
    seen = par.filter("prose").select("uid", "par_no", "line").join(standing.withColumn("standing", F.lit(True)), "line", "left")
    at = F.when(F.col("standing").isNull(), F.col("par_no"))
    cores = cut(seen.groupBy("uid").agg(F.max("standing").alias("recast"), F.min(at).alias("core_first"), F.max(at).alias("core_last")).filter("recast"), "recast-cores")
    zone = F.when(F.col("recast").isNull(), F.col("zone")).when(F.col("core_first").isNull(), 0).when((F.col("par_no") > F.col("core_first")) & (F.col("par_no") < F.col("core_last")), 2).otherwise(1)
    line = par.filter(~F.col("prose")).join(cores, "uid", "left").withColumn("zone", zone)  # each step reads only the columns it needs of the written rows
    flags = lambda c: F.sum(F.when(c, 1).otherwise(0))
    keep = ("feats", "shingles") if shingled else ("feats",)
    distinct = line.groupBy("line").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep], F.first("size").alias("size"), F.first("ends").alias("ends"), F.first("mark").alias("mark"), F.count(F.lit(1)).alias("times"), sent,
        flags(F.col("zone") == 1).alias("outside"), flags(F.col("zone") == 2).alias("inside"))
    rows = distinct.join(covered, "line", "left").withColumn("covered", share >= COVERED)
    # Bare lines are taught by their places; sentences outside of the cores only where repeated substrings cover them.
    placed = F.col("outside") + F.col("inside")
    part = F.when(F.col("void"), F.col("times")).when(~F.col("ends"), F.col("outside") + F.when(F.col("covered"), F.col("times") - placed).otherwise(0)).when(F.col("covered"), F.col("outside")).otherwise(0)
    story = F.when(F.col("void"), 0).when(F.col("ends") & F.col("covered"), 0).otherwise(F.col("inside"))
    rows = rows.withColumn("void", F.col("mark").isin(TEMPLATE_ONLY, FILLED, EMPTY)).withColumn("story", story).withColumn("part", part).withColumn("placed", placed)
    rows = cut(rows.select("line", "mark", *keep, "void", "times", "inside", "placed", "story", "part"), "covered-lines")
    said = first.filter(F.col("kind").isin(COUNTS, HEADLINES))
    of = lambda kind, x: F.when(F.col("kind") == kind, F.col(x)).otherwise(0)
    known = said.select("kind", F.explode(F.arrays_zip("feats", "counts")).alias("x")).select(F.col("x.feats").alias("bucket"), of(COUNTS, "x.counts").alias("story"), of(HEADLINES, "x.counts").alias("part"))
    known = known.unionByName(said.select(F.lit(-1).alias("bucket"), of(COUNTS, "par_no").alias("story"), of(HEADLINES, "par_no").alias("part")))
    base, base_units = _collect_counts(known)
    ratio = None
    for _ in range(rounds + 1):
        counts, units = _collect_counts(_teach(rows.select("feats", "story", "part") if ratio is None else rows.select("feats", "void", "times", "inside", "placed"), ratio))
        ratio = log_ratio(base + counts, (base_units[0] + units[0], base_units[1] + units[1]))
    scored = _score(rows.select("line", "mark", *keep, "void"), ratio)
    scored = scored.select("line", "mark", *keep, F.when(F.col("void"), 99.0).otherwise(F.col("score")).alias("score"))
    verdict = cut(scored.select("line", "score"), "line-verdicts")
    scores = verdict.select("line", "score").unionByName(standing.select("line", F.lit(99.0).alias("score")))
    every = par.select("uid", "page_id", "par_no", "line", "mark", "bare", "prose").join(scores, "line", "left").withColumn("prose", F.col("prose") & F.col("score").isNull()).withColumn("score", F.coalesce("score", F.lit(-99.0)))
    # A page without prose must have a line that is far more like a story's than like a part's; a notice, farther still.
    alone = F.when(F.col("mark") == NOTICED, F.lit(2 * LONE_STORY)).otherwise(F.lit(LONE_STORY))
    place = lambda limit: F.when(F.col("score") <= limit, F.col("par_no"))
    ends = every.groupBy("uid").agg(F.max("prose").alias("has_prose"), F.min(place(SURE_STORY)).alias("first"), F.max(place(SURE_STORY)).alias("last"), F.min(place(alone)).alias("lone_first"), F.max(place(alone)).alias("lone_last"))
    has_story = F.col("has_prose") | F.col("lone_first").isNotNull()
    first_par, last_par = F.when(F.col("has_prose"), F.col("first")).otherwise(F.col("lone_first")), F.when(F.col("has_prose"), F.col("last")).otherwise(F.col("lone_last"))
    within = F.coalesce((F.col("par_no") > first_par) & (F.col("par_no") < last_par), F.lit(False))
    sure = F.when(F.col("has_prose"), F.col("score") <= SURE_STORY).otherwise(F.col("score") <= alone)
    story = has_story & (sure | ((F.col("score") < SURE_PART) & within))
    return every.join(ends, "uid").select("uid", "page_id", "par_no", "line", story.alias("story"), "prose", "mark", "bare", "score"), scored
