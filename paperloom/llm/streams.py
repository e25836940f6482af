"""Token streams of many texts at once: their bytes are classed, hashed and masked as arrays.

A token is a run of bytes between white space and the signs of SEPARATORS, or one of the signs of SINGLES. Its key is
a 64-bit polynomial of its lower-case bytes (case is folded for ASCII and Latin-1 letters; others are taken as they
are). What follows a digit up to the next white space is masked, so that figures have one key whatever their value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS, SINGLES = b" \t\n\r\x0b\x0c.,;:!?\"()", b"|/>"
# Signs of several bytes that stand for one of those of one byte.
_ALIKE = (("“", '"'), ("”", '"'), ("„", '"'), ("«", '"'), ("»", '"'), ("·", "|"), ("•", "|"), ("›", ">"), ("\xa0", " "))

_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = np.ones(1, np.uint64), np.ones(1, np.uint64)

_KIND = np.ones(256, np.uint8)
_KIND[list(SEPARATORS)] = 0
_KIND[list(SINGLES)] = 2
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_NO_NAME_AFTER = _SPACE | _STOP
_NO_NAME_AFTER[ord(":")] = True
_OPENS = np.zeros(256, bool)
_OPENS[list(b"\"('")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_CAPITAL, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SMALL[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[_CAPITAL] += 32


def _before(flags: np.ndarray) -> np.ndarray:
    """The number of flags before each place, and of all."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, dtype=np.int32, out=out[1:])
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 2 * len(_UP))
        _UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _UP[:n], _DOWN[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unique(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of an ordered pair of keys."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def key_of(text: str) -> np.uint64:
    """The key of one token."""
    raw = text.lower().encode()
    up, down = powers(len(raw) + 1)
    return mix(np.array([(np.frombuffer(raw, np.uint8).astype(np.uint64) * down[: len(raw)]).sum(dtype=np.uint64) + np.uint64(len(raw))], np.uint64))[0]


@dataclass
class Tokens:
    """Tokens of a batch of texts in order: the text each stands in, its key, whether it is a name within a sentence,
    and whether it begins one."""

    text: np.ndarray
    key: np.ndarray
    name: np.ndarray
    fresh: np.ndarray

    def take(self, keep: np.ndarray) -> Tokens:
        return Tokens(self.text[keep], self.key[keep], self.name[keep], self.fresh[keep])


def tokens(texts: pa.Array) -> Tokens:
    """The tokens of an array of strings without nulls."""
    for sign, one in _ALIKE:
        texts = pc.replace_substring(texts, sign, one)
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    b = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and len(texts) else np.empty(0, np.uint8)
    edges = edges - edges[0] if len(edges) else np.zeros(1, np.int64)
    n = len(b)
    if not n:
        return Tokens(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool))
    kind = _KIND[b]
    starts = unique(edges[:-1][edges[:-1] < n])
    word, single = kind == 1, kind == 2
    joined = np.zeros(n + 1, bool)  # to the byte before
    joined[1:n] = word[1:] & word[:-1]
    joined[starts] = False
    s = np.flatnonzero(single | (word & ~joined[:-1]))
    e = np.flatnonzero(single | (word & ~joined[1:])) + 1
    text = np.searchsorted(edges, s, side="right") - 1
    begin = edges[text]
    low = _LOWER[b]
    upper2 = np.zeros(n, bool)  # second bytes of Latin-1 capitals
    upper2[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    low[upper2] += 0x20
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * down[:n], out=total[1:])
    digit = _DIGIT[b]
    digits = _before(digit)
    first_digit = np.append(np.flatnonzero(digit), n)[digits[s]]
    masked = first_digit < e
    end = np.where(masked, first_digit, e)
    key = mix((total[end] - total[s]) * up[s] + (end - s).astype(np.uint64))
    key[masked] = mix(key[masked] ^ np.uint64(0x30))
    space = _SPACE[b]
    spaces = _before(space)
    last_space = np.append(0, np.flatnonzero(space) + 1)[spaces[s]]
    swallowed = digits[s] > digits[np.maximum(last_space, begin)]
    # A capitalised word is a name where a word stands before it in the same sentence.
    p = s - 1
    p = p - np.where((p >= begin) & _OPENS[b[np.maximum(p, 0)]], 1, 0)
    q = np.maximum(p - 1, 0)
    capital = _CAPITAL[b[s]] | ((b[s] == 0xC3) & upper2[np.minimum(s + 1, n - 1)])
    danda = np.zeros(n, bool)
    danda[1:] = (b[1:] == 0xA4) & (b[:-1] == 0xA5)
    name = capital & (p - 1 >= begin) & (b[np.maximum(p, 0)] == 32) & ~_NO_NAME_AFTER[b[q]] & ~danda[q]
    small = _SMALL[b]
    small[1:] |= (b[:-1] == 0xC3) & (b[1:] >= 0x9F)
    smalls = _before(small)
    name &= (smalls[edges[text + 1]] > smalls[begin])  # a line all in capitals tells no names
    stops = _before(_STOP[b])
    prev_end = np.concatenate([[0], e[:-1]])
    same = np.concatenate([[False], text[1:] == text[:-1]])
    fresh = ~same | (((stops[s] > stops[prev_end]) | danda[np.maximum(prev_end - 1, 0)]) & (spaces[s] > spaces[prev_end]))
    keep = ~swallowed
    # A swallowed token that began a sentence can't: figures are swallowed within a word only.
    return Tokens(text[keep], key[keep], name[keep], fresh[keep])


def sequence_keys(keys: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """One key for the ordered keys of each unit; unit is sorted, and units without keys get zero."""
    place = np.arange(len(unit)) - np.searchsorted(unit, unit, side="left")
    up, _ = powers(int(place.max(initial=0)) + 1)
    out = np.zeros(units, np.uint64)
    if len(unit):
        heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        out[unit[heads]] = np.add.reduceat(mix(keys) * up[place], heads, dtype=np.uint64)
    return mix(out)


def windows(keys: np.ndarray, unit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, unit) of every run of width keys of a unit; a shorter unit has the key of all it has."""
    if not len(keys):
        return np.empty(0, np.uint64), np.empty(0, unit.dtype)
    first, last = np.searchsorted(unit, unit, side="left"), np.searchsorted(unit, unit, side="right")
    place = np.arange(len(keys))
    up, _ = powers(width)
    out = np.zeros(len(keys), np.uint64)
    for j in range(width):
        at = place + j
        out += np.where(at < last, keys[np.minimum(at, len(keys) - 1)] * up[j], np.uint64(0))
    whole = (place + width <= last) | ((last - first < width) & (place == first))
    return mix(out[whole]), unit[whole]
