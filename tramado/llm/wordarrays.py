"""Words of many texts at once, as arrays of hashes: the kernel of the operators that read every word of every text.

A batch of texts becomes one array of code points; folding is a table lookup, word bounds are differences, and a word's
hash comes from prefix sums of a polynomial over the code points. So the cost is a few array passes per character.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_END = "\x1e"
_TAG = re.compile(r"<[^<>\x1e]{1,300}>")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK = 1 << 20
# Letters as they look when UTF-8 was read as Latin-1 or Windows-1252.
_MISREAD = (("Ã¡", "a"), ("Ã©", "e"), ("Ã­", "i"), ("Ã³", "o"), ("Ãº", "u"), ("Ã±", "n"), ("Ã¼", "u"), ("Ã\x81", "a"), ("Ã‰", "e"), ("Ã\x89", "e"), ("Ã\x8d", "i"), ("Ã“", "o"), ("Ã\x93", "o"), ("Ãš", "u"), ("Ã\x9a", "u"), ("Ã‘", "n"), ("Ã\x91", "n"))


@lru_cache(1)
def fold_table() -> np.ndarray:
    """For each code point of the basic plane: 0 separates words, 1 is skipped (combining marks, soft hyphens), else the
    code point of the folded letter or digit."""
    t = np.zeros(0x10000, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if unicodedata.combining(c) or i in (0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF):
            t[i] = 1
        elif c.isalnum() or unicodedata.category(c) in ("Mc", "Mn"):
            base = unicodedata.normalize("NFKD", c.lower())
            t[i] = ord(base[0]) if base and not unicodedata.combining(base[0]) else i
    return t


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(n, _BASE), np.full(n, _INVERSE)
    a[0] = b[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hash_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices of folded code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(20, int(len(codes)).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * power[: len(codes)], dtype=np.uint64, out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about CHUNK characters together, each with the index of its first. Null is an empty text."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


def _shortened(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``least`` letters or more (up to 24) with each letter left out in turn, and the word of each."""
    long_ = np.flatnonzero((ends - starts >= least) & (ends - starts <= 24))
    if not len(long_):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = 1 << max(20, int(len(codes)).bit_length())
    power, inverse = _powers(size)
    n = (ends - starts)[long_]
    of = np.repeat(long_, n)
    cut = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[of]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes.astype(np.uint64) * power[: len(codes)], dtype=np.uint64, out=sums[1:])
        head = (sums[cut] - sums[starts[of]]) * inverse[starts[of]]
        tail = (sums[ends[of]] - sums[cut + 1]) * inverse[starts[of] + 1]
        return mix(head + tail), of


def words(texts: list[str], markup: bool = True, deletions: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words and the index of the text of each, in order. Case, accents, punctuation, spacing and (with
    ``markup``) tags and character references don't count. With ``deletions``, also the hashes of the different words of so
    many letters with each letter left out, the word of each, a place of each word, and the word at each place."""
    joined = _END.join(t.replace(_END, " ") if _END in t else t for t in texts)
    if markup:
        if "<" in joined:
            joined = _TAG.sub(" ", joined)
        if "&" in joined:
            joined = _END.join(html.unescape(t).replace(_END, " ") if "&" in t else t for t in joined.split(_END))
    if "Ã" in joined:
        for bad, good in _MISREAD:
            joined = joined.replace(bad, good)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    f = np.where(cp < 0x10000, fold_table()[np.minimum(cp, 0xFFFF)], cp)
    at = np.cumsum(cp == 0x1E)
    seen = f != 1
    f, at = f[seen], at[seen]
    inside = np.concatenate(([False], f > 1, [False]))
    step = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    h, at = hash_words(f, starts, ends), at[starts] if len(starts) else np.zeros(0, np.int64)
    if not deletions:
        return h, at
    _, first, same = np.unique(h, return_index=True, return_inverse=True)
    form, of = _shortened(f, starts[first], ends[first], deletions) if len(h) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return h, at, (form, of, first, same)


def shingles(w: np.ndarray, doc: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a text, and the text of each; a shorter text gives one run of all its
    words."""
    if len(w) < n:
        w, doc = np.concatenate((w, np.zeros(n, np.uint64))), np.concatenate((doc, np.full(n, -1)))
    m = len(w) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + w[i : i + m]
        h = mix(h)
    whole = (doc[:m] == doc[n - 1 :]) & (doc[:m] >= 0)
    count = np.bincount(doc[doc >= 0].astype(np.int64)) if (doc >= 0).any() else np.zeros(0, int)
    short = np.flatnonzero((count > 0) & (count < n))
    hs, ds = h[whole], doc[:m][whole]
    if len(short):
        first = np.searchsorted(doc[doc >= 0], short)
        with np.errstate(over="ignore"):
            extra = np.array([mix(np.array([np.bitwise_xor.reduce(mix(w[a : a + c] + np.arange(c, dtype=np.uint64)))]))[0] for a, c in zip(first, count[short])], np.uint64)
        hs, ds = np.concatenate((hs, extra)), np.concatenate((ds, short))
    return hs, ds
