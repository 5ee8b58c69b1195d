"""Evaluation texts leaking into training text: a BM25 index of the test items, queried by every passage of the corpus.

Queries run the other way round: the test items are few and are indexed; every passage of every document is a query.
Terms are pairs of neighbouring words, so that a passage with an item's words in another order scores low.
Retrieval is block-max WAND on inverted lists, over all passages of a batch at once: a passage whose words' highest
impacts don't reach the threshold is skipped; then blocks of items whose highest impacts don't; only what is left is
scored. The bounds are never below the score, so all items above the threshold are retrieved. Each is then verified by a
local alignment of the document's words around the passage with the item's words. Before all this, words of the document
that are one edit or swap away from an item's word, and no item's word themselves, are read as that word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordarrays import chunks, mix, words

HALF = 16  # a passage is two neighbouring runs of so many words
PART = 0.16  # least score, as a share of an item's score with itself
K1, B = 1.2, 0.75
BLOCK = 8
SIEVE = 20
ITEMS = 50_000  # items per index: some 50 MB of lists at sixty words each; more are indexed in several
SUB, GAP = 0.3, 0.4
CARRIED = 0.5
SLIP = 5  # words of so many letters may be mistyped by one edit or swap


class Index:
    """Inverted lists of the items: for each term the items it is in with its impact, and the blocks of items with the
    highest impact in each; the items' words, and the forms of their longer words with one letter left out."""

    def __init__(self, texts: list[str]):
        w, at, lone = words(texts, markup=False, deletions=SLIP)
        n = len(texts)
        bounds = np.searchsorted(at, np.arange(n + 1))
        self.items = [w[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        self.words = np.unique(w)
        # A form with a letter left out stands for the smallest word it comes from.
        form, of, first, _ = lone
        form, whole = np.concatenate((form, w[first])), np.concatenate((w[first][of], w[first]))
        order = np.lexsort((whole, form))
        first = np.concatenate(([True], form[order][1:] != form[order][:-1])) if len(form) else np.zeros(0, bool)
        self.forms, self.stands = form[order][first], whole[order][first]
        pairs, at = _pairs(w, at)
        length = np.bincount(at, minlength=n)
        self.vocabulary, term = np.unique(pairs, return_inverse=True)
        v = len(self.vocabulary)
        cell, tf = np.unique(term.astype(np.int64) * max(n, 1) + at, return_counts=True)
        term, self.item = cell // max(n, 1), (cell % max(n, 1)).astype(np.int32)
        df = np.bincount(term, minlength=v)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean() if n else 1, 1))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[self.item])
        own = np.bincount(self.item, impact * tf, max(n, 1))
        self.impact = (impact / np.maximum(own[self.item], 1e-9)).astype(np.float32)
        self.start = np.searchsorted(term, np.arange(v + 1))
        new = np.concatenate(([True], (term[1:] != term[:-1]) | (self.item[1:] // BLOCK != self.item[:-1] // BLOCK))) if len(term) else np.zeros(0, bool)
        at_block = np.flatnonzero(new)
        self.block = self.item[at_block] // BLOCK
        self.top = np.maximum.reduceat(self.impact, at_block) if len(at_block) else np.zeros(0, np.float32)
        self.block_start = np.searchsorted(term[at_block], np.arange(v + 1))
        self.most = np.zeros(v + 1, np.float32)
        np.maximum.at(self.most, term, self.impact)
        self.sieve = np.zeros(1 << SIEVE, bool)  # which leading bits any term has
        self.sieve[self.vocabulary >> np.uint64(64 - SIEVE)] = True


def _expand(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence of a term, the places of its list: (occurrence, place)."""
    size = start[term + 1] - start[term]
    which = np.repeat(np.arange(len(term)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[term], size)


def _summed(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Keys whose values add up to PART at least, in order."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    if not len(key):
        return key
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first][np.add.reduceat(value, first) >= PART]


def _corrected(index: Index, w: np.ndarray, lone: tuple[np.ndarray, ...]) -> np.ndarray:
    """Words that are no item's, but one edit or swap away from one, as that word."""
    if not len(index.forms) or not len(w):
        return w
    form, of, first, same = lone
    each = w[first]
    strange = index.words[np.minimum(np.searchsorted(index.words, each), len(index.words) - 1)] != each
    form, of = np.concatenate((form[strange[of]], each[strange])), np.concatenate((of[strange[of]], np.flatnonzero(strange)))
    spot = np.minimum(np.searchsorted(index.forms, form), len(index.forms) - 1)
    hit = index.forms[spot] == form
    each[of[hit]] = index.stands[spot[hit]]
    return each[same]


def _pairs(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index terms: hashes of neighbouring words of a text, and the text of each."""
    with np.errstate(over="ignore"):
        h = mix(w[:-1] * np.uint64(0x100000001B3) + w[1:])
    same = at[1:] == at[:-1]
    return h[same], at[:-1][same]


def _align(doc: list[np.ndarray], item: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each document stretch with its item: a word in common 1, another in its place -SUB, a
    word too many or missing -GAP. All pairs advance together, one item word per step."""
    n, m = max(map(len, item)), max(map(len, doc))
    d = np.zeros((len(doc), m), np.uint64)
    q = np.ones((len(doc), n), np.uint64)
    for k, (x, y) in enumerate(zip(doc, item)):
        d[k, : len(x)], q[k, : len(y)] = x, y
    live = np.array([len(y) for y in item])
    ramp = (GAP * np.arange(m + 1)).astype(np.float32)
    row = np.zeros((len(doc), m + 1), np.float32)
    best = np.zeros(len(doc), np.float32)
    for i in range(n):
        new = np.maximum(row - np.float32(GAP), 0)
        step = np.where(d == q[:, i : i + 1], np.float32(1), np.float32(-SUB)) + row[:, :-1]
        np.maximum(new[:, 1:], step, out=new[:, 1:])
        row = np.maximum.accumulate(new + ramp, 1) - ramp
        np.maximum(best, np.where(i < live, row.max(1), 0), out=best)
    return best


def _passages(index: Index, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, item) of every passage and item with a score of at least PART."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(w) or not len(index.vocabulary):
        return none
    with np.errstate(over="ignore"):
        pairs = np.concatenate((mix(w[:-1] * np.uint64(0x100000001B3) + w[1:]), [np.uint64(0)]))
    term = np.full(len(w), len(index.vocabulary))
    maybe = np.flatnonzero(index.sieve[pairs >> np.uint64(64 - SIEVE)])
    spot = np.minimum(np.searchsorted(index.vocabulary, pairs[maybe]), len(index.vocabulary) - 1)
    sure = (index.vocabulary[spot] == pairs[maybe]) & (at[np.minimum(maybe + 1, len(at) - 1)] == at[maybe])
    term[maybe[sure]] = spot[sure]
    begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    place = np.arange(len(w)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(w)]))))
    half = np.flatnonzero(place % HALF == 0)
    of = at[half]
    pair = np.concatenate((of[1:] == of[:-1], [False]))
    # No passage whose terms' highest impacts don't reach the threshold.
    most = np.add.reduceat(index.most[term], half)
    likely = most.copy()
    likely[:-1][pair[:-1]] += most[1:][pair[:-1]]
    likely = likely >= PART
    if not likely.any():
        return none
    which = np.repeat(np.arange(len(half)), np.diff(np.concatenate((half, [len(w)]))))
    use = term < len(index.vocabulary)
    h, t = which[use], term[use]
    before = np.maximum(h - 1, 0)
    own, back = likely[h], likely[before] & pair[before] & (h > 0)
    passage, t = np.concatenate((h[own], before[back])), np.concatenate((t[own], t[back]))
    # No block of items whose highest impacts don't reach it; of the others, every item is scored.
    blocks = np.int64(len(index.items) // BLOCK + 1)
    i, k = _expand(index.block_start, t)
    alive = _summed(passage[i] * blocks + index.block[k], index.top[k])
    if not len(alive):
        return none
    i, k = _expand(index.start, t)
    key = passage[i] * blocks + index.item[k] // BLOCK
    spot = np.minimum(np.searchsorted(alive, key), len(alive) - 1)
    on = alive[spot] == key
    n = np.int64(len(index.items))
    found = _summed(passage[i[on]] * n + index.item[k[on]], index.impact[k[on]])
    return of[found // n], half[found // n], found % n


def _search(index: Index, w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, start, item = _passages(index, w, at)
    if not len(doc):
        return doc, item
    # Passages of one document and item that follow each other are verified as one stretch.
    order = np.lexsort((start, item, doc))
    doc, start, item = doc[order], start[order], item[order]
    size = np.array([len(x) for x in index.items])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[item[1:]])
    lo = start[new] - size[item[new]]
    last = np.flatnonzero(np.concatenate((new[1:], [True])))
    hi = start[last] + 2 * HALF + size[item[new]]
    doc, item = doc[new], item[new]
    first = np.searchsorted(at, doc)
    end = np.searchsorted(at, doc, "right")
    lo, hi = np.maximum(lo, first), np.minimum(hi, end)
    good = np.zeros(len(doc), bool)
    by_size = np.argsort(hi - lo, kind="stable")
    for a in range(0, len(doc), 128):
        k = by_size[a : a + 128]
        got = _align([w[lo[i] : hi[i]] for i in k], [index.items[item[i]] for i in k])
        good[k] = got >= CARRIED * size[item[k]]
    return doc[good], item[good]


def leaked_items(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """Distinct ``(key, item)``: the document has one stretch that carries at least half of the item's words in their
    order, apart from case, accents, punctuation, spacing and small slips.

    Every word of every document is read, in passages that overlap by half. Null and empty texts carry nothing; items
    without words leak nowhere; either table may be empty. Repeated rows add nothing. Items are indexed ``ITEMS`` at a
    time, so what is sent to the executors has a fixed bound per item text.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    ikind = items.schema[item].dataType.simpleString()
    rows = items.select(item, item_text).where(F.col(item_text).isNotNull()).distinct().orderBy(item).toLocalIterator()
    docs = documents.select(F.col(key), F.col(text))
    out: DataFrame | None = None
    block: list = []

    def search(block: list) -> DataFrame:
        index = spark.sparkContext.broadcast(Index([r[1] for r in block]))
        ids = spark.sparkContext.broadcast([r[0] for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, part in chunks(batch.column(1).to_pylist()):
                    w, at, lone = words(part, markup=False, deletions=SLIP)
                    d, i = _search(index.value, _corrected(index.value, w, lone), at)
                    keys = batch.column(0).take(pa.array(d + first, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([ids.value[k] for k in i], _arrow(ikind))], [key, item])

        return docs.mapInArrow(run, f"`{key}` {kind}, `{item}` {ikind}")

    for r in rows:
        block.append(r)
        if len(block) == ITEMS:
            out, block = (search(block) if out is None else out.union(search(block))), []
    if block:
        out = search(block) if out is None else out.union(search(block))
    if out is None:
        return spark.createDataFrame([], f"`{key}` {kind}, `{item}` {ikind}")
    return out.distinct()


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
