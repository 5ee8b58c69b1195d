"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key scaled by its quality weight; within a source, documents are taken in the order
of keys until their tokens fill the source's budget. Complete epochs come before the fractional selection.

Prefix sums run in two steps, so no source is sorted in one task: tokens are added up by source and key bucket, the
few bucket sums are prefix-summed, and only the one bucket in which a budget ends is sorted.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .wordarrays import chunks, hash_words

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKETS = 4096
KEPT = 1 << 20
SEED = 42


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    from importlib.util import module_from_spec, spec_from_file_location

    spec = spec_from_file_location("public_tokenizers", path.rsplit("/", 1)[0] + "/__init__.py")
    module = module_from_spec(spec)
    spec.loader.exec_module(module)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _classes() -> np.ndarray:
    """1 letters, 2 numbers, 3 white space, 4 the rest."""
    import regex

    t = np.full(0x110000, 4, np.int8)
    every = "".join(map(chr, [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]))
    for pattern, k in ((r"\p{L}", 1), (r"\p{N}", 2), (r"\s", 3)):
        t[[ord(c) for c in regex.findall(pattern, every)]] = k
    return t


def _pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces the tokenizer's pattern cuts texts into: the joined text, starts, ends, text of each, hashes."""
    joined = "".join(texts)
    size = np.array([len(t) for t in texts])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _classes()[c]
    n = len(c)
    first = np.zeros(n + 1, bool)  # a text starts here
    first[np.concatenate(([0], np.cumsum(size)))] = True
    start = first[:n].copy()
    start[1:] |= k[1:] != k[:-1]
    # White space: all but the last one of a run go together; a last plain blank joins what follows.
    white = k == 3
    last = white & np.concatenate((~white[1:] | first[1:n], [True]))
    follows = last & np.concatenate((~first[1:n], [False]))
    joins = follows & (c == 32)
    start |= follows  # the last one of a run before a word is cut off ...
    start[1:] &= ~joins[:-1] | first[1:n]  # ... and, if a plain blank, leads the word
    # Contractions: an apostrophe and certain letters are a piece.
    quote = np.flatnonzero((c == 39) & ~np.concatenate(([False], joins[:-1])) & start) if n else np.zeros(0, int)
    for q in quote:
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            e = q + 1 + len(tail)
            if joined[q + 1 : e] == tail and not first[q + 1 : e].any():
                start[q + 1 : e] = False
                if e < n:
                    start[e] = True
                break
    s = np.flatnonzero(start)
    e = np.concatenate((s[1:], [n]))
    at = np.searchsorted(np.cumsum(size), s, "right")
    return joined, s, e, at, hash_words(c, s, e)


class Counter:
    """Tokens of texts, exactly as the tokenizer counts: a piece's tokens don't depend on its neighbours, so each
    different piece is encoded once and kept (up to a bound) by hash."""

    def __init__(self, path: str):
        self.path, self.kept = path, {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        joined, s, e, at, h = _pieces(texts)
        if not len(s):
            return np.zeros(len(texts), np.int64)
        unique, one, back = np.unique(h, return_index=True, return_inverse=True)
        kept, encode = self.kept, _encoding(self.path).encode_ordinary
        if len(kept) > KEPT:
            kept.clear()
        count = np.empty(len(unique), np.int64)
        for i, (x, j) in enumerate(zip(unique.tolist(), one.tolist())):
            n = kept.get(x)
            if n is None:
                n = kept[x] = len(encode(joined[s[j] : e[j]]))
            count[i] = n
        return np.bincount(at, count[back], len(texts)).astype(np.int64)


def token_counts(documents: DataFrame, key: str, text: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, *keep, tokens)``. Null and empty texts have no tokens."""
    counter = Counter(tokenizer)
    rows = documents.select(key, *keep, F.col(text).alias("_text"))
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [counter(part) for _, part in chunks(batch.column("_text").to_pylist())]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n)], [*names, "tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema)
    return rows.mapInArrow(run, f"{schema}, tokens long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: the share of letters among all characters, halved for texts under 200 characters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), letters * F.when(F.length(text) < 200, 0.5).otherwise(1.0))


def mix(documents: DataFrame, key: str, source: str, weight: str, tokens: str, targets: DataFrame, total: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)``.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``. The mixture has ``total`` tokens (by default as
    many as the documents of the targeted sources have). A source's budget is its share of them, at most ``max_repeats``
    times its own tokens. Chosen: ``(key, source, copies, tokens)``, a row per document with at least one copy. Shares:
    a row per target with what was asked for and reached; sources without documents reach 0.

    Documents without source, of sources without target, or without tokens are in no mixture; no document has more
    than ``max_repeats`` copies. A document that would overrun the rest of a budget ends its source's selection, so a
    source is short of its budget by less than one document. Ties of keys go to the smaller ``key``. Null weights count
    as 1, weights under 0.001 as 0.001. Each row of ``documents`` is a document; empty tables give empty results.
    """
    t = targets.select(F.col("source").alias(source), "target_share", "max_repeats")
    d = documents.where((F.col(tokens) > 0) & F.col(source).isNotNull()).select(key, source, F.col(tokens).alias("tokens"), F.greatest(F.coalesce(weight, F.lit(1.0)), F.lit(0.001)).alias("w"))
    # A uniform number from the document's key alone, so that the choice survives any rerun or partitioning.
    u = (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    d = d.withColumn("k", -F.log(u) / F.col("w")).join(t.select(source), source)
    d = d.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("k") / 4)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    parts = d.groupBy(source, "bucket").agg(F.sum("tokens").alias("n"))
    have = parts.groupBy(source).agg(F.sum("n").alias("have"))
    whole = F.lit(total) if total is not None else F.sum(F.coalesce("have", F.lit(0))).over(W.partitionBy(F.lit(1)))
    plan = t.join(have, source, "left").withColumn("whole", whole)
    plan = plan.withColumn("asked", (F.col("target_share") * F.col("whole")).cast("long"))
    plan = plan.withColumn("budget", F.least("asked", F.col("have") * F.col("max_repeats")))
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("have")).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have"))
    before = F.sum("n").over(W.partitionBy(source).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    edges = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(plan.select(source, "epochs", "rest"), source)
    edges = edges.select(source, "bucket", "before", "epochs", "rest", (F.col("before") + F.col("n") <= F.col("rest")).alias("inside"), (F.col("before") < F.col("rest")).alias("begun"))
    x = d.join(edges, [source, "bucket"])
    inside = x.where("inside").select(key, source, "tokens", F.lit(1).alias("one"), "epochs")
    none = x.where("not begun").select(key, source, "tokens", F.lit(0).alias("one"), "epochs")
    run = F.sum("tokens").over(W.partitionBy(source, "bucket").orderBy("k", key))
    edge = x.where("begun and not inside").withColumn("one", (F.col("before") + run <= F.col("rest")).cast("int")).select(key, source, "tokens", "one", "epochs")
    copies = (F.col("epochs") + F.col("one")).alias("copies")
    chosen = inside.union(none).union(edge).select(key, source, copies, "tokens").where("copies > 0")
    got = chosen.groupBy(source).agg(F.sum(F.col("copies") * F.col("tokens")).alias("got"), F.count("*").alias("docs"), F.max("copies").alias("most"))
    shares = t.join(got, source, "left").select(source, "target_share", "max_repeats", F.coalesce("got", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most", F.lit(0)).alias("most_copies"))
    every = F.sum("tokens").over(W.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.when(every > 0, F.col("tokens") / every))
    return chosen, shares
