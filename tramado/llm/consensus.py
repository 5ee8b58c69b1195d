"""Consensus from several annotators' labels: the competence-and-spamming mixture.

Each label is either truthful, with the annotator's competence as probability, or drawn from the annotator's own guess
distribution. Expectation-maximisation yields the true labels' probabilities, competences and guess distributions.
Some annotators guess by a habit that depends on the item (one grade too low, say). With ``habits`` a guess distribution
may differ by true label where an annotator's labels show it: it is drawn towards the annotator's common one with weight
``COMMON``. Without, it is the plain mixture.

The labels of an item are packed into one row once. An iteration is one pass: every batch adds up what its items expect
of each annotator and label, partial sums meet in one small aggregation, and the parameters (annotators x labels
numbers, the only thing that reaches the driver) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_words
from ..sources.tables import Scratch

#: Rounds at most, and how little every parameter moves in a round when the fit is done.
ROUNDS = 200
CLOSE = 2e-3
#: Bytes of parameters sent to each executor at most.
LARGEST = 1 << 29
SMOOTH = 0.1
COMMON = 10


@dataclass
class Parameters:
    competence: np.ndarray
    guess: np.ndarray  # annotator, true label, label given
    prior: np.ndarray


def clean_label(c: Column, labels: tuple[str, ...]) -> Column:
    """The label a spelling stands for, apart from case, accents, separators and full stops; null if it is none."""
    v = F.replace(plain_words(c), F.lit(" "), F.lit("_"))
    return F.when(v.isin(*labels), v)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, annotator, label) of every label of a batch."""
    who, what = batch.column("who"), batch.column("what")
    size = np.diff(who.offsets.to_numpy())
    return np.repeat(np.arange(batch.num_rows), size), who.flatten().to_numpy(), what.flatten().to_numpy()


def _posterior(p: Parameters, n: int, item: np.ndarray, who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each true label by item, and of each label given being truthful."""
    row = np.arange(len(item))
    likely = (1 - p.competence[who])[:, None] * p.guess[who, :, what]
    likely[row, what] += p.competence[who]
    log = np.repeat(np.log(p.prior)[None, :], n, 0)
    np.add.at(log, item, np.log(likely))
    log -= log.max(1, keepdims=True)
    post = np.exp(log)
    post /= post.sum(1, keepdims=True)
    return post, post[item, what] * p.competence[who] / likely[row, what]


def _expect(items: DataFrame, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected truthful labels by annotator, guesses by annotator, true label and label given, items by true label."""
    j, k = p.guess.shape[:2]
    shared = items.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true, spam, of = np.zeros(j), np.zeros((j, k, k)), np.zeros(k)
        for batch in batches:
            item, who, what = _rows(batch)
            post, share = _posterior(shared.value, batch.num_rows, item, who, what)
            np.add.at(true, who, share)
            guess = post[item]
            guess[np.arange(len(item)), what] -= share
            np.add.at(spam, (who, slice(None), what), guess)
            of += post.sum(0)
        out = np.concatenate((true, spam.ravel(), of))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "x"])

    total = np.zeros(j + j * k * k + k)
    for r in items.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        total[r["at"]] = r["x"]
    shared.destroy()
    return total[:j], total[j : j + j * k * k].reshape(j, k, k), total[j + j * k * k :]


def fit(items: DataFrame, annotators: int, labels: int, habits: bool = True) -> Parameters:
    """Parameters fitted to ``items`` (columns who, what: arrays of annotator and label numbers). The start treats all
    annotators alike, so the first posterior is close to a vote. The fit ends when no parameter moves by ``CLOSE``."""
    if annotators * labels * labels * 8 > LARGEST:
        raise ValueError(f"parameters of {annotators} annotators don't fit an executor")
    p = Parameters(np.full(annotators, 0.7), np.full((annotators, labels, labels), 1 / labels), np.full(labels, 1 / labels))
    for _ in range(ROUNDS):
        true, spam, of = _expect(items, p)
        n = true + spam.sum((1, 2))
        competence = np.clip((true + SMOOTH) / (n + 2 * SMOOTH), 1e-4, 1 - 1e-4)
        common = spam.sum(1) + SMOOTH
        common /= common.sum(1, keepdims=True)
        weight = COMMON if habits else 1e12
        guess = (spam + weight * common[:, None, :]) / (spam.sum(2, keepdims=True) + weight)
        prior = (of + 1) / (of + 1).sum()
        moved = max(np.abs(x - y).max(initial=0) for x, y in ((competence, p.competence), (guess, p.guess), (prior, p.prior)))
        p = Parameters(competence, guess, prior)
        if moved < CLOSE:
            break
    return p


def consensus(decisions: DataFrame, item: str, annotator: str, label: str, when: str, labels: tuple[str, ...], unknown: str, habits: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(items, annotators)`` from ``decisions``, a row per decision.

    Items: ``(item, etiqueta, confianza, acuerdo, decisiones)``: the most probable label (ties: the first of
    ``labels``), its probability, the share of decisions that agree with it, how many there are. An item none of whose
    decisions is a known label gets ``unknown``, with null measures. Annotators: ``(annotator, fiabilidad, decisiones)``:
    the competence estimated.

    An annotator counts once per item, with the latest decision (``when``; equal or missing times: the label first by
    code point). Repeated rows add nothing; rows without item are left out; a row without annotator or known label only
    names its item. Empty tables give empty results.
    """
    spark = decisions.sparkSession
    scratch = Scratch(spark, "consensus")
    d = decisions.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), clean_label(F.col(label), labels).alias("label"), F.col(when).alias("at")).where("item is not null")
    d = d.groupBy("item", "annotator").agg(
        F.max(F.when(F.col("label").isNotNull(), F.struct(F.coalesce("at", F.lit(0).cast("timestamp")).alias("t")))).alias("last"),
        F.collect_set(F.when(F.col("label").isNotNull(), F.struct(F.coalesce("at", F.lit(0).cast("timestamp")).alias("t"), "label"))).alias("all"),
    )
    d = scratch.write(d.select("item", "annotator", F.array_min(F.transform(F.filter("all", lambda x: x["t"] == F.col("last.t")), lambda x: x["label"])).alias("label")))
    who = sorted(r[0] for r in d.where("label is not null and annotator is not null").select("annotator").distinct().collect())
    code = spark.createDataFrame(list(enumerate(who)), "who int, annotator string")
    number = spark.createDataFrame(list(enumerate(labels)), "what int, label string")
    known = d.join(code, "annotator").join(number, "label")
    items = scratch.write(known.groupBy("item").agg(F.collect_list(F.struct("who", "what")).alias("x")).select("item", F.col("x.who").alias("who"), F.col("x.what").alias("what")))
    p = fit(items, len(who), len(labels), habits)
    best_fit = spark.sparkContext.broadcast(p)

    def label_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, k = _rows(batch)
            post, _ = _posterior(best_fit.value, batch.num_rows, i, j, k)
            best = post.argmax(1)
            n = np.bincount(i, minlength=batch.num_rows)
            agree = np.bincount(i, k == best[i], batch.num_rows) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), pa.array(np.array(labels, object)[best]), pa.array(post.max(1)), pa.array(agree), pa.array(n)],
                ["item", "etiqueta", "confianza", "acuerdo", "decisiones"],
            )

    found = items.mapInArrow(label_of, "item string, etiqueta string, confianza double, acuerdo double, decisiones long")
    rest = d.select("item").distinct().join(items.select("item"), "item", "left_anti")
    rest = rest.select("item", F.lit(unknown).alias("etiqueta"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long"))
    counts = known.groupBy("annotator").agg(F.count("*").alias("decisiones"))
    trust = spark.createDataFrame([(w, float(c)) for w, c in zip(who, p.competence)], "annotator string, fiabilidad double")
    return found.union(rest).withColumnRenamed("item", item), trust.join(counts, "annotator").withColumnRenamed("annotator", annotator)
