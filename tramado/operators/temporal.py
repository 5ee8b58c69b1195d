"""Statistics of threads over time, their randomised nulls, and false-discovery control."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..sources.tables import Scratch
from .order import lowest_onwards, ordinal, places, reshuffled, running_total


def gaps(days: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, docs, max_gap, tras_gap, p_largo, dur)`` from ``(*keys, doc_id, fecha)``: the longest pause between
    consecutive documents, how many documents come after the first pause of that length, the share of pauses over a
    year, and the days between first and last."""
    order = W.partitionBy(*keys).orderBy("fecha", "doc_id")
    x = days.withColumns({"g": F.datediff("fecha", F.lag("fecha").over(order)), "rn": F.row_number().over(order)})
    agg = x.groupBy(*keys).agg(F.count("*").alias("docs"), F.max("g").alias("max_gap"), F.min(F.when(F.col("g").isNotNull(), F.struct((-F.col("g")).alias("g"), "rn"))).alias("t"), F.avg((F.col("g") > 365).cast("double")).alias("p_largo"), F.datediff(F.max("fecha"), F.min("fecha")).alias("dur"))
    return agg.select(*keys, "docs", "max_gap", (F.col("docs") - F.col("t.rn") + 1).alias("tras_gap"), "p_largo", "dur")


def bursts(days: DataFrame, keys: list[str], window: int = 30) -> DataFrame:
    """Peak year of each thread (earliest among equals) and the most documents in any ``window`` trailing days of it."""
    x = days.withColumns({"anio": F.year("fecha"), "d": F.unix_date("fecha")})
    n = x.groupBy(*keys, "anio").agg(F.count("*").alias("n"))
    peak = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "anio"))["anio"].alias("anio"))
    run = F.count("*").over(W.partitionBy(*keys, "anio").orderBy("d").rangeBetween(-window, 0))
    return x.join(peak, [*keys, "anio"]).withColumn("r", run).groupBy(*keys, "anio").agg(F.max("r").alias("rafaga"))


def year_gaps(days: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, pausa)``: the longest pause between consecutive documents of one year; 0 where no year has two."""
    g = F.datediff("fecha", F.lag("fecha").over(W.partitionBy(*keys, F.year("fecha")).orderBy("fecha")))
    return days.select(*keys, g.alias("g")).groupBy(*keys).agg(F.coalesce(F.max("g"), F.lit(0)).cast("long").alias("pausa"))


def period_share(days: DataFrame, corpus: DataFrame, keys: list[str], period) -> DataFrame:
    """The highest share that a thread has of a period's documents, ``period`` being a function of the date."""
    all_ = corpus.groupBy(period(F.col("fecha")).alias("p")).agg(F.count("*").alias("total"))
    mine = days.groupBy(*keys, period(F.col("fecha")).alias("p")).agg(F.count("*").alias("n"))
    return mine.join(all_, "p").groupBy(*keys).agg(F.max(F.col("n") / F.col("total")).alias("parte"))


def permuted_dates(docs: DataFrame, members: DataFrame, stratum: list[str], replicates: int, seed: int) -> DataFrame:
    """Null N1: ``(rep, doc_id, fecha)`` for the documents of ``members``, with dates permuted among all documents of a
    stratum. Documents and dates of a stratum are put into two random orders once, by ranges, so that a large stratum is
    split; a replicate only moves places. Only documents of ``members`` are copied by replicate."""
    scratch = Scratch(docs.sparkSession, "orders")
    mine = places(docs.select(*stratum, "doc_id"), stratum, [F.md5(F.concat_ws("|", F.lit(f"{seed}a"), "doc_id")), F.col("doc_id")], "k", "n")
    mine = scratch.write(mine.join(members.select("doc_id").distinct(), "doc_id", "left_semi"))
    dates = places(docs.select(*stratum, "doc_id", "fecha"), stratum, [F.md5(F.concat_ws("|", F.lit(f"{seed}b"), "doc_id")), F.col("doc_id")], "k", "n")
    dates = scratch.write(dates.select(*stratum, "k", "fecha"))
    reps = mine.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    reps = reps.withColumn("k", reshuffled(F.col("k"), F.col("n"), F.col("rep"), S.hash_number(F.lit(seed), F.col("rep"), *stratum), replicates))
    return reps.join(dates, [*stratum, "k"]).select("rep", "doc_id", "fecha")


def pseudo_threads(docs: DataFrame, sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Null N2: ``(n, rep, doc_id, fecha)``, uniform sets of ``n`` documents, drawn once per distinct size. Slots are
    hashed to positions, a few more than needed; repeats are dropped and the first ``n`` kept, so the cost is sizes
    times draws, not times documents."""
    pos = ordinal(docs, [F.col("doc_id")], "pos").withColumn("pos", F.col("pos") - 1)
    total = docs.count()
    d = sizes.select("n").distinct().select("n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    d = d.select("n", "rep", F.explode(F.sequence(F.lit(1), F.col("n") + F.greatest(F.lit(4), F.ceil(F.col("n") * F.col("n") / F.lit(max(total, 1))) * 2).cast("long"))).alias("slot"))
    d = d.withColumn("pos", F.pmod(S.hash_number(F.lit(seed), F.col("n"), F.col("rep"), F.col("slot")), F.lit(max(total, 1))))
    first = d.groupBy("n", "rep", "pos").agg(F.min("slot").alias("slot"))
    pick = first.withColumn("k", F.row_number().over(W.partitionBy("n", "rep").orderBy("slot"))).where("k <= n")
    # Spark takes exploded rows for as few as they come from and would send them all to the driver to broadcast them.
    return pick.hint("merge").join(pos, "pos").select("n", "rep", "doc_id", "fecha")


def empirical_p(real: DataFrame, null: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """Both tails with one added: ``p_alto`` counts draws at least as high, ``p_bajo`` at most as low."""
    j = real.select(*keys, F.col(stat).alias("x")).join(null.select(*keys, F.col(stat).alias("y")), keys)
    high, low = F.count_if(F.col("y") >= F.col("x")), F.count_if(F.col("y") <= F.col("x"))
    return j.groupBy(*keys).agg(F.max("x").alias(stat), F.count("*").alias("sorteos"), ((1 + high) / (F.count("*") + 1)).alias("p_alto"), ((1 + low) / (F.count("*") + 1)).alias("p_bajo"))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] | None = None, tie: str | None = None, monotone: bool = True, name: str = "q") -> DataFrame:
    """Column ``name``: p times tests over rank; monotone, or only capped at one. Families (``keys``) are corrected apart.
    Ranks and lowest values come from ranges of the order, so a family may be of any size; ``tie`` orders equal p and must
    be unique in a family."""
    keys = keys or []
    order = [F.col(p)] + ([F.col(tie)] if tie else [F.xxhash64(*df.columns)])
    x = places(df, keys, order, "_k", "_m").withColumn("_q", F.col(p) * F.col("_m") / (F.col("_k") + 1))
    if not monotone:
        return x.select(*df.columns, F.least(F.lit(1.0), "_q").alias(name))
    x = lowest_onwards(x, keys, [*[F.col(k) for k in keys], *order], F.col("_q"), name)
    return x.select(*df.columns, F.least(F.lit(1.0), name).alias(name))


def coherence(vectors: DataFrame, key: str) -> DataFrame:
    """Mean cosine of all pairs of unit vectors of a group, from the length of their sum: linear in members."""
    v = vectors.select(key, F.posexplode(S.unit(F.col("v"))).alias("i", "x"))
    sums = v.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count("*").alias("m"))
    m = F.max("m")
    return sums.groupBy(key).agg(m.alias("docs"), F.try_divide(F.sum(F.col("s") * F.col("s")) - m, m * (m - 1)).alias("coherencia"))


def source_mix(docs: DataFrame, key: str, source: str) -> DataFrame:
    n = docs.groupBy(key, source).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.count("*").alias("fuentes"), (F.max("n") / F.sum("n")).alias("mayor_fuente"))


def grown_threads(threads: DataFrame, corpus: list[tuple[int, int]], replicates: int, seed: int, near: int = 365, far: int = 1095) -> DataFrame:
    """Null of growth, ``(hilo, rep, max_gap, dur)``: for each thread ``(hilo, n, largo, primero)`` pseudo-threads of ``n``
    different documents. They start at a random document of the semester of the thread's first day ``primero`` (of its
    year, if the semester has fewer than five documents) and grow by a random document within ``near`` days of a random
    member, or within ``far`` days with probability ``largo``, both ways. A draw is given up after 20 starts; a start,
    when 30 tries in a row hit members. Draws given up are left out.

    ``corpus`` is the calendar: (day, how many documents) in order, so a few bytes for each day that has documents,
    whatever their number; a document is a place in the running count of documents. Draws are independent, seeded by
    thread and replicate."""
    days = np.array([d for d, _ in corpus], np.int64)
    upto = np.concatenate(([0], np.cumsum([c for _, c in corpus]))).astype(np.int64)
    moments = days.astype("datetime64[D]")
    months = moments.astype("datetime64[M]").astype(np.int64)
    shared = threads.sparkSession.sparkContext.broadcast((days, upto, months // 6, months // 12))

    def run(batches):
        days, upto, semester, year = shared.value
        between = lambda lo, hi: (int(upto[np.searchsorted(days, lo)]), int(upto[np.searchsorted(days, hi, "right")]))

        def grow(rng, n, largo, lo, hi):
            for _ in range(20):
                got = [int(rng.integers(lo, hi))]
                seen, at = set(got), [int(days[np.searchsorted(upto, got[0], "right") - 1])]
                while len(got) < n:
                    for _ in range(30):
                        reach = far if rng.random() < largo else near
                        middle = at[int(rng.integers(len(at)))]
                        new = int(rng.integers(*between(middle - reach, middle + reach)))
                        if new not in seen:
                            break
                    else:
                        break
                    seen.add(new)
                    got.append(new)
                    at.append(int(days[np.searchsorted(upto, new, "right") - 1]))
                if len(got) == n:
                    return np.sort(at)
            return None

        for pdf in batches:
            out = []
            for hilo, n, largo, first, rep in zip(pdf["hilo"], pdf["n"], pdf["largo"], pdf["primero"], pdf["rep"]):
                rng = np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}|{hilo}|{rep}".encode()).digest()[:8], "little"))
                i = np.searchsorted(days, first)
                for period in (semester, year):
                    lo, hi = int(upto[np.searchsorted(period, period[i])]), int(upto[np.searchsorted(period, period[i], "right")])
                    if hi - lo >= 5:
                        break
                d = grow(rng, n, largo, lo, hi)
                if d is not None:
                    out.append((hilo, rep, int(np.diff(d).max()) if len(d) > 1 else 0, int(d[-1] - d[0])))
            yield pd.DataFrame(out, columns=["hilo", "rep", "max_gap", "dur"])

    draws = threads.select("hilo", "n", "largo", "primero", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    return draws.repartition("hilo", "rep").mapInPandas(run, "hilo string, rep int, max_gap long, dur long")


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """Two-sided test of ``value`` between rows where the boolean ``group`` holds or not: U of the true group, z with tie
    and continuity correction, p by the normal approximation. Ranks come from counts of equal values."""
    v = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("t"), F.count_if(F.col(group)).alias("a"))
    r = running_total(v, [F.col(value)], F.col("t"), "upto").withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    s = r.agg(F.sum("t").alias("n"), F.sum("a").alias("n1"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n, n1 = F.col("n"), F.col("n1")
    n2, u = n - n1, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), sd)
    return s.select("n", "n1", u.alias("u"), z.alias("z"), (2 * (1 - normal_cdf(z))).alias("p"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution for z >= 0 by a rational approximation, right to about 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly
