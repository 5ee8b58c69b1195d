"""Queries on pairs, threads and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import order as O
from ..operators import pairs as P
from ..operators import partitions as R
from ..operators import sampling as M
from ..operators import temporal as X
from ..operators import threads as H
from ..sources.tables import Scratch, table
from . import sql as Q
from .corpus import docs, refs

TAU = 0.45


def frequencies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Referents and their frequencies; both are used by several steps, so they are written once."""
    scratch = Scratch(spark, "referents")
    r = scratch.write(refs(spark, d))
    dated = docs(spark, d).where(S.day(F.col("fecha_iso")).isNotNull()).count()
    return r, P.frequencies(r, dated)


def edges(spark: SparkSession, d: str) -> DataFrame:
    return P.clean_edges(table(spark, d, "f2b_idf_v2_l2_edges"))


def grid(e: DataFrame, tier: str = "L2") -> DataFrame:
    """Edges at every threshold of the grid; scored once, accepted many times."""
    return e.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in DEFAULT.taus]))).where(P.accepted(F.col("tau"), tier))


def threads(spark: SparkSession, d: str, tau: float = TAU, tier: str = "L2") -> DataFrame:
    return H.numbered(G.components(edges(spark, d).where(P.accepted(F.lit(tau), tier))))


def thread_days(spark: SparkSession, d: str) -> DataFrame:
    """Dated documents of threads of at least three documents."""
    day = docs(spark, d).select(F.col("id").alias("doc_id"), S.day(F.col("fecha_iso")).alias("fecha"), "fuente")
    t = threads(spark, d).where(F.col("n") >= DEFAULT.min_thread)
    return t.join(day.where("fecha is not null"), "doc_id").select("hilo", "doc_id", "fecha", "fuente")


def pair_frequencies(spark: SparkSession, d: str) -> DataFrame:
    _, f = frequencies(spark, d)
    return f.select("tipo", "referente", "df", "hub", F.round("idf", 6).alias("idf"))


def pair_scored(spark: SparkSession, d: str) -> DataFrame:
    """Scored candidate pairs."""
    r, f = frequencies(spark, d)
    return P.scored_pairs(r, f).select("doc_i", "doc_j", "dias", F.round("s_ref", 6).alias("s_ref"))


def thread_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Which documents form persistent threads: from the corpus to threads with their span, at the lowest threshold."""
    r, f = frequencies(spark, d)
    accepted = P.scored_pairs(r, f).where(P.accepted(F.lit(DEFAULT.taus[0])))
    t = H.numbered(G.components(accepted.select(F.col("doc_i").alias("a"), F.col("doc_j").alias("b"))))
    x = t.where(F.col("n") >= DEFAULT.min_thread).join(r.select("doc_id", "fecha").distinct(), "doc_id")
    return x.groupBy("hilo").agg(F.count("*").alias("docs"), F.min("fecha").cast("string").alias("desde"), F.max("fecha").cast("string").alias("hasta"))


def pair_bands(spark: SparkSession, d: str) -> DataFrame:
    """Edges by band of weight and distance in time."""
    band = F.when(F.col("w") < 0.40, "rechazada").when(F.col("w") < 0.45, "casi").when(F.col("w") < 0.47, "apenas").otherwise("segura")
    far = F.when(F.col("dias") > DEFAULT.near_days, F.when((F.col("s_ref") >= 0.5) & (F.col("s_ref") < 0.6), "larga_debil").otherwise("larga")).otherwise("corta")
    return edges(spark, d).groupBy(band.alias("banda"), F.coalesce(far, F.lit("sin_dias")).alias("tramo")).agg(F.count("*").alias("aristas"), F.round(F.avg("w"), 6).alias("w_medio"))


def thread_members(spark: SparkSession, d: str) -> DataFrame:
    return threads(spark, d).select("hilo", "doc_id", "n")


def _grid_summary(spark: SparkSession, d: str) -> DataFrame:
    e = Scratch(spark, "grid").write(grid(edges(spark, d)))
    n = docs(spark, d).where(S.day(F.col("fecha_iso")).isNotNull()).count()
    return H.grid_summary(e, G.components(e.select("tau", "a", "b"), ["tau"]), n)


def thread_grid(spark: SparkSession, d: str) -> DataFrame:
    """Threads at each threshold of the grid."""
    g = _grid_summary(spark, d)
    return g.select("tau", "aristas", "largas", "hilos", "hilos_3", "mediana_3", F.round("cobertura_3", 6).alias("cobertura_3"), F.round("gigante", 6).alias("gigante"), "cabe")


def thread_tau(spark: SparkSession, d: str) -> DataFrame:
    """The threshold the grid's rule picks."""
    return H.chosen_tau(_grid_summary(spark, d))


def thread_profiles(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "profiles")  # both are used twice
    p = H.profiles(scratch.write(threads(spark, d).where(F.col("n") >= DEFAULT.min_thread)), scratch.write(refs(spark, d)))
    return p.select("hilo", "docs", F.col("desde").cast("string").alias("desde"), F.col("hasta").cast("string").alias("hasta"), F.round("anios", 6).alias("anios"), "objeto", "territorio", "actor")


def thread_far_share(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return H.far_share(e.where(P.accepted(F.lit(TAU))), threads(spark, d)).withColumn("parte_larga", F.round("parte_larga", 6))


def thread_isolates(spark: SparkSession, d: str) -> DataFrame:
    """Documents in no thread."""
    t = threads(spark, d).select(F.col("doc_id").alias("id"))
    return docs(spark, d).join(t, "id", "left_anti").select("id", S.day(F.col("fecha_iso")).cast("string").alias("fecha"))


def thread_tiers(spark: SparkSession, d: str) -> DataFrame:
    """How alike the threads of two tiers and of two thresholds are. All variants share the rounds of one component run."""
    scratch = Scratch(spark, "tiers")
    rules = {"base": P.accepted(F.lit(TAU)), "L1": P.accepted(F.lit(TAU), "L1"), "L3": P.accepted(F.lit(TAU), "L3"), "tau_55": P.accepted(F.lit(0.55))}
    e = edges(spark, d).withColumn("variante", F.explode(F.array(*[F.when(ok, F.lit(name)) for name, ok in rules.items()]))).where("variante is not null")
    c = scratch.write(G.components(e.select("variante", "a", "b"), ["variante"]).select("variante", "doc_id", F.col("comp").alias("grupo")))
    of = lambda v: c.where(F.col("variante") == v).select("doc_id", "grupo")
    out = None
    for name in ("L1", "L3", "tau_55"):
        x = R.compare(of("base"), of(name)).withColumn("con", F.lit(name))
        out = x if out is None else out.union(x)
    return out.select("con", "docs", "grupos_a", "grupos_b", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("pares_a", "pares_b", "pares_ambos", "jaccard", "ari", "nmi", "vi", "retencion")])


def thread_best_overlap(spark: SparkSession, d: str) -> DataFrame:
    return H.best_overlap(threads(spark, d), threads(spark, d, 0.55))


def temporal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return X.gaps(thread_days(spark, d), ["hilo"]).withColumn("p_largo", F.round("p_largo", 6))


def temporal_bursts(spark: SparkSession, d: str) -> DataFrame:
    return X.bursts(thread_days(spark, d), ["hilo"])


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(F.col("id").alias("doc_id"), S.day(F.col("fecha_iso")).alias("fecha"), F.lower(F.coalesce("fuente", F.lit("desconocida"))).alias("fuente")).where("fecha is not null")


def temporal_periods(spark: SparkSession, d: str) -> DataFrame:
    """The highest share of a quarter's and of a semester's documents that a thread has."""
    days, corpus = thread_days(spark, d), _dated(spark, d)
    q = X.period_share(days, corpus, ["hilo"], S.quarter).select("hilo", F.round("parte", 6).alias("trimestre"))
    return q.join(X.period_share(days, corpus, ["hilo"], S.semester).select("hilo", F.round("parte", 6).alias("semestre")), "hilo")


def temporal_thin_periods(spark: SparkSession, d: str) -> DataFrame:
    """Quarters with fewer than fifty documents."""
    return _dated(spark, d).groupBy(S.quarter(F.col("fecha")).alias("trimestre")).agg(F.count("*").alias("docs")).where("docs < 50")


def temporal_sources(spark: SparkSession, d: str) -> DataFrame:
    return X.source_mix(thread_days(spark, d).where("fuente is not null"), "hilo", "fuente").withColumn("mayor_fuente", F.round("mayor_fuente", 6))


#: Replicates of dropped documents and of moved dates (RS14, RS15).
DROPS = 20


def _tested(x: DataFrame, tests: list[tuple[str, str]]) -> DataFrame:
    """p columns with their q and significance, each corrected as a family of its own."""
    scratch = Scratch(x.sparkSession, "tests")
    x = scratch.write(x)
    for p, q in tests:
        x = scratch.write(X.benjamini_hochberg(x, p, tie="hilo", name=q))
    return x


def _bursts(days: DataFrame, keys: list[str]) -> DataFrame:
    """Most documents in thirty days and longest pause, both inside one year."""
    return X.bursts(days, keys).select(*keys, F.col("rafaga").alias("rafaga")).join(X.year_gaps(days, keys), keys)


def null_permuted(spark: SparkSession, d: str, reps: int = DEFAULT.replicates) -> DataFrame:
    """Bursts and pauses within a year against dates permuted within year and source: p and q by thread."""
    scratch = Scratch(spark, "null")
    days = scratch.write(thread_days(spark, d).select("hilo", "doc_id", "fecha"))
    pool = scratch.write(_dated(spark, d).withColumn("anio", F.year("fecha")))
    drawn = X.permuted_dates(pool, days, ["anio", "fuente"], reps, 20260731).join(days.select("hilo", "doc_id"), "doc_id")
    null, real = scratch.write(_bursts(drawn, ["hilo", "rep"])), scratch.write(_bursts(days, ["hilo"]))
    b = X.empirical_p(real, null, ["hilo"], "rafaga").select("hilo", "rafaga", "sorteos", F.col("p_alto").alias("p_rafaga"))
    g = X.empirical_p(real, null, ["hilo"], "pausa").select("hilo", "pausa", F.col("p_alto").alias("p_pausa"))
    x = _tested(b.join(g, "hilo"), [("p_rafaga", "q_rafaga"), ("p_pausa", "q_pausa")])
    return x.select("hilo", "rafaga", "pausa", "sorteos", *[F.round(c, 6).alias(c) for c in ("p_rafaga", "q_rafaga", "p_pausa", "q_pausa")])


def null_sizes(spark: SparkSession, d: str, reps: int = DEFAULT.replicates) -> DataFrame:
    """Span and longest pause against random sets of the same size; a thread reappears if its pause is significant and
    three documents or more follow it."""
    scratch = Scratch(spark, "sizes")
    days = scratch.write(thread_days(spark, d).select("hilo", "doc_id", "fecha"))
    real = scratch.write(X.gaps(days, ["hilo"]).withColumnRenamed("docs", "n"))
    sets = X.pseudo_threads(_dated(spark, d).select("doc_id", "fecha"), real.select("n"), reps, 20260732)
    null = scratch.write(X.gaps(sets, ["n", "rep"]).select("n", "rep", "max_gap", "dur"))
    # Threads of one size and value have one p, so draws meet values, not threads.
    p = lambda stat: X.empirical_p(real.select("n", stat, F.col(stat).alias("v")).distinct(), null.join(real.select("n", F.col(stat).alias("v")).distinct(), "n"), ["n", "v"], stat)
    of = lambda stat: real.select("hilo", "n", F.col(stat).alias("v")).join(p(stat), ["n", "v"])
    g = of("max_gap").select("hilo", "max_gap", "sorteos", F.col("p_alto").alias("p_pausa"))
    s = of("dur").select("hilo", "dur", F.col("p_bajo").alias("p_corto"), F.col("p_alto").alias("p_largo"))
    x = _tested(g.join(s, "hilo").join(real.select("hilo", "tras_gap"), "hilo"), [("p_pausa", "q_pausa"), ("p_corto", "q_corto"), ("p_largo", "q_largo")])
    again = (F.round("q_pausa", 6) <= DEFAULT.fdr) & (F.col("tras_gap") >= 3)
    cols = [F.round(c, 6).alias(c) for c in ("p_pausa", "q_pausa", "p_corto", "q_corto", "p_largo", "q_largo")]
    return x.select("hilo", "max_gap", "tras_gap", "dur", "sorteos", *cols, again.alias("reaparece"))


def null_significant(spark: SparkSession, d: str, reps: int = DEFAULT.replicates) -> DataFrame:
    """How many threads are significant in each family of tests, how many reappear, and the share without any signal."""
    scratch = Scratch(spark, "families")
    n, s = scratch.write(null_permuted(spark, d, reps)), scratch.write(null_sizes(spark, d, reps))
    x = n.select("hilo", "q_rafaga", F.col("q_pausa").alias("q_pausa_anual")).join(s.select("hilo", "q_pausa", "q_corto", "q_largo", "reaparece"), "hilo")
    families = ("q_rafaga", "q_pausa_anual", "q_pausa", "q_corto", "q_largo")
    signal = sum([(F.col(c) <= DEFAULT.fdr).cast("int") for c in families], F.col("reaparece").cast("int")) > 0
    return x.agg(F.count("*").alias("hilos"), *[F.count_if(F.col(c) <= DEFAULT.fdr).alias(c[2:]) for c in families], F.count_if("reaparece").alias("reaparecen"), F.round(F.avg((~signal).cast("double")), 6).alias("sin_senal"))


def null_pseudo(spark: SparkSession, d: str, reps: int = DEFAULT.replicates) -> DataFrame:
    """Mean duration of size-matched random sets, by size."""
    sizes = threads(spark, d).where(F.col("n") >= DEFAULT.min_thread).select("n").distinct()
    x = X.pseudo_threads(_dated(spark, d).select("doc_id", "fecha"), sizes, reps, 20260732)
    dur = x.groupBy("n", "rep").agg(F.datediff(F.max("fecha"), F.min("fecha")).alias("dur"), F.count("*").alias("docs"))
    return dur.groupBy("n").agg(F.count("*").alias("sorteos"), F.min("docs").alias("docs"), F.round(F.avg("dur"), 6).alias("dur_media"))


def null_growth(spark: SparkSession, d: str, reps: int = DEFAULT.replicates) -> DataFrame:
    """Longest pause and span against threads grown at random over time: p and q by thread."""
    scratch = Scratch(spark, "growth")
    days = scratch.write(thread_days(spark, d))
    g = scratch.write(X.gaps(days, ["hilo"]).join(days.groupBy("hilo").agg(F.unix_date(F.min("fecha")).alias("primero")), "hilo"))
    calendar = sorted((r[0], r[1]) for r in _dated(spark, d).groupBy(F.unix_date("fecha")).count().collect())
    draws = scratch.write(X.grown_threads(g.select("hilo", F.col("docs").alias("n"), F.coalesce("p_largo", F.lit(0.0)).alias("largo"), "primero"), calendar, reps, 20260741))
    a = X.empirical_p(g, draws, ["hilo"], "max_gap").select("hilo", "max_gap", "sorteos", F.col("p_alto").alias("p_pausa"))
    b = X.empirical_p(g, draws, ["hilo"], "dur").select("hilo", "dur", F.col("p_bajo").alias("p_corto"))
    return _tested(a.join(b, "hilo"), [("p_pausa", "q_pausa"), ("p_corto", "q_corto")])


def stability_drop(spark: SparkSession, d: str, reps: int = DROPS) -> DataFrame:
    """Share of each thread's pairs that stay together when a tenth of the documents is dropped, over replicates; a
    thread is fragile if it keeps under half in a quarter of them."""
    scratch = Scratch(spark, "drop")
    e = scratch.write(edges(spark, d).where(P.accepted(F.lit(TAU))))
    ids = docs(spark, d).select("id")
    both = e.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    r = G.kept_pairs(scratch.write(both), scratch.write(G.components(e.select("a", "b"))), 10, reps, 5)
    r = r.groupBy(F.col("comp").alias("grupo")).agg(F.avg("recuperado").alias("media"), F.avg((F.col("recuperado") < 0.5).cast("double")).alias("bajo"))
    return r.select("grupo", F.round("media", 6).alias("media"), (F.col("bajo") >= 0.25).alias("fragil"))


def stability_jitter(spark: SparkSession, d: str, reps: int = DROPS) -> DataFrame:
    """Edges that stay when dates move by up to seven days, over replicates: shared, lost, and their Jaccard."""
    day = _dated(spark, d).select("doc_id", "fecha")
    e = edges(spark, d).join(day.select(F.col("doc_id").alias("a"), F.col("fecha").alias("fa")), "a").join(day.select(F.col("doc_id").alias("b"), F.col("fecha").alias("fb")), "b")
    # Replicates come after the joins: no join holds the documents once per replicate.
    j = e.select("a", "b", "fa", "fb", "w", "s_ref", P.accepted(F.lit(TAU)).alias("antes"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    fa, fb = (S.jitter(F.col("f" + c), 7, F.lit(9), F.col("rep"), F.col(c)) for c in "ab")
    j = j.withColumn("dias", F.abs(F.datediff(fa, fb)))
    now = (F.col("dias") > 0) & (F.col("dias") <= DEFAULT.far_days) & P.accepted(F.lit(TAU))
    x = j.groupBy("rep").agg(F.count_if(now & F.col("antes")).alias("comunes"), F.count_if(now | F.coalesce("antes", F.lit(False))).alias("todas"))
    return x.select("rep", "comunes", "todas", F.round(F.try_divide("comunes", "todas"), 6).alias("jaccard"))


QUERIES = {f.__name__: f for f in (
    thread_flagship, pair_frequencies, pair_scored, pair_bands, thread_members, thread_grid, thread_tau, thread_profiles, thread_far_share, thread_isolates,
    thread_tiers, thread_best_overlap, temporal_gaps, temporal_bursts, temporal_periods, temporal_thin_periods, temporal_sources,
    null_permuted, null_sizes, null_significant, null_pseudo, null_growth, stability_drop, stability_jitter,
)}

_ACC = "w >= {t} AND (dias <= 365 OR s_ref >= 0.5)"
_E45 = f"e45 AS (SELECT * FROM edges WHERE {_ACC.format(t=0.45)})"
_BASE = (Q.DOCS, Q.EDGES, _E45, Q.components("e45"), Q.THREADS)
_IDF = (
    f"freq AS (SELECT tipo, referente, count(DISTINCT doc_id) AS df, count(DISTINCT doc_id) > 400 AS hub, least(1.0::DOUBLE, ln({Q.DATED}::DOUBLE / count(DISTINCT doc_id)) / ln({Q.DATED}::DOUBLE / 5)) AS idf FROM refs GROUP BY ALL)"
)
_SCORED = (
    "r AS (SELECT refs.*, hub, idf FROM refs JOIN freq USING (tipo, referente) WHERE fecha IS NOT NULL), "
    "cand AS (SELECT DISTINCT x.doc_id AS doc_i, y.doc_id AS doc_j, abs(x.fecha - y.fecha)::INT AS dias FROM r x JOIN r y ON x.tipo = y.tipo AND x.referente = y.referente AND x.doc_id < y.doc_id WHERE NOT x.hub AND NOT y.hub AND abs(x.fecha - y.fecha) BETWEEN 1 AND 1095), "
    "kinds AS (SELECT doc_i, doc_j, dias, x.tipo, least(1.0::DOUBLE, sum(x.idf)) AS s FROM cand JOIN r x ON x.doc_id = doc_i JOIN r y ON y.doc_id = doc_j AND y.tipo = x.tipo AND y.referente = x.referente GROUP BY ALL), "
    "scored AS (SELECT * FROM (SELECT doc_i, doc_j, dias, coalesce(sum(s) FILTER (tipo = 'objeto'), 0) * 0.5::DOUBLE + coalesce(sum(s) FILTER (tipo = 'territorio'), 0) * 0.3::DOUBLE + coalesce(sum(s) FILTER (tipo = 'actor'), 0) * 0.2::DOUBLE AS s_ref FROM kinds GROUP BY ALL) WHERE s_ref > 0 AND NOT (dias > 365 AND s_ref < 0.5))"
)
_GRID = f"grid AS (SELECT tau, edges.* FROM edges, (VALUES (0.35::DOUBLE), (0.45::DOUBLE), (0.55::DOUBLE)) t(tau) WHERE {_ACC.format(t='tau')})"
_GSUM = (
    f"sizes AS (SELECT tau, comp, count(*) AS n FROM comps GROUP BY ALL), summary AS (SELECT tau, aristas, largas, hilos, hilos_3, mediana_3, cobertura_3, gigante, gigante <= 0.3 AS cabe "
    f"FROM (SELECT tau, count(*) AS aristas, count(*) FILTER (dias > 365) AS largas FROM grid GROUP BY 1) JOIN (SELECT tau, count(*) AS hilos, count(*) FILTER (n >= 3) AS hilos_3, median(n) FILTER (n >= 3) AS mediana_3, "
    f"sum(n) FILTER (n >= 3) / {Q.DATED} AS cobertura_3, max(n) / {Q.DATED} AS gigante FROM sizes GROUP BY 1) USING (tau))"
)
_top = lambda k: f"(SELECT string_agg(referente || ' (' || n || ')', '; ' ORDER BY r) FROM best b WHERE b.hilo = t.hilo AND tipo = '{k}')"


def _compare(name: str, other: str) -> str:
    return (
        f"SELECT '{name}' AS con, n AS docs, ka AS grupos_a, kb AS grupos_b, round(pa, 6) AS pares_a, round(pb, 6) AS pares_b, round(pab, 6) AS pares_ambos, round(pab / (pa + pb - pab), 6) AS jaccard, "
        f"round((pab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, round(2 * hab - ha - hb, 6) + 0 AS vi, round(pab / pa, 6) AS retencion "
        f"FROM (SELECT (SELECT sum(m)::BIGINT FROM c_{other}) AS n, (SELECT count(DISTINCT x) FROM c_{other}) AS ka, (SELECT count(DISTINCT y) FROM c_{other}) AS kb, (SELECT sum(m * (m - 1) / 2) FROM c_{other}) AS pab, "
        f"(SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c_{other} GROUP BY x)) AS pa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c_{other} GROUP BY y)) AS pb, "
        f"(SELECT -sum(m / t * ln(m / t)) FROM (SELECT m, sum(m) OVER () AS t FROM c_{other})) AS hab, (SELECT -sum(m / t * ln(m / t)) FROM (SELECT sum(m) AS m, sum(sum(m)) OVER () AS t FROM c_{other} GROUP BY x)) AS ha, "
        f"(SELECT -sum(m / t * ln(m / t)) FROM (SELECT sum(m) AS m, sum(sum(m)) OVER () AS t FROM c_{other} GROUP BY y)) AS hb)"
    )


def _cells(other: str) -> str:
    return f"c_{other} AS (SELECT comps.comp AS x, o.comp AS y, count(*) AS m FROM comps JOIN {other} o USING (doc_id) GROUP BY ALL)"


_DATED_DOCS = f"dated AS (SELECT id AS doc_id, {Q.day('fecha_iso')} AS fecha, lower(coalesce(fuente, 'desconocida')) AS fuente FROM docs WHERE {Q.day('fecha_iso')} IS NOT NULL)"
_GAPS = "g AS (SELECT *, fecha - lag(fecha) OVER w AS g, row_number() OVER w AS rn FROM days WINDOW w AS (PARTITION BY hilo ORDER BY fecha, doc_id))"
_quarter, _semester = "year(fecha) || '-Q' || quarter(fecha)", "year(fecha) || '-S' || ((month(fecha) - 1) // 6 + 1)"
_PERIOD = lambda n, p: f"{n} AS (SELECT hilo, max(m / total) AS parte FROM (SELECT hilo, {p} AS p, count(*) AS m FROM days GROUP BY ALL) JOIN (SELECT {p} AS p, count(*) AS total FROM dated GROUP BY 1) USING (p) GROUP BY 1)"
_REPS = DEFAULT.replicates
_BH = lambda name, src, p: (
    f"{name}0 AS (SELECT *, {p} * count(*) OVER () / row_number() OVER (ORDER BY {p}, hilo) AS q0 FROM {src}), "
    f"{name} AS (SELECT *, least(1.0::DOUBLE, min(q0) OVER (ORDER BY {p} DESC, hilo DESC ROWS UNBOUNDED PRECEDING)) AS q FROM {name}0)"
)
_BURST = lambda name, src, k: (
    f"{name}y AS (SELECT {k}, anio FROM (SELECT {k}, anio, row_number() OVER (PARTITION BY {k} ORDER BY m DESC, anio) AS r FROM (SELECT {k}, year(fecha) AS anio, count(*) AS m FROM {src} GROUP BY ALL)) WHERE r = 1), "
    f"{name}b AS (SELECT {k}, max(r) AS rafaga FROM (SELECT {k}, count(*) OVER (PARTITION BY {k} ORDER BY fecha RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS r FROM {src} JOIN {name}y USING ({k}) WHERE year(fecha) = anio) GROUP BY ALL), "
    f"{name}g AS (SELECT {k}, coalesce(max(g), 0)::BIGINT AS pausa FROM (SELECT {k}, fecha - lag(fecha) OVER (PARTITION BY {k}, year(fecha) ORDER BY fecha) AS g FROM {src}) GROUP BY ALL), "
    f"{name} AS (SELECT * FROM {name}b JOIN {name}g USING ({k}))"
)
_PERM = (
    f"primes AS (SELECT * FROM (VALUES {', '.join(f'({i}, {p}::BIGINT)' for i, p in enumerate(O.primes(_REPS), 1))}) v(rep, prime)), "
    "ra AS (SELECT year(fecha) AS anio, fuente, doc_id, row_number() OVER (PARTITION BY year(fecha), fuente ORDER BY md5('20260731a|' || doc_id), doc_id) - 1 AS k, count(*) OVER (PARTITION BY year(fecha), fuente) AS n FROM dated), "
    "rb AS (SELECT year(fecha) AS anio, fuente, fecha, row_number() OVER (PARTITION BY year(fecha), fuente ORDER BY md5('20260731b|' || doc_id), doc_id) - 1 AS k FROM dated), "
    "moved AS (SELECT days.hilo, rep, anio, fuente, (k * prime + ('0x' || substr(md5('20260731|' || rep || '|' || anio || '|' || fuente), 1, 8))::BIGINT) % n AS k FROM (SELECT hilo, doc_id FROM days) days JOIN ra USING (doc_id), primes), "
    "drawn AS (SELECT hilo || '/' || rep AS hr, fecha FROM moved JOIN rb USING (anio, fuente, k)), "
    + _BURST("nb", "drawn", "hr") + ", " + _BURST("rl", "days", "hilo") + ", "
    "pp AS (SELECT r.hilo, any_value(r.rafaga) AS rafaga, any_value(r.pausa) AS pausa, count(*) AS sorteos, (1 + count(*) FILTER (x.rafaga >= r.rafaga)) / (count(*) + 1) AS p_rafaga, (1 + count(*) FILTER (x.pausa >= r.pausa)) / (count(*) + 1) AS p_pausa FROM rl r JOIN nb x ON split_part(x.hr, '/', 1) = r.hilo GROUP BY 1), "
    + _BH("fa", "pp", "p_rafaga") + ", " + _BH("fb", "pp", "p_pausa")
    + ", n1 AS (SELECT fa.hilo, fa.rafaga, fa.pausa, fa.sorteos, round(fa.p_rafaga, 6) AS p_rafaga, round(fa.q, 6) AS q_rafaga, round(fb.p_pausa, 6) AS p_pausa, round(fb.q, 6) AS q_pausa FROM fa JOIN fb USING (hilo))"
)
_PSEUDO = (
    "pos AS (SELECT doc_id, fecha, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM dated), tot AS (SELECT count(*) AS t FROM dated), sz AS (SELECT DISTINCT n FROM threads WHERE n >= 3), "
    f"slots AS (SELECT n, rep, slot FROM sz, tot, (SELECT unnest(range(1, {_REPS + 1})) AS rep), LATERAL (SELECT unnest(range(1, (n + greatest(4, ceil(n * n / t) * 2))::BIGINT + 1)) AS slot)), "
    "hit AS (SELECT n, rep, ('0x' || substr(md5('20260732|' || n || '|' || rep || '|' || slot), 1, 8))::BIGINT % t AS pos, min(slot) AS slot FROM slots, tot GROUP BY ALL), "
    "pick AS (SELECT *, row_number() OVER (PARTITION BY n, rep ORDER BY slot) AS k FROM hit), "
    "pk AS (SELECT n, rep, fecha, pos.doc_id FROM pick JOIN pos USING (pos) WHERE k <= n), "
    "pd AS (SELECT n, rep, (max(fecha) - min(fecha))::INT AS dur, count(*) AS docs FROM pick JOIN pos USING (pos) WHERE k <= n GROUP BY ALL)"
)
_SIZES = (
    "zn AS (SELECT n, rep, max(g)::INT AS mg, (max(fecha) - min(fecha))::INT AS dur FROM (SELECT *, fecha - lag(fecha) OVER (PARTITION BY n, rep ORDER BY fecha, doc_id) AS g FROM pk) GROUP BY ALL), "
    + _GAPS + ", gm AS (SELECT hilo, max(g) AS mg FROM g GROUP BY 1), zr AS (SELECT hilo, count(*) AS n, any_value(mg)::INT AS mg, count(*) - min(rn) FILTER (g = mg) + 1 AS tras, (max(fecha) - min(fecha))::INT AS dur FROM g JOIN gm USING (hilo) GROUP BY 1), "
    "zp AS (SELECT r.hilo, any_value(r.mg) AS mg, any_value(r.tras) AS tras, any_value(r.dur) AS dur, count(*) AS sorteos, (1 + count(*) FILTER (x.mg >= r.mg)) / (count(*) + 1) AS p_pausa, (1 + count(*) FILTER (x.dur <= r.dur)) / (count(*) + 1) AS p_corto, (1 + count(*) FILTER (x.dur >= r.dur)) / (count(*) + 1) AS p_largo FROM zr r JOIN zn x ON x.n = r.n GROUP BY 1), "
    + _BH("za", "zp", "p_pausa") + ", " + _BH("zb", "zp", "p_corto") + ", " + _BH("zc", "zp", "p_largo")
    + ", n2 AS (SELECT za.hilo, za.mg AS max_gap, za.tras AS tras_gap, za.dur, za.sorteos, round(za.p_pausa, 6) AS p_pausa, round(za.q, 6) AS q_pausa, round(za.p_corto, 6) AS p_corto, round(zb.q, 6) AS q_corto, round(za.p_largo, 6) AS p_largo, round(zc.q, 6) AS q_largo, round(za.q, 6) <= 0.05 AND za.tras >= 3 AS reaparece FROM za JOIN zb USING (hilo) JOIN zc USING (hilo))"
)
ORACLE = {
    "thread_flagship": Q.query(Q.DOCS, Q.REFS, _IDF, _SCORED, "acc AS (SELECT doc_i AS a, doc_j AS b FROM scored WHERE s_ref >= 0.35 AND (dias <= 365 OR s_ref >= 0.5))", Q.components("acc"), Q.THREADS, "SELECT hilo, count(*) AS docs, min(fecha)::VARCHAR AS desde, max(fecha)::VARCHAR AS hasta FROM threads JOIN (SELECT DISTINCT doc_id, fecha FROM refs) r USING (doc_id) WHERE n >= 3 GROUP BY 1"),
    "pair_frequencies": Q.query(Q.DOCS, Q.REFS, _IDF, "SELECT tipo, referente, df, hub, round(idf, 6) AS idf FROM freq"),
    "pair_scored": Q.query(Q.DOCS, Q.REFS, _IDF, _SCORED, "SELECT doc_i, doc_j, dias, round(s_ref, 6) AS s_ref FROM scored"),
    "pair_bands": Q.query(Q.EDGES, "SELECT CASE WHEN w < 0.40 THEN 'rechazada' WHEN w < 0.45 THEN 'casi' WHEN w < 0.47 THEN 'apenas' ELSE 'segura' END AS banda, CASE WHEN dias > 365 THEN CASE WHEN s_ref >= 0.5 AND s_ref < 0.6 THEN 'larga_debil' ELSE 'larga' END ELSE 'corta' END AS tramo, count(*) AS aristas, round(avg(w), 6) AS w_medio FROM edges GROUP BY ALL"),
    "thread_members": Q.query(*_BASE, "SELECT hilo, doc_id, n FROM threads"),
    "thread_grid": Q.query(Q.DOCS, Q.EDGES, _GRID, Q.components("grid", keys="tau"), _GSUM, "SELECT tau, aristas, largas, hilos, hilos_3, mediana_3, round(cobertura_3, 6) AS cobertura_3, round(gigante, 6) AS gigante, cabe FROM summary"),
    "thread_tau": Q.query(Q.DOCS, Q.EDGES, _GRID, Q.components("grid", keys="tau"), _GSUM, "SELECT coalesce(min(tau) FILTER (cabe), max(tau)) AS tau FROM summary"),
    "thread_profiles": Q.query(Q.DOCS, Q.REFS, Q.EDGES, _E45, Q.components("e45"), Q.THREADS, "counts AS (SELECT hilo, tipo, referente, count(DISTINCT refs.doc_id) AS n FROM threads t JOIN refs ON refs.doc_id = t.doc_id WHERE t.n >= 3 GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hilo, tipo ORDER BY n DESC, referente) AS r FROM counts) WHERE r <= 3), base AS (SELECT hilo, count(DISTINCT threads.doc_id) AS docs, min(fecha) AS desde, max(fecha) AS hasta FROM threads LEFT JOIN (SELECT DISTINCT doc_id, fecha FROM refs) r ON r.doc_id = threads.doc_id WHERE n >= 3 GROUP BY 1)", f"SELECT hilo, docs, desde::VARCHAR AS desde, hasta::VARCHAR AS hasta, round((hasta - desde) / 365.25::DOUBLE, 6) AS anios, coalesce({_top('objeto')}, '') AS objeto, coalesce({_top('territorio')}, '') AS territorio, coalesce({_top('actor')}, '') AS actor FROM base t"),
    "thread_far_share": Q.query(*_BASE, "SELECT hilo, count(*) AS aristas, count(*) FILTER (dias > 365) AS largas, round(count(*) FILTER (dias > 365) / count(*), 6) AS parte_larga FROM e45 JOIN threads ON doc_id = a GROUP BY 1"),
    "thread_isolates": Q.query(*_BASE, f"SELECT id, {Q.day('fecha_iso')}::VARCHAR AS fecha FROM docs WHERE id NOT IN (SELECT doc_id FROM threads)"),
    "thread_tiers": Q.query(Q.EDGES, _E45, Q.components("e45"), "l1 AS (SELECT * FROM edges WHERE CASE WHEN dias > 365 THEN s_ref >= 0.5 ELSE w >= 0.45 AND (dias <= 365 OR s_ref >= 0.5) END)", Q.components("l1", "o1"), "l3 AS (SELECT * FROM edges WHERE w >= 0.45 AND (dias <= 365 OR s_ref >= 0.6))", Q.components("l3", "o3"), f"l5 AS (SELECT * FROM edges WHERE {_ACC.format(t=0.55)})", Q.components("l5", "o5"), _cells("o1"), _cells("o3"), _cells("o5"), " UNION ALL ".join(_compare(n, o) for n, o in (("L1", "o1"), ("L3", "o3"), ("tau_55", "o5")))),
    "thread_best_overlap": Q.query(Q.EDGES, _E45, Q.components("e45"), Q.THREADS, f"l5 AS (SELECT * FROM edges WHERE {_ACC.format(t=0.55)})", Q.components("l5", "o5"), Q.THREADS.replace("threads AS", "t5 AS").replace("comps", "o5"), "j AS (SELECT t.hilo, t5.hilo AS otro, count(*) AS m FROM threads t LEFT JOIN t5 USING (doc_id) GROUP BY ALL), k AS (SELECT *, sum(m) OVER (PARTITION BY hilo)::BIGINT AS docs, row_number() OVER (PARTITION BY hilo ORDER BY otro IS NULL, m DESC, otro) AS r FROM j)", "SELECT hilo, docs, otro, CASE WHEN otro IS NULL THEN 0 ELSE m END AS comunes FROM k WHERE r = 1"),
    "temporal_gaps": Q.query(*_BASE, Q.DAYS, _GAPS, "m AS (SELECT hilo, max(g) AS mg FROM g GROUP BY 1)", "SELECT hilo, count(*) AS docs, any_value(mg)::INT AS max_gap, count(*) - min(rn) FILTER (g = mg) + 1 AS tras_gap, round(avg((g > 365)::INT), 6) AS p_largo, (max(fecha) - min(fecha))::INT AS dur FROM g JOIN m USING (hilo) GROUP BY 1"),
    "temporal_bursts": Q.query(*_BASE, Q.DAYS, "y AS (SELECT hilo, anio FROM (SELECT hilo, anio, row_number() OVER (PARTITION BY hilo ORDER BY m DESC, anio) AS r FROM (SELECT hilo, year(fecha) AS anio, count(*) AS m FROM days GROUP BY ALL)) WHERE r = 1), k AS (SELECT d.hilo, y.anio, d.doc_id, count(*) AS r FROM days d JOIN y ON y.hilo = d.hilo AND year(d.fecha) = y.anio JOIN days e ON e.hilo = d.hilo AND year(e.fecha) = y.anio AND e.fecha BETWEEN d.fecha - 30 AND d.fecha GROUP BY ALL)", "SELECT hilo, anio::INT AS anio, max(r) AS rafaga FROM k GROUP BY ALL"),
    "temporal_periods": Q.query(*_BASE, Q.DAYS, _DATED_DOCS, _PERIOD("pq", _quarter), _PERIOD("ps", _semester), "SELECT hilo, round(pq.parte, 6) AS trimestre, round(ps.parte, 6) AS semestre FROM pq JOIN ps USING (hilo)"),
    "temporal_thin_periods": Q.query(Q.DOCS, _DATED_DOCS, f"SELECT {_quarter} AS trimestre, count(*) AS docs FROM dated GROUP BY 1 HAVING count(*) < 50"),
    "temporal_sources": Q.query(*_BASE, Q.DAYS, "s AS (SELECT hilo, fuente, count(*) AS m FROM days JOIN docs ON id = doc_id WHERE fuente IS NOT NULL GROUP BY ALL)", "SELECT hilo, count(*) AS fuentes, round(max(m) / sum(m), 6) AS mayor_fuente FROM s GROUP BY 1"),
    "null_permuted": Q.query(*_BASE, Q.DAYS, _DATED_DOCS, _PERM, "SELECT * FROM n1"),
    "null_sizes": Q.query(*_BASE, Q.DAYS, _DATED_DOCS, _PSEUDO.replace("sz AS (SELECT DISTINCT n FROM threads WHERE n >= 3)", "sz AS (SELECT DISTINCT count(*) AS n FROM days GROUP BY hilo)"), _SIZES, "SELECT * FROM n2"),
    "null_significant": Q.query(*_BASE, Q.DAYS, _DATED_DOCS, _PERM, _PSEUDO.replace("sz AS (SELECT DISTINCT n FROM threads WHERE n >= 3)", "sz AS (SELECT DISTINCT count(*) AS n FROM days GROUP BY hilo)"), _SIZES, "SELECT count(*) AS hilos, count(*) FILTER (q_rafaga <= 0.05) AS rafaga, count(*) FILTER (n1.q_pausa <= 0.05) AS pausa_anual, count(*) FILTER (n2.q_pausa <= 0.05) AS pausa, count(*) FILTER (q_corto <= 0.05) AS corto, count(*) FILTER (q_largo <= 0.05) AS largo, count(*) FILTER (reaparece) AS reaparecen, round(avg((q_rafaga > 0.05 AND n1.q_pausa > 0.05 AND n2.q_pausa > 0.05 AND q_corto > 0.05 AND q_largo > 0.05 AND NOT reaparece)::INT), 6) AS sin_senal FROM n1 JOIN n2 USING (hilo)"),
    "null_pseudo": Q.query(*_BASE, _DATED_DOCS, _PSEUDO, "SELECT n, count(*) AS sorteos, min(docs) AS docs, round(avg(dur), 6) AS dur_media FROM pd GROUP BY 1"),
    "stability_drop": Q.query(Q.DOCS, Q.EDGES, _E45, Q.components("e45"), "kept AS (SELECT id AS doc_id, rep FROM docs, (SELECT unnest(range(1, 21)) AS rep) WHERE ('0x' || substr(md5('5|' || rep || '|' || id), 1, 8))::BIGINT % 100 >= 10), sub AS (SELECT k.rep, a, b FROM e45 JOIN kept k ON k.doc_id = a JOIN kept l ON l.doc_id = b AND l.rep = k.rep)", Q.components("sub", "again", "rep"), "size AS (SELECT comp, count(*) AS n FROM comps GROUP BY 1), cell AS (SELECT rep, c.comp, x.comp AS y, count(*) AS m FROM comps c JOIN again x USING (doc_id) GROUP BY ALL), rec AS (SELECT rep, comp, sum(m * (m - 1) / 2) / any_value(n * (n - 1) / 2) AS r FROM cell JOIN size USING (comp) GROUP BY ALL)", "SELECT comp AS grupo, round(avg(r), 6) AS media, avg((r < 0.5)::INT) >= 0.25 AS fragil FROM rec GROUP BY 1"),
    "stability_jitter": Q.query(Q.DOCS, Q.EDGES, _DATED_DOCS, "mv AS (SELECT doc_id, rep, fecha + (('0x' || substr(md5('9|' || rep || '|' || doc_id), 1, 8))::BIGINT % 15 - 7)::INT AS fecha FROM dated, (SELECT unnest(range(1, 21)) AS rep)), j AS (SELECT x.rep, e.dias AS d0, e.w, e.s_ref, abs(x.fecha - y.fecha) AS dias FROM edges e JOIN mv x ON x.doc_id = a JOIN mv y ON y.doc_id = b AND x.rep = y.rep), f AS (SELECT rep, w >= 0.45 AND dias BETWEEN 1 AND 1095 AND (dias <= 365 OR s_ref >= 0.5) AS now, w >= 0.45 AND (d0 <= 365 OR s_ref >= 0.5) AS antes FROM j)", "SELECT rep, count(*) FILTER (now AND antes) AS comunes, count(*) FILTER (now OR antes) AS todas, round(count(*) FILTER (now AND antes) / count(*) FILTER (now OR antes), 6) AS jaccard FROM f GROUP BY 1"),
}
