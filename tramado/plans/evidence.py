"""Queries on what lies behind links: families, shared referents, weights with vectors, errors by stratum, pools of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..functions.text import token_jaccard
from ..operators import corpus as C
from ..operators import graph as G
from ..operators import pairs as P
from ..operators import sampling as M
from ..operators.order import places
from ..sources.tables import Scratch, table
from . import sql as Q
from . import threads as H
from .corpus import _family, docs
from .review import _FINAL, _final, _tok, _w
from .threads import _BASE, _E45, _IDF, _SCORED, TAU, edges, frequencies, threads
from .topology import _BRIDGES, _C, accepted

POOLS = (("puente", 20), ("largo", 20), ("intra", 40), ("inter", 40))
LOOSE = 0.05


def thread_families(spark: SparkSession, d: str) -> DataFrame:
    """The procedure families of each thread's documents; ``otro`` is none."""
    fam = C.records(docs(spark, d)).select("doc_id", "familia")
    t = threads(spark, d).where("n >= 3").join(fam, "doc_id", "left")
    named = F.when(F.col("familia") != "otro", F.col("familia"))
    return t.groupBy("hilo").agg(F.count("*").alias("docs"), F.count_distinct(named).alias("familias"), F.concat_ws(";", F.array_sort(F.collect_set(named))).alias("nombres"))


def thread_family_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of families per thread, and the share of threads with two or more."""
    x = thread_families(spark, d)
    return x.agg(F.count("*").alias("hilos"), F.round(F.avg("familias"), 6).alias("media"), F.round(F.avg((F.col("familias") >= 2).cast("double")), 6).alias("multifamilia"))


def thread_moved(spark: SparkSession, d: str) -> DataFrame:
    """Documents of threads at the working threshold that are in no thread at the highest one."""
    now, then = threads(spark, d).where("n >= 3").select("doc_id", "hilo"), threads(spark, d, 0.55).where("n >= 3").select("doc_id")
    return now.join(then, "doc_id", "left_anti")


def thread_order(spark: SparkSession, d: str) -> DataFrame:
    """Dated documents of each thread in order of day, then of id."""
    x = places(H.thread_days(spark, d).select("hilo", "doc_id", "fecha"), ["hilo"], [F.col("fecha"), F.col("doc_id")], "k", "m")
    return x.select("hilo", "doc_id", F.col("fecha").cast("string").alias("fecha"), (F.col("k") + 1).alias("orden"))


def sample_isolates(spark: SparkSession, d: str) -> DataFrame:
    """Twenty documents in no thread."""
    return M.simple(H.thread_isolates(spark, d).select("id"), 20, 41, "id")


def subthread_signed(spark: SparkSession, d: str) -> DataFrame:
    """Assigned documents with the signature, project and territory, of their node; empty without one."""
    a = table(spark, d, "node_subhilo_assignment").where("doc_id is not null and subhilo_primario is not null and not coalesce(abstuvo, false)").groupBy("doc_id").agg(F.min("subhilo_primario").alias("subhilo"))
    s = table(spark, d, "h0000_02_node_metrics").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.concat_ws("|", "objeto", "territorio")).alias("firma"))
    return a.join(s, "doc_id", "left").select("doc_id", "subhilo", F.coalesce("firma", F.lit("")).alias("firma"))


def graph_shared(spark: SparkSession, d: str) -> DataFrame:
    """How many referents the ends of an accepted edge share, and the highest anchor weight among them."""
    r, f = frequencies(spark, d)
    r = r.join(f.select("tipo", "referente", "idf"), ["tipo", "referente"])
    e = edges(spark, d).where(P.accepted(F.lit(TAU))).select("a", "b")
    j = e.join(r.select(F.col("doc_id").alias("a"), "tipo", "referente", "idf"), "a").join(r.select(F.col("doc_id").alias("b"), "tipo", "referente"), ["b", "tipo", "referente"])
    s = j.groupBy("a", "b").agg(F.count("*").alias("compartidos"), F.max("idf").alias("idf"))
    return e.join(s, ["a", "b"], "left").select("a", "b", F.coalesce("compartidos", F.lit(0)).cast("long").alias("compartidos"), F.round("idf", 6).alias("idf_max"))


def pair_plain(spark: SparkSession, d: str) -> DataFrame:
    """Candidate pairs scored by plain Jaccard of referents instead of anchored sums."""
    r, f = frequencies(spark, d)
    return P.scored_pairs(r, f, plain=True).select("doc_i", "doc_j", "dias", F.round("s_ref", 6).alias("s_ref"))


def pair_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs whose documents both have a vector, with the cosine and the combined weight."""
    r, f = frequencies(spark, d)
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.col("embedding").alias("v"))
    x = P.scored_pairs(r, f, vectors=v)
    return x.select("doc_i", "doc_j", "dias", *[F.round(c, 6).alias(c) for c in ("s_ref", "s_emb", "w")])


def agreement_errors(spark: SparkSession, d: str) -> DataFrame:
    """Final verdicts by stratum and link, with totals: counts per verdict, the share of one process among the decided,
    with its interval, and among all. Without a link that share is the rate of missed links."""
    x = _final(spark, d).where("final is not null").select(F.coalesce("estrato", F.lit("sin_dato")).alias("e"), F.coalesce(F.col("directa").cast("string"), F.lit("sin_dato")).alias("l"), "final")
    cells = F.explode(F.array(*[F.struct(a.alias("estrato"), b.alias("enlace")) for a in (F.col("e"), F.lit("TOTAL")) for b in (F.col("l"), F.lit("TOTAL"))])).alias("c")
    n = x.groupBy("e", "l", "final").agg(F.count("*").alias("n")).select("final", "n", cells)
    of = lambda k: F.sum(F.when(F.col("final") == k, F.col("n")).otherwise(0))
    g = n.groupBy("c.estrato", "c.enlace").agg(F.sum("n").alias("casos"), of("mismo_proceso_especifico").alias("mismo"), of("mismo_macroproceso").alias("macro"), of("relacionado_tematicamente").alias("relacionado"), of("no_relacionado").alias("no_relacionado"), of("indeterminado").alias("indeterminado"))
    decided = F.col("casos") - F.col("indeterminado")
    low, high = S.wilson(F.col("mismo"), F.nullif(decided, F.lit(0)))
    return g.select("*", F.round(F.try_divide(F.col("mismo"), decided), 6).alias("tasa"), F.round(low, 6).alias("tasa_baja"), F.round(high, 6).alias("tasa_alta"), F.round(F.col("mismo") / F.col("casos"), 6).alias("tasa_todos"))


def _communities_of(spark: SparkSession, d: str) -> DataFrame:
    """The communities in the node table by document; empty and negative labels are none."""
    x = table(spark, d, "h0000_02_node_metrics").where("doc_id is not null")
    valid = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin("", "-1"), F.col(c))
    return x.groupBy("doc_id").agg(F.min(valid("comunidad_louvain")).alias("lou"), F.min(valid("comunidad_infomap")).alias("inf"))


def agreement_links(spark: SparkSession, d: str) -> DataFrame:
    """What is known of the link of each reviewed pair, looked up in either order (``dias`` -1 without a link or its days),
    and whether its documents are known to be in one community."""
    x = table(spark, d, "intermediate_merged_cases").select("case_id", F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).where("a is not null and b is not null").distinct()
    c = _communities_of(spark, d)
    j = x.join(edges(spark, d).select("a", "b", "w", "dias"), ["a", "b"], "left")
    for k in "ab":
        j = j.join(c.select(F.col("doc_id").alias(k), F.col("lou").alias("l" + k), F.col("inf").alias("i" + k)), k, "left")
    return j.select("case_id", "a", "b", F.col("w").isNotNull().alias("enlace"), F.round("w", 6).alias("w"), F.coalesce("dias", F.lit(-1)).alias("dias"), F.coalesce(F.col("la") == F.col("lb"), F.lit(False)).alias("intra_louvain"), F.coalesce(F.col("ia") == F.col("ib"), F.lit(False)).alias("intra_infomap"))


def sample_pools(spark: SparkSession, d: str) -> DataFrame:
    """A sample from four pools of pairs, none twice: bridges, long edges with few common neighbours, edges inside a
    community, and pairs of different communities at most two steps apart. A pair of several pools counts for the first.

    Two-step pairs are not listed: around each document its neighbours, in random order, are taken two by two, so the pool
    is no larger than the edges."""
    scratch = Scratch(spark, "pools")
    e, c = accepted(spark, d)
    com = scratch.write(_communities_of(spark, d).where("lou is not null").select("doc_id", F.col("lou").alias("g")))
    both = lambda p: p.join(com.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")), "a").join(com.select(F.col("doc_id").alias("b"), F.col("g").alias("gb")), "b")
    pair = lambda p, name: p.select("a", "b", F.lit([k for k, _ in POOLS].index(name)).alias("p"))
    near = both(e.select("a", "b"))
    around = M.ranked(G.both_ways(e).select("doc_id", "other"), "doc_id", 31, "doc_id", "other")
    two = around.groupBy("doc_id", F.floor((F.col("k") - 1) / 2).alias("r")).agg(F.min("other").alias("a"), F.max("other").alias("b")).where("a < b").select("a", "b").distinct()
    two = two.join(e.select("a", "b"), ["a", "b"], "left_anti")
    loose = G.edge_features(e).where(F.col("incrustacion") <= LOOSE).select("a", "b").join(e.where("dias > 365").select("a", "b"), ["a", "b"])
    pools = pair(G.bridges(e, c), "puente").union(pair(loose, "largo")).union(pair(near.where("ga = gb"), "intra")).union(pair(near.where("ga <> gb"), "inter")).union(pair(both(two).where("ga <> gb"), "inter"))
    one = scratch.write(pools.groupBy("a", "b").agg(F.min("p").alias("p")))
    size = F.element_at(F.array(*[F.lit(k) for _, k in POOLS]), F.col("p") + 1)
    name = F.element_at(F.array(*[F.lit(n) for n, _ in POOLS]), F.col("p") + 1)
    return M.stratified(one.withColumn("size", size), "p", F.col("size"), 32, "a", "b").select(name.alias("grupo"), "a", "b")


def sample_subthread_pairs(spark: SparkSession, d: str, size: int = 30) -> DataFrame:
    """Pairs of documents of one subthread, of different subthreads of one macrothread, and of a macrothread where one
    abstained: ``size`` of each, evenly from the thirds of how alike their titles are; where a third has too few, the
    others fill up by their next ranks.

    Pairs of a group aren't listed: its documents, in random order, are taken two by two."""
    scratch = Scratch(spark, "subpairs")
    x = table(spark, d, "node_subhilo_assignment").where("doc_id is not null and macrohilo_id is not null").groupBy("doc_id").agg(F.min("macrohilo_id").alias("m"), F.min("subhilo_primario").alias("s"), F.max(F.coalesce("abstuvo", F.lit(False))).alias("abs"))
    x = scratch.write(x.withColumn("s", F.when(~F.col("abs"), F.col("s"))))
    sure = x.where("s is not null")

    def two(df: DataFrame, key: Column, seed: int, name: str, keep: str) -> DataFrame:
        r = M.ranked(df.withColumn("key", key), "key", seed, "doc_id").withColumn("r", F.floor((F.col("k") - 1) / 2))
        one, other = (F.min_by(F.struct("doc_id", "s", "abs"), "k").alias("x"), F.max_by(F.struct("doc_id", "s", "abs"), "k").alias("y"))
        p = r.groupBy("key", "r").agg(one, other, F.count("*").alias("n")).where("n = 2").where(keep)
        return p.select(F.lit(name).alias("grupo"), F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    pairs = two(sure, F.concat_ws("|", "m", "s"), 51, "intra", "true").union(two(sure, F.col("m"), 52, "inter", "x.s <> y.s")).union(two(x, F.col("m"), 53, "abstencion", "x.abs <> y.abs"))
    title = docs(spark, d).select(F.col("id").alias("doc_id"), "titulo")
    j = pairs.join(title.select(F.col("doc_id").alias("a"), F.col("titulo").alias("ta")), "a").join(title.select(F.col("doc_id").alias("b"), F.col("titulo").alias("tb")), "b")
    j = scratch.write(j.select("grupo", "a", "b", F.coalesce(F.round(token_jaccard(F.col("ta"), F.col("tb")), 6), F.lit(0.0)).alias("s")))
    j = places(j, ["grupo"], [F.col("s"), F.col("a"), F.col("b")], "k", "n").withColumn("tercio", F.floor(F.col("k") * 3 / F.col("n")).cast("int"))
    first = M.stratified(j.withColumn("cell", F.concat_ws("|", "grupo", "tercio")), "cell", size, 54, "a", "b")
    rank = F.row_number().over(W.partitionBy("grupo", "tercio").orderBy(M.ticket(54, "a", "b"), "a", "b"))
    filled = F.row_number().over(W.partitionBy("grupo").orderBy("rank", "tercio"))
    return first.withColumn("rank", rank).withColumn("f", filled).where(F.col("f") <= size).select("grupo", "a", "b", "tercio")


QUERIES = {f.__name__: f for f in (
    thread_families, thread_family_summary, thread_moved, thread_order, sample_isolates, subthread_signed, graph_shared, pair_plain, pair_weighted, agreement_errors, agreement_links, sample_pools, sample_subthread_pairs,
)}

_FAM = f"fm AS (SELECT id AS doc_id, {_family('llm_contentious_action_type')} AS familia FROM docs), tf AS (SELECT hilo, count(*) AS docs, count(DISTINCT familia) FILTER (familia <> 'otro') AS familias, coalesce(string_agg(DISTINCT familia, ';' ORDER BY familia) FILTER (familia <> 'otro'), '') AS nombres FROM threads LEFT JOIN fm USING (doc_id) WHERE n >= 3 GROUP BY 1)"
_PLAIN = (
    "r AS (SELECT refs.*, hub FROM refs JOIN freq USING (tipo, referente) WHERE fecha IS NOT NULL), own AS (SELECT doc_id, tipo, count(*) AS n FROM r GROUP BY ALL), "
    "cand AS (SELECT DISTINCT x.doc_id AS doc_i, y.doc_id AS doc_j, abs(x.fecha - y.fecha)::INT AS dias FROM r x JOIN r y ON x.tipo = y.tipo AND x.referente = y.referente AND x.doc_id < y.doc_id WHERE NOT x.hub AND abs(x.fecha - y.fecha) BETWEEN 1 AND 1095), "
    "sh AS (SELECT doc_i, doc_j, dias, x.tipo, count(*) AS m FROM cand JOIN r x ON x.doc_id = doc_i JOIN r y ON y.doc_id = doc_j AND y.tipo = x.tipo AND y.referente = x.referente GROUP BY ALL), "
    "kd AS (SELECT sh.*, m / (p.n + q.n - m) AS s FROM sh JOIN own p ON p.doc_id = doc_i AND p.tipo = sh.tipo JOIN own q ON q.doc_id = doc_j AND q.tipo = sh.tipo), "
    "sc AS (SELECT doc_i, doc_j, dias, coalesce(sum(s) FILTER (tipo = 'objeto'), 0) * 0.5::DOUBLE + coalesce(sum(s) FILTER (tipo = 'territorio'), 0) * 0.3::DOUBLE + coalesce(sum(s) FILTER (tipo = 'actor'), 0) * 0.2::DOUBLE AS s_ref FROM kd GROUP BY ALL)"
)
_COM = "cm AS (SELECT doc_id, min(comunidad_louvain) FILTER (comunidad_louvain::VARCHAR NOT IN ('', '-1')) AS lou, min(comunidad_infomap) FILTER (comunidad_infomap::VARCHAR NOT IN ('', '-1')) AS inf FROM h0000_02_node_metrics WHERE doc_id IS NOT NULL GROUP BY 1)"
_POOLS = (
    "od AS (SELECT v, x, row_number() OVER (PARTITION BY v ORDER BY md5('31|' || v || '|' || x), v, x) - 1 AS k FROM s), "
    "two AS (SELECT DISTINCT a, b FROM (SELECT min(x) AS a, max(x) AS b FROM od GROUP BY v, k // 2) WHERE a < b AND (a, b) NOT IN (SELECT (a, b) FROM e45)), "
    "gd AS (SELECT v, count(*) AS g FROM s GROUP BY 1), cn AS (SELECT a, b, count(q.x) AS k FROM e45 JOIN s p ON p.v = a LEFT JOIN s q ON q.v = b AND q.x = p.x GROUP BY ALL), "
    f"ls AS (SELECT cn.a, cn.b FROM cn JOIN e45 USING (a, b) JOIN gd x ON x.v = cn.a JOIN gd y ON y.v = cn.b WHERE dias > 365 AND k / greatest(1, x.g - 1 + y.g - 1 - k) <= {LOOSE}), "
    "nr AS (SELECT a, b, x.lou AS ga, y.lou AS gb FROM (SELECT a, b, 1 AS e FROM e45 UNION ALL SELECT a, b, 0 FROM two) JOIN cm x ON x.doc_id = a JOIN cm y ON y.doc_id = b WHERE e = 1 OR x.lou <> y.lou), "
    "pl AS (SELECT a, b, min(p) AS p FROM (SELECT a, b, 0 AS p FROM br UNION ALL SELECT a, b, 1 FROM ls UNION ALL SELECT a, b, CASE WHEN ga = gb THEN 2 ELSE 3 END FROM nr WHERE ga IS NOT NULL AND gb IS NOT NULL) GROUP BY ALL)"
)
_EMB = "vc AS (SELECT vec_id::VARCHAR AS doc_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_SIM = f"CASE WHEN len({_tok('x.titulo')}) > 0 AND len({_tok('y.titulo')}) > 0 THEN len(list_intersect({_tok('x.titulo')}, {_tok('y.titulo')}))::DOUBLE / len(list_distinct(list_concat({_tok('x.titulo')}, {_tok('y.titulo')}))) ELSE 0.0::DOUBLE END"
_two = lambda name, src, key, seed, keep: (
    f"SELECT '{name}' AS grupo, least(p.doc_id, q.doc_id) AS a, greatest(p.doc_id, q.doc_id) AS b FROM "
    f"(SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY md5('{seed}|' || doc_id), doc_id) - 1 AS k FROM {src}) p JOIN "
    f"(SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY md5('{seed}|' || doc_id), doc_id) - 1 AS k FROM {src}) q ON q.key = p.key AND q.k = p.k + 1 AND p.k % 2 = 0 WHERE {keep}"
)
_SUBPAIRS = (
    "x0 AS (SELECT doc_id, min(macrohilo_id) AS m, CASE WHEN NOT max(coalesce(abstuvo, false)) THEN min(subhilo_primario) END AS s, max(coalesce(abstuvo, false)) AS abs FROM node_subhilo_assignment WHERE doc_id IS NOT NULL AND macrohilo_id IS NOT NULL GROUP BY 1), x1 AS (SELECT * FROM x0 WHERE s IS NOT NULL), "
    f"pr AS ({_two('intra', 'x1', chr(39).join(['m || ', '|', ' || s']), 51, 'true')} UNION ALL {_two('inter', 'x1', 'm', 52, 'p.s <> q.s')} UNION ALL {_two('abstencion', 'x0', 'm', 53, 'p.abs <> q.abs')}), "
    f"sm AS (SELECT grupo, a, b, round({_SIM}, 6) AS s FROM pr JOIN docs x ON x.id = a JOIN docs y ON y.id = b), "
    "tc AS (SELECT *, ((row_number() OVER (PARTITION BY grupo ORDER BY s, a, b) - 1) * 3 // count(*) OVER (PARTITION BY grupo))::INT AS tercio FROM sm), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY grupo, tercio ORDER BY md5('54|' || a || '|' || b), a, b) AS r FROM tc), fl AS (SELECT *, row_number() OVER (PARTITION BY grupo ORDER BY r, tercio) AS f FROM rk)"
)
ORACLE = {
    "sample_subthread_pairs": Q.query(Q.DOCS, _SUBPAIRS, "SELECT grupo, a, b, tercio FROM fl WHERE f <= 30"),
    "thread_families": Q.query(*_BASE, _FAM, "SELECT hilo, docs, familias, nombres FROM tf"),
    "thread_family_summary": Q.query(*_BASE, _FAM, "SELECT count(*) AS hilos, round(avg(familias), 6) AS media, round(avg((familias >= 2)::INT), 6) AS multifamilia FROM tf"),
    "thread_moved": Q.query(*_BASE, "l5 AS (SELECT * FROM edges WHERE w >= 0.55 AND (dias <= 365 OR s_ref >= 0.5))", Q.components("l5", "o5"), "big AS (SELECT comp FROM o5 GROUP BY 1 HAVING count(*) >= 3)", "SELECT doc_id, hilo FROM threads WHERE n >= 3 AND doc_id NOT IN (SELECT doc_id FROM o5 JOIN big USING (comp))"),
    "thread_order": Q.query(*_BASE, Q.DAYS, "SELECT hilo, doc_id, fecha::VARCHAR AS fecha, row_number() OVER (PARTITION BY hilo ORDER BY fecha, doc_id) AS orden FROM days"),
    "sample_isolates": Q.query(*_BASE, "SELECT id FROM docs WHERE id NOT IN (SELECT doc_id FROM threads) ORDER BY md5('41|' || id), id LIMIT 20"),
    "subthread_signed": "WITH a AS (SELECT doc_id, min(subhilo_primario) AS subhilo FROM node_subhilo_assignment WHERE doc_id IS NOT NULL AND subhilo_primario IS NOT NULL AND NOT coalesce(abstuvo, false) GROUP BY 1), s AS (SELECT doc_id, min(concat_ws('|', objeto, territorio)) AS firma FROM h0000_02_node_metrics WHERE doc_id IS NOT NULL GROUP BY 1) SELECT a.doc_id, subhilo, coalesce(firma, '') AS firma FROM a LEFT JOIN s USING (doc_id)",
    "graph_shared": Q.query(Q.DOCS, Q.REFS, Q.EDGES, _E45, _IDF, "j AS (SELECT a, b, count(*) AS k, max(idf) AS m FROM e45 JOIN refs x ON x.doc_id = a JOIN refs y ON y.doc_id = b AND y.tipo = x.tipo AND y.referente = x.referente JOIN freq f ON f.tipo = x.tipo AND f.referente = x.referente GROUP BY ALL)", "SELECT e45.a, e45.b, coalesce(k, 0)::BIGINT AS compartidos, round(m, 6) AS idf_max FROM e45 LEFT JOIN j USING (a, b)"),
    "pair_plain": Q.query(Q.DOCS, Q.REFS, _IDF, _PLAIN, "SELECT doc_i, doc_j, dias, round(s_ref, 6) AS s_ref FROM sc WHERE s_ref > 0 AND NOT (dias > 365 AND s_ref < 0.5)"),
    "pair_weighted": Q.query(Q.DOCS, Q.REFS, _IDF, _SCORED, _EMB, "x AS (SELECT scored.*, list_sum(list_transform(list_zip(p.v, q.v), lambda z: z[1] * z[2])) AS e FROM scored JOIN vc p ON p.doc_id = doc_i JOIN vc q ON q.doc_id = doc_j)", "SELECT doc_i, doc_j, dias, round(s_ref, 6) AS s_ref, round(e, 6) AS s_emb, round(0.7::DOUBLE * s_ref + 0.3::DOUBLE * e, 6) AS w FROM x"),
    "agreement_errors": Q.query(Q.CASES, _FINAL, "g AS (SELECT coalesce(estrato, 'sin_dato') AS e, coalesce(directa::VARCHAR, 'sin_dato') AS l, final FROM fin WHERE final IS NOT NULL), z AS (SELECT coalesce(e, 'TOTAL') AS estrato, coalesce(l, 'TOTAL') AS enlace, count(*) AS casos, count(*) FILTER (final = 'mismo_proceso_especifico') AS k, count(*) FILTER (final = 'mismo_macroproceso') AS macro, count(*) FILTER (final = 'relacionado_tematicamente') AS relacionado, count(*) FILTER (final = 'no_relacionado') AS no_relacionado, count(*) FILTER (final = 'indeterminado') AS indeterminado, nullif(count(*) FILTER (final <> 'indeterminado'), 0) AS n FROM g GROUP BY CUBE (e, l))", f"SELECT estrato, enlace, casos, k AS mismo, macro, relacionado, no_relacionado, indeterminado, round(k / n, 6) AS tasa, {_w('-')} AS tasa_baja, {_w('+')} AS tasa_alta, round(k / casos, 6) AS tasa_todos FROM z"),
    "agreement_links": Q.query(Q.EDGES, _COM, "x AS (SELECT DISTINCT case_id, least(doc_a, doc_b) AS a, greatest(doc_a, doc_b) AS b FROM intermediate_merged_cases WHERE doc_a IS NOT NULL AND doc_b IS NOT NULL)", "SELECT case_id, x.a, x.b, w IS NOT NULL AS enlace, round(w, 6) AS w, coalesce(dias, -1)::INT AS dias, coalesce(p.lou = q.lou, false) AS intra_louvain, coalesce(p.inf = q.inf, false) AS intra_infomap FROM x LEFT JOIN edges e ON e.a = x.a AND e.b = x.b LEFT JOIN cm p ON p.doc_id = x.a LEFT JOIN cm q ON q.doc_id = x.b"),
    "sample_pools": Q.query(*_C, _BRIDGES, _COM, _POOLS, "rk AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY md5('32|' || a || '|' || b), a, b) AS r FROM pl)", "SELECT ['puente', 'largo', 'intra', 'inter'][p + 1] AS grupo, a, b FROM rk WHERE r <= [20, 20, 40, 40][p + 1]"),
}
