"""Queries on reviewed pairs, samples and subthreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import token_jaccard
from ..operators import agreement as A
from ..operators import corpus as C
from ..operators import graph as G
from ..operators import pairs as P
from ..operators import sampling as M
from ..operators import subthreads as B
from ..sources.tables import table
from . import sql as Q
from .corpus import docs
from .threads import TAU, edges, threads


def cases(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "intermediate_merged_cases")
    return x.select("case_id", "doc_a", "doc_b", "estrato", "detalle", F.col("tiene_arista_directa").alias("directa"), A.label(F.col("decision_gpt")).alias("a"), A.label(F.col("decision_claude")).alias("b"), A.label(F.col("decision_arbitro")).alias("arb")).distinct()


def agreement_confusion(spark: SparkSession, d: str) -> DataFrame:
    return A.confusion(cases(spark, d), "a", "b")


def agreement_kappa(spark: SparkSession, d: str) -> DataFrame:
    k = A.kappa(cases(spark, d), "a", "b")
    return k.select("casos", *[F.round(c, 6).alias(c) for c in ("acuerdo", "azar", "kappa")])


def _final(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).withColumn("final", A.final_decision(F.col("a"), F.col("b"), F.col("arb")))


def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    """Strict, broad and thematic shares of final decisions by stratum, detail and link."""
    x = A.rates(_final(spark, d), "final", ["estrato", "detalle", "directa"])
    return x.select("grupo", "valor", "casos", *[F.round(c, 6).alias(c) for c in ("estricto", "estricto_bajo", "estricto_alto", "amplio", "tematico")])


def agreement_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return A.disagreements(cases(spark, d), "a", "b")


def agreement_arbitration(spark: SparkSession, d: str) -> DataFrame:
    x = cases(spark, d)
    kind = A.disagreement_kind(F.col("a"), F.col("b"), F.col("detalle") == "louvain")
    return x.where("a <> b").groupBy(kind.alias("motivo"), A.arbitration(F.col("a"), F.col("b"), F.col("arb")).alias("arbitraje")).agg(F.count("*").alias("casos"))


def agreement_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses reconstructed from verdicts by stratum, for both reviewers, and how often they agree, with a total."""
    x = cases(spark, d).where("a is not null and b is not null")
    x = x.select("estrato", A.outcome(F.col("estrato"), F.col("a")).alias("oa"), A.outcome(F.col("estrato"), F.col("b")).alias("ob"))
    return x.rollup("estrato").agg(F.count("*").alias("casos"), F.count_if(F.col("oa") == F.col("ob")).alias("iguales")).select(F.coalesce("estrato", F.lit("TOTAL")).alias("estrato"), "casos", "iguales")


def agreement_domain(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the case table: keys, labels that can't be read, documents unknown to the corpus, keys of one table only."""
    x = table(spark, d, "intermediate_merged_cases")
    one = x.select("case_id").distinct()
    two = table(spark, d, "case_labels").select("case_id").distinct().withColumn("l", F.lit(1))
    only = one.withColumn("c", F.lit(1)).join(two, "case_id", "full")
    ids = docs(spark, d).select(F.col("id").alias("doc"))
    lost = cases(spark, d).select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).where("doc is not null").distinct().join(ids, "doc", "left_anti")
    rows = [
        x.agg(F.lit("casos").alias("control"), F.count_distinct("case_id").alias("n")),
        x.agg(F.lit("sin_etiqueta_legible"), F.count_if(F.col("decision_gpt").isNotNull() & A.label(F.col("decision_gpt")).isNull())),
        lost.agg(F.lit("documentos_desconocidos"), F.count("*")),
        only.agg(F.lit("claves_de_un_lado"), F.count_if(F.col("c").isNull() | F.col("l").isNull())),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("bien", (F.col("control") == "casos") | (F.col("n") == 0) | (F.col("control") == "claves_de_un_lado"))


def sample_simple(spark: SparkSession, d: str) -> DataFrame:
    return M.simple(docs(spark, d).select("id", "titulo"), 30, 20260722, "id")


def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Forty documents of each kind of conflict, as a sheet of running ids that shows neither kind nor source."""
    x = M.stratified(docs(spark, d).where("llm_conflict_type is not null"), "llm_conflict_type", 40, 7, "id")
    return M.numbered(x, "E", 4, 8, "id").select("item_id", "id", F.substring("titulo", 1, 160).alias("titulo"))


def sample_sealed(spark: SparkSession, d: str) -> DataFrame:
    """A sealed sample: the items in order, and one digest over them all."""
    x = M.simple(docs(spark, d).select("id"), 50, 99, "id")
    return x.agg(F.count("*").alias("items"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("sello"))


def sample_quintiles(spark: SparkSession, d: str) -> DataFrame:
    """Edges by quintile of weight."""
    q = M.quintiles(edges(spark, d).where("w is not null"), "w")
    return q.groupBy("quintil").agg(F.count("*").alias("aristas"), F.min("w").alias("desde"), F.max("w").alias("hasta"))


def sample_near_misses(spark: SparkSession, d: str) -> DataFrame:
    """Rejected pairs near the threshold, at most eight per document on either side, none of them an edge."""
    e = edges(spark, d)
    pool = e.where((F.col("w") >= 0.40) & (F.col("w") < TAU) & (F.col("dias") <= 365))
    pool = pool.join(e.where(P.accepted(F.lit(TAU))).select("a", "b"), ["a", "b"], "left_anti")
    for side in ("a", "b"):
        pool = M.stratified(pool.select("a", "b", "w", F.col(side).alias("s")), "s", 8, 3, "a", "b").select("a", "b", "w")
    return pool


def sample_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs in thirds of how alike their titles are, by thread: available and drawn, at most five a third."""
    t = threads(spark, d).where("n >= 15").select("doc_id", "hilo")
    title = docs(spark, d).select(F.col("id").alias("doc_id"), "titulo")
    e = edges(spark, d).where(P.accepted(F.lit(TAU))).join(t.select(F.col("doc_id").alias("a"), "hilo"), "a")
    e = e.join(title.select(F.col("doc_id").alias("a"), F.col("titulo").alias("ta")), "a").join(title.select(F.col("doc_id").alias("b"), F.col("titulo").alias("tb")), "b")
    e = e.select("hilo", "a", "b", F.round(token_jaccard(F.col("ta"), F.col("tb")), 6).alias("s"))
    w = W.partitionBy("hilo")
    third = F.floor(3 * (F.row_number().over(w.orderBy("s", "a", "b")) - 1) / F.count("*").over(w)).cast("int")
    x = e.withColumn("tercio", third)
    k = x.withColumn("r", F.row_number().over(W.partitionBy("hilo", "tercio").orderBy(M.ticket(20260723, "a", "b"), "a", "b")))
    return k.groupBy("hilo", "tercio").agg(F.count("*").alias("disponibles"), F.count_if(F.col("r") <= 5).alias("elegidos"))


def primary(spark: SparkSession, d: str) -> DataFrame:
    return C.primary(C.records(docs(spark, d)))


def subthread_primary(spark: SparkSession, d: str) -> DataFrame:
    return primary(spark, d).select("doc_id", "subhilo", "abstuvo")


def subthread_secondary(spark: SparkSession, d: str) -> DataFrame:
    return B.secondary(primary(spark, d), edges(spark, d))


def subthread_quality(spark: SparkSession, d: str) -> DataFrame:
    m = threads(spark, d).where("n >= 15").select("doc_id", "hilo").join(primary(spark, d), "doc_id")
    x = B.split_quality(m)
    return x.select("hilo", "docs", F.round("cobertura", 6).alias("cobertura"), "subhilos", F.round("fragmentacion", 6).alias("fragmentacion"), "amplios")


def subthread_purity(spark: SparkSession, d: str) -> DataFrame:
    x = B.pair_purity(_final(spark, d).select("doc_a", "doc_b", "final"), primary(spark, d))
    return x.select("pares", "juntos", F.round("pureza", 6).alias("pureza"), F.round("retencion", 6).alias("retencion"))


def subthread_crossings(spark: SparkSession, d: str) -> DataFrame:
    """Bridges between documents of different subthreads."""
    e = edges(spark, d).where(P.accepted(F.lit(TAU)))
    return B.crossings(G.bridges(e, G.components(e.select("a", "b"))), primary(spark, d))


def subthread_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each subthread is assigned, in the assignment table as given: documents, abstentions, several."""
    x = table(spark, d, "node_subhilo_assignment").groupBy("macrohilo_id").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("abstuvo"), F.col("doc_id"))).alias("abstenciones"), F.count_distinct(F.when(F.col("multiasignado"), F.col("doc_id"))).alias("multiples"), F.count_distinct("subhilo_primario").alias("etiquetas"))
    return x


QUERIES = {f.__name__: f for f in (
    agreement_confusion, agreement_kappa, agreement_rates, agreement_disagreements, agreement_arbitration, agreement_outcomes, agreement_domain,
    sample_simple, sample_stratified, sample_sealed, sample_quintiles, sample_near_misses, sample_terciles,
    subthread_primary, subthread_secondary, subthread_quality, subthread_purity, subthread_crossings, subthread_counts,
)}

_FINAL = "fin AS (SELECT *, coalesce(arb, CASE WHEN a = b THEN a END) AS final FROM cases)"
_w = lambda s: f"round((k / n + 1.9208::DOUBLE / n {s} 1.96::DOUBLE * sqrt(k / n * (1 - k / n) / n + 0.9604::DOUBLE / (n * n))) / (1 + 3.8416::DOUBLE / n), 6)"
_names = [x.strip("() '") for x in Q.LABELS.split(",")]
_same, _open = "= 'mismo_proceso_especifico'", "= 'indeterminado'"
_out = lambda c: f"CASE WHEN estrato = 'intra' THEN CASE WHEN {c} {_same} THEN 'asignacion_correcta' WHEN {c} {_open} THEN 'indeterminado' ELSE 'sobreagregacion' END WHEN estrato = 'inter' THEN CASE WHEN {c} {_same} THEN 'fragmentacion_falsa' WHEN {c} {_open} THEN 'indeterminado' ELSE 'asignacion_correcta' END ELSE 'juicio_por_documento' END"
_near = lambda x, y: f"((a = '{x}' AND b = '{y}') OR (a = '{y}' AND b = '{x}'))"
_E45 = "e45 AS (SELECT * FROM edges WHERE w >= 0.45 AND (dias <= 365 OR s_ref >= 0.5))"
_T = (Q.DOCS, Q.EDGES, _E45, Q.components("e45"), Q.THREADS)
_tok = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
_K = Q.base_key
_PRIM = (
    f"rec AS (SELECT id AS doc_id, {_K('llm_project_name')} AS p0, {_K('llm_main_conflict_place_name')} AS pl, {Q.strip('llm_main_conflict_place_type')} AS pt, coalesce({_K('llm_main_conflict_place_name')}, {_K('geo_comuna')}, {_K('geo_provincia')}, {_K('geo_region')}) AS territorio, "
    f"list_filter([{_K('llm_demandant_actor_name')}, {_K('llm_demanded_actor_name')}], lambda v: v IS NOT NULL) AS orgs FROM docs), "
    "prim AS (SELECT doc_id, coalesce(p0, CASE WHEN pt IN ('mine', 'thermoelectric', 'industrial_facility', 'company_facility') THEN pl END) AS p, territorio, orgs FROM rec), "
    "pri AS (SELECT doc_id, coalesce(p, 'SIN_SUBHILO_ESPECIFICO') AS subhilo, p IS NULL AS abstuvo, territorio, orgs FROM prim)"
)
ORACLE = {
    "agreement_confusion": Q.query(Q.CASES, f"l(etiqueta) AS (VALUES {Q.LABELS})", "SELECT etiqueta, " + ", ".join(f"(SELECT count(*) FROM cases WHERE a = etiqueta AND b = '{x}') AS {x}" for x in _names) + " FROM l"),
    "agreement_kappa": Q.query(Q.CASES, "x AS (SELECT * FROM cases WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS po FROM x), pe AS (SELECT sum(p) AS pe FROM (SELECT (SELECT count(*) FROM x WHERE a = k) * (SELECT count(*) FROM x WHERE b = k) / ((SELECT n FROM n) * (SELECT n FROM n)) AS p FROM (SELECT DISTINCT a AS k FROM x UNION SELECT DISTINCT b FROM x)))", "SELECT n AS casos, round(po, 6) AS acuerdo, round(pe, 6) AS azar, round((po - pe) / (1 - pe), 6) AS kappa FROM n, pe"),
    "agreement_rates": Q.query(Q.CASES, _FINAL, "kn AS (SELECT *, coalesce(directa::VARCHAR, 'sin_dato') AS dir FROM fin WHERE final IS NOT NULL AND final <> 'indeterminado'), g AS (SELECT 'TOTAL' AS grupo, 'TOTAL' AS valor, final FROM kn UNION ALL SELECT 'estrato', coalesce(estrato, 'sin_dato'), final FROM kn UNION ALL SELECT 'detalle', coalesce(detalle, 'sin_dato'), final FROM kn UNION ALL SELECT 'directa', dir, final FROM kn), s AS (SELECT grupo, valor, count(*) AS n, count(*) FILTER (final = 'mismo_proceso_especifico') AS k, count(*) FILTER (final IN ('mismo_proceso_especifico', 'mismo_macroproceso')) AS m, count(*) FILTER (final IN ('mismo_proceso_especifico', 'mismo_macroproceso', 'relacionado_tematicamente')) AS t FROM g GROUP BY ALL)", f"SELECT grupo, valor, n AS casos, round(k / n, 6) AS estricto, {_w('-')} AS estricto_bajo, {_w('+')} AS estricto_alto, round(m / n, 6) AS amplio, round(t / n, 6) AS tematico FROM s"),
    "agreement_disagreements": Q.query(Q.CASES, "SELECT least(a, b) AS una, greatest(a, b) AS otra, count(*) AS casos FROM cases WHERE a <> b GROUP BY ALL"),
    "agreement_arbitration": Q.query(Q.CASES, f"SELECT CASE WHEN a {_open} OR b {_open} THEN 'evidencia_insuficiente' WHEN detalle = 'louvain' THEN 'granularidad' WHEN {_near('mismo_proceso_especifico', 'relacionado_tematicamente')} THEN 'frontera_de_identidad' WHEN {_near('relacionado_tematicamente', 'no_relacionado')} THEN 'ambiguedad_textual' ELSE 'revision_manual' END AS motivo, CASE WHEN arb IS NULL THEN NULL WHEN arb = a AND arb = b THEN 'ambos' WHEN arb = a THEN 'primero' WHEN arb = b THEN 'segundo' ELSE 'ninguno' END AS arbitraje, count(*) AS casos FROM cases WHERE a <> b GROUP BY ALL"),
    "agreement_outcomes": Q.query(Q.CASES, f"o AS (SELECT estrato, {_out('a')} AS oa, {_out('b')} AS ob FROM cases WHERE a IS NOT NULL AND b IS NOT NULL)", "SELECT coalesce(estrato, 'TOTAL') AS estrato, count(*) AS casos, count(*) FILTER (oa = ob) AS iguales FROM o GROUP BY ROLLUP (estrato)"),
    "agreement_domain": Q.query(Q.DOCS, Q.CASES, f"r(control, n) AS (SELECT 'casos', count(DISTINCT case_id) FROM intermediate_merged_cases UNION ALL SELECT 'sin_etiqueta_legible', count(*) FROM intermediate_merged_cases WHERE decision_gpt IS NOT NULL AND {Q.label('decision_gpt')} IS NULL UNION ALL SELECT 'documentos_desconocidos', count(DISTINCT x) FROM (SELECT doc_a AS x FROM cases UNION SELECT doc_b FROM cases) WHERE x IS NOT NULL AND x NOT IN (SELECT id FROM docs WHERE id IS NOT NULL) UNION ALL SELECT 'claves_de_un_lado', count(*) FROM (SELECT DISTINCT case_id FROM intermediate_merged_cases) c FULL JOIN (SELECT DISTINCT case_id FROM case_labels) l USING (case_id) WHERE c.case_id IS NULL OR l.case_id IS NULL)", "SELECT control, n, control IN ('casos', 'claves_de_un_lado') OR n = 0 AS bien FROM r"),
    "sample_simple": Q.query(Q.DOCS, "SELECT id, titulo FROM docs ORDER BY md5('20260722|' || id), id LIMIT 30"),
    "sample_stratified": Q.query(Q.DOCS, "s AS (SELECT *, row_number() OVER (PARTITION BY llm_conflict_type ORDER BY md5('7|' || id), id) AS r FROM docs WHERE llm_conflict_type IS NOT NULL)", "SELECT 'E' || lpad((row_number() OVER (ORDER BY md5('8|' || id), id))::VARCHAR, 4, '0') AS item_id, id, substr(titulo, 1, 160) AS titulo FROM s WHERE r <= 40"),
    "sample_sealed": Q.query(Q.DOCS, "s AS (SELECT id FROM docs ORDER BY md5('99|' || id), id LIMIT 50)", "SELECT count(*) AS items, sha256(string_agg(id, chr(10) ORDER BY id)) AS sello FROM s"),
    "sample_quintiles": Q.query(Q.EDGES, "o AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM edges WHERE w IS NOT NULL), c AS (SELECT w FROM o WHERE i IN (n * 1 // 5, n * 2 // 5, n * 3 // 5, n * 4 // 5))", "SELECT q AS quintil, count(*) AS aristas, min(w) AS desde, max(w) AS hasta FROM (SELECT w, (1 + (SELECT count(*) FROM c WHERE o.w >= c.w))::INT AS q FROM o) GROUP BY 1"),
    "sample_near_misses": Q.query(Q.EDGES, "p AS (SELECT a, b, w FROM edges WHERE w >= 0.40 AND w < 0.45 AND dias <= 365), pa AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY md5('3|' || a || '|' || b), a, b) AS r FROM p), pb AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY md5('3|' || a || '|' || b), a, b) AS r2 FROM pa WHERE r <= 8)", "SELECT a, b, w FROM pb WHERE r2 <= 8"),
    "sample_terciles": Q.query(*_T, f"s AS (SELECT hilo, a, b, round(CASE WHEN len({_tok('x.titulo')}) > 0 AND len({_tok('y.titulo')}) > 0 THEN len(list_intersect({_tok('x.titulo')}, {_tok('y.titulo')}))::DOUBLE / len(list_distinct(list_concat({_tok('x.titulo')}, {_tok('y.titulo')}))) ELSE 0.0::DOUBLE END, 6) AS s FROM e45 JOIN threads t ON t.doc_id = a JOIN docs x ON x.id = a JOIN docs y ON y.id = b WHERE n >= 15), k AS (SELECT *, (3 * (row_number() OVER (PARTITION BY hilo ORDER BY s, a, b) - 1) // count(*) OVER (PARTITION BY hilo))::INT AS tercio FROM s), m AS (SELECT *, row_number() OVER (PARTITION BY hilo, tercio ORDER BY md5('20260723|' || a || '|' || b), a, b) AS r FROM k)", "SELECT hilo, tercio, count(*) AS disponibles, count(*) FILTER (r <= 5) AS elegidos FROM m GROUP BY ALL"),
    "subthread_primary": Q.query(Q.DOCS, _PRIM, "SELECT doc_id, subhilo, abstuvo FROM pri"),
    "subthread_secondary": Q.query(Q.DOCS, Q.EDGES, _PRIM, "en AS (SELECT a AS doc_id, b AS via FROM edges WHERE w >= 0.6 UNION ALL SELECT b, a FROM edges WHERE w >= 0.6), j AS (SELECT en.doc_id, via, y.subhilo AS otro FROM en JOIN pri x ON x.doc_id = en.doc_id JOIN pri y ON y.doc_id = via WHERE y.subhilo <> 'SIN_SUBHILO_ESPECIFICO' AND y.subhilo <> x.subhilo AND list_has_any(x.orgs, y.orgs))", "SELECT doc_id, string_agg(DISTINCT otro, ';' ORDER BY otro) AS secundarios, string_agg(DISTINCT via || ':' || otro, ';' ORDER BY via || ':' || otro) AS evidencia FROM j GROUP BY 1"),
    "subthread_quality": Q.query(*_T, _PRIM, "m AS (SELECT hilo, pri.* FROM threads JOIN pri USING (doc_id) WHERE n >= 15), s AS (SELECT hilo, count(*) AS k, count(*) FILTER (n >= 2 AND t > 1) AS w FROM (SELECT hilo, subhilo, count(*) AS n, count(DISTINCT territorio) AS t FROM m WHERE NOT abstuvo GROUP BY ALL) GROUP BY 1)", "SELECT hilo, count(*) AS docs, round(count(*) FILTER (NOT abstuvo) / count(*), 6) AS cobertura, coalesce(any_value(k), 0) AS subhilos, round(any_value(k) / nullif(count(*) FILTER (NOT abstuvo), 0), 6) AS fragmentacion, coalesce(any_value(w), 0) AS amplios FROM m LEFT JOIN s USING (hilo) GROUP BY 1"),
    "subthread_purity": Q.query(Q.DOCS, Q.CASES, _FINAL, _PRIM, "j AS (SELECT x.subhilo = y.subhilo AS uno, final = 'mismo_proceso_especifico' AS same FROM fin JOIN pri x ON x.doc_id = doc_a JOIN pri y ON y.doc_id = doc_b WHERE NOT x.abstuvo AND NOT y.abstuvo)", "SELECT count(*) AS pares, count(*) FILTER (uno) AS juntos, round(count(*) FILTER (uno AND same) / nullif(count(*) FILTER (uno), 0), 6) AS pureza, round(count(*) FILTER (uno AND same) / nullif(count(*) FILTER (same), 0), 6) AS retencion FROM j"),
    "subthread_counts": "SELECT macrohilo_id, count(DISTINCT doc_id) AS docs, count(DISTINCT doc_id) FILTER (abstuvo) AS abstenciones, count(DISTINCT doc_id) FILTER (multiasignado) AS multiples, count(DISTINCT subhilo_primario) AS etiquetas FROM node_subhilo_assignment GROUP BY 1",
}
