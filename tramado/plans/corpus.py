"""Queries on the corpus: coverage, referents, aliases, records, and the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as T
from ..operators import corpus as C
from ..sources.tables import table
from . import sql as Q


def docs(spark: SparkSession, d: str) -> DataFrame:
    return C.latest(table(spark, d, "f0_referent_coverage"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    return C.referents(docs(spark, d))


def corpus_coverage(spark: SparkSession, d: str) -> DataFrame:
    return C.coverage(docs(spark, d))


def corpus_components(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have how many kinds of referent."""
    n = refs(spark, d).groupBy("doc_id").agg(F.count_distinct("tipo").alias("n"))
    every = docs(spark, d).select(F.col("id").alias("doc_id")).join(n, "doc_id", "left")
    return every.groupBy(F.coalesce("n", F.lit(0)).alias("tipos")).agg(F.count("*").alias("docs"))


def corpus_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).groupBy("tipo").agg(F.count_distinct("referente").alias("referentes"), F.count_distinct("doc_id").alias("docs"))


def corpus_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent values of two columns; ties by value. A top-k report."""
    x = docs(spark, d)
    out = None
    for c in ("llm_conflict_type", "source_run"):
        top = x.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("valor")).agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "valor").limit(10)
        top = top.select(F.lit(c).alias("columna"), "valor", "docs")
        out = top if out is None else out.union(top)
    return out


def corpus_years(spark: SparkSession, d: str) -> DataFrame:
    year = S.year_prefix(T.norm(F.col("fecha_iso")))
    return docs(spark, d).groupBy(F.coalesce(year, F.lit("sin_fecha")).alias("anio")).agg(F.count("*").alias("docs"), F.count_if(T.base_key(F.col("llm_project_name")).isNotNull()).alias("con_objeto"))


def corpus_referents(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).select("doc_id", F.col("fecha").cast("string").alias("fecha"), "tipo", "referente")


def corpus_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return C.acronym_forms(refs(spark, d))


def corpus_aliased(spark: SparkSession, d: str) -> DataFrame:
    """Documents per referent once aliases are applied."""
    r = refs(spark, d)
    return C.apply_aliases(r, C.aliases(C.acronym_forms(r))).groupBy("tipo", "referente").agg(F.count_distinct("doc_id").alias("docs"))


def corpus_records(spark: SparkSession, d: str) -> DataFrame:
    return C.records(docs(spark, d))


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Normalisation of typed values."""
    actor = F.col("llm_demandant_actor_name")
    return docs(spark, d).select(
        "id",
        T.norm(actor).alias("norma"),
        T.norm_key(actor).alias("clave"),
        T.base_key(actor).alias("base"),
        F.coalesce(T.is_generic_actor(T.base_key(actor)), F.lit(False)).alias("generico"),
        F.lower(T.strip(F.coalesce(F.nullif("fuente", F.lit("")), F.lit("desconocida")))).alias("fuente"),
        F.substring("titulo", 1, 120).alias("titulo_120"),
        F.coalesce(F.col("titulo").ilike("%tranque%") | F.col("snippet").ilike("%tranque%"), F.lit(False)).alias("tranque"),
        T.padded_id("D", 8, F.col("id").try_cast("long")).alias("codigo"),
    )


def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of titles, whether any is in the snippet, and the likeness of both."""
    words = T.keywords(F.col("titulo"), stop=("sobre", "contra", "entre"))
    plain = T.accents_off(F.lower("snippet"))
    return docs(spark, d).select(
        "id",
        F.concat_ws(";", words).alias("palabras"),
        T.packed_set(words).alias("conjunto"),
        F.size(T.unpacked_set(T.packed_set(words))).alias("cuantas"),
        F.coalesce(F.exists(words, lambda w: plain.contains(w)), F.lit(False)).alias("aparece"),
        F.round(T.token_jaccard(F.col("titulo"), F.col("snippet")), 6).alias("parecido"),
    )


TITLE = "(?:Central|Planta|Minera|Parque|Embalse|Vertedero|Tranque)[^\\n.,;]{3,40}"


def text_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Fields cut out of running text: a labelled field, a year after words, a place, the last title-like phrase, and
    the blocks that an anchor word opens."""
    text = F.col("text")
    titles = F.regexp_extract_all(text, F.lit(f"({TITLE})"), 1)
    return table(spark, d, "documents").select(
        "doc_id",
        T.labelled_field(text, "según", (".", ";"), 200).alias("segun"),
        F.nullif(F.regexp_extract(text, "acta ([0-9]+)", 1), F.lit("")).alias("acta"),
        F.nullif(F.regexp_extract(text, "kilómetros de ([A-Z][a-z]+(?: [A-Z][a-z]+)?)", 1), F.lit("")).alias("lugar"),
        F.when(F.size(titles) > 0, F.element_at(titles, -1)).alias("ultimo"),
        (F.size(F.split(text, "La empresa ")) - 1).cast("long").alias("bloques"),
    )


RULES = [("vegas de|quebrada", "agua"), ("desal", "desaladora"), ("etapa (1|i)$", "primera_etapa"), ("relaves|tranque", "relaves")]


def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """First rule that a project's key matches, and its pattern."""
    label, pattern = T.first_rule(F.col("k"), RULES, "SIN_SUBHILO_ESPECIFICO")
    return docs(spark, d).select("id", T.base_key(F.col("llm_project_name")).alias("k")).select("id", label.alias("clave"), pattern.alias("regla"))


def dates_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Dates, their periods, and a jitter of up to seven days by hash."""
    day = S.day(F.col("fecha_iso"))
    return docs(spark, d).select(
        "id",
        day.cast("string").alias("fecha"),
        S.year_prefix(F.col("fecha_iso")).alias("anio"),
        F.when(day.isNotNull(), S.quarter(day)).alias("trimestre"),
        F.when(day.isNotNull(), S.semester(day)).alias("semestre"),
        F.date_format(day, "yyyy-MM").alias("mes"),
        S.jitter(day, 7, F.lit(11), F.col("id")).cast("string").alias("movida"),
    )


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column read into fields, null where it can't be, and written again."""
    k = F.from_json("props", "struct<k:int>")
    x = table(spark, d, "events").groupBy("event_type").agg(F.count_if(k.isNotNull()).alias("legibles"), F.sum(k["k"]).alias("suma"), F.max(k["k"]).alias("mayor"))
    return x.withColumn("json", F.to_json(F.struct("legibles", "mayor")))


QUERIES = {f.__name__: f for f in (
    corpus_coverage, corpus_components, corpus_cardinality, corpus_top_values, corpus_years, corpus_referents, corpus_acronyms,
    corpus_aliased, corpus_records, text_keys, text_keywords, text_extraction, text_rules, dates_parsed, json_props,
)}

_B = Q.base_key
_place = f"coalesce({_B('llm_main_conflict_place_name')}, {_B('geo_comuna')}, {_B('geo_region')})"
_has = f"SELECT {Q.day('fecha_iso')} AS f, ({_B('llm_project_name')}) IS NOT NULL AS o, ({_place}) IS NOT NULL AS t, coalesce({_B('llm_demandant_actor_name')}, {_B('llm_demanded_actor_name')}) IS NOT NULL AS a FROM docs"
_paren = "'^(.+?)\\s*\\(([a-z0-9\\-. ]{2,15})\\)\\s*$'"
_generic = ", ".join(f"'{x}'" for x in T.GENERIC_NAMES)
_stop = ", ".join(f"'{x}'" for x in T.INITIAL_STOPWORDS)
_first = "array_to_string(list_transform({0}, lambda w: w[1]), '')"
_words = "list_filter(string_split(nombre, ' '), lambda w: w <> '')"
_content = f"list_filter({_words}, lambda w: w NOT IN ({_stop}))"
_letters = "regexp_replace(sigla, '[^a-z0-9]', '', 'g')"
_FORMS = (
    f"forms AS (SELECT tipo, referente, regexp_extract(referente, {_paren}, 1) AS nombre, replace(regexp_extract(referente, {_paren}, 2), '.', '') AS sigla, count(DISTINCT doc_id) AS docs "
    f"FROM refs WHERE regexp_matches(referente, {_paren}) GROUP BY ALL), "
    f"classed AS (SELECT *, CASE WHEN nombre IN ({_generic}) THEN 'generico' WHEN NOT (length({_letters}) >= 2 AND ({_first.format(_content)} = {_letters} OR {_first.format(_words)} = {_letters})) THEN 'iniciales_no_coinciden' ELSE 'aceptado' END AS motivo FROM forms)"
)
_ALIAS = (
    "ok AS (SELECT * FROM classed WHERE motivo = 'aceptado'), one AS (SELECT tipo, sigla FROM ok GROUP BY ALL HAVING count(DISTINCT nombre) = 1), "
    "alias AS (SELECT tipo, referente AS alias, nombre FROM ok UNION SELECT ok.tipo, ok.sigla, nombre FROM ok JOIN one USING (tipo, sigla))"
)


def _family(c: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(k, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in T.FAMILIES.items())
    return f"(SELECT CASE WHEN k IS NULL THEN 'otro' {whens} ELSE 'otro' END FROM (SELECT {_B(c)} AS k))"


_facility = ", ".join(f"'{x}'" for x in T.FACILITIES)
_kws = "(regexp_extract_all({0}, '[a-z]{{5,}}'))".format(Q.plain("titulo"))
_dist = f"list_filter({_kws}, lambda w, i: list_position({_kws}, w) = i)"
_six = f"coalesce(list_filter({_dist}, lambda w: w NOT IN ('sobre', 'contra', 'entre'))[1:6], [])"
_tok = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
ORACLE = {
    "corpus_coverage": Q.query(Q.DOCS, f"h AS (SELECT *, o::INT + t::INT + a::INT AS n FROM ({_has}))",
        "SELECT count(*) AS docs, count(f) AS fechados, count(*) FILTER (o) AS objeto, count(*) FILTER (t) AS territorio, count(*) FILTER (a) AS actor, count(*) FILTER (n >= 1) AS al_menos_1, count(*) FILTER (n >= 2) AS al_menos_2, count(*) FILTER (n = 3) AS los_3, round(100.0::DOUBLE * count(*) FILTER (n >= 1) / count(*), 4) AS pct_al_menos_1, count(*) FILTER (n >= 1) / count(*) >= 0.7 AS pasa FROM h"),
    "corpus_components": Q.query(Q.DOCS, Q.REFS, "SELECT coalesce(n, 0) AS tipos, count(*) AS docs FROM docs LEFT JOIN (SELECT doc_id, count(DISTINCT tipo) AS n FROM refs GROUP BY 1) r ON r.doc_id = docs.id GROUP BY 1"),
    "corpus_cardinality": Q.query(Q.DOCS, Q.REFS, "SELECT tipo, count(DISTINCT referente) AS referentes, count(DISTINCT doc_id) AS docs FROM refs GROUP BY 1"),
    "corpus_top_values": Q.query(Q.DOCS, "(SELECT 'llm_conflict_type' AS columna, llm_conflict_type AS valor, count(*) AS docs FROM docs WHERE llm_conflict_type IS NOT NULL GROUP BY ALL ORDER BY docs DESC, valor LIMIT 10) UNION ALL (SELECT 'source_run', source_run AS valor, count(*) AS docs FROM docs WHERE source_run IS NOT NULL GROUP BY ALL ORDER BY docs DESC, valor LIMIT 10)"),
    "corpus_years": Q.query(Q.DOCS, f"SELECT coalesce(CASE WHEN regexp_matches({Q.norm('fecha_iso')}, '^[0-9]{{4}}') THEN substr({Q.norm('fecha_iso')}, 1, 4) END, 'sin_fecha') AS anio, count(*) AS docs, count({_B('llm_project_name')}) AS con_objeto FROM docs GROUP BY 1"),
    "corpus_referents": Q.query(Q.DOCS, Q.REFS, "SELECT doc_id, fecha::VARCHAR AS fecha, tipo, referente FROM refs"),
    "corpus_acronyms": Q.query(Q.DOCS, Q.REFS, _FORMS, "SELECT tipo, referente, nombre, sigla, docs, motivo FROM classed"),
    "corpus_aliased": Q.query(Q.DOCS, Q.REFS, _FORMS, _ALIAS, "SELECT refs.tipo, coalesce(alias.nombre, referente) AS referente, count(DISTINCT doc_id) AS docs FROM refs LEFT JOIN alias ON alias.tipo = refs.tipo AND alias.alias = referente GROUP BY ALL"),
    "corpus_records": Q.query(Q.DOCS, f"SELECT id AS doc_id, coalesce({_B('llm_project_name')}, CASE WHEN {Q.strip('llm_main_conflict_place_type')} IN ({_facility}) THEN {_B('llm_main_conflict_place_name')} END) AS proyecto, coalesce({_B('llm_main_conflict_place_name')}, {_B('geo_comuna')}, {_B('geo_provincia')}, {_B('geo_region')}) AS territorio, coalesce(array_to_string(list_sort(list_distinct(list_filter([{_B('llm_demandant_actor_name')}, {_B('llm_demanded_actor_name')}], lambda v: v IS NOT NULL))), ';'), '') AS organizacion, {_B('llm_contentious_action_type')} AS procedimiento, {_family('llm_contentious_action_type')} AS familia, {_family('llm_contentious_action_type')} || '::' || coalesce(substr(nullif(substr(fecha_iso, 1, 10), ''), 1, 7), 'sin_fecha') AS fase FROM docs"),
    "text_keys": Q.query(Q.DOCS, f"SELECT id, {Q.norm('llm_demandant_actor_name')} AS norma, {Q.norm_key('llm_demandant_actor_name')} AS clave, {_B('llm_demandant_actor_name')} AS base, coalesce(regexp_matches({_B('llm_demandant_actor_name')}, '^({'|'.join(T.GENERIC_ACTORS)})'), false) AS generico, lower({Q.strip(chr(99) + 'oalesce(nullif(fuente, ' + chr(39) * 2 + '), ' + chr(39) + 'desconocida' + chr(39) + ')')}) AS fuente, substr(titulo, 1, 120) AS titulo_120, coalesce(titulo ILIKE '%tranque%' OR snippet ILIKE '%tranque%', false) AS tranque, 'D' || lpad(id, 8, '0') AS codigo FROM docs"),
    "text_keywords": Q.query(Q.DOCS, f"k AS (SELECT id, titulo, snippet, {_six} AS p FROM docs)", f"SELECT id, array_to_string(p, ';') AS palabras, array_to_string(list_sort(list_distinct(p)), ';') AS conjunto, len(p) AS cuantas, coalesce(len(list_filter(p, lambda w: contains({Q.plain('snippet')}, w))) > 0, false) AS aparece, round(CASE WHEN len({_tok('titulo')}) > 0 AND len({_tok('snippet')}) > 0 THEN len(list_intersect({_tok('titulo')}, {_tok('snippet')}))::DOUBLE / len(list_distinct(list_concat({_tok('titulo')}, {_tok('snippet')}))) ELSE 0.0::DOUBLE END, 6) AS parecido FROM k"),
    "text_extraction": f"SELECT doc_id, regexp_replace(trim(regexp_replace(string_split(string_split(regexp_extract(text, '(?s)según(.{{0,200}})', 1), '.')[1], ';')[1], '\\s+', ' ', 'g')), '^[ :]+|[ :]+$', '', 'g') AS segun, nullif(regexp_extract(text, 'acta ([0-9]+)', 1), '') AS acta, nullif(regexp_extract(text, 'kilómetros de ([A-Z][a-z]+(?: [A-Z][a-z]+)?)', 1), '') AS lugar, regexp_extract_all(text, '{TITLE}')[-1] AS ultimo, len(string_split(text, 'La empresa ')) - 1 AS bloques FROM documents",
    "text_rules": Q.query(Q.DOCS, f"k AS (SELECT id, {_B('llm_project_name')} AS k FROM docs)", "SELECT id, CASE " + " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{x}'" for p, x in RULES) + " ELSE 'SIN_SUBHILO_ESPECIFICO' END AS clave, CASE " + " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{p}'" for p, x in RULES) + " END AS regla FROM k"),
    "dates_parsed": Q.query(Q.DOCS, f"k AS (SELECT id, fecha_iso, {Q.day('fecha_iso')} AS f FROM docs)", "SELECT id, f::VARCHAR AS fecha, CASE WHEN regexp_matches(fecha_iso, '^[0-9]{4}') THEN substr(fecha_iso, 1, 4) END AS anio, year(f) || '-Q' || quarter(f) AS trimestre, year(f) || '-S' || ((month(f) - 1) // 6 + 1) AS semestre, strftime(f, '%Y-%m') AS mes, (f + (('0x' || substr(md5('11|' || id), 1, 8))::BIGINT % 15 - 7)::INT)::VARCHAR AS movida FROM k"),
    "json_props": "SELECT event_type, count(props->>'k') AS legibles, sum((props->>'k')::INT)::BIGINT AS suma, max((props->>'k')::INT) AS mayor, '{\"legibles\":' || count(props->>'k') || ',\"mayor\":' || max((props->>'k')::INT) || '}' AS json FROM events GROUP BY 1",
}
