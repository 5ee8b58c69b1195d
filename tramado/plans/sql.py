"""Parts of the SQL that states what the queries compute, for engines that check them."""

from __future__ import annotations

from ..functions.text import NULL_TOKENS

_NULLS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def norm(c: str) -> str:
    return f"(CASE WHEN lower({strip(c)}) NOT IN ({_NULLS}) THEN {strip(c)} END)"


def plain(c: str) -> str:
    return f"translate(strip_accents(lower({c})), 'ªº¹²³ ', 'ao123 ')"


def norm_key(c: str) -> str:
    return f"trim(regexp_replace({plain(norm(c))}, '\\s+', ' ', 'g'))"


def base_key(c: str) -> str:
    v = f"translate({plain(norm(c))}, '\"''“”;|', '      ')"
    v = f"regexp_replace(trim(regexp_replace({v}, '\\s+', ' ', 'g')), '[ .,]+$', '')"
    return f"nullif(CASE WHEN len(string_split({v}, ' ')) >= 3 THEN regexp_replace({v}, '^(el|la|los|las) ', '') ELSE {v} END, '')"


def day(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '^\\d{{4}}-\\d\\d-\\d\\d') THEN try_strptime(substr({c}, 1, 10), '%Y-%m-%d')::DATE END)"


DOCS = (
    "docs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cargado_en DESC NULLS LAST, "
    "md5(concat_ws('|', fecha_iso, titulo, llm_project_name, llm_demandant_actor_name))) AS rn FROM f0_referent_coverage) WHERE rn = 1)"
)
_PLACE = f"coalesce({base_key('llm_main_conflict_place_name')}, {base_key('geo_comuna')}, {base_key('geo_region')})"
REFS = (
    f"refs AS (SELECT DISTINCT doc_id, fecha, tipo, referente FROM ("
    f"SELECT id AS doc_id, {day('fecha_iso')} AS fecha, 'objeto' AS tipo, {base_key('llm_project_name')} AS referente FROM docs "
    f"UNION ALL SELECT id, {day('fecha_iso')}, 'territorio', {_PLACE} FROM docs "
    f"UNION ALL SELECT id, {day('fecha_iso')}, 'actor', {base_key('llm_demandant_actor_name')} FROM docs "
    f"UNION ALL SELECT id, {day('fecha_iso')}, 'actor', {base_key('llm_demanded_actor_name')} FROM docs) WHERE referente IS NOT NULL)"
)
DATED = f"(SELECT count(*) FROM docs WHERE {day('fecha_iso')} IS NOT NULL)"
_ID = lambda c: f"nullif({strip(c)}, '')"
EDGES = (
    f"edges AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(dias) AS dias, max(s_ref) AS s_ref, max(s_emb) AS s_emb, max(w) AS w "
    f"FROM (SELECT {_ID('doc_i')} AS x, {_ID('doc_j')} AS y, dias, s_ref, s_emb, w FROM f2b_idf_v2_l2_edges) WHERE x <> y GROUP BY 1, 2)"
)


def components(edges: str = "edges", name: str = "comps", keys: str = "") -> str:
    """Smallest id reachable; ``keys`` is a column that separates graphs."""
    k, on = (f"{keys}, ", f"s.{keys} = r.{keys} AND ") if keys else ("", "")
    rk = f"r.{keys}, " if keys else ""
    return (
        f"{name}_s AS (SELECT {k}a, b FROM {edges} UNION SELECT {k}b, a FROM {edges}), "
        f"{name}_r({k}doc_id, m) AS (SELECT {k}a, a FROM {name}_s UNION SELECT {rk}s.b, r.m FROM {name}_r r JOIN {name}_s s ON {on}s.a = r.doc_id WHERE r.m < s.b), "
        f"{name} AS (SELECT {k}doc_id, min(m) AS comp FROM {name}_r GROUP BY ALL)"
    )


THREADS = (
    "threads AS (SELECT doc_id, c.comp, hilo, n FROM comps c JOIN (SELECT comp, n, 'H' || lpad((row_number() OVER (ORDER BY n DESC, comp) - 1)::VARCHAR, 4, '0') AS hilo "
    "FROM (SELECT comp, count(*) AS n FROM comps GROUP BY 1)) s USING (comp))"
)
DAYS = f"days AS (SELECT t.hilo, t.doc_id, d.fecha FROM threads t JOIN (SELECT id AS doc_id, {day('fecha_iso')} AS fecha FROM docs) d USING (doc_id) WHERE t.n >= 3 AND d.fecha IS NOT NULL)"
LABELS = "('mismo_proceso_especifico'), ('mismo_macroproceso'), ('relacionado_tematicamente'), ('no_relacionado'), ('indeterminado')"
_L = "'mismo_proceso_especifico', 'mismo_macroproceso', 'relacionado_tematicamente', 'no_relacionado', 'indeterminado'"


def label(c: str) -> str:
    v = f"trim(regexp_replace({plain(c)}, '[^a-z0-9]+', ' ', 'g'))"
    return f"(CASE WHEN replace({v}, ' ', '_') IN ({_L}) THEN replace({v}, ' ', '_') END)"


CASES = (
    f"cases AS (SELECT DISTINCT case_id, doc_a, doc_b, estrato, detalle, tiene_arista_directa AS directa, {label('decision_gpt')} AS a, "
    f"{label('decision_claude')} AS b, {label('decision_arbitro')} AS arb FROM intermediate_merged_cases)"
)


def query(*parts: str) -> str:
    """The last part selects; those before are named subqueries."""
    return "WITH RECURSIVE " + ", ".join(parts[:-1]) + " " + parts[-1]
