"""Queries on graph topology, communities, and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import order as O
from ..operators import pairs as P
from ..operators import partitions as R
from ..operators import sampling as M
from ..operators import temporal as X
from ..operators import vectors as V
from ..sources.tables import Scratch, table
from . import sql as Q
from .corpus import docs, refs
from .threads import TAU, edges


def accepted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges at the working threshold and their components, each written once."""
    scratch = Scratch(spark, "graph")
    e = scratch.write(edges(spark, d).where(P.accepted(F.lit(TAU))).select("a", "b", "w", "dias", "s_ref"))
    return e, scratch.write(G.components(e.select("a", "b")))


def graph_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Degree, weighted degree, triangles and clustering of each vertex."""
    e, _ = accepted(spark, d)
    return G.clustering(e).select("doc_id", "grado", F.round("grado_w", 6).alias("grado_w"), "tri", F.round("agrupamiento", 6).alias("agrupamiento"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    e, _ = accepted(spark, d)
    return G.edge_features(e).select("a", "b", "ga", "gb", "comunes", F.round("incrustacion", 6).alias("incrustacion"))


def graph_density(spark: SparkSession, d: str) -> DataFrame:
    """Size and density of each component."""
    e, c = accepted(spark, d)
    n = c.groupBy("comp").agg(F.count("*").alias("nodos"))
    m = e.join(c.withColumnRenamed("doc_id", "a"), "a").groupBy("comp").agg(F.count("*").alias("aristas"))
    return n.join(m, "comp").select("comp", "nodos", "aristas", F.round(S.density(F.col("nodos"), F.col("aristas")), 6).alias("densidad"))


def graph_cores(spark: SparkSession, d: str) -> DataFrame:
    e, _ = accepted(spark, d)
    return G.cores(e)


def graph_structure(spark: SparkSession, d: str) -> DataFrame:
    """Articulation points and membership in biconnected components."""
    return G.vertex_structure(*accepted(spark, d)).drop("comp")


def graph_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Bridges, whether they are weak, and the documents their loss cuts off."""
    return G.bridges(*accepted(spark, d)).select("a", "b", (F.col("w") < 0.5).alias("debil"), "lado_menor")


def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by length of the shortest path, with diameter and mean of each component."""
    x = G.path_lengths(*accepted(spark, d))
    return x.groupBy("comp").agg(F.max("largo").alias("diametro"), F.sum("pares").alias("pares"), F.round(F.sum(F.col("largo") * F.col("pares")) / F.sum("pares"), 6).alias("medio"))


def graph_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_betweenness(*accepted(spark, d)).select("a", "b", F.round("intermediacion", 9).alias("intermediacion"))


def graph_satellites(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hang on loosely, by several definitions."""
    e, c = accepted(spark, d)
    x = G.vertex_structure(e, c).join(G.degrees(e), "doc_id")
    return x.agg(F.count_if(F.col("grado") <= 2).alias("grado_hasta_2"), F.count_if(F.col("grado") == 1).alias("grado_1"), F.count_if("articulacion").alias("articulaciones"), F.count_if(F.col("bicomponentes") > 1).alias("en_varios_bicomponentes"))


def _scenarios(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e, c = accepted(spark, d)
    b = G.bridges(e, c).select("a", "b", F.lit(True).alias("puente"))
    x = e.join(b, ["a", "b"], "left").withColumn("puente", F.coalesce("puente", F.lit(False)))
    keep = {"P0": F.lit(True), "P1": ~F.col("puente"), "P2": ~(F.col("puente") & (F.col("w") < 0.5)), "S048": F.col("w") >= 0.48, "S050": F.col("w") >= 0.50, "S052": F.col("w") >= 0.52}
    rows = x.withColumn("escenario", F.explode(F.array(*[F.when(k, F.lit(n)) for n, k in keep.items()]))).where("escenario is not null")
    return Scratch(spark, "scenarios").write(rows), c


def graph_pruning(spark: SparkSession, d: str) -> DataFrame:
    """What is left of components and pairs when edges are cut by scenario: without bridges, without weak ones, or above
    a weight. All scenarios share the rounds of one component run."""
    e, c = _scenarios(spark, d)
    now = G.components(e.select("escenario", "a", "b"), ["escenario"])
    size = now.groupBy("escenario", "comp").agg(F.count("*").alias("n"))
    total = c.groupBy("comp").agg(F.count("*").alias("n")).agg(F.sum(S.pairs_of(F.col("n")))).first()[0] or 0
    x = size.groupBy("escenario").agg(F.count("*").alias("componentes"), F.max("n").alias("mayor"), F.sum(S.pairs_of(F.col("n"))).alias("p"))
    return x.join(e.groupBy("escenario").agg(F.count("*").alias("aristas")), "escenario").select("escenario", "aristas", "componentes", "mayor", F.round(F.col("p") / F.lit(float(max(total, 1))), 6).alias("retencion"))


def _communities(spark: SparkSession, d: str, method: str, seeds=(0,)) -> DataFrame:
    return G.communities(*accepted(spark, d), method, seeds)


def _communities_query(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = _communities(spark, d, method)
        return x.select("doc_id", F.concat_ws("-", "comp", "comunidad").alias("comunidad"))

    run.__name__, run.__doc__ = f"community_{method}", f"Communities by {method}."
    return run


def community_comparison(spark: SparkSession, d: str) -> DataFrame:
    """How alike the methods' communities are to the given ones and to the components."""
    e, c = accepted(spark, d)
    base = c.select("doc_id", F.col("comp").alias("grupo"))
    out = None
    for m in ("louvain", "leiden", "cpm", "infomap"):
        x = G.communities(e, c, m).select("doc_id", F.concat_ws("-", "comp", "comunidad").alias("grupo"))
        r = R.compare(base, x).withColumn("metodo", F.lit(m))
        out = r if out is None else out.union(r)
    return out.select("metodo", "docs", "grupos_b", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"), F.round("vi", 6).alias("vi"), F.round("retencion", 6).alias("retencion"))


def community_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Communities over a grid of resolutions of the constant Potts model."""
    e, c = accepted(spark, d)
    out = None
    for r in (0.05, 0.1, 0.2):
        x = G.communities(e, c, "cpm", resolution=r).agg(F.lit(r).alias("resolucion"), F.count_distinct("comp", "comunidad").alias("comunidades"))
        out = x if out is None else out.union(x)
    return out


def community_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Components of the edges whose ends are together in at least half of eighty runs: twenty seeds of four methods."""
    e, c = accepted(spark, d)
    runs = None
    for k, method in enumerate(("louvain", "leiden", "cpm", "infomap")):
        x = G.communities(e, c, method, range(20)).withColumn("semilla", F.col("semilla") + 20 * k)
        runs = x if runs is None else runs.union(x)
    both = G.coassignment(Scratch(spark, "runs").write(runs), e).where("parte >= 0.5")
    return G.components(both.select("a", "b")).groupBy("comp").agg(F.count("*").alias("docs"))


def community_given(spark: SparkSession, d: str) -> DataFrame:
    """The communities in the node table: agreement of two of its partitions by document."""
    x = table(spark, d, "h0000_02_node_metrics").dropDuplicates(["doc_id", "comunidad_louvain", "comunidad_infomap"])
    one = x.groupBy("doc_id").agg(F.min("comunidad_louvain").alias("l"), F.min("comunidad_infomap").alias("i"))
    r = R.compare(one.select("doc_id", F.col("l").alias("grupo")), one.select("doc_id", F.col("i").alias("grupo")))
    return r.select("docs", "grupos_a", "grupos_b", F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"), F.round("vi", 6).alias("vi"))


def graph_heterogeneous(spark: SparkSession, d: str, reps: int = 300) -> DataFrame:
    """Paths of two steps whose ends share neither project nor territory, against documents' referents permuted: by
    replicate, 0 being the real assignment."""
    e, c = accepted(spark, d)
    one = refs(spark, d).where("tipo <> 'actor'").groupBy("doc_id").pivot("tipo", ["objeto", "territorio"]).agg(F.min("referente"))
    r = Scratch(spark, "donors").write(one.na.drop().join(c.select("doc_id"), "doc_id", "left_semi"))
    return G.mixed_paths(e, r, "objeto", "territorio", reps, 17)


def graph_bridge_features(spark: SparkSession, d: str) -> DataFrame:
    """Do bridges weigh less than other edges? Rank test."""
    e, c = accepted(spark, d)
    b = G.bridges(e, c).select("a", "b", F.lit(True).alias("puente"))
    x = e.join(b, ["a", "b"], "left").select(F.coalesce("puente", F.lit(False)).alias("puente"), "w")
    return X.mann_whitney(x, "puente", "w").select("n", "n1", "u", F.round("z", 6).alias("z"), F.round("p", 6).alias("p"))


def graph_long_edges(spark: SparkSession, d: str) -> DataFrame:
    """Do edges over a year weigh less? Rank test, exact counts."""
    e = edges(spark, d).where("dias is not null")
    return X.mann_whitney(e.select((F.col("dias") > 365).alias("larga"), "w"), "larga", "w").select("n", "n1", "u", F.round("z", 6).alias("z"))


def graph_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of mean weight between near and far edges with its bootstrap interval."""
    e = edges(spark, d).where("dias is not null").select((F.col("dias") <= 365).alias("corta"), "w", F.concat_ws("|", "a", "b").alias("_id"))
    return M.bootstrap_difference(e, "corta", "w", 2000, 3)


def emb_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest vectors within 365 ids of every vector whose id is divisible by a hundred, among all."""
    x = table(spark, d, "embeddings")
    return V.window_neighbours(x.where("vec_id % 100 = 0"), x, "vec_id", "embedding", "vec_id", 365, 5).select("vec_id", "vecino", F.round("coseno", 6).alias("coseno"))


def emb_graph(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors linked as neighbours with a cosine of at least 0.3, by size."""
    x = table(spark, d, "embeddings")
    e = V.undirected(V.window_neighbours(x, x, "vec_id", "embedding", "vec_id", 365, 15), "vec_id").where("w >= 0.3")
    return G.components(e).groupBy("comp").agg(F.count("*").alias("docs"))


def emb_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of all pairs by label."""
    x = X.coherence(table(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label")
    return x.select("label", "docs", F.round("coherencia", 6).alias("coherencia"))


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases: documents whose title names the same place; groups: threads."""
    place = F.regexp_extract("titulo", "kilómetros de ([A-Z][a-z]+)", 1)
    gold = docs(spark, d).select(F.col("id").alias("doc_id"), place.alias("caso")).where("caso <> ''")
    _, c = accepted(spark, d)
    return gold, c.select("doc_id", F.col("comp").alias("grupo"))


def gold_recovery(spark: SparkSession, d: str) -> DataFrame:
    x = R.recovery(*_gold(spark, d))
    return x.select("caso", "docs", *[F.round(k, 6).alias(k) for k in ("cobertura", "recuperado", "pureza")], "fragmentos")


def gold_average(spark: SparkSession, d: str) -> DataFrame:
    """Means over cases, each rounded first; null without cases."""
    x = R.recovery(*_gold(spark, d))
    return x.agg(F.count("*").alias("casos"), *[F.round(F.avg(F.round(k, 3)), 6).alias(k) for k in ("cobertura", "recuperado", "pureza")])


def gold_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title contains any keyword of a catalogue entry. Keywords are whole words of the title here, so
    both sides join on the word instead of every title being compared with every entry."""
    from ..functions.text import keywords

    entry = table(spark, d, "subhilo_catalogo").select("subhilo_id", F.explode(keywords(F.col("nombre"), stop=("central", "parque", "planta", "puerto", "proyecto", "vertedero", "tranque", "linea", "embalse"))).alias("palabra"))
    title = docs(spark, d).select("id", F.explode(keywords(F.col("titulo"), most=99)).alias("palabra"))
    return title.join(entry, "palabra").groupBy("subhilo_id").agg(F.count_distinct("id").alias("docs"))


def graph_block_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree that bridges make of a component's blocks, the parts left without bridges: blocks, leaves, the largest
    block, and the pairs of documents that only a bridge connects. Components that have bridges."""
    e, c = accepted(spark, d)
    b = Scratch(spark, "blocks").write(G.bridges(e, c).select("comp", "a", "b"))
    inner = G.components(e.select("a", "b").join(b.select("a", "b"), ["a", "b"], "left_anti"))
    block = c.join(inner.withColumnRenamed("comp", "bloque"), "doc_id", "left").select("doc_id", "comp", F.coalesce("bloque", "doc_id").alias("bloque"))
    ends = b.select("comp", F.explode(F.array("a", "b")).alias("doc_id")).join(block.select("doc_id", "bloque"), "doc_id")
    degree = ends.groupBy("comp", "bloque").agg(F.count("*").alias("puentes"))
    size = block.join(b.select("comp").distinct(), "comp", "left_semi").groupBy("comp", "bloque").agg(F.count("*").alias("n"))
    x = size.join(degree, ["comp", "bloque"], "left").groupBy("comp").agg(F.count("*").alias("bloques"), F.count_if(F.col("puentes") == 1).alias("hojas"), F.max("n").alias("mayor"), (S.pairs_of(F.sum("n")) - F.sum(S.pairs_of(F.col("n")))).cast("long").alias("pares_por_puente"))
    return x


def stability_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities with a twentieth and a tenth of the edges dropped, over twenty seeds each: retention of pairs and
    variation of information against the communities of all edges."""
    x = G.perturbed(*accepted(spark, d), [(share, seed) for share in (5, 10) for seed in range(1, 21)])
    return x.select("porcentaje", "semilla", F.round("retencion", 6).alias("retencion"), F.round("vi", 6).alias("vi"))


def sample_unlike_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five near pairs of vectors that share no label: near by content, unrelated by what is known of them."""
    x = table(spark, d, "embeddings")
    near = V.undirected(V.window_neighbours(x, x, "vec_id", "embedding", "vec_id", 365, 15), "vec_id").where("w >= 0.2")
    label = x.select(F.col("vec_id").cast("string").alias("id"), "label")
    j = near.join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return M.simple(j.where("la <> lb").select("a", "b"), 25, 5, "a", "b")


def sample_missed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one gold case in different threads and without a link: documents in hash order, two by two, at most two
    pairs a case."""
    gold, group = _gold(spark, d)
    order = F.row_number().over(W.partitionBy("caso").orderBy(M.ticket(6, "doc_id"), "doc_id")) - 1
    x = gold.withColumn("r", order).where("r < 4").join(group, "doc_id", "left")
    pair = x.groupBy("caso", F.floor(F.col("r") / 2).alias("k")).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"), F.count_distinct("grupo").alias("g"), F.count("grupo").alias("in_"))
    pair = pair.where("n = 2 and not (in_ = 2 and g = 1)")
    return pair.join(edges(spark, d).select("a", "b"), ["a", "b"], "left_anti").select("caso", "a", "b")


QUERIES = {f.__name__: f for f in (
    graph_block_tree, stability_communities, sample_unlike_neighbours, sample_missed_pairs, graph_vertices, graph_edges, graph_density, graph_cores, graph_structure, graph_bridges, graph_paths, graph_betweenness, graph_satellites,
    graph_pruning, graph_heterogeneous, graph_bridge_features, graph_long_edges, graph_bootstrap,
    *[_communities_query(m) for m in ("louvain", "leiden", "cpm", "infomap")], community_comparison, community_resolutions, community_consensus, community_given,
    emb_neighbours, emb_graph, emb_coherence, gold_recovery, gold_average, gold_tokens,
)}

_E45 = "e45 AS (SELECT * FROM edges WHERE w >= 0.45 AND (dias <= 365 OR s_ref >= 0.5))"
_G = (Q.EDGES, _E45, "s AS (SELECT a AS v, b AS x, w FROM e45 UNION ALL SELECT b, a, w FROM e45)")
_C = (*_G, Q.components("e45"))
_TRI = "tri AS (SELECT p.v AS x, p.x AS y, q.x AS z FROM s p JOIN s q ON q.v = p.v AND p.x < q.x JOIN e45 e ON e.a = p.x AND e.b = q.x)"
_BFS = "d0(src, v, k) AS (SELECT v, v, 0 FROM (SELECT DISTINCT v FROM s) UNION SELECT src, s.x, k + 1 FROM d0 JOIN s ON s.v = d0.v WHERE k < 25), dd AS (SELECT src, v, min(k) AS k FROM d0 GROUP BY ALL)"
_REC = (
    "gold AS (SELECT id AS doc_id, regexp_extract(titulo, 'kilómetros de ([A-Z][a-z]+)', 1) AS caso FROM docs WHERE regexp_matches(titulo, 'kilómetros de ([A-Z][a-z]+)')), size AS (SELECT comp, count(*) AS tam FROM comps GROUP BY 1), cs AS (SELECT caso, count(*) AS docs FROM gold GROUP BY 1), "
    "j AS (SELECT caso, comp, count(*) AS n FROM gold JOIN comps USING (doc_id) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY caso ORDER BY n DESC, tam) AS r FROM j JOIN size USING (comp) JOIN cs USING (caso)), "
    "rec AS (SELECT cs.caso, cs.docs, coalesce(sum(n), 0) / cs.docs AS cobertura, coalesce(max(n) FILTER (r = 1) / cs.docs, 0) AS recuperado, max(n) FILTER (r = 1) / max(tam) FILTER (r = 1) AS pureza, count(*) FILTER (n >= 0.1 * cs.docs) AS fragmentos FROM cs LEFT JOIN b ON b.caso = cs.caso GROUP BY cs.caso, cs.docs)"
)
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_U_TEST = "t AS (SELECT w, count(*) AS t, count(*) FILTER (dias > 365) AS a FROM edges WHERE dias IS NOT NULL AND w IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rk FROM t), m AS (SELECT sum(t)::BIGINT AS n, sum(a)::BIGINT AS n1, sum(a * rk) - sum(a) * (sum(a) + 1) / 2 AS u, sum(t::DOUBLE * t * t - t) AS ties FROM r)"
# A bridge is an edge whose ends don't reach each other without it: by search from one end over all other edges.
_BRIDGES = (
    "reach(a, b, v) AS (SELECT a, b, a FROM e45 UNION SELECT r.a, r.b, s.x FROM reach r JOIN s ON s.v = r.v WHERE NOT (s.v = r.a AND s.x = r.b) AND NOT (s.v = r.b AND s.x = r.a)), "
    "side AS (SELECT a, b, count(*) AS n, count(*) FILTER (v = b) AS meets FROM reach GROUP BY ALL), total AS (SELECT comp, count(*) AS t FROM comps GROUP BY 1), "
    "br AS (SELECT side.a, side.b, w, comp, least(n, t - n) AS lado_menor FROM side JOIN e45 USING (a, b) JOIN comps ON comps.doc_id = side.a JOIN total USING (comp) WHERE meets = 0)"
)
_SCEN = (
    "sc AS (SELECT x.esc AS escenario, e45.a, e45.b FROM e45 LEFT JOIN (SELECT a, b, 1 AS p FROM br) q USING (a, b), (VALUES ('P0'), ('P1'), ('P2'), ('S048'), ('S050'), ('S052')) x(esc) "
    "WHERE CASE esc WHEN 'P0' THEN true WHEN 'P1' THEN p IS NULL WHEN 'P2' THEN p IS NULL OR w >= 0.5 WHEN 'S048' THEN w >= 0.48 WHEN 'S050' THEN w >= 0.5 ELSE w >= 0.52 END)"
)
ORACLE = {
    "graph_bridges": Q.query(*_C, _BRIDGES, "SELECT a, b, w < 0.5 AS debil, lado_menor FROM br"),
    "graph_pruning": Q.query(*_C, _BRIDGES, _SCEN, Q.components("sc", "cut", "escenario"), "tp AS (SELECT sum(t * (t - 1) / 2) AS tp FROM total), z AS (SELECT escenario, comp, count(*) AS n FROM cut GROUP BY ALL)", "SELECT escenario, aristas, componentes, mayor, round(p / tp, 6) AS retencion FROM (SELECT escenario, count(*) AS componentes, max(n) AS mayor, sum(n * (n - 1) / 2) AS p FROM z GROUP BY 1) JOIN (SELECT escenario, count(*) AS aristas FROM sc GROUP BY 1) USING (escenario), tp"),
    "graph_block_tree": Q.query(*_C, _BRIDGES, "inn AS (SELECT a, b FROM e45 WHERE (a, b) NOT IN (SELECT (a, b) FROM br))", Q.components("inn", "blk"), "bl AS (SELECT comps.doc_id, comps.comp, coalesce(blk.comp, comps.doc_id) AS bloque FROM comps LEFT JOIN blk USING (doc_id)), dg AS (SELECT bl.comp, bloque, count(*) AS puentes FROM (SELECT a AS doc_id FROM br UNION ALL SELECT b FROM br) JOIN bl USING (doc_id) GROUP BY ALL), sz AS (SELECT comp, bloque, count(*) AS n FROM bl WHERE comp IN (SELECT comp FROM br) GROUP BY ALL)", "SELECT comp, count(*) AS bloques, count(*) FILTER (puentes = 1) AS hojas, max(n) AS mayor, (sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2))::BIGINT AS pares_por_puente FROM sz LEFT JOIN dg USING (comp, bloque) GROUP BY 1"),
    "graph_vertices": Q.query(*_G, _TRI, "tv AS (SELECT v, count(*) AS tri FROM (SELECT x AS v FROM tri) GROUP BY 1), g AS (SELECT v, count(*) AS grado, sum(w) AS gw FROM s GROUP BY 1)", "SELECT g.v AS doc_id, grado, round(gw, 6) AS grado_w, coalesce(tri, 0) AS tri, round(CASE WHEN grado > 1 THEN 2 * coalesce(tri, 0) / (grado * (grado - 1)) ELSE 0 END, 6) AS agrupamiento FROM g LEFT JOIN tv ON tv.v = g.v"),
    "graph_edges": Q.query(*_G, "g AS (SELECT v, count(*) AS g FROM s GROUP BY 1), c AS (SELECT a, b, count(q.x) AS comunes FROM e45 JOIN s p ON p.v = a LEFT JOIN s q ON q.v = b AND q.x = p.x GROUP BY ALL)", "SELECT a, b, x.g AS ga, y.g AS gb, comunes, round(comunes / greatest(1, x.g - 1 + y.g - 1 - comunes), 6) AS incrustacion FROM c JOIN g x ON x.v = a JOIN g y ON y.v = b"),
    "graph_density": Q.query(*_C, "n AS (SELECT comp, count(*) AS nodos FROM comps GROUP BY 1), m AS (SELECT comp, count(*) AS aristas FROM e45 JOIN comps ON doc_id = a GROUP BY 1)", "SELECT comp, nodos, aristas, round(2 * aristas / (nodos * (nodos - 1)), 6) AS densidad FROM n JOIN m USING (comp)"),
    "graph_paths": Q.query(*_C, _BFS, "SELECT comp, max(k) AS diametro, count(*) AS pares, round(sum(k) / count(*), 6) AS medio FROM dd JOIN comps ON doc_id = src WHERE src < v GROUP BY 1"),
    "graph_heterogeneous": Q.query(Q.DOCS, Q.REFS, *_G, "o AS (SELECT doc_id, max(referente) FILTER (tipo = 'objeto') AS o, max(referente) FILTER (tipo = 'territorio') AS t FROM refs GROUP BY 1), n AS (SELECT * FROM o WHERE o IS NOT NULL AND t IS NOT NULL AND doc_id IN (SELECT v FROM s)), primes AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {p}::BIGINT)" for i, p in enumerate(O.primes(300), 1)) + ") v(rep, prime)), pa AS (SELECT doc_id, row_number() OVER (ORDER BY md5('17a|' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM n), ra AS (SELECT rep, doc_id, (k * prime + ('0x' || substr(md5('17|' || rep), 1, 8))::BIGINT) % n AS k FROM pa, primes), rb AS (SELECT doc_id AS donante, row_number() OVER (ORDER BY md5('17b|' || doc_id), doc_id) - 1 AS k FROM n), mp AS (SELECT rep, ra.doc_id, donante FROM ra JOIN rb USING (k) UNION ALL SELECT 0, doc_id, doc_id FROM n), lk AS (SELECT rep, mp.doc_id, o, t FROM mp JOIN n ON n.doc_id = donante)", "w AS (SELECT rep, s.v, o, t, count(*)::BIGINT AS n FROM s JOIN lk ON lk.doc_id = s.x GROUP BY ALL), one AS (SELECT rep, v, sum(n)::BIGINT AS n, sum(n * (n - 1) / 2)::BIGINT AS bo_t FROM w GROUP BY ALL), oo AS (SELECT rep, v, o, sum(n)::BIGINT AS n FROM w GROUP BY ALL), tt AS (SELECT rep, v, t, sum(n)::BIGINT AS n FROM w GROUP BY ALL), so AS (SELECT rep, sum(n * (n - 1) / 2)::BIGINT AS k FROM oo GROUP BY 1), st AS (SELECT rep, sum(n * (n - 1) / 2)::BIGINT AS k FROM tt GROUP BY 1), al AS (SELECT rep, sum(n * (n - 1) / 2)::BIGINT AS k, sum(bo_t)::BIGINT AS b FROM one GROUP BY 1)", "SELECT rep, al.k AS caminos, al.k - so.k - st.k + al.b AS heterogeneos FROM al JOIN so USING (rep) JOIN st USING (rep)"),
    "community_given": "WITH one AS (SELECT doc_id, min(comunidad_louvain) AS x, min(comunidad_infomap) AS y FROM h0000_02_node_metrics GROUP BY 1), c AS (SELECT x, y, count(*) AS m FROM one WHERE doc_id IS NOT NULL GROUP BY ALL), p AS (SELECT (SELECT sum(m)::BIGINT FROM c) AS n, (SELECT count(DISTINCT coalesce(x::VARCHAR, '?')) FROM c) AS ka, (SELECT count(DISTINCT coalesce(y::VARCHAR, '?')) FROM c) AS kb, (SELECT sum(m * (m - 1) / 2) FROM c) AS pab, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c GROUP BY x)) AS pa, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(m) AS m FROM c GROUP BY y)) AS pb, (SELECT -sum(m / t * ln(m / t)) FROM (SELECT m, sum(m) OVER () AS t FROM c)) AS hab, (SELECT -sum(m / t * ln(m / t)) FROM (SELECT sum(m) AS m, sum(sum(m)) OVER () AS t FROM c GROUP BY x)) AS ha, (SELECT -sum(m / t * ln(m / t)) FROM (SELECT sum(m) AS m, sum(sum(m)) OVER () AS t FROM c GROUP BY y)) AS hb) SELECT n AS docs, ka AS grupos_a, kb AS grupos_b, round((pab - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, round(2 * hab - ha - hb, 6) AS vi FROM p",
    "graph_long_edges": Q.query(Q.EDGES, _U_TEST, "SELECT n, n1, u, round(greatest(abs(u - n1 * (n - n1) / 2) - 0.5::DOUBLE, 0) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM m"),
    "emb_neighbours": f"WITH {_UNIT}, c AS (SELECT q.vec_id, r.vec_id AS vecino, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS coseno FROM u q JOIN u r ON r.vec_id BETWEEN q.vec_id - 365 AND q.vec_id + 365 AND r.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY coseno DESC, vecino) AS r FROM c WHERE coseno > 0) SELECT vec_id, vecino, round(coseno, 6) AS coseno FROM k WHERE r <= 5",
    "emb_graph": Q.query(_UNIT, "c AS (SELECT q.vec_id, r.vec_id AS vecino, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS coseno FROM u q JOIN u r ON r.vec_id BETWEEN q.vec_id - 365 AND q.vec_id + 365 AND r.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY coseno DESC, vecino) AS r FROM c WHERE coseno > 0), e AS (SELECT DISTINCT least(vec_id::VARCHAR, vecino::VARCHAR) AS a, greatest(vec_id::VARCHAR, vecino::VARCHAR) AS b FROM k WHERE r <= 15 AND coseno >= 0.3)", Q.components("e"), "SELECT comp, count(*) AS docs FROM comps GROUP BY 1"),
    "sample_missed_pairs": Q.query(Q.DOCS, *_C, _REC.split(", size AS")[0], "o AS (SELECT gold.*, row_number() OVER (PARTITION BY caso ORDER BY md5('6|' || doc_id), doc_id) - 1 AS r FROM gold), p AS (SELECT caso, r // 2 AS k, min(o.doc_id) AS a, max(o.doc_id) AS b, count(*) AS n, count(DISTINCT comp) AS g, count(comp) AS i FROM o LEFT JOIN comps ON comps.doc_id = o.doc_id WHERE r < 4 GROUP BY ALL)", "SELECT caso, a, b FROM p WHERE n = 2 AND NOT (i = 2 AND g = 1) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = p.a AND e.b = p.b)"),
    "sample_unlike_neighbours": f"WITH {_UNIT}, c AS (SELECT q.vec_id, r.vec_id AS vecino, list_sum(list_transform(list_zip(q.v, r.v), lambda z: z[1] * z[2])) AS coseno FROM u q JOIN u r ON r.vec_id BETWEEN q.vec_id - 365 AND q.vec_id + 365 AND r.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY coseno DESC, vecino) AS r FROM c WHERE coseno > 0), e AS (SELECT DISTINCT least(vec_id::VARCHAR, vecino::VARCHAR) AS a, greatest(vec_id::VARCHAR, vecino::VARCHAR) AS b FROM k WHERE r <= 15 AND coseno >= 0.2) SELECT a, b FROM e JOIN embeddings x ON x.vec_id::VARCHAR = a JOIN embeddings y ON y.vec_id::VARCHAR = b WHERE x.label <> y.label ORDER BY md5('5|' || a || '|' || b), a, b LIMIT 25",
    "emb_coherence": f"WITH {_UNIT}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), s AS (SELECT label, i, sum(x) AS s, count(*) AS m FROM e GROUP BY ALL) SELECT label, max(m) AS docs, round((sum(s * s) - max(m)) / (max(m) * (max(m) - 1)), 6) AS coherencia FROM s GROUP BY 1",
    "gold_recovery": Q.query(Q.DOCS, *_C, _REC, "SELECT caso, docs, round(cobertura, 6) AS cobertura, round(recuperado, 6) AS recuperado, round(pureza, 6) AS pureza, fragmentos FROM rec"),
    "gold_average": Q.query(Q.DOCS, *_C, _REC, "SELECT count(*) AS casos, round(avg(round(cobertura, 3)), 6) AS cobertura, round(avg(round(recuperado, 3)), 6) AS recuperado, round(avg(round(pureza, 3)), 6) AS pureza FROM rec"),
    "gold_tokens": Q.query(Q.DOCS, f"e AS (SELECT subhilo_id, unnest(list_filter(list_filter(k, lambda w, i: list_position(k, w) = i), lambda w: w NOT IN ('central', 'parque', 'planta', 'puerto', 'proyecto', 'vertedero', 'tranque', 'linea', 'embalse'))[1:6]) AS p FROM (SELECT subhilo_id, regexp_extract_all({Q.plain('nombre')}, '[a-z]{{5,}}') AS k FROM subhilo_catalogo)), t AS (SELECT id, unnest(regexp_extract_all({Q.plain('titulo')}, '[a-z]{{5,}}')) AS p FROM docs)", "SELECT subhilo_id, count(DISTINCT id) AS docs FROM t JOIN e USING (p) GROUP BY 1"),
}
