import datetime as dt
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramado.operators import agreement as A
from tramado.operators import corpus as C
from tramado.operators import graph as G
from tramado.operators import pairs as P
from tramado.operators import partitions as R
from tramado.operators import sampling as M
from tramado.operators import subthreads as B
from tramado.operators import temporal as X
from tramado.operators import threads as H
from tramado.operators import vectors as V

EDGE = "a string, b string, w double"
# A path a-b-c and a triangle d-e-f.
SMALL = [("a", "b", 0.9), ("b", "c", 0.4), ("d", "e", 0.8), ("e", "f", 0.8), ("d", "f", 0.8)]


def groups(edges):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def test_components(spark):
    """Many random graphs at once, each under its own key."""
    rng = random.Random(5)
    graphs = {str(k): [(str(rng.randint(0, 14)), str(rng.randint(0, 14))) for _ in range(rng.randint(1, 25))] for k in range(40)}
    df = spark.createDataFrame([(k, *e) for k, es in graphs.items() for e in es], "k string, a string, b string")
    got = {}
    for r in G.components(df, ["k"]).collect():
        got.setdefault(r.k, {})[r.doc_id] = r.comp
    assert got == {k: groups(es) for k, es in graphs.items()}


def test_components_of_long_paths_and_keys(spark):
    path = [(f"{i:03d}", f"{i + 1:03d}") for i in range(200)]
    df = spark.createDataFrame([("x", *e) for e in path] + [("y", *e) for e in path[::2]], "k string, a string, b string")
    got = {(r.k, r.comp) for r in G.components(df, ["k"]).collect()}
    assert ("x", "000") in got and len([g for g in got if g[0] == "x"]) == 1 and len([g for g in got if g[0] == "y"]) == 100
    assert G.components(df.limit(0).select("a", "b")).count() == 0


def test_structure(spark, rows):
    e = spark.createDataFrame(SMALL, EDGE)
    c = G.components(e.select("a", "b"))
    assert rows(G.bridges(e, c), "a", "b", "lado_menor") == [("a", "b", 1), ("b", "c", 1)]
    v = {r.doc_id: (r.articulacion, r.bicomponentes) for r in G.vertex_structure(e, c).collect()}
    assert v["b"] == (True, 2) and v["a"] == (False, 1) and v["d"] == (False, 1)
    assert dict(rows(G.cores(e))) == {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2, "f": 2}
    assert {r.doc_id: r.agrupamiento for r in G.clustering(e).collect()}["d"] == 1.0
    assert rows(G.path_lengths(e, c).where("largo = 2"), "pares") == [(1,)]
    assert {(r.a, r.b): r.intermediacion for r in G.edge_betweenness(e, c).collect()}[("a", "b")] == pytest.approx(4 / 6)


def test_bridges_and_cores_by_brute_force(spark):
    """Many random graphs side by side in one table."""
    rng = random.Random(8)
    graphs = [sorted({(f"{k:02d}-{a}", f"{k:02d}-{b}") for a, b in ((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(2, 24))) if a < b}) for k in range(30)]
    e = spark.createDataFrame([(*x, 1.0) for g in graphs for x in g], EDGE)
    bridges, cores = [], {}
    for links in graphs:
        n = lambda es: len(set(groups([*es, *[(v, v) for x in links for v in x]]).values()))  # noqa: E731, B023
        bridges += [x for x in links if n([y for y in links if y != x]) > n(links)]
        core, k, left = {}, 0, set(links)
        while len(core) < len({v for x in links for v in x}):
            deg = {v: 0 for x in links for v in x if v not in core}
            for x in left:
                for v in x:
                    deg[v] += 1
            v = min(deg, key=lambda y: (deg[y], y))
            k = max(k, deg[v])
            core[v] = k
            left = {x for x in left if v not in x}
        cores |= core
    assert sorted((r.a, r.b) for r in G.bridges(e, G.components(e.select("a", "b"))).collect()) == sorted(bridges)
    c = G.components(e.select("a", "b"))
    one = {(r.comp, r.a, r.b, r.lado_menor) for r in G.bridges(e, c).collect()}
    assert one == {(r.comp, r.a, r.b, r.lado_menor) for r in G.bridges(e, c, large=0).collect()}
    assert {r.doc_id: r.kcore for r in G.cores(e).collect()} == cores


@pytest.mark.parametrize("method", ["louvain", "leiden", "cpm", "infomap"])
def test_communities_find_two_cliques(spark, method):
    links = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "xy" for i, j in itertools.combinations(range(6), 2)] + [("x0", "y0", 0.1)]
    e = spark.createDataFrame(links, EDGE)
    got = {r.doc_id: r.comunidad for r in G.communities(e, G.components(e.select("a", "b")), method, resolution=0.5 if method == "cpm" else None).collect()}
    assert len({got[f"x{i}"] for i in range(6)}) == 1 and len(set(got.values())) == 2


@pytest.mark.parametrize("gap,s,ok", [(0, 0.8, False), (1, 0.8, True), (365, 0.4, True), (366, 0.49, False), (366, 0.5, True), (1095, 0.5, True), (1096, 0.8, False)])
def test_windows_of_pairs(spark, gap, s, ok):
    day = dt.date(2020, 1, 1)
    refs = spark.createDataFrame([(i, day + dt.timedelta(days=g), k, "r") for i, g in (("1", 0), ("2", gap)) for k in ("objeto", "territorio")], "doc_id string, fecha date, tipo string, referente string")
    freq = spark.createDataFrame([("objeto", "r", False, min(1.0, s / 0.5)), ("territorio", "r", False, max(0.0, (s - 0.5) / 0.3))], "tipo string, referente string, hub boolean, idf double")
    got = P.scored_pairs(refs, freq).collect()
    assert bool(got) == ok and (not ok or got[0].s_ref == pytest.approx(s))


def test_hubs_make_no_pairs_but_count(spark):
    d = dt.date(2020, 1, 1)
    refs = spark.createDataFrame([(i, d + dt.timedelta(days=int(i)), t, r) for i, t, r in (("1", "objeto", "h"), ("2", "objeto", "h"), ("3", "objeto", "h"), ("1", "actor", "x"), ("2", "actor", "x"))], "doc_id string, fecha date, tipo string, referente string")
    freq = spark.createDataFrame([("objeto", "h", True, 0.5), ("actor", "x", False, 1.0)], "tipo string, referente string, hub boolean, idf double")
    got = P.scored_pairs(refs, freq).collect()
    assert [(r.doc_i, r.doc_j, round(r.s_ref, 6)) for r in got] == [("1", "2", 0.45)]


def test_record_and_fallback(spark):
    cols = "id fecha_iso llm_project_name llm_main_conflict_place_name llm_main_conflict_place_type geo_comuna geo_provincia geo_region llm_demandant_actor_name llm_demanded_actor_name llm_contentious_action_type".split()
    data = [("1", "2024-05-01", "Planta Norte", None, "commune", None, None, None, None, None, "Recurso de Proteccion"), ("2", None, "", "Mina Sur", "mine", None, None, None, "B", "A", None), ("3", None, "", "Mina Sur", "commune", None, None, None, None, None, None)]
    got = {r.doc_id: r for r in C.records(spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))).collect()}
    assert (got["1"].proyecto, got["1"].familia, got["1"].fase) == ("planta norte", "judicial", "judicial::2024-05")
    assert got["2"].proyecto == "mina sur" and got["2"].organizacion == "a;b" and got["2"].fase == "otro::sin_fecha"
    assert got["3"].proyecto is None


def test_secondary(spark, rows):
    p = spark.createDataFrame([("a", "x", False, "o1"), ("b", "y", False, "o1;o2"), ("c", "z", False, "o9"), ("n", "SIN_SUBHILO_ESPECIFICO", True, "o1")], "doc_id string, subhilo string, abstuvo boolean, organizacion string")
    e = spark.createDataFrame([("a", "b", 0.75), ("a", "c", 0.9), ("b", "n", 0.7)], EDGE)
    assert rows(B.secondary(p, e), "doc_id", "secundarios") == [("a", "y"), ("b", "x"), ("n", "y")]
    assert B.secondary(p, e.withColumn("w", F.lit(0.59))).count() == 0
    assert B.crossings(e.limit(0), p).columns == ["a", "b", "w", "sub_a", "sub_b", "cruza"]


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    q = {r.p: round(r.q, 4) for r in X.benjamini_hochberg(df, "p").collect()}
    assert q == {0.01: 0.04, 0.03: 0.0533, 0.04: 0.0533, 0.5: 0.5}
    assert {r.p: round(r.q, 4) for r in X.benjamini_hochberg(df, "p", monotone=False).collect()}[0.03] == 0.06


def test_gaps_and_bursts(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("h", str(i), d + dt.timedelta(days=x)) for i, x in enumerate([0, 10, 30, 31, 100])], "hilo string, doc_id string, fecha date")
    g = X.gaps(df, ["hilo"]).first()
    assert (g.max_gap, g.tras_gap, g.dur, g.docs) == (69, 1, 100, 5)
    assert X.bursts(df, ["hilo"]).first().rafaga == 3


def test_permutation_keeps_strata(spark):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(str(i), d + dt.timedelta(days=i), str(i % 2)) for i in range(20)], "doc_id string, fecha date, s string")
    got = X.permuted_dates(df, df, ["s"], 3, 1).collect()
    assert len(got) == 60
    for rep in (1, 2, 3):
        for s in (0, 1):
            assert sorted(r.fecha for r in got if r.rep == rep and int(r.doc_id) % 2 == s) == [d + dt.timedelta(days=i) for i in range(s, 20, 2)]


def test_false_discovery_by_family(spark):
    """Against the definition, family by family, with equal p values."""
    rng = random.Random(2)
    data = [(k, f"{i:02d}", round(rng.random(), 1)) for k in ("a", "b") for i in range(25)]
    df = spark.createDataFrame(data, "k string, id string, p double")
    got = {(r.k, r.id): r.q for r in X.benjamini_hochberg(df, "p", ["k"], "id").collect()}
    capped = {(r.k, r.id): r.q for r in X.benjamini_hochberg(df, "p", ["k"], "id", monotone=False).collect()}
    for k in ("a", "b"):
        mine = sorted((p, i) for f, i, p in data if f == k)
        raw = [p * len(mine) / r for r, (p, _) in enumerate(mine, 1)]
        for r, (_, i) in enumerate(mine):
            assert got[k, i] == pytest.approx(min(1.0, *raw[r:])) and capped[k, i] == pytest.approx(min(1.0, raw[r]))


def test_grown_threads_stay_in_reach(spark):
    t = spark.createDataFrame([("h", 4, 0.0, 100), ("g", 3, 0.0, 5000)], "hilo string, n long, largo double, primero int")
    got = X.grown_threads(t, [(100, 3), (150, 4), (400, 2), (5000, 1), (9000, 9)], 20, 1).collect()
    assert {r.hilo for r in got} == {"h"} and len(got) == 20  # nothing else is within a year of day 5000
    assert all(r.dur <= 300 and r.max_gap <= 300 for r in got)


def test_pseudo_threads_have_their_size(spark):
    df = spark.createDataFrame([(f"{i:02d}", dt.date(2020, 1, 1)) for i in range(40)], "doc_id string, fecha date")
    got = X.pseudo_threads(df, spark.createDataFrame([(3,), (8,)], "n long"), 5, 1).groupBy("n", "rep").agg(F.count_distinct("doc_id").alias("k")).collect()
    assert len(got) == 10 and all(r.k == r.n for r in got)


def test_kappa_and_confusion(spark):
    cells = [(0, 0, 49), (0, 1, 10), (0, 2, 2), (1, 0, 7), (1, 1, 32), (1, 2, 4)]
    df = spark.createDataFrame([(A.LABELS[a], A.LABELS[b]) for a, b, n in cells for _ in range(n)] + [(None, A.LABELS[0])], "a string, b string")
    k = A.kappa(df, "a", "b").first()
    assert k.casos == 104 and k.acuerdo == pytest.approx(81 / 104) and k.kappa == pytest.approx(0.5724, abs=1e-4)
    table = {r.etiqueta: r for r in A.confusion(df, "a", "b").collect()}
    assert len(table) == 5 and table[A.LABELS[0]][A.LABELS[1]] == 10 and table[A.LABELS[4]][A.LABELS[0]] == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=3, max_size=12))
def test_partition_measures(spark, labels):
    a = spark.createDataFrame([(str(i), x) for i, (x, _) in enumerate(labels)], "doc_id string, grupo int")
    b = spark.createDataFrame([(str(i), y) for i, (_, y) in enumerate(labels)], "doc_id string, grupo int")
    same = R.compare(a, a).first()
    assert same.ari in (None, pytest.approx(1.0)) and same.vi == pytest.approx(0, abs=1e-9)
    r = R.compare(a, b).first()
    pair = lambda k: {p for p in itertools.combinations(range(len(labels)), 2) if labels[p[0]][k] == labels[p[1]][k]}
    x, y = pair(0), pair(1)
    assert (r.pares_a, r.pares_b, r.pares_ambos) == (len(x), len(y), len(x & y))


def test_sampling_repeats(spark, rows):
    df = spark.createDataFrame([(str(i), str(i % 3)) for i in range(60)], "id string, s string")
    a, b = M.simple(df, 10, 1, "id"), M.simple(df.repartition(7), 10, 1, "id")
    assert rows(a) == rows(b) and a.count() == 10 and rows(M.simple(df, 10, 2, "id")) != rows(a)
    assert {r["s"]: r["count"] for r in M.stratified(df, "s", 4, 1, "id").groupBy("s").count().collect()} == {"0": 4, "1": 4, "2": 4}
    q = M.quintiles(spark.createDataFrame([(float(i // 2),) for i in range(20)], "w double"), "w").groupBy("w").agg(F.count_distinct("quintil").alias("k"))
    assert {r.k for r in q.collect()} == {1}


def test_rank_test_against_direct_count(spark):
    rng = random.Random(3)
    data = [(rng.random() < 0.4, float(rng.randint(0, 9))) for _ in range(80)]
    r = X.mann_whitney(spark.createDataFrame(data, "g boolean, v double"), "g", "v").first()
    one, two = [v for g, v in data if g], [v for g, v in data if not g]
    assert r.u == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in one for y in two)) and 0 <= r.p <= 1


def test_neighbours_by_brute_force(spark):
    rng = random.Random(1)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, v array<double>")
    got = {}
    for r in V.window_neighbours(df, df, "id", "v", "id", 7, 3).collect():
        got.setdefault(r.id, []).append((round(r.coseno, 6), r.vecino))
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(a * a for a in y)) ** 0.5
    for i, v in data:
        want = sorted(((round(cos(v, y), 6), j) for j, y in data if j != i and abs(i - j) <= 7 and cos(v, y) > 0), reverse=True)[:3]
        assert sorted(got.get(i, []), reverse=True) == want


def test_numbering(spark, rows):
    c = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")], "doc_id string, comp string")
    assert {r.comp: r.hilo for r in H.numbered(c).collect()} == {"c": "H0000", "a": "H0001"}


def test_empty_and_tiny_corpora(spark):
    cols = "id fecha_iso titulo llm_project_name llm_main_conflict_place_name llm_main_conflict_place_type geo_comuna geo_provincia geo_region llm_demandant_actor_name llm_demanded_actor_name llm_contentious_action_type".split()
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in cols) + ", cargado_en timestamp")
    assert C.coverage(C.latest(empty)).first().docs == 0 and C.referents(empty).count() == 0 and C.records(empty).count() == 0
    assert C.aliases(C.acronym_forms(C.referents(empty))).count() == 0
    five = spark.createDataFrame([(str(i), None, "t", "Mina Sur") + (None,) * 8 + (None,) for i in range(5)], empty.schema)
    refs = C.referents(C.latest(five))
    assert {r.idf for r in P.frequencies(refs, 5).collect()} == {1.0} and P.scored_pairs(refs, P.frequencies(refs, 5)).count() == 0
    none = spark.createDataFrame([], "tau double, a string, b string, dias int")
    assert H.grid_summary(none, spark.createDataFrame([], "tau double, doc_id string, comp string"), 0).count() == 0
    assert A.kappa(spark.createDataFrame([], "a string, b string"), "a", "b").first().kappa is None
