"""Replicates: nothing is copied by replicate into a join, and the ways without copies give the same."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tramado.operators import graph as G
from tramado.operators import order as O
from tramado.operators import partitions as R
from tramado.operators import sampling as M
from tramado.operators import temporal as X
from tramado.plans import threads as T
from tramado.plans import topology as P


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted((f"v{40 * g + rng.randrange(40):03d}", f"v{40 * g + rng.randrange(40):03d}"))) for g in range(4) for _ in range(60)}
    e = spark.createDataFrame([(a, b, rng.random()) for a, b in sorted(pairs) if a != b], "a string, b string, w double").cache()
    return e, G.components(e.select("a", "b")).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("few"))
    cols = ("id", "fecha_iso", "fuente", "cargado_en", "titulo", "llm_project_name", "llm_demandant_actor_name", "llm_demanded_actor_name", "llm_main_conflict_place_name", "geo_comuna", "geo_region")
    rows = [(f"d{i:02d}", str(dt.date(2020, 1, 1) + dt.timedelta(days=9 * i)), "x", "2024-01-01", *[None] * 7) for i in range(40)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)).write.parquet(f"{d}/f0_referent_coverage.parquet")
    links = [(f"d{i:02d}", f"d{i + 1:02d}", 9, 0.9, 0.9, 0.9) for i in range(38) if i % 5]
    spark.createDataFrame(links, "doc_i string, doc_j string, dias int, s_ref double, s_emb double, w double").write.parquet(f"{d}/f2b_idf_v2_l2_edges.parquet")
    return d


def test_jitter_joins_before_it_copies(spark, folder):
    plan = T.stability_jitter(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_pseudo_threads_broadcast_no_draws(spark):
    days = spark.createDataFrame([(f"d{i:03d}", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(300)], "doc_id string, fecha date")
    sets = X.pseudo_threads(days, spark.createDataFrame([(3,), (8,)], "n long"), 50, 7)
    assert "SortMergeJoin [pos" in sets._jdf.queryExecution().executedPlan().toString()
    assert {(r.n, r.k) for r in sets.groupBy("n", "rep").agg(F.count_distinct("doc_id").alias("k")).collect()} == {(3, 3), (8, 8)}


def test_sizes_join_values_not_threads(spark, folder, monkeypatch):
    """Equal threads cost no more draws than one of them."""
    seen, whole = [], X.empirical_p
    monkeypatch.setattr(X, "empirical_p", lambda real, null, keys, stat: (seen.append(null.count()), whole(real, null, keys, stat))[1])
    got = T.null_sizes(spark, folder, 20).collect()
    assert len(got) == 8 and {r.sorteos for r in got} == {20} and max(seen) <= 2 * 20


def test_kept_pairs_by_kernel_by_joins_and_by_copies(spark, graph, rows):
    e, c = graph
    kernel = rows(G.kept_pairs(e, c, 10, 6, 5))
    assert kernel == rows(G.kept_pairs(e, c, 10, 6, 5, large=10))
    k = M.drop_share(c.select("doc_id"), 10, 6, 5, "doc_id")
    sub = e.join(k.select("rep", F.col("doc_id").alias("a")), "a").join(k.select("rep", F.col("doc_id").alias("b")), ["rep", "b"])
    again = G.components(sub.select("rep", "a", "b"), ["rep"]).select("rep", "doc_id", F.col("comp").alias("grupo"))
    assert kernel == rows(R.recall_by_group(c.select("doc_id", F.col("comp").alias("grupo")), again, ["rep"]), "grupo", "rep", "recuperado")


def test_drop_makes_no_components_by_replicate(spark, folder, monkeypatch):
    keyed, whole = [], G.components
    monkeypatch.setattr(G, "components", lambda e, keys=None: (keyed.append(keys), whole(e, keys))[1])
    assert T.stability_drop(spark, folder).count() == 8 and keyed == [None]


def test_perturbed_communities_as_run_one_by_one(spark, graph):
    e, c = graph
    got = {(r.porcentaje, r.semilla): (r.retencion, r.vi) for r in G.perturbed(e, c, [(5, 1), (10, 3)]).collect()}
    name = F.concat_ws("-", "comp", "comunidad").alias("grupo")
    base = G.communities(e, c, "louvain").select("doc_id", name)
    for (share, seed), x in got.items():
        less = M.drop_share(e, share, 1, seed, "a", "b").drop("rep")
        r = R.compare(base, G.communities(less, G.components(less.select("a", "b")), "louvain").select("doc_id", name)).first()
        assert x == pytest.approx((r.retencion, r.vi))
    assert len(got) == 2 and 0.3 < got[5, 1][0] < 1


def test_communities_are_perturbed_in_one_pass(spark, folder, monkeypatch):
    ran, whole = [], G.components
    monkeypatch.setattr(G, "components", lambda e, keys=None: (ran.append(keys), whole(e, keys))[1])
    got = P.stability_communities(spark, folder).collect()
    assert len(got) == 40 and len(ran) == 1
    none = G.perturbed(*(x.limit(0) for x in P.accepted(spark, folder)), [(5, 1)]).collect()
    assert [tuple(r) for r in none] == [(5, 1, None, None)]


def test_mixed_paths_by_brute_force(spark, graph):
    e, _ = graph
    kinds = {f"v{i:03d}": (f"o{i % 3}", f"t{i % 5}") for i in range(160) if i % 7}
    df = spark.createDataFrame([(v, *k) for v, k in kinds.items()], "doc_id string, o string, t string")
    got = {r.rep: (r.caminos, r.heterogeneos) for r in G.mixed_paths(e, df, "o", "t", 4, 17).collect()}
    donor = {(r.rep, r.doc_id): r.donante for r in M.donors(df.select("doc_id"), "doc_id", 4, 17).collect()} | {(0, v): v for v in kinds}
    near = {}
    for a, b, _ in e.collect():
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for rep in range(5):
        ends = [[kinds[donor[rep, x]] for x in n if x in kinds] for n in near.values()]
        pairs = [p for n in ends for p in combinations(n, 2)]
        assert got[rep] == (len(pairs), sum(x[0] != y[0] and x[1] != y[1] for x, y in pairs))
    assert len(got) == 5 and len(O.primes(4)) == 4
