"""Graph operators on edge tables, keyed: a key (threshold, scenario, replicate) separates graphs that run together."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import hash_number
from ..sources.tables import Scratch
from .order import places, primes
from .partitions import recall_by_group
from .sampling import ticket

#: From so many edges a component's bridges are found by joins; steps of a task that searches from every vertex.
LARGE = 200_000
WORK = 20_000_000


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, doc_id, comp)`` for the ends of ``edges`` (columns a, b): the smallest id of its component.

    Alternating large-star and small-star: in a round, every vertex hangs its larger neighbours on the smallest vertex
    it sees, then the smaller ones. Rounds grow with the logarithm of the size, and a round is two aggregations with a
    map-side part, so a vertex with very many edges is no single task. Ends when a round changes nothing; the tables of
    a round are written to the shared folder and dropped. All keys share the rounds.
    """
    keys = keys or []
    scratch = Scratch(edges.sparkSession, "stars")
    now = scratch.write(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    vertices = scratch.write(edges.select(*keys, F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = e.where("u > v")
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("m", "u").alias("m"))
        j = both.join(least, [*keys, "u"])
        if large:
            j = j.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hang = j.select(*keys, F.col("v").alias("x"), "m").where("x <> m").select(*keys, F.col("x").alias("u"), F.col("m").alias("v"))
            j = hang.union(least.where("u <> m").select(*keys, "u", F.col("m").alias("v")))
        return j.where("u <> v").distinct()

    before = None
    while True:
        nxt = scratch.write(star(star(now, True), False))
        stamp = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*keys, "u", "v")).alias("h")).first()
        scratch.drop(now)
        now = nxt
        if before == (stamp["n"], stamp["h"]):
            break
        before = (stamp["n"], stamp["h"])
    label = now.select(*keys, F.col("u").alias("doc_id"), F.col("v").alias("comp"))
    return vertices.join(label, [*keys, "doc_id"], "left").select(*keys, "doc_id", F.coalesce("comp", "doc_id").alias("comp"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges from either end: ``(doc_id, other, w)``."""
    return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), "w").union(edges.select("b", "a", "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("doc_id").agg(F.count("*").alias("grado"), F.sum("w").alias("grado_w"))


def triangles(edges: DataFrame) -> DataFrame:
    """``(x, y, z)``, each triangle once. Edges point from the end of lower degree to the other, so a hub's edges are
    never paired with each other: work is at most edges times the square root of edges."""
    d = degrees(edges).select("doc_id", "grado")
    e = edges.join(d.select(F.col("doc_id").alias("a"), F.col("grado").alias("da")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("grado").alias("db")), "b")
    low = F.struct(F.col("da"), F.col("a")) < F.struct(F.col("db"), F.col("b"))
    o = e.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedge = o.select("s", F.col("t").alias("t1")).join(o.select("s", F.col("t").alias("t2")), "s").where("t1 < t2")
    close = edges.select(F.col("a").alias("t1"), F.col("b").alias("t2"))
    return wedge.join(close, ["t1", "t2"]).select(F.col("s").alias("x"), F.col("t1").alias("y"), F.col("t2").alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """Degree, triangles and clustering coefficient of each vertex."""
    t = triangles(edges).select(F.explode(F.array("x", "y", "z")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("tri"))
    x = degrees(edges).join(t, "doc_id", "left").withColumn("tri", F.coalesce("tri", F.lit(0)))
    coef = F.coalesce(F.try_divide(2 * F.col("tri"), F.col("grado") * (F.col("grado") - 1)), F.lit(0.0))
    return x.select("doc_id", "grado", "grado_w", "tri", coef.alias("agrupamiento"))


def edge_features(edges: DataFrame) -> DataFrame:
    """Common neighbours and embeddedness of each edge: common over all other neighbours of both ends."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("x", "y"), ("x", "z"), ("y", "z"))])).alias("e"))
    common = sides.groupBy("e.a", "e.b").agg(F.count("*").alias("comunes"))
    d = degrees(edges).select("doc_id", "grado")
    x = edges.join(common, ["a", "b"], "left").withColumn("comunes", F.coalesce("comunes", F.lit(0)))
    x = x.join(d.select(F.col("doc_id").alias("a"), F.col("grado").alias("ga")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("grado").alias("gb")), "b")
    rest = F.greatest(F.lit(1), (F.col("ga") - 1) + (F.col("gb") - 1) - F.col("comunes"))
    return x.select("a", "b", "w", "ga", "gb", "comunes", (F.col("comunes") / rest).alias("incrustacion"))


def cores(edges: DataFrame) -> DataFrame:
    """``(doc_id, kcore)`` by repeated h-index: a vertex's core number is the fixpoint of the largest h such that h
    neighbours have at least h. Each round is one join and one window; nothing is peeled one vertex at a time."""
    scratch = Scratch(edges.sparkSession, "cores")
    links = scratch.write(both_ways(edges).select("doc_id", "other").distinct())
    now = scratch.write(links.groupBy("doc_id").agg(F.count("*").alias("h")))
    while True:
        near = links.join(now.select(F.col("doc_id").alias("other"), F.col("h").alias("nh")), "other")
        # Neighbours by level first: the number at each level is small, however many neighbours a hub has.
        level = near.join(now, "doc_id").groupBy("doc_id", F.least("nh", "h").alias("lv")).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(W.partitionBy("doc_id").orderBy(F.desc("lv")))
        nxt = level.withColumn("m", F.least(upto, "lv")).groupBy("doc_id").agg(F.max("m").alias("h2"))
        nxt = scratch.write(nxt.join(now, "doc_id").select("doc_id", F.least("h2", "h").alias("h"), "h", F.least("h2", "h").alias("g")).toDF("doc_id", "new", "old", "g").select("doc_id", F.col("new").alias("h"), F.col("old")))
        changed = not nxt.where("h <> old").isEmpty()
        scratch.drop(now)
        now = nxt.select("doc_id", "h")
        now._scratch_path = nxt._scratch_path
        if not changed:
            return now.select("doc_id", F.col("h").alias("kcore"))


# Traversals run per component, as one kernel each; no component is left out. Searches from every vertex are cut into
# slices of sources, bridges of large components are found by joins; for the rest a component's edges must fit a task.
def _adjacency(a_: list[str], b_: list[str]) -> dict[str, list[str]]:
    near: dict[str, list[str]] = {}
    for a, b in zip(a_, b_):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return {v: sorted(n) for v, n in sorted(near.items())}


def lowlinks(near: dict[str, list[str]]) -> tuple[set[tuple[str, str]], set[str], list[set[str]], dict[tuple[str, str], int]]:
    """Bridges, articulation points, biconnected components, and for each bridge the size of the side below it: one
    depth-first pass without recursion."""
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    size: dict[str, int] = {}
    bridges, cuts, blocks, below = set(), set(), [], {}
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        size[root] = 1
        stack = [(root, "", iter(near[root]))]
        edges: list[tuple[str, str]] = []
        children = 0
        while stack:
            v, up, it = stack[-1]
            for x in it:
                if x not in order:
                    order[x] = low[x] = len(order)
                    size[x] = 1
                    edges.append((v, x))
                    stack.append((x, v, iter(near[x])))
                    children += v == root
                    break
                if x != up and order[x] < order[v]:
                    edges.append((v, x))
                    low[v] = min(low[v], order[x])
            else:
                stack.pop()
                if not up:
                    continue
                low[up] = min(low[up], low[v])
                size[up] += size[v]
                if low[v] >= order[up]:
                    if up != root:
                        cuts.add(up)
                    block: set[str] = set()
                    while True:
                        e = edges.pop()
                        block.update(e)
                        if e == (up, v):
                            break
                    blocks.append(block)
                if low[v] > order[up]:
                    e = (min(up, v), max(up, v))
                    bridges.add(e)
                    below[e] = size[v]
        if children > 1:
            cuts.add(root)
    return bridges, cuts, blocks, below


def _packed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """A row per component: ``(comp, m, e)`` with its number of edges and the edges (a, b, w)."""
    e = edges.join(comps.withColumnRenamed("doc_id", "a"), "a")
    return e.groupBy("comp").agg(F.count("*").alias("m"), F.collect_list(F.struct("a", "b", F.col("w").cast("double").alias("w"))).alias("e"))


def _spread(packed: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(comp, a, b, w, part, parts)`` for each row of ``packed`` (columns part and parts optional); it returns rows.
    Rows are spread over all tasks, heavy and light ones mixed."""
    names = [x.split()[0] for x in schema.split(", ")]
    if "part" not in packed.columns:
        packed = packed.withColumns({"part": F.lit(0), "parts": F.lit(1)})

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            out = []
            for comp, rows, part, parts in zip(pdf["comp"], pdf["e"], pdf["part"], pdf["parts"]):
                a, b, w = zip(*sorted((r["a"], r["b"], r["w"]) for r in rows))
                out += kernel(comp, a, b, w, part, parts)
            yield pd.DataFrame(out, columns=names)

    n = packed.sparkSession.sparkContext.defaultParallelism * 4
    return packed.select("comp", "e", "part", "parts").repartition(n, F.xxhash64("comp", "part")).mapInPandas(run, schema)


def vertex_structure(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``(comp, doc_id, articulacion, bicomponentes)``. One depth-first pass over a component, in one task."""

    def kernel(comp, a, b, w, part, parts):
        near = _adjacency(a, b)
        _, cuts, blocks, _ = lowlinks(near)
        member = dict.fromkeys(near, 0)
        for block in blocks:
            for v in block:
                member[v] += 1
        return [(comp, v, v in cuts, n) for v, n in member.items()]

    return _spread(_packed(edges, comps), kernel, "comp string, doc_id string, articulacion boolean, bicomponentes int")


def bridges(edges: DataFrame, comps: DataFrame, large: int = LARGE) -> DataFrame:
    """``(comp, a, b, w, lado_menor)``: edges whose loss splits a component, and the size of the smaller part. Components
    of more than ``large`` edges are done by joins, the others by a kernel each; both find the same."""

    def kernel(comp, a, b, w, part, parts):
        near = _adjacency(a, b)
        found, _, _, below = lowlinks(near)
        return [(comp, *e, x, min(below[e], len(near) - below[e])) for e, x in zip(zip(a, b), w) if e in found]

    scratch = Scratch(edges.sparkSession, "bridges")
    size = edges.join(comps.withColumnRenamed("doc_id", "a"), "a").groupBy("comp").agg(F.count("*").alias("m"))
    size = scratch.write(size.where(F.col("m") > large).select("comp"))
    schema = "comp string, a string, b string, w double, lado_menor long"
    if size.isEmpty():
        return _spread(_packed(edges, comps), kernel, schema)
    big = scratch.write(comps.join(size, "comp", "left_semi"))
    small = _spread(_packed(edges, comps.join(size, "comp", "left_anti")), kernel, schema)
    return small.union(_wide_bridges(edges.join(big.select(F.col("doc_id").alias("a")), "a", "left_semi"), big, scratch))


def _wide_bridges(edges: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Bridges by a breadth-first forest. Every edge outside the forest gets a random label; the labels met below a vertex
    cancel out (xor) if both their ends are there, so the edge above a vertex is a bridge if nothing remains: wrong with
    a chance of 2^-64. Rounds grow with the distance from a component's smallest document, not with its size."""
    links = scratch.write(both_ways(edges).select("doc_id", "other"))
    seen = scratch.write(comps.where("doc_id = comp").select("doc_id", F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth")))
    rings, ring, depth = [seen], seen, 0
    while not ring.isEmpty():
        depth += 1
        found = links.join(ring.select("doc_id"), "doc_id").groupBy("other").agg(F.min("doc_id").alias("up"))
        new = found.select(F.col("other").alias("doc_id"), "up", F.lit(depth).alias("depth"))
        for old in rings[-2:]:  # a neighbour of a ring lies in it, in the one before, or in the next
            new = new.join(old.select("doc_id"), "doc_id", "left_anti")
        ring = scratch.write(new)
        rings.append(ring)
    forest = rings[0]
    for r in rings[1:]:
        forest = forest.union(r)
    forest = scratch.write(forest)
    tree = forest.where("up is not null").select(F.least("doc_id", "up").alias("a"), F.greatest("doc_id", "up").alias("b"))
    rest = edges.join(tree, ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b").alias("x"))
    own = rest.select(F.explode(F.array("a", "b")).alias("doc_id"), "x").groupBy("doc_id").agg(F.bit_xor("x").alias("x"))
    state = scratch.write(forest.join(own, "doc_id", "left").select("doc_id", "up", "depth", F.coalesce("x", F.lit(0).cast("long")).alias("x"), F.lit(1).cast("long").alias("n")))
    done = None
    below = None
    for d in range(depth - 1, 0, -1):
        level = state.where(F.col("depth") == d)
        if below is not None:
            level = level.join(below, "doc_id", "left").select("doc_id", "up", "depth", F.col("x").bitwiseXOR(F.coalesce("bx", F.lit(0).cast("long"))).alias("x"), (F.col("n") + F.coalesce("bn", F.lit(0))).alias("n"))
        level = scratch.write(level)
        done = level if done is None else done.union(level)
        below = level.groupBy(F.col("up").alias("doc_id")).agg(F.bit_xor("x").alias("bx"), F.sum("n").alias("bn"))
    total = comps.groupBy("comp").agg(F.count("*").alias("total"))
    cut = done.where("x = 0").select("doc_id", F.least("doc_id", "up").alias("a"), F.greatest("doc_id", "up").alias("b"), "n")
    cut = cut.join(comps, "doc_id").join(total, "comp").join(edges.select("a", "b", F.col("w").cast("double").alias("w")), ["a", "b"])
    return cut.select("comp", "a", "b", "w", F.least(F.col("n"), F.col("total") - F.col("n")).alias("lado_menor"))


def _sliced(packed: DataFrame) -> DataFrame:
    """Rows of ``packed`` in as many parts as leave each about ``WORK`` steps of a search from every vertex."""
    n = F.ceil(F.col("m") * F.col("m") / F.lit(WORK)).cast("int")
    return packed.withColumn("parts", F.greatest(F.lit(1), n)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _distances(near: dict[str, list[str]], source: str) -> dict[str, int]:
    seen, ring = {source: 0}, [source]
    while ring:
        ring = [x for v in ring for x in near[v] if x not in seen and not seen.update({x: seen[v] + 1})]
    return seen


def path_lengths(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``(comp, largo, pares)``: pairs by length of the shortest path."""

    def kernel(comp, a, b, w, part, parts):
        near = _adjacency(a, b)
        count: dict[int, int] = {}
        for v in list(near)[part::parts]:
            for x, d in _distances(near, v).items():
                if v < x:
                    count[d] = count.get(d, 0) + 1
        return [(comp, d, n) for d, n in count.items()]

    x = _spread(_sliced(_packed(edges, comps)), kernel, "comp string, largo int, pares long")
    return x.groupBy("comp", "largo").agg(F.sum("pares").alias("pares"))


def edge_betweenness(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """``(comp, a, b, intermediacion)``: share of shortest paths of a component's pairs that use the edge. Searches from
    different sources add up, so a component's sources are searched in parallel."""

    def kernel(comp, a, b, w, part, parts):
        near = _adjacency(a, b)
        score = dict.fromkeys(zip(a, b), 0.0)
        for s in list(near)[part::parts]:
            paths, dist, order, ring = {s: 1.0}, {s: 0}, [s], [s]
            while ring:
                nxt: list[str] = []
                for v in ring:
                    for x in near[v]:
                        if x not in dist:
                            dist[x] = dist[v] + 1
                            paths[x] = 0.0
                            nxt.append(x)
                        if dist[x] == dist[v] + 1:
                            paths[x] += paths[v]
                order += nxt
                ring = nxt
            load = dict.fromkeys(order, 0.0)
            for x in reversed(order):
                for v in near[x]:
                    if dist.get(v, -1) == dist[x] - 1:
                        flow = paths[v] / paths[x] * (1 + load[x])
                        load[v] += flow
                        score[(min(v, x), max(v, x))] += flow
        n = len(near)
        return [(comp, *e, x / (n * (n - 1))) for e, x in score.items()]

    x = _spread(_sliced(_packed(edges, comps)), kernel, "comp string, a string, b string, intermediacion double")
    return x.groupBy("comp", "a", "b").agg(F.sum("intermediacion").alias("intermediacion"))


# Community detection. All methods move single vertices to the neighbouring community that gains most, until none gains,
# then merge communities into vertices and go on. They differ in what a move gains.
def _levels(weights: dict[str, dict[str, float]], method: str, resolution: float, seed: int) -> dict[str, str]:
    """Communities by moves, refinement (``leiden``, ``cpm``) and merging, until no vertex moves."""
    import random

    rng = random.Random(seed)
    label = {v: v for v in weights}
    graph = {v: dict(n) for v, n in weights.items()}
    loops = dict.fromkeys(graph, 0.0)
    count = dict.fromkeys(graph, 1)
    total = sum(sum(n.values()) for n in graph.values()) / 2 or 1.0
    part = {v: v for v in graph}
    while True:
        strength = {v: sum(n.values()) + 2 * loops[v] for v, n in graph.items()}
        mass = {v: (strength[v] if method != "cpm" else count[v]) for v in graph}
        rate = resolution * (1 / (2 * total) if method != "cpm" else 1.0)
        held: dict[str, float] = {}
        for v, c in part.items():
            held[c] = held.get(c, 0.0) + mass[v]
        moved_any, moving = False, True
        while moving:
            moving = False
            for v in rng.sample(sorted(graph), len(graph)):
                here = part[v]
                links: dict[str, float] = {}
                for x, w in graph[v].items():
                    links[part[x]] = links.get(part[x], 0.0) + w
                held[here] -= mass[v]
                best, gain = here, links.get(here, 0.0) - rate * mass[v] * held[here]
                for c in sorted(links):
                    g = links[c] - rate * mass[v] * held[c]
                    if g > gain + 1e-12:
                        best, gain = c, g
                held[best] += mass[v]
                if best != here:
                    part[v], moving, moved_any = best, True, True
        if not moved_any:
            return {v: part[c] for v, c in label.items()}
        fine = _refined(graph, part, mass, rate, rng) if method in ("cpm", "leiden") else part
        label = {v: fine[c] for v, c in label.items()}
        merged: dict[str, dict[str, float]] = {c: {} for c in set(fine.values())}
        loop = dict.fromkeys(merged, 0.0)
        number = dict.fromkeys(merged, 0)
        for v, n in graph.items():
            c = fine[v]
            loop[c] += loops[v]
            number[c] += count[v]
            for x, w in n.items():
                if fine[x] == c:
                    loop[c] += w / 2
                else:
                    merged[c][fine[x]] = merged[c].get(fine[x], 0.0) + w
        # What was refined is merged; what it was refined from is where the next moves start.
        part = {fine[v]: part[v] for v in graph}
        graph, loops, count = merged, loop, number


def _refined(graph: dict[str, dict[str, float]], part: dict[str, str], mass: dict[str, float], rate: float, rng) -> dict[str, str]:
    """Each community split anew: vertices start alone and, while alone, join a part of their community that gains and is
    well tied to it, drawn with odds that grow with the gain. Parts are connected, since only ties gain."""
    import math

    fine = {v: v for v in graph}
    held, size = dict(mass), dict.fromkeys(graph, 1)
    whole: dict[str, float] = {}
    for v, c in part.items():
        whole[c] = whole.get(c, 0.0) + mass[v]
    cut = {v: sum(w for x, w in n.items() if part[x] == part[v]) for v, n in graph.items()}
    tied = lambda v: cut[v] >= rate * mass[v] * (whole[part[v]] - mass[v]) - 1e-12
    outer = dict(cut)  # of each part, its ties to the rest of its community
    for v in rng.sample(sorted(graph), len(graph)):
        if size[fine[v]] > 1 or not tied(v):
            continue
        links: dict[str, float] = {}
        for x, w in graph[v].items():
            if part[x] == part[v]:
                links[fine[x]] = links.get(fine[x], 0.0) + w
        odds = []
        for c in sorted(links):
            gain = links[c] - rate * mass[v] * held[c]
            if c != fine[v] and gain > 1e-12 and outer[c] >= rate * held[c] * (whole[part[v]] - held[c]) - 1e-12:
                odds.append((c, gain))
        if not odds:
            continue
        top = max(g for _, g in odds)
        c = rng.choices([c for c, _ in odds], [math.exp((g - top) / (0.01 * max(top, 1e-9))) for _, g in odds])[0]
        old = fine[v]
        outer[c] += cut[v] - 2 * links[c]
        held[c] += mass[v]
        size[c] += size[old]
        held[old] = size[old] = outer[old] = 0
        fine[v] = c
    return fine


def _map_equation(near: dict[str, dict[str, float]], seed: int, trials: int = 5) -> dict[str, str]:
    """Communities that shorten the two-level description of a random walk: of ``trials`` runs, the shortest. A run moves
    vertices one by one until none shortens it, merges communities into vertices, and goes on."""
    runs = [_map_run(near, seed * trials + k) for k in range(trials)]
    return min(runs, key=lambda r: r[0])[1]


def _plogp(x: float) -> float:
    import math

    return x * math.log2(x) if x > 1e-15 else 0.0


def _map_run(near: dict[str, dict[str, float]], seed: int) -> tuple[float, dict[str, str]]:
    import random

    rng, f = random.Random(seed), _plogp
    total = sum(sum(n.values()) for n in near.values()) or 1.0
    graph = {v: {x: w / total for x, w in n.items() if x != v} for v, n in near.items()}
    flow = {v: sum(n.values()) / total for v, n in near.items()}
    base = sum(f(x) for x in flow.values())
    label = {v: v for v in graph}
    while True:
        part = {v: v for v in graph}
        away = {v: sum(n.values()) for v, n in graph.items()}
        inside, leaves = dict(flow), dict(away)
        left, moved, moving = sum(leaves.values()), False, True
        while moving:
            moving = False
            for v in rng.sample(sorted(graph), len(graph)):
                here = part[v]
                links: dict[str, float] = {}
                for x, w in graph[v].items():
                    links[part[x]] = links.get(part[x], 0.0) + w
                best, gain, kept = here, -1e-10, None
                out_here = leaves[here] - away[v] + 2 * links.get(here, 0.0)
                for c in sorted(links):
                    if c == here:
                        continue
                    out_c = leaves[c] + away[v] - 2 * links[c]
                    q = left - leaves[here] - leaves[c] + out_here + out_c
                    d = f(q) - f(left) - 2 * (f(out_here) + f(out_c) - f(leaves[here]) - f(leaves[c]))
                    d += f(out_here + inside[here] - flow[v]) + f(out_c + inside[c] + flow[v]) - f(leaves[here] + inside[here]) - f(leaves[c] + inside[c])
                    if d < gain:
                        best, gain, kept = c, d, (out_here, out_c, q)
                if kept:
                    leaves[here], leaves[best], left = kept
                    inside[here] -= flow[v]
                    inside[best] += flow[v]
                    part[v], moving, moved = best, True, True
        if not moved:
            used = set(part.values())
            length = f(left) - 2 * sum(f(leaves[c]) for c in used) - base + sum(f(leaves[c] + inside[c]) for c in used)
            return length, label
        label = {v: part[c] for v, c in label.items()}
        merged: dict[str, dict[str, float]] = {c: {} for c in set(part.values())}
        for v, n in graph.items():
            for x, w in n.items():
                if part[x] != part[v]:
                    merged[part[v]][part[x]] = merged[part[v]].get(part[x], 0.0) + w
        flow = {c: inside[c] for c in merged}
        graph = merged


def _weights(rows: Iterable[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    near: dict[str, dict[str, float]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return dict(sorted(near.items()))


def communities(edges: DataFrame, comps: DataFrame, method: str, seeds: Iterable[int] = (0,), resolution: float | None = None) -> DataFrame:
    """``(comp, semilla, doc_id, comunidad)`` by ``louvain``, ``leiden`` (with refinement), ``cpm`` (constant Potts model,
    refined; by default the resolution is the component's density) or ``infomap``, one run per seed. Communities are
    numbered by their smallest member. Runs are spread over tasks; a run holds one component."""

    def kernel(comp, a_, b_, w_, seed, parts):
        near = _weights(zip(a_, b_, w_))
        n, m = len(near), len(a_)
        if method == "infomap":
            label = _map_equation(near, seed)
        else:
            r = resolution if resolution is not None else (2 * m / (n * (n - 1)) if method == "cpm" else 1.0)
            label = _levels(near, method, r, seed)
        name: dict[str, int] = {}
        return [(comp, seed, v, name.setdefault(label[v], len(name))) for v in near]

    runs = _packed(edges, comps).withColumns({"part": F.explode(F.array(*[F.lit(s) for s in seeds])), "parts": F.lit(1)})
    return _spread(runs, kernel, "comp string, semilla int, doc_id string, comunidad int")


def _parted(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The root of each vertex of the edges given: one root per component."""
    top: dict[str, str] = {}

    def root(v: str) -> str:
        while top[v] != v:
            top[v] = v = top[top[v]]
        return v

    for a, b in pairs:
        top.setdefault(a, a)
        top.setdefault(b, b)
        top[root(a)] = root(b)
    return {v: root(v) for v in top}


def _ticket(*parts: object) -> int:
    """The number that ``scalars.hash_number`` gives these parts."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def kept_pairs(edges: DataFrame, comps: DataFrame, percent: int, replicates: int, seed: int, large: int = LARGE) -> DataFrame:
    """``(comp, rep, recuperado)``: share of a component's pairs that stay together when about ``percent`` in a hundred
    vertices are dropped by hash; replicates that leave a component no edge give no row. What is left of a component lies
    in it, so a component's replicates are one kernel call and nothing is copied by replicate; components of more than
    ``large`` edges are done by joins. ``comps`` may have vertices without edges."""

    def kernel(comp, a, b, w, part, n):
        vertices, out = set(a) | set(b), []
        for rep in range(1, replicates + 1):
            left = {v for v in vertices if _ticket(seed, rep, v) % 100 >= percent}
            top = _parted((x, y) for x, y in zip(a, b) if x in left and y in left)
            if top:
                out.append((comp, rep, sum(m * (m - 1) // 2 for m in Counter(top.values()).values()) / (int(n) * (int(n) - 1) / 2)))
        return out

    scratch = Scratch(edges.sparkSession, "kept")
    size = comps.groupBy("comp").agg(F.count("*").cast("int").alias("parts"))
    m = edges.join(comps.withColumnRenamed("doc_id", "a"), "a").groupBy("comp").agg(F.count("*").alias("m"))
    wide = scratch.write(m.where(F.col("m") > large).select("comp"))
    schema = "comp string, rep int, recuperado double"
    few = comps.join(wide, "comp", "left_anti")
    small = _spread(_packed(edges, few).join(size, "comp").withColumn("part", F.lit(0)), kernel, schema)
    if wide.isEmpty():
        return small
    big = scratch.write(comps.join(wide, "comp", "left_semi"))
    e = edges.select("a", "b", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).join(big.select(F.col("doc_id").alias("a")), "a", "left_semi")
    stays = lambda c: F.pmod(hash_number(F.lit(seed), F.col("rep"), F.col(c)), F.lit(100)) >= percent
    again = components(e.where(stays("a") & stays("b")).select("rep", "a", "b"), ["rep"]).select("rep", "doc_id", F.col("comp").alias("grupo"))
    r = recall_by_group(big.select("doc_id", F.col("comp").alias("grupo")), again, ["rep"])
    return small.union(r.select(F.col("grupo").alias("comp"), "rep", "recuperado"))


def perturbed(edges: DataFrame, comps: DataFrame, runs: list[tuple[int, int]]) -> DataFrame:
    """``(porcentaje, semilla, retencion, vi)``: Louvain's communities with about ``porcentaje`` in a hundred edges dropped
    by hash, against those of all edges, over the vertices that keep an edge. Both lie within a component, so a component's
    runs are one kernel call that returns counts; a part of a component that has been seen with the same edges isn't done
    again. Runs of components of more than 2,000 edges are spread over twenty tasks."""

    def kernel(comp, a, b, w, part, parts):
        edge, seen = list(zip(a, b, w)), {}

        def label(rows):
            key = tuple((x, y) for x, y, _ in rows)
            if key not in seen:
                seen[key] = _levels(_weights(rows), "louvain", 1.0, 0)
            return seen[key]

        base, out = label(edge), []
        for percent, seed in runs[part::parts]:
            left = [x for x in edge if _ticket(seed, 1, x[0], x[1]) % 100 >= percent]
            top, inside = _parted((x, y) for x, y, _ in left), {}
            for x in left:
                inside.setdefault(top[x[0]], []).append(x)
            cell = Counter((base[v], c, c2) for c, rows in inside.items() for v, c2 in label(rows).items())
            rows_, cols = Counter(), Counter()
            for (x, *y), k in cell.items():
                rows_[x] += k
                cols[tuple(y)] += k
            pairs = lambda c: float(sum(k * (k - 1) // 2 for k in c.values()))
            info = lambda c: sum(k * math.log(k) for k in c.values())
            out.append((percent, seed, len(top), pairs(rows_), pairs(cell), info(rows_) + info(cols) - 2 * info(cell)))
        return out

    packed = _packed(edges, comps).withColumn("parts", F.when(F.col("m") > 2000, 20).otherwise(1))
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = _spread(packed, kernel, "porcentaje int, semilla int, n long, pa double, pab double, h double")
    x = x.groupBy("porcentaje", "semilla").agg(*[F.sum(c).alias(c) for c in ("n", "pa", "pab", "h")])
    every = edges.sparkSession.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("porcentaje"), F.lit(s).alias("semilla")) for p, s in runs])).alias("r")).select("r.*")
    x = every.join(x, ["porcentaje", "semilla"], "left")
    return x.select("porcentaje", "semilla", F.try_divide("pab", "pa").alias("retencion"), F.try_divide("h", "n").alias("vi"))


def mixed_paths(edges: DataFrame, kinds: DataFrame, first: str, second: str, replicates: int, seed: int) -> DataFrame:
    """``(rep, caminos, heterogeneos)``: paths of two steps, and those whose ends share neither ``first`` nor ``second``,
    with these two (columns of ``kinds``, by ``doc_id``) as they are (0) and permuted among vertices as in
    :func:`sampling.donors`. Ends are counted by group around each middle, never paired: all pairs, less those that share
    one, less those that share the other, plus those that share both.

    Vertices are not copied by replicate: a kernel reckons the place of each neighbour's donor and looks up its groups,
    twelve bytes for each vertex of ``kinds``, which every executor and, once, the driver hold."""
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "paths")
    other = places(kinds.select("doc_id"), [], [ticket(f"{seed}b", "doc_id"), F.col("doc_id")], "at", "n")
    known = scratch.write(kinds.join(other, "doc_id"))
    for name, keys in (("g0", [first]), ("g1", [second]), ("g2", [first, second])):  # a group goes by the first place in it
        known = known.join(known.groupBy(*keys).agg(F.min("at").cast("int").alias(name)), keys)
    known = scratch.write(known.select("doc_id", F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"), "g0", "g1", "g2"))
    got = known.select("at", "g0", "g1", "g2").toArrow()
    groups = np.zeros((3, got.num_rows), np.int32)
    for i in range(3):
        groups[i, got.column("at").to_numpy()] = got.column(f"g{i}").to_numpy()
    salts = [0] + [_ticket(seed, rep) for rep in range(1, replicates + 1)]
    shared = spark.sparkContext.broadcast((groups, [0, *primes(replicates)], salts))
    mine = places(kinds.select("doc_id"), [], [ticket(f"{seed}a", "doc_id"), F.col("doc_id")], "k", "m").select(F.col("doc_id").alias("other"), F.col("k").cast("int").alias("k"))
    near = both_ways(edges).select("doc_id", "other").join(mine, "other").join(known.select(F.col("doc_id").alias("other"), "at"), "other")
    packed = near.groupBy("doc_id").agg(F.collect_list("k").alias("k"), F.collect_list("at").alias("at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        groups, prime, salt = shared.value
        paths, mixed, any_ = 0, np.zeros(len(prime), np.int64), False
        for batch in batches:
            any_ = any_ or batch.num_rows > 0
            lists = batch.column("k")
            size = lists.value_lengths().to_numpy()
            middle = np.repeat(np.arange(len(size)), size)
            use = size[middle] > 1
            middle = middle[use] << 32
            k, at = (batch.column(c).flatten().to_numpy()[use].astype(np.int64) for c in ("k", "at"))
            size = size.astype(np.int64)
            here = int((size * (size - 1) // 2).sum())
            paths += here
            for rep in range(len(prime) if len(k) else 0):
                spot = (k * prime[rep] + salt[rep]) % groups.shape[1] if rep else at
                mixed[rep] += here - _alike(middle | groups[0, spot]) - _alike(middle | groups[1, spot]) + _alike(middle | groups[2, spot])
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(prime), dtype=np.int32)), pa.array(np.full(len(prime), paths)), pa.array(mixed)], ["rep", "caminos", "heterogeneos"])

    n = spark.sparkContext.defaultParallelism * 4
    x = packed.repartition(n, F.xxhash64("doc_id")).mapInArrow(run, "rep int, caminos long, heterogeneos long")
    return x.groupBy("rep").agg(F.sum("caminos").alias("caminos"), F.sum("heterogeneos").alias("heterogeneos"))


def _alike(key: np.ndarray) -> int:
    """How many pairs have equal keys."""
    key = np.sort(key)
    ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
    n = np.diff(ends, prepend=-1)
    return int((n * (n - 1) // 2).sum())


def coassignment(runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of runs in which the two ends of an edge are in one community: ``(a, b, parte)``. Only linked pairs are
    compared, so nothing grows with the square of a community."""
    n = runs.select("semilla").distinct().count()
    a = runs.select(F.col("doc_id").alias("a"), "semilla", F.col("comunidad").alias("ca"))
    b = runs.select(F.col("doc_id").alias("b"), "semilla", F.col("comunidad").alias("cb"))
    j = edges.select("a", "b").join(a, "a").join(b, ["b", "semilla"])
    return j.groupBy("a", "b").agg((F.count_if(F.col("ca") == F.col("cb")) / F.lit(max(n, 1))).alias("parte"))
