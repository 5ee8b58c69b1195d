import random

import numpy as np
import pytest

from tramado.llm.components import connected_groups
from tramado.llm.consensus import consensus
from tramado.llm.mixing import Counter, mix, token_counts

LABELS = ("mismo_proceso_especifico", "mismo_macroproceso", "relacionado_tematicamente", "no_relacionado", "indeterminado")


def groups(links):
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def test_groups_by_union_find(spark):
    """Random graphs side by side, a long path, a hub, a star of stars; blanks, repeats, self-pairs, missing sides."""
    rng = random.Random(2)
    links = [(f"{k}-{rng.randint(0, 12)}", f"{k}-{rng.randint(0, 12)}") for k in range(25) for _ in range(rng.randint(1, 14))]
    links += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(150)] + [("hub", f"h{i}") for i in range(300)]
    rng.shuffle(links)
    rows = [(a + rng.choice(["", " ", "\t"]), " " + b, 1) for a, b in links] + [(b, a, 2) for a, b in links[:50]]
    rows += [("solo", None, 1), (None, "otro", 1), ("  ", None, 1), (None, None, 1), ("s", "s", 1)]
    got = [tuple(r) for r in connected_groups(spark.createDataFrame(rows, "doc_id string, grupo_id string, w int"), "doc_id", "grupo_id").collect()]
    assert dict(got) == groups(links) | {"solo": "solo", "otro": "otro", "s": "s"} and len(got) == len(dict(got))


@pytest.mark.parametrize("rows,want", [([], {}), ([("a", "a")], {"a": "a"}), ([("b", "a"), ("b", "a")], {"a": "a", "b": "a"}), ([("10", "9")], {"10": "10", "9": "10"})])
def test_small_groups(spark, rows, want):
    df = spark.createDataFrame(rows, "i string, j string")
    assert {r[0]: r[1] for r in connected_groups(df, "i", "j").collect()} == want


def decisions(seed, items=150):
    """Eight annotators: four careful, one random, one always the same, two a grade too low."""
    rng = random.Random(seed)
    truth = {f"c{i:03d}": rng.choices(range(5), [4, 3, 2, 2, 1])[0] for i in range(items)}
    rows = []
    for c, t in truth.items():
        for j in range(8):
            if rng.random() < 0.75:
                x = t if rng.random() < 0.75 else rng.randrange(5)
                x = rng.randrange(5) if j == 4 else 2 if j == 5 else min(x + 1, 4) if j > 5 else x
                rows.append((c, f"a{j}", LABELS[x].upper().replace("_", rng.choice(["_", " ", "-"])), None))
    return truth, rows


def test_consensus_beats_vote(spark):
    truth, rows = decisions(1)
    df = spark.createDataFrame([*rows, *rows[:40]], "case_id string, who string, d string, t timestamp")
    items, trust = consensus(df, "case_id", "who", "d", "t", LABELS, "indeterminado")
    got = {r.case_id: r for r in items.collect()}
    right = lambda label: sum(label(c) == LABELS[t] for c, t in truth.items()) / len(truth)
    vote = {}
    for c, _, d, _ in rows:
        vote.setdefault(c, []).append(d.lower().replace(" ", "_").replace("-", "_"))
    assert right(lambda c: got[c].etiqueta) >= max(0.85, right(lambda c: max(LABELS, key=vote.get(c, []).count)) + 0.05)
    assert all(0 <= r.acuerdo <= 1 and 0 < r.confianza <= 1 for r in got.values())
    plain = {r.case_id: r.etiqueta for r in consensus(df, "case_id", "who", "d", "t", LABELS, "indeterminado", habits=False)[0].collect()}
    assert right(lambda c: got[c].etiqueta) >= right(lambda c: plain[c]) >= right(lambda c: max(LABELS, key=vote.get(c, []).count))
    t = {r.who: r.fiabilidad for r in trust.collect()}
    assert min(t[f"a{j}"] for j in range(4)) > max(t[f"a{j}"] for j in range(4, 8))


def test_consensus_of_odd_rows(spark):
    rows = [("1", "a", "Mismo macroproceso.", "2020-01-02"), ("1", "a", "no relacionado", "2020-01-01"), ("2", "a", "???", None), ("3", None, "no_relacionado", None), (None, "a", "no_relacionado", None), ("4", "b", None, None)]
    df = spark.createDataFrame(rows, "item string, label string, d string, t string").selectExpr("item", "label", "d", "cast(t as timestamp) t")
    items, _ = consensus(df, "item", "label", "d", "t", LABELS, "indeterminado")
    got = {r.item: (r.etiqueta, r.decisiones) for r in items.collect()}
    assert got == {"1": ("mismo_macroproceso", 1), "2": ("indeterminado", 0), "3": ("indeterminado", 0), "4": ("indeterminado", 0)}
    items, trust = consensus(df.limit(0), "item", "label", "d", "t", LABELS, "indeterminado")
    assert items.count() == 0 and trust.count() == 0


def test_token_counts_are_exact(spark):
    from tramado.llm.mixing import TOKENIZER, _encoding

    rng = random.Random(4)
    texts = ["".join(rng.choice("ab'sdt ré\n\t1２.¿ 中文’ ") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["it's we'll  x\n\n y", "", " ", "\n", "'s"]
    want = [len(_encoding(TOKENIZER).encode_ordinary(t)) for t in texts]
    assert Counter(TOKENIZER)(texts).tolist() == want
    df = spark.createDataFrame([(1, None, "k"), (2, "hola mundo", "k")], "id int, text string, tokens string")
    assert [r["tokens"] for r in token_counts(df.drop("tokens"), "id", "text", []).orderBy("id").collect()] == [0, len(_encoding(TOKENIZER).encode_ordinary("hola mundo"))]


def test_mixture(spark):
    rng = np.random.default_rng(0)
    docs = [(i, "big", 1.0, int(rng.integers(1, 50))) for i in range(2000)] + [(5000 + i, "small", None, 10) for i in range(7)] + [(9000, "none", 1.0, 5), (9001, None, 1.0, 5), (9002, "big", 1.0, 0)]
    targets = [("big", 0.5, 1), ("small", 0.1, 3), ("empty", 0.4, 2)]
    d, t = spark.createDataFrame(docs, "id int, source string, w double, n int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, shares = mix(d, "id", "source", "w", "n", t, total=10_000)
    got = chosen.collect()
    s = {r["source"]: r for r in shares.collect()}
    assert s["big"].tokens <= 5000 and 5000 - s["big"].tokens < 50 and s["big"].most_copies == 1
    assert s["small"].tokens == 210 and s["small"].most_copies == 3 and s["empty"].tokens == 0
    assert sum(r.actual_share for r in s.values()) == pytest.approx(1) and {r["source"] for r in got} == {"big", "small"}
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(d.repartition(9), "id", "source", "w", "n", t, total=10_000)[0].collect()))
    part, _ = mix(d, "id", "source", "w", "n", t, total=1_000)
    small = [r for r in part.collect() if r["source"] == "small"]
    assert sum(r["copies"] * r["tokens"] for r in small) == 100 and {r["copies"] for r in small} == {1, 2}
    none, empty = mix(d.limit(0), "id", "source", "w", "n", t)
    assert none.count() == 0 and {r.tokens for r in empty.collect()} == {0}


def test_heavier_weights_come_more_often(spark):
    rows = [(i, "s", 0.1 if i % 2 else 1.0, 1) for i in range(4000)]
    t = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mix(spark.createDataFrame(rows, "id int, source string, w double, n int"), "id", "source", "w", "n", t, total=1000)[0].collect()
    heavy = sum(r["id"] % 2 == 0 for r in got) / len(got)
    assert len(got) == 1000 and heavy > 0.8
