import random
from collections import Counter

import numpy as np
import pytest

from tramado.llm.wordarrays import chunks, shingles, words
from tramado.llm import neardup as N
from tramado.llm.leakage import PART, SLIP, Index, _corrected, _pairs, _passages, leaked_items
from tramado.llm.sentences import Model, Places, _stripped, spans, split_sentences

VOCAB = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pi", "dru") for c in ("l", "nte", "s", "rma", "xo")]


def text(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for _ in range(k):
        i = rng.randrange(len(w))
        x = w[i]
        w[i] = rng.choice([x + "q", x[1:] or x, x[::-1], x.upper()])
    return " ".join(w)


def test_words_fold_and_skip_markup():
    one = lambda t: words([t])[0].tolist()
    assert one("Árbol <b class='x'>AZUL</b> &aacute;gua") == one("arbol azul agua") and one("línea") == one("lÃ­nea") == one("LÍNEA")
    assert one("") == [] and one("...") == [] and one("a,b;c") == one("a b c")
    h, doc = words(["uno dos", "", "tres"])
    assert doc.tolist() == [0, 0, 2] and len(set(h.tolist())) == 3
    s, d = shingles(*words(["a b c d e f", "x y", ""]))
    assert sorted(d.tolist()) == [0, 0, 1] and [len(p) for _, p in chunks(["a", None])] == [2]


def share(a, b):
    x, y = Counter(words([a])[0].tolist()), Counter(words([b])[0].tolist())
    return sum((x & y).values()) / max(sum((x | y).values()), 1)


def test_near_duplicates_by_brute_force(spark):
    """Copies with edits, moved halves, exact copies, a family larger than a block, shared closing lines, odd rows."""
    rng = random.Random(11)
    docs = []
    for _ in range(30):
        base = text(rng, rng.randint(40, 260))
        docs += [base, edited(rng, base, 4), base.upper(), base]
        w = base.split()
        docs.append(" ".join(w[len(w) // 2 :] + w[: len(w) // 2]))
        docs.append(" ".join(w[: int(len(w) * 0.7)]) + " " + text(rng, int(len(w) * 0.3)))
    family = text(rng, 200)
    docs += [edited(rng, family, 3) for _ in range(30)]
    closing = text(rng, 30)
    docs += [text(rng, 80) + " " + closing for _ in range(26)]
    docs += ["", None, "Contenido no disponible.", "Contenido no disponible.", "uno dos tres", "<p></p>"]
    rows = [(f"{i:04d}", t, "z") for i, t in enumerate(docs)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, docs[0], "z")], "doc_a string, t string, rid string")
    got = {tuple(r) for r in N.similar_documents(df, "doc_a", "t").collect()}
    usable = [(i, t) for i, t, _ in rows if t and len(words([t])[0]) >= N.LEAST_WORDS]
    want = {(a, b) for k, (a, x) in enumerate(usable) for b, y in usable[k + 1 :] if share(x, y) >= 0.75}
    assert got == want
    assert N.similar_documents(df.limit(0), "doc_a", "t").count() == 0


def test_leaks(spark):
    rng = random.Random(5)
    items = [(k, text(rng, rng.randint(48, 100))) for k in range(40)]
    docs, want = [], set()
    for i in range(120):
        t = text(rng, rng.randint(20, 200))
        if i % 3 == 0:
            k, item = rng.choice(items)
            w = item.split()
            part = rng.choice([1.0, 0.7, 0.6, 0.35, 0.25])
            a = rng.randint(0, len(w) - int(len(w) * part))
            piece = edited(rng, " ".join(w[a : a + int(len(w) * part)]), 1).upper()
            t = t + "\n" + piece.replace(" ", ",  ") + ". " + text(rng, 30)
            if part >= 0.6:
                want.add((i, k))
        docs.append((i, t, "x"))
    docs += [(500, "", "x"), (501, None, "x"), (502, "uno", "x"), (503, " ".join(text(rng, 50) for _ in range(4000)), "x")]
    d = spark.createDataFrame([*docs, *docs[:4]], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, items[0], (900, None), (901, "")], "item_id long, text string")
    got = [tuple(r) for r in leaked_items(d, "doc_id", "text", i, "item_id", "text").collect()]
    assert set(got) == want and len(got) == len(want)
    assert leaked_items(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0
    assert leaked_items(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_leaks_with_slips(spark):
    """Half of an item's words and more, with a word in six mistyped by one letter; unrelated text carries nothing."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(5, 9)))
    items = [(k, [word() for _ in range(60)]) for k in range(30)]

    def slip(x):
        i = rng.randrange(1, len(x) - 1)
        return rng.choice([x[:i] + "z" + x[i + 1 :], x[:i] + x[i + 1 :], x[:i] + "z" + x[i:], x[: i - 1] + x[i] + x[i - 1] + x[i + 1 :]])

    docs = []
    for k, w in items:
        a = rng.randint(0, 24)
        docs.append((k, " ".join([word() for _ in range(40)] + [slip(x) if j % 6 == 3 else x for j, x in enumerate(w[a : a + 36])] + [word() for _ in range(40)])))
        docs.append((100 + k, " ".join(w[:24] + [word() for _ in range(60)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, t string")
    got = {tuple(r) for r in leaked_items(d, "doc_id", "text", i, "item_id", "t").collect()}
    assert got == {(k, k) for k, _ in items}


def test_index_finds_what_full_scores_find():
    """Lists and blocks against scores of all passages and items."""
    rng = random.Random(3)
    texts = [text(rng, rng.randint(10, 80)) for _ in range(50)]
    index = Index(texts)
    w, at, lone = words([t + " " + text(rng, 40) for t in texts] + [text(rng, 300)], markup=False, deletions=SLIP)
    got = set(zip(*(x.tolist() for x in _passages(index, _corrected(index, w, lone), at))))
    dense = np.zeros((len(index.vocabulary), len(texts)))
    for t in range(len(index.vocabulary)):
        dense[t, index.item[index.start[t] : index.start[t + 1]]] = index.impact[index.start[t] : index.start[t + 1]]
    want = set()
    for d in range(len(texts) + 1):
        mine = np.flatnonzero(at == d)
        for a in range(0, len(mine), 16):
            span = mine[a : a + 32]
            pairs, _ = _pairs(*(np.append(x[span], x[span[-1] + 1]) if span[-1] + 1 < len(x) else x[span] for x in (w, at)))
            spot = np.minimum(np.searchsorted(index.vocabulary, pairs), len(index.vocabulary) - 1)
            score = dense[spot[index.vocabulary[spot] == pairs]].sum(0)
            want |= {(d, int(span[0]), int(i)) for i in np.flatnonzero(score >= PART + 1e-6)}
    assert want <= got and len(got - want) <= 2 and want


SENTENCES = [
    ["El Sr. Pérez llegó a las 10.30 a. m. y se fue.", "La carta llegó de EE. UU. con copia a la Dra. Ruiz.", "¿Cuándo?", "¡Basta!", "Faltan planos, timbres, etc.", "Nadie contestó."],
    ["«No vamos a firmar.», respondió Luis Mora.", "—Nos quedamos —dijo Ana—.", "La reunión... nunca empezó.", "Según la pág. 39 (véase fig. 6.1), está seco."],
    ["Mr. Smith moved to the U.S. in June.", "\"Who pays?\" asked Ann Lee.", "\"We will not sign,\" said Bob, \"not now.\"", "The fine was $1,490.50, i.e. less than Acme Corp. had offered."],
    ["Dr. Braun traf die Grupo AG am 1. März in Bonn.", "Der Abfluss fiel auf 3,5 m³/s, vgl. Abs. 7 der Regeln.", "Der Zuschlag ging an die GmbH u. Co. KG."],
    ["« Qui paie pour le port ? », a demandé M. Dupont.", "L'amende est de 1 900,50 €, env. 5 fois moins."],
]


@pytest.mark.parametrize("parts", SENTENCES)
def test_sentences_with_blanks(parts):
    model = Model([" ".join(p) for p in SENTENCES] * 20)
    t = " ".join(parts)
    _, a, b = spans(model, [t])
    assert [t[i:j] for i, j in zip(a, b)] == parts


@pytest.mark.parametrize(
    "t,parts",
    [
        ("峰渚議会は道を閉じた。水はどこへ行った？「払うのか。」と峰さんは尋ねた。会議は……始まらなかった。", ["峰渚議会は道を閉じた。", "水はどこへ行った？", "「払うのか。」と峰さんは尋ねた。", "会議は……始まらなかった。"]),
        ("岚岚说：“我们不会签字。”渡汀合作社封路。“够了！”人群喊道，“还水！”水呢？", ["岚岚说：“我们不会签字。”", "渡汀合作社封路。", "“够了！”人群喊道，“还水！”", "水呢？"]),
        ("डॉ. गिरि और श्री. नद मिले। पानी कहाँ गया?", ["डॉ. गिरि और श्री. नद मिले।", "पानी कहाँ गया?"]),
        ("أين الماء؟ التقى د. سفح وأ. رملة في كرم. الاجتماع... لم يبدأ قط.", ["أين الماء؟", "التقى د. سفح وأ. رملة في كرم.", "الاجتماع... لم يبدأ قط."]),
        ("น้ำไหล 13.2 เมตร กลางดึกปิดทาง  แม้ฝนตก", ["น้ำไหล 13.2 เมตร", "กลางดึกปิดทาง", "แม้ฝนตก"]),
        ("Agua y territorio\nLa carta pide:\n1. Medir el ruido\n2) Citar a Ana\n- Retirar equipos\nNadie contestó.Una vocera habló.", ["Agua y territorio", "La carta pide:", "1. Medir el ruido", "2) Citar a Ana", "- Retirar equipos", "Nadie contestó.", "Una vocera habló."]),
        ("Uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece\ncatorce quince. En vísperas del invierno, Ana Mora visitó las obras del\nEmbalse Norte.", ["Uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece\ncatorce quince.", "En vísperas del invierno, Ana Mora visitó las obras del\nEmbalse Norte."]),
        ("sin punto", ["sin punto"]), ("  \n ", []), ("", []), ("...", ["..."]),
    ],
)
def test_sentences_by_script(t, parts):
    model = Model([" ".join(p) for p in SENTENCES] * 20)
    _, a, b = spans(model, [t])
    assert [t[i:j] for i, j in zip(a, b)] == parts


def test_the_model_decides():
    """No prior and no rule enters the decoding: a model fitted to other labels tags otherwise, and without the marks' view
    the others still find the ends."""
    texts = [" ".join(p) for p in SENTENCES] * 20
    place = Places(["Uno dos. Tres cuatro. Cinco seis."])
    assert Model(texts).decode(place).tolist() == [True, True, True]
    assert Model(texts, views=(1, 2, 3)).decode(place).tolist() == [True, True, True]
    shy = Model(texts)
    shy.w = -shy.w
    assert shy.decode(place).tolist() == [False, False, True]


def test_stripped_text_keeps_labels():
    s, e = _stripped("กา. ขา งา", np.array([3, 6, 9]))
    assert s == "กา ขา งา" and [s[:k].rstrip() for k in e] == ["กา", "กา ขา", "กา ขา งา"]


def test_quotation_with_several_sentences():
    model = Model([" ".join(p) for p in SENTENCES] * 20 + ["«Fue un error. Lo sentimos», admitió la empresa. Nadie contestó."] * 10)
    t = "Ana llegó. «Fue una pena. Lo lamento. No más», dijo Luis. Se fue."
    _, a, b = spans(model, [t])
    assert [t[i:j] for i, j in zip(a, b)] == ["Ana llegó.", "«Fue una pena. Lo lamento. No más», dijo Luis.", "Se fue."]


def test_sentences_cover_every_character(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB .?!\n¿«»”,;:-1)(。？ 中ไท　\x1e'\"…") for _ in range(rng.randint(0, 200))) for _ in range(400)] + [None, "Hola. " * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)], "doc_id int, text string, inicio int")
    got = {}
    for r in split_sentences(df, "doc_id", "text", sample=50).collect():
        got.setdefault(r.doc_id, []).append((r.inicio, r.fin))
    for i, t in enumerate(texts):
        s = sorted(got.get(i, []))
        assert all(a < b for a, b in s) and all(x[1] <= y[0] for x, y in zip(s, s[1:]))
        kept = "".join((t or "")[a:b] for a, b in s)
        squeeze = lambda x: "".join(c for c in x if not c.isspace() and c not in "\x1e")
        assert squeeze(kept) == squeeze(t or "") and all((t or "")[a].strip() and (t or "")[b - 1].strip() for a, b in s)
    assert len(got[len(texts) - 1]) == 20000
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_array_arithmetic_is_deterministic():
    a, b = words(["hola mundo"])[0], words(["x", "hola mundo"])[0][1:]
    assert np.array_equal(a, b)
