import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tramado.llm.canonical import UNLISTED, map_to_catalogue
from tramado.llm.lexicon import Lexicon
from tramado.llm.names import entities, read_name, variant_pairs
from tramado.llm.pigeonhole import within_edits
from tramado.llm.queries import WORKS

CATALOGUE = [
    ("planta_desaladora_rilco_fase_ii", "Planta Desaladora Rilcomuntri Fase II", None),
    ("planta_desaladora_rilco", "Planta Desaladora Rilcomuntri", "Complejo Vanturelpa"),
    ("embalse_cerro_rilco_etapa_1", "Embalse Cerro Rilcomuntri Etapa 1", None),
    ("parque_eolico_pelmu_norte", "Parque Eólico Vegas de Pelmuchanfe Norte", None),
]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pigeonhole_join_by_brute_force(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    left, right = {word() for _ in range(120)}, {word() for _ in range(120)}
    got = within_edits(spark.createDataFrame([(w,) for w in left] + [(None,)], "l string"), "l", spark.createDataFrame([(w,) for w in right], "r string"), "r", k)
    want = {(a, b, lev(a, b)) for a in left for b in right if len(b) > k and lev(a, b) <= k}
    assert {tuple(r) for r in got.collect()} == want


def test_mapping(spark):
    typed = {
        "Pta. Desal. Rilcomuntri F. II": "planta_desaladora_rilco_fase_ii",
        "rilcomuntri fase dos, planta desaladora (en evaluación)": "planta_desaladora_rilco_fase_ii",
        "planta-desaladora-rilcomuntir": "planta_desaladora_rilco",
        "EMB. CERRO RILCOMUNTRI 1ª ETAPA": "embalse_cerro_rilco_etapa_1",
        "complejo vanturelpa": "planta_desaladora_rilco",
        "pe pelmuchanfe nte / conflicto por ruido": "parque_eolico_pelmu_norte",
        "Parque EÃ³lico Vegas de Pelmuchanffe norte": "parque_eolico_pelmu_norte",
        "Parque Eólico Pelmuchanfe": UNLISTED,
        "Embalse Rilcomuntri Etapa 2": UNLISTED,
        "Vertedero Comunal Rilcomuntri": UNLISTED,
        "Planta Desaladora Otronombre": UNLISTED,
        "x" * 5000: UNLISTED,
    }
    nothing = ["", " ", "s/i", "-", "no aplica", UNLISTED, None]
    cat = spark.createDataFrame(CATALOGUE, "e string, n string, o string").withColumn("value", F.lit(1))
    df = spark.createDataFrame([(v, "z") for v in [*typed, *typed, *nothing]], "value string, e string")
    got = map_to_catalogue(df, "value", cat, "e", "n", "o", {**WORKS, "emb": "embalse", "pe": "parque eolico"}).collect()
    assert {r[0]: r[1] for r in got} == typed and len(got) == len(typed)
    assert map_to_catalogue(df.limit(0), "value", cat, "e", "n", "o").count() == 0
    assert {r[1] for r in map_to_catalogue(df, "value", cat.limit(0), "e", "n", "o").collect()} == {UNLISTED}


def test_mapping_to_any_list(spark):
    """Nothing about the list is in the code: cities, job titles, brands."""
    names = ["Valparaiso", "Concepcion", "Puerto Montt", "Data Engineer", "Data Analyst", "Senior Data Engineer", "Acme Tools", None]
    cat = spark.createDataFrame([(f"e{i}", n, "The Garden City" if i == 1 else None) for i, n in enumerate(names)], "e string, n string, o string")
    typed = {
        "Valparaiso": "e0", "Valparaizo": "e0", "VALPARAÍSO": "e0", "Concepcion": "e1", "Conception": "e1", "the garden city": "e1", "Puerto Montt": "e2",
        "Montt, Puerto": "e2", "puerto mont": "e2", "Puerto": UNLISTED, "data enginer": "e3", "Data Engineer": "e3", "DataEngineer": "e3", "data analist": "e4",
        "Senior Data Engineer": "e5", "acme tols": "e6", "Santiago": UNLISTED, "Painter": UNLISTED,
    }
    df = spark.createDataFrame([(v,) for v in typed], "v string")
    got = {r[0]: r[1] for r in map_to_catalogue(df, "v", cat, "e", "n", "o").collect()}
    assert {k: (v, got[k]) for k, v in typed.items() if got.get(k) != v} == {}


def test_ambiguous_values_are_reported(spark):
    cat = spark.createDataFrame([("a", "Lago Rendalmir", None), ("b", "Lago Rendalmor", None)], "e string, n string, o string")
    df = spark.createDataFrame([("lago rendalmer",), ("lago rendalmir",)], "v string")
    got = map_to_catalogue(df, "v", cat, "e", "n", "o", ambiguous=True).collect()
    assert [(r[0], r[1]) for r in got] == [("lago rendalmer", ["a", "b"])]


@pytest.mark.parametrize(
    "name,parts",
    [
        ("Junta de Vecinos N° 30 Tocheplubra", ("jv", "30", "", "", "tocheplubra", "", "")), ("Tocheplubra, Junta de Vecinos 30", ("jv", "30", "", "", "tocheplubra", "", "")),
        ("JV N.º 30 Tocheplubra", ("jv", "30", "", "", "tocheplubra", "", "")), ("Cía. Minera Calche S.A.", ("minera", "", "", "", "calche", "", "")),
        ("Calche (Minera)", ("minera", "", "", "", "calche", "", "")), ("FPA Namaldingru", ("fpa", "", "", "", "namaldingru", "", "")),
        ("Frente por las Aguas de Namaldingru (FPA)", ("fpa", "", "", "", "namaldingru", "", "")), ("Goyo Ponoluchin", ("per", "", "gregorio", "g", "ponoluchin", "", "")),
        ('Rafael "Rafa" Chelhue', ("per", "", "rafael", "r", "chelhue", "", "")), ("CHOLBRO, Yolanda", ("per", "", "yolanda", "y", "cholbro", "", "")),
        ("Y. Cholbro Rerelli", ("per", "", "", "y", "cholbro", "rerelli", "r")), ("Lic. Violeta Pulcho (vocera, sector alto)", ("per", "", "violeta", "v", "pulcho", "", "")),
        ("Antonia Gibite R.", ("per", "", "antonia", "a", "gibite", "", "r")), ("vecinos", ("",) * 7), ("s/i", ("",) * 7), ("", ("",) * 7), (None, ("",) * 7), ("Junta de Vecinos", ("",) * 7),
        ("Comnidad Indígena de Lilgi", ("ci", "", "", "", "lilgi", "", "")),
    ],
)
def test_reading_names(name, parts):
    assert read_name(name) == parts


def test_variants(spark):
    one = ["Yolanda Cholbrode Rerelliral", "Y. Cholbrode Rerelliral", "CHOLBRODE, Yolanda", "Yoli Cholbrode Rerelliral", "yolanda cholbrode-rerelliral", "Yolanda Cholbroed Rerelliral"]
    other = ["Isabel Cholbrode Rerelliral", "Isabel Cholbrode Rereliral"]
    org = ["Comunidad Indígena N° 7 Romoldenfu", "Romoldenfu, Comunidad Indígena 7", "com. ind. n.o 7 romoldenfu"]
    rest = ["Comunidad Indígena N° 8 Romoldenfu", "Junta de Vecinos N° 7 Romoldenfu", "vecinos", "-", "", None, "w" * 4000]
    df = spark.createDataFrame([(n, 1) for n in [*one, *other, *org, *rest, *one, " " + one[0] + " "]], "entity string, name int")
    pairs = {tuple(r) for r in variant_pairs(df, "entity").collect()}
    want = {(a, b) for group in (one, other, org) for a in group for b in group if a < b}
    assert pairs == want
    assert entities(df.limit(0), "entity").count() == 0


def test_variants_with_another_lexicon(spark):
    """Names of another language: given names, kinds and short forms come with the lexicon, or there are none."""
    english = Lexicon(kinds={"council": "council", "union": "union", "mining": "mining"}, heads=("company", "city"), stop=("the", "of", "and"), titles=("mr", "mrs", "dr"), given=("margaret", "robert", "john"), short={"peggy": "margaret", "bob": "robert"})
    groups = [
        ["Margaret Thompson", "Peggy Thompson", "THOMPSON, Margaret", "Dr. Margaret Thomson", "Margaret Thompsno"], ["Robert Thompson", "Bob Thompson"],
        ["Acme Holdings Inc", "ACME Holdings, Inc.", "Acme Holdigns Inc"], ["Mining Company of Redrock", "Redrock Mining"], ["Redrock Council"],
    ]
    names = [n for g in groups for n in g] + ["Margaret Thompson"] * 4 + ["Acme Holdings Inc"] * 2
    df = spark.createDataFrame([(n,) for n in names], "n string")
    want = {tuple(sorted((a, b))) for g in groups for a in g for b in g if a != b}
    assert {tuple(r) for r in variant_pairs(df, "n", english).collect()} == want
    got = {r[0]: r[1] for r in entities(df, "n", english).collect()}
    assert [len({got[n] for n in g}) for g in groups] == [1] * 5 and len(set(got.values())) == 5
    assert variant_pairs(df, "n", Lexicon()).count() > 0


def test_repeated_rows_change_no_link(spark):
    """A spelling with one name joins one with several; two spellings with several names each stay apart."""
    forms = lambda x: [f"Minera {x} S.A.", f"MINERA {x}", f"{x}, Minera"]
    names = forms("Calcheruntu") + ["Minera Calcherunti S.A."] + forms("Pelmuchanfe") + forms("Pelmuchanfa")
    want = {tuple(sorted(p)) for g in (names[:4], names[4:7], names[7:]) for p in combinations(g, 2)}
    for times in (1, 10):
        df = spark.createDataFrame([(n,) for n in names * times], "n string")
        assert {tuple(r) for r in variant_pairs(df, "n").collect()} == want


def test_ambiguous_initials_stay_apart(spark):
    df = spark.createDataFrame([(n,) for n in ("Isabel Chinyudi Filulche", "Ignacio Chinyudi Filulche", "I. Chinyudi Filulche")], "n string")
    assert variant_pairs(df, "n").count() == 0
