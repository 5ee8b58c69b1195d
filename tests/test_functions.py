import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramado.functions import scalars as S
from tramado.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "value,key",
    [
        ("  El Gran Valle ", "gran valle"), ("El Niño", "el nino"), ("no aplica", None), ("", None), (None, None), ("-", None),
        ('"Mina" Sur.,', "mina sur"), ("A;B|C", "a b c"), ("ÁÉÍ  óú", "aei ou"), ("N/A", None), ("Planta Norte", "planta norte"),
    ],
)
def test_base_key(spark, value, key):
    assert one(spark, value, T.base_key) == key


def test_acronyms(spark):
    df = spark.createDataFrame([("consejo minero nacional (cmn)",), ("ministerio de obras (mdo)",), ("persona (pp)",), ("sin sigla",)], "k string")
    name, acr = T.acronym_form(F.col("k"))
    got = [tuple(r) for r in df.select(name.alias("n"), acr.alias("a"), T.initials_match(name, acr).alias("m")).collect()]
    assert got == [("consejo minero nacional", "cmn", True), ("ministerio de obras", "mdo", True), ("persona", "pp", False), (None, None, None)]


@pytest.mark.parametrize("value,family", [("Recurso de Protección", "judicial"), ("denuncia publica", "manifestacion_publica"), ("Denuncia", "administrativo_general"), ("", "otro"), (None, "otro"), ("Toma", "manifestacion_publica")])
def test_family(spark, value, family):
    assert one(spark, value, lambda c: T.family_of(T.base_key(c))) == family


def test_rules_first_wins(spark):
    label, pattern = T.first_rule(F.col("k"), [("a", "uno"), ("b", "dos")], "nada")
    df = spark.createDataFrame([("ab",), ("b",), ("c",), (None,)], "k string")
    assert [tuple(r) for r in df.select(label, pattern).collect()] == [("uno", "a"), ("dos", "b"), ("nada", None), ("nada", None)]


def test_labelled_field(spark):
    assert one(spark, "x Lugar:  Valle\n Norte FIN más", lambda c: T.labelled_field(c, "Lugar", ("FIN",))) == "Valle Norte"
    assert one(spark, "nada", lambda c: T.labelled_field(c, "Lugar")) == ""


@pytest.mark.parametrize("value,day", [("2024-05-01", "2024-05-01"), ("2024-13-01", None), ("", None), (None, None), ("2024-02-11T21:15:00", "2024-02-11"), ("2024", None)])
def test_day(spark, value, day):
    assert one(spark, value, lambda c: S.day(c).cast("string")) == day


def test_wilson(spark):
    low, high = S.wilson(F.lit(37.0), F.lit(50.0))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (round(r.a, 3), round(r.b, 3)) == (0.604, 0.841)


def test_cosine_and_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(S.cosine(F.col("a"), F.col("b")).alias("c"), S.unit(F.col("a")).alias("u")).collect()
    assert got[0].c == pytest.approx(0.96) and got[0].u == pytest.approx([0.6, 0.8]) and got[1].c is None and got[1].u == [0.0, 0.0]


def test_jitter_stays_near(spark):
    df = spark.range(200).select(F.datediff(S.jitter(F.lit("2020-01-01").cast("date"), 7, F.lit(1), F.col("id")), F.lit("2020-01-01")).alias("d"))
    got = {r.d for r in df.collect()}
    assert min(got) == -7 and max(got) == 7


@settings(max_examples=5, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", ""]), min_size=2, max_size=2))
def test_jaccard_bounds(spark, pair):
    df = spark.createDataFrame([tuple(pair)], "a string, b string")
    v = df.select(T.token_jaccard(F.col("a"), F.col("b"))).first()[0]
    assert 0 <= v <= 1 and (v == 1) == (set(pair[0].split()) == set(pair[1].split()) != set())
