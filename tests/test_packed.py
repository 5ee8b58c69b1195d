import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tramado.operators.packed import explode_packed, split_packed


def split(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(split_packed(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    "value,parts",
    [
        ("A; B ;C;", ["A", "B", "C"]), ('["a, b", "c"]', ["a, b", "c"]), ("['a', 'b']", ["a", "b"]), ('"x ""y"" z","w"', ['x "y" z', "w"]),
        ('["Luis \\"Lucho\\" P", "b"]', ['Luis "Lucho" P', "b"]), ("A, B", ["A", "B"]), ("A, B; C", ["A, B", "C"]), ("a (b; c, d)", ["a (b; c, d)"]),
        ("1) x 2) y, z", ["x", "y, z"]), ("1. x\n2. y", ["x", "y"]), ("- a\n- b", ["a", "b"]), ("* a\r\n* b", ["a", "b"]), ("a || b;; c", ["a", "b", "c"]),
        ("a / b • c", ["a", "b", "c"]), ("solo", ["solo"]), ('"solo, uno"', ["solo, uno"]), (" ; | ", []), ("", []), (None, []),
        ('"sin cerrar; b', ['"sin cerrar', "b"]), ("a\tb", ["a", "b"]), ('P "Q" R', ['P "Q" R']), ("0;1", ["0", "1"]), ("«a; b» | c", ["a; b", "c"]),
    ],
)
def test_split(spark, value, parts):
    assert split(spark, value) == [parts]


def test_long_fields(spark):
    quoted, plain = '"' + "a;" * 100_000 + '"', ";".join(["x"] * 50_000)
    got = split(spark, quoted, plain)
    assert got[0] == ["a;" * 100_000] and len(got[1]) == 50_000


def test_positions_nulls_and_extra_columns(spark, rows):
    df = spark.createDataFrame([("1", "a;b", "n"), ("1", "a;b", "n"), (None, "c", "n"), ("2", None, "n")], "doc string, f string, valor string")
    assert sorted((tuple(r) for r in explode_packed(df, "doc", "f").collect()), key=str) == sorted([("1", 1, "a"), ("1", 2, "b"), ("1", 1, "a"), ("1", 2, "b"), (None, 1, "c")], key=str)
    assert explode_packed(df.limit(0), "doc", "f").count() == 0


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab ,;|/()\"'", min_size=1, max_size=8), min_size=1, max_size=5), min_size=40, max_size=60))
def test_round_trip_of_quoted_values(spark, fields):
    """Values written with quotes doubled come back, whatever they hold."""
    fields = [[v.strip() for v in vs if v.strip() and not re.fullmatch(r"[\"'].*[\"']", v.strip())] for vs in fields]
    packed = ["; ".join('"' + v.replace('"', '""') + '"' for v in vs) for vs in fields]
    assert split(spark, *packed) == fields
