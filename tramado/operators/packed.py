"""Several values packed in one field: one row per value, with its place.

Built-in expressions only, evaluated row by row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders stand between two private-use characters. Where a text holds one of these itself, it is masked like a
# quoted span and restored with the rest, so no text can be mistaken for a placeholder.
_OPEN, _CLOSE, _CUT = "", "", ""
_SPANS = (
    '"[^"\\\\]*+(?:(?:\\\\.|"")[^"\\\\]*+)*+"'
    "|(?<![\\p{L}\\p{N}])'[^'\\\\]*+(?:\\\\.[^'\\\\]*+)*+'(?![\\p{L}\\p{N}])"
    "|«[^»]*»|“[^”]*”"
    "|\\([^()]*+(?:\\([^()]*+\\)[^()]*+)*+\\)"
    f"|[{_OPEN}{_CLOSE}{_CUT}]"
)
_BLANKS = "^[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+$"
_QUOTED = "^(?:\"(?s:.*)\"|'(?s:.*)'|«(?s:.*)»|“(?s:.*)”)$"
_HARD = "[;|\\n\\r\\t•\\u2028]+|\\s/\\s"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda refers to from outside is computed per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _BLANKS, "")


def _restore(value: Column, spans: Column) -> Column:
    """Put the spans back: the pieces between placeholders, each followed by the span its index names."""
    pieces = F.split(value, f"{_OPEN}[0-9]+{_CLOSE}", -1)
    at = F.regexp_extract_all(value, F.lit(f"{_OPEN}([0-9]+){_CLOSE}"), 1)
    return F.array_join(
        F.zip_with(pieces, at, lambda p, i: F.concat(p, F.coalesce(F.get(spans, i.cast("int")), F.lit("")))), ""
    )


def _unquote(v: Column) -> Column:
    """Take enclosing quotes off, undo doubled and backslashed quotes inside, trim."""
    inner = F.substring(v, 2, F.length(v) - 2)
    plain = F.regexp_replace(F.regexp_replace(inner, "\\\\([\"'\\\\/])", "$1"), '""', '"')
    return F.when(v.rlike(_QUOTED) & (F.length(v) >= 2), _trim(plain)).otherwise(v)


def split_packed(field: Column) -> Column:
    """The values of a packed field as an array of strings, in order, empty ones left out.

    Quoted and parenthesised spans are masked first, so no mark inside them separates. Then the field is cut at
    ``;``, ``|``, line breaks, tabs, bullets and a slash between blanks, or at the numbers of a numbered list; only a
    field with none of these is cut at commas. Spans are restored by index.

    Null, empty and blank fields give an empty array. Quotes that never close separate nothing and stay as they are.
    """
    def mask(spans: Column) -> Column:
        mark = lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))).otherwise(p)
        return F.array_join(F.transform(F.split(field, _SPANS, -1), mark), "")

    def separate(body: Column) -> Column:
        cut = F.transform(F.split(body, f"{_HARD}|{_CUT}", -1), lambda v: F.regexp_replace(_trim(v), "^[-*–·‣▪]\\s+", ""))
        return F.filter(cut, lambda v: F.length(v) > 0)

    def commas(cut: Column) -> Column:
        # Trailing or doubled marks separate nothing: a field of which they leave one value is still cut at commas.
        one = F.filter(F.transform(F.split(F.get(cut, F.lit(0)), ",", -1), _trim), lambda v: F.length(v) > 0)
        return F.when(F.size(cut) == 1, one).otherwise(cut)

    def values(spans: Column) -> Column:
        body = _let(F.regexp_replace(_trim(mask(spans)), "^\\[(?s:(.*))\\]$", "$1"), _unnumbered)
        cut = _let(_let(body, separate), commas)
        return F.filter(F.transform(cut, lambda v: _let(_restore(v, spans), _unquote)), lambda v: F.length(v) > 0)

    return F.coalesce(_let(F.regexp_extract_all(field, F.lit(_SPANS), 0), values), F.array().cast("array<string>"))


def _unnumbered(body: Column) -> Column:
    """The marks of a numbered list become cuts."""
    return (
        F.when(body.rlike("^\\s*1\\)\\s"), F.regexp_replace(body, "(?:^|(?<=[\\s;,|]))\\d{1,3}\\)\\s+", _CUT))
        .when(body.rlike("^\\s*1\\.\\s"), F.regexp_replace(body, "(?:^|(?<=[\\s;,|]))\\d{1,3}\\.\\s+", _CUT))
        .otherwise(body)
    )


def explode_packed(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row ``(key, posicion, valor)`` per value of ``field``; places count from 1. Rows are as many as values:
    repeated input rows give repeated rows. An empty table gives an empty one; other columns are not read."""
    got = df.select(F.col(key), F.posexplode(split_packed(F.col(field))).alias("posicion", "valor"))
    return got.select(key, (F.col("posicion") + 1).alias("posicion"), "valor")
