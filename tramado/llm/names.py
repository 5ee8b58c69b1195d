"""Variant spellings of names typed by people: pigeonhole segment join with banded edit distance.

A name is read into parts: for an organisation its kind, number and proper name; for a person the given name (or its
initial) and surnames. Kinds and numbers must agree exactly. Proper names and surnames are mistyped freely, so they are
compared as text: each is cut into k+1 segments, position-shifted substrings are looked up in an inverted index of
segments, and candidates are verified by banded edit distance. A spelling joins the most frequent one near it, never
the other way round, so chains of typing errors don't run across names. Which words tell kinds, given names and short
forms is data (:class:`Lexicon`), not part of the method.
Reduced forms (initials, one surname) join a full name only where there is just one that they can stand for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISREAD
from ..sources.tables import Scratch
from .lexicon import SPANISH, Lexicon, nearest
from .pigeonhole import probes, segments

EDITS = 2
#: From so many letters two edits count; how many times as many names a spelling must have to stand for another one.
LONG = 8
RATIO = 1.5
_TOKEN = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\bn(?:[.°º]|ro|um|umero|o)*\s*(\d+)\b", re.I)


def _fold(s: str) -> str:
    if "Ã" in s or "Â" in s:
        for bad, good in MISREAD.items():
            s = s.replace(bad, good)
    s = unicodedata.normalize("NFKD", s.lower())
    return "".join(c for c in s if not unicodedata.combining(c))


_EMPTY = ("", "", "", "", "", "", "")


def _legal(s: str, forms: tuple[str, ...]) -> str:
    """A name without its form of company."""
    for form in forms:
        got = re.sub(r"[\s,]+" + form + r"\s*$", "", s)
        if got != s:
            return got
    return s


def _kind_of(tokens: list[str], lex: Lexicon) -> tuple[str, list[str]]:
    """The kind the words tell, and the words left over."""
    kind, rest, heads = "", [], False
    for t in tokens:
        k = lex.kinds.get(t)
        if k is None and t not in lex.heads and len(t) >= 4:
            k = nearest(t, lex.kind_index)
        elif k is None and t in lex.heads:
            k = "-"
        if k is None:
            rest.append(t)
            continue
        heads = True
        k = "" if k == "-" else k
        if k and (not kind or kind == k or k in lex.kinds_over.get(kind, ())):
            kind = kind or k
        elif k and kind != k:
            rest.append(t)
    alone = next((t for t in rest if t in lex.weak_kinds), None)
    if kind or heads:
        return kind or lex.weak_kinds.get(alone, ""), [t for t in rest if t not in lex.weak]
    if alone and len(alone) > 1:
        return lex.weak_kinds[alone], [t for t in rest if t != alone]
    return "", rest


def read_name(name: str | None, lex: Lexicon = SPANISH) -> tuple[str, str, str, str, str, str, str]:
    """The parts of a name: kind (``per`` for people), number, given name, its initial, first name part (surname or
    proper name), second surname, its initial. All empty if the name names nobody."""
    if not name or not name.strip():
        return _EMPTY
    s = _fold(name.strip())
    if " ".join(_TOKEN.findall(s)) in lex.nobody:
        return _EMPTY
    inner = re.findall(r"\(([^)]*)\)", s)
    s = re.sub(r"\([^)]*\)", " ", s)
    nick = re.findall(r"[\"“”'](\w+)[\"“”']", s)
    s = re.sub(r"[\"“”']\w+[\"“”']", " ", s)
    s = s.replace('"', " ").replace("jj.vv", "jjvv")
    bare = _legal(s, lex.legal)
    legal, s = bare != s, bare
    number = ""
    m = _NUMBER.search(s)
    if m:
        number, s = m[1].lstrip("0") or "0", s[: m.start()] + " " + s[m.end() :]
    swapped = s.count(",") == 1
    if swapped:
        a, b = s.split(",")
        s = b + " " + a
    tokens = _TOKEN.findall(s)
    if not number and any(t.isdigit() for t in tokens):
        number = next(t for t in tokens if t.isdigit()).lstrip("0") or "0"
        tokens = [t for t in tokens if not t.isdigit()]
    first = tokens[0] if tokens else ""
    person = not legal and not number and (first in lex.people or first in lex.short) and not any(t in lex.kinds or t in lex.heads for t in tokens[1:])
    if not person:
        kind, rest = _kind_of([t for t in tokens if t not in lex.stop or len(tokens) < 2], lex)
        if not kind:
            for part in inner:
                kind = kind or lex.kinds.get(part.strip()) or (lex.weak_kinds.get(part.strip(), "") if len(part.strip()) == 1 else "")
        if not kind and (legal or number):
            kind = "org"  # a company or a numbered body of a kind that isn't known
        if kind:
            # A mistyped "de" or "del" is no part of the name.
            core = "".join(t for t in rest if t not in lex.stop and not (len(t) < 4 and ("d" in t or "e" in t) and len(rest) > 1))
            return (kind, number, "", "", core, "", "") if len(core) > 2 else _EMPTY
        if rest != tokens and not rest:
            return _EMPTY
    tokens = [t for t in tokens if t not in lex.titles]
    if len(tokens) < 2 and not (nick and tokens):
        return _EMPTY
    given = initial = ""
    at = next((i for i, t in enumerate(tokens) if t in lex.people or t in lex.short), None)
    if at is None and not (len(tokens[0]) == 1):
        at = next((i for i, t in enumerate(tokens) if len(t) > 3 and nearest(t, lex.name_index)), None)
    if at is not None:
        given = lex.short.get(tokens[at]) or (tokens[at] if tokens[at] in lex.people else nearest(tokens[at], lex.name_index) or "")
        tokens = tokens[:at] + tokens[at + 1 :]
    elif len(tokens[0]) == 1:
        initial, tokens = tokens[0], tokens[1:]
    else:
        given, tokens = tokens[0], tokens[1:]
    initial = given[:1] or initial
    if tokens and tokens[0] == given:
        tokens = tokens[1:]
    tokens = [t for t in tokens if t not in lex.stop]
    if not tokens or len(tokens[0]) < 3:
        return _EMPTY
    second = tokens[1] if len(tokens) > 1 else ""
    return ("per", "", given, initial, tokens[0], second if len(second) > 1 else "", second[:1])


_SCHEMA = "name string, kind string, num string, given string, ini string, one string, two string, two_ini string"


def _reader(lex: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            parts = [read_name(x, lex) for x in names.to_pylist()]
            cols = list(zip(*parts)) if parts else [[]] * 7
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), *[pa.array(c, pa.string()) for c in cols]], ["name", "kind", "num", "given", "ini", "one", "two", "two_ini"])

    return read


def canonical_spellings(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(block, text, best)`` for ``words`` (columns block, text, n): the spelling each text stands for within its block:
    of those one edit or one swap of neighbours away the one that the most names carry
    (``n``: different strings, so repeated rows don't count; ties: the smaller), if they are at least ``ratio`` times as
    many, or if both spellings have one name only. With ``ratio`` 1, for blocks that hold what else agrees, the one with
    more names, of equal ones the smaller; there two edits count from ``LONG`` letters. Texts without such a neighbour are not in the result."""
    text = words.where(F.length("text") > EDITS)
    probe = probes(text.select("block", "text", "n"), "text", EDITS)
    index = segments(text.select("block", F.col("text").alias("other"), F.col("n").alias("m")), "other", EDITS)
    j = probe.join(index, ["block", "seg_n", "seg_i", "seg"])
    more = (F.col("m") >= ratio * F.col("n")) | (F.col("n") == 1)
    j = j.where((F.col("text") != F.col("other")) & more & ((F.col("m") > F.col("n")) | (F.col("other") < F.col("text"))))
    j = j.select("block", "text", "n", "other", "m").distinct()
    edits = F.levenshtein("text", "other", EDITS)
    swap = F.array_sort(F.split("text", "")) == F.array_sort(F.split("other", ""))
    wide = swap & (F.length("text") == F.length("other"))
    if ratio == 1:
        wide = wide | (F.least(F.length("text"), F.length("other")) >= LONG)
    wide = (edits == 2) & wide
    near = j.where((edits == 1) | wide)
    up = near.groupBy("block", "text").agg(F.min(F.struct(-F.col("m"), F.col("other")))["other"].alias("best"))
    # A rare spelling of a rare spelling: one more step up.
    far = up.alias("a").join(up.select("block", F.col("text").alias("best"), F.col("best").alias("top")).alias("b"), ["block", "best"], "left")
    return far.select("block", "text", F.coalesce("top", "best").alias("best"))


def _respelled(forms: DataFrame, column: str, block: Column, ratio: float = RATIO) -> DataFrame:
    """``forms`` with ``column`` respelled within ``block``; where that is null, as it is."""
    with_block = forms.withColumn("block", block)
    words = with_block.where((F.col(column) != "") & F.col("block").isNotNull()).groupBy("block", F.col(column).alias("text")).agg(F.count("*").alias("n"))
    best = canonical_spellings(words, ratio).select("block", F.col("text").alias(column), "best")
    return with_block.join(best, ["block", column], "left").withColumn(column, F.coalesce("best", column)).drop("best", "block")


def entities(names: DataFrame, column: str, lexicon: Lexicon = SPANISH) -> DataFrame:
    """Distinct names with the entity each stands for, ``(name, entity)``: a row per spelling, however many there are of
    one name. Names that name nobody (null, blank, placeholders, generic words, an organisation's kind alone) are left
    out. An empty table gives an empty one; columns other than ``column`` aren't read. Repeated names add nothing."""
    scratch = Scratch(names.sparkSession, "names")
    trimmed = names.select(F.trim(F.regexp_replace(column, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")).alias("name")).where("name <> ''")
    distinct = trimmed.distinct()
    read = scratch.write(distinct.mapInArrow(_reader(lexicon), _SCHEMA).where("kind <> ''"))
    # Where a given name and the other surname agree, one spelling is as good as another; elsewhere it must be the rarer.
    known = (F.col("kind") == "per") & (F.col("given") != "")
    steps = [
        ("one", F.when(known & (F.col("two") != ""), F.concat_ws("|", "given", "two")), 1),
        ("one", F.concat_ws("|", "kind", "num", "ini"), RATIO),
        ("two", F.when(known, F.concat_ws("|", "given", "one")), 1),
        ("two", F.concat_ws("|", "kind", "ini", F.when(F.col("kind") == "per", F.col("one")).otherwise("")), RATIO),
    ]
    forms = read
    for column, block, ratio in steps:
        now = scratch.write(_respelled(forms, column, block, ratio))
        scratch.drop(forms)
        forms = now
    orgs = forms.where("kind <> 'per'").select("name", F.concat_ws("|", "kind", "num", "one").alias("entity"))
    people = forms.where("kind = 'per'")
    key = people.select("given", "ini", "one", "two", "two_ini").distinct()
    full = key.where("given <> '' and two <> ''").select("given", "ini", "one", "two", "two_ini")
    one_of = lambda by, what: full.groupBy(*by).agg(F.count_distinct(what).alias("k"), F.min(what).alias("x")).where("k = 1").drop("k")
    # A second surname left out or reduced to its initial; a given name reduced to its initial; both.
    no_two = one_of(["given", "one"], "two").select("given", "one", F.col("x").alias("t1"))
    ini_two = one_of(["given", "one", "two_ini"], "two").select("given", "one", "two_ini", F.col("x").alias("t2"))
    no_given = one_of(["ini", "one", "two"], "given").select("ini", "one", "two", F.col("x").alias("g1"))
    pair = full.withColumn("pair", F.struct("given", "two"))
    neither = pair.groupBy("ini", "one").agg(F.count_distinct("pair").alias("k"), F.min("pair").alias("x")).where("k = 1").select("ini", "one", F.col("x").alias("p1"))
    short = key.where("given <> '' and two = ''").groupBy("ini", "one").agg(F.count_distinct("given").alias("k"), F.min("given").alias("g2")).where("k = 1").drop("k")
    r = key.join(no_two, ["given", "one"], "left").join(ini_two, ["given", "one", "two_ini"], "left")
    r = r.join(no_given, ["ini", "one", "two"], "left").join(neither, ["ini", "one"], "left").join(short, ["ini", "one"], "left")
    has_given, has_two = F.col("given") != "", F.col("two") != ""
    given = F.when(has_given, F.col("given")).when(has_two, F.col("g1")).otherwise(F.coalesce("p1.given", "g2"))
    two = (
        F.when(has_two, F.col("two"))
        .when(has_given & (F.col("two_ini") != ""), F.coalesce("t2", F.concat(F.col("two_ini"), F.lit("."))))
        .when(has_given, F.coalesce("t1", F.lit("")))
        .otherwise(F.coalesce("p1.two", F.lit("")))
    )
    r = r.select("given", "ini", "one", "two", "two_ini", F.concat_ws("|", F.lit("per"), F.coalesce(given, F.concat(F.col("ini"), F.lit("."))), "one", two).alias("entity"))
    return orgs.union(people.join(r, ["given", "ini", "one", "two", "two_ini"]).select("name", "entity"))


def variant_pairs(names: DataFrame, column: str, lexicon: Lexicon = SPANISH) -> DataFrame:
    """Pairs ``(nombre_a, nombre_b)``, a < b, of different strings that name the same person or organisation. Every
    pair within an entity is given, since the result is defined as pairs; :func:`entities` has a row per string."""
    e = Scratch(names.sparkSession, "entities").write(entities(names, column, lexicon))
    a, b = e.select("entity", F.col("name").alias("nombre_a")), e.select("entity", F.col("name").alias("nombre_b"))
    return a.join(b, "entity").where("nombre_a < nombre_b").select("nombre_a", "nombre_b")
