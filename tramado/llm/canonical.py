"""Mapping free-entered values to a canonical list: pigeonhole joins, built-in expressions only.

The list alone says how its names are built. In each name the rarest word is the proper name; words after it tell the
stage or sector; words before it tell the kind, except those that occur with several kinds (articles, "hill", "valley").
The words of the list are the reference strings: cut into k+1 segments, they meet the typed words by equality of
positional substrings, and ``levenshtein`` verifies. A value means an entry if proper name and kind agree and the words
for stage or sector are the same. Values that this leaves over are compared as a whole, blanks left out, by the same
join, so that words written together or torn apart are found too; what is still left over is reported by an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_words
from ..sources.tables import Scratch
from .pigeonhole import within_edits

UNLISTED = "SIN_SUBHILO_ESPECIFICO"
EDITS = 2
#: With so many kinds of names a word before the proper name tells none of them.
WIDE = 3
# What stands for nothing known.
NOTHING = ("s i", "n a", "no aplica", "sin informacion", "sin datos", "desconocido", "no especificado", "ninguno", "null", "none", "nan", "x")


def known(field: Column) -> Column:
    """Whether a value says anything: not null, blank, a placeholder for nothing known, or the literal for unlisted."""
    v = plain_words(field)
    return F.coalesce((v != "") & ~v.isin(*NOTHING) & (F.trim(field) != UNLISTED) & (v != "sin subhilo especifico"), F.lit(False))


def _words(c: Column, synonyms: dict[str, str]) -> Column:
    """The words of a value; letters of an abbreviation joined (``c. h.`` -> ``ch``) but for those that are synonyms
    themselves, synonyms replaced."""
    own = "".join(sorted(k for k in synonyms if len(k) == 1 and k.isalpha()))
    letter = f"[a-z&&[^{own}]]" if own else "[a-z]"
    v = F.regexp_replace(plain_words(c), f"(?<![^ ])({letter}) (?=[a-z](?: |$))", "$1")
    if not synonyms:
        return F.split(v, " ")
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.split(F.array_join(F.transform(F.split(v, " "), lambda w: F.coalesce(table[w], w)), " "), " ")


def _in_order(what: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(F.col(what), F.struct("pos", "word")))), lambda x: x["word"])


def _entries(catalogue: DataFrame, entry: str, name: str, synonyms: dict[str, str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(entry, core, phrase, suffix)`` of each name, and its words by role: ``(ref, role, val)``."""
    w = catalogue.where(F.col(name).isNotNull()).select(entry, F.posexplode(_words(F.col(name), synonyms)).alias("pos", "word")).where("word <> ''")
    w = scratch.write(w)
    w = scratch.write(w.join(w.groupBy("word").agg(F.count_distinct(entry).alias("df")), "word"))
    rarest = F.min(F.struct((F.length("word") < 4).alias("short"), "df", (-F.length("word")).alias("l"), F.col("pos").alias("at"), F.col("word").alias("core")))
    first = F.min_by("word", "pos")
    head = w.groupBy(entry).agg(rarest.alias("c"), first.alias("first")).select(entry, F.col("c.at").alias("at"), F.col("c.core").alias("core"), "first")
    w = scratch.write(w.join(head, entry))
    wide = w.where("pos < at and word <> first").groupBy("word").agg(F.count_distinct("first").alias("kinds")).where(F.col("kinds") >= WIDE).select("word")
    w = scratch.write(w.join(wide.withColumn("wide", F.lit(True)), "word", "left").withColumns({"tells": F.expr("pos < at and wide is null"), "ends": F.col("pos") > F.col("at")}))
    e = w.groupBy(entry, "core").agg(F.array_join(_in_order("tells"), " ").alias("phrase"), F.array_sort(F.collect_set(F.when(F.col("ends"), F.col("word")))).alias("suffix"))
    e = scratch.write(e)
    phrases = e.select("phrase").where("phrase <> ''").distinct()
    kind = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("ref"))
    one = lambda d: d.groupBy("ref").agg(F.count_distinct("phrase").alias("k"), F.min("phrase").alias("val")).where("k = 1").select("ref", F.lit("kind").alias("role"), "val")
    telling = scratch.write(one(kind))
    # Short for a kind: its words' initials, and beginnings of three letters or more of its telling words.
    initials = phrases.where("phrase like '% %'").select("phrase", F.array_join(F.transform(F.split("phrase", " "), lambda x: F.substring(x, 1, 1)), "").alias("ref"))
    long_ = telling.where("length(ref) > 3")
    starts = long_.select(F.col("val").alias("phrase"), F.explode(F.transform(F.sequence(F.lit(3), F.length("ref") - 1), lambda n: F.substring(F.col("ref"), F.lit(1), n))).alias("ref"))
    every = w.select("word").distinct()
    short = one(initials.select("phrase", "ref").union(starts)).join(every, F.col("ref") == F.col("word"), "left_anti").withColumn("role", F.lit("short"))
    roles = telling.union(short).union(w.where("ends").select("word", F.lit("suffix"), "word").distinct())
    roles = roles.union(e.select("core", F.lit("core"), "core").distinct()).union(every.select("word", F.lit("word"), "word"))
    return e, roles


def map_to_catalogue(values: DataFrame, value: str, catalogue: DataFrame, entry: str, name: str, other: str, synonyms: dict[str, str] | None = None, ambiguous: bool = False) -> DataFrame:
    """Distinct ``value`` of ``values`` with the ``entry`` of ``catalogue`` it means, ``UNLISTED`` if none. The catalogue has
    an entry's ``name`` and perhaps an ``other`` name. ``synonyms`` maps words and abbreviations to words of the list
    that neither spelling nor initials nor beginnings lead to; at most some hundreds.

    Values for which :func:`known` is false are left out. A word mistyped by up to two edits (one in words under six
    letters, synonyms and beginnings; or two letters swapped) counts as the word; words under four letters, and beginnings of words under five, must be exact. A word equally near
    to several proper names stands for each of them. If a value means several entries, the one with most of its words
    in the value is given, of these the smallest identifier; ``ambiguous=True`` gives instead the values that mean several,
    with the identifiers in order (``entries``). An empty table or catalogue gives no rows or only unlisted values; null
    names and other columns are not read.
    """
    synonyms = synonyms or {}
    scratch = Scratch(values.sparkSession, "canonical")
    v = scratch.write(values.select(F.col(value).alias("value")).where(known(F.col(value))).distinct().withColumn("words", _words(F.col("value"), synonyms)))
    vw = v.select("value", F.explode(F.array_distinct("words")).alias("word")).where("word <> ''")
    c = catalogue.select(F.col(entry).alias("entry"), F.col(name).alias("name"), F.col(other).alias("other"))
    e, roles = _entries(c, "entry", "name", synonyms, scratch)
    roles = scratch.write(roles)
    # Another name is known by its rarest word that is no word of the names.
    o = c.where("other is not null").select("entry", F.explode(_words(F.col("other"), synonyms)).alias("word")).where("word <> ''")
    o = o.join(o.groupBy("word").agg(F.count_distinct("entry").alias("df")), "word")
    o = o.groupBy("entry").agg(F.min(F.struct("df", (-F.length("word")).alias("l"), "word"))["word"].alias("core"))
    roles = roles.union(o.select("core", F.lit("other"), "core").distinct())
    # Synonyms are mistyped as words of the list are.
    long_ = [(k, x) for k, x in synonyms.items() if len(k) > 4 and " " not in x]
    if long_:
        also = values.sparkSession.createDataFrame(long_, "synonym string, ref string")
        roles = roles.union(roles.where("role <> 'short'").join(F.broadcast(also), "ref").select("synonym", F.when(F.col("role") == "kind", F.lit("short")).otherwise(F.col("role")), "val"))
        roles = roles.union(also.select("synonym", F.lit("short"), F.lit(None).cast("string")))
    roles = scratch.write(roles)

    words = scratch.write(vw.select("word").distinct())
    refs = roles.where(F.length("ref") >= F.when(F.col("role") == "short", 5).otherwise(4)).select("ref").distinct()
    near = scratch.write(within_edits(words, "word", refs, "ref", EDITS))
    swapped = F.array_sort(F.split("word", "")) == F.array_sort(F.split("ref", ""))
    brief = roles.where("role = 'short'").select("ref", F.lit(True).alias("brief")).distinct()
    near = near.join(brief, "ref", "left").where((F.col("edits") <= F.when((F.length("ref") < 6) | F.col("brief"), 1).otherwise(EDITS)) | swapped).select("word", "ref", "edits")
    exact = words.join(roles.select("ref").distinct(), F.col("word") == F.col("ref")).select("word", "ref", F.lit(0))
    best = near.union(exact).groupBy("word").agg(F.min("edits").alias("least"), F.collect_set(F.struct("edits", "ref")).alias("all"))
    best = best.select("word", F.explode(F.transform(F.filter("all", lambda x: x["edits"] == F.col("least")), lambda x: x["ref"])).alias("ref"))
    meaning = scratch.write(best.join(roles, "ref").select("word", "ref", "role", "val"))

    only = lambda role, what: F.array_sort(F.collect_set(F.when(F.col("role").isin(*role), F.col(what))))
    read = vw.join(meaning, "word").groupBy("value").agg(only(["kind", "short"], "val").alias("kinds"), only(["suffix"], "val").alias("ends"), only(["core"], "val").alias("cores"), only(["other"], "val").alias("others"), only(["word"], "val").alias("has"))
    read = scratch.write(read)
    phrase = F.split("phrase", " ")
    agrees = (F.col("phrase") == "") | F.array_contains("kinds", F.col("phrase")) | ((F.size("kinds") == 0) & (F.size(F.array_except(phrase, "has")) == 0))
    hit = read.select("value", "kinds", "ends", "has", F.explode("cores").alias("core")).join(e, "core")
    # A name's stage may lie among the words of its kind's phrase; the same words on both sides agree.
    same = (F.size(F.array_except("suffix", "ends")) == 0) & (F.size(F.array_except(F.array_except("ends", "suffix"), F.array_union(phrase, F.array("core")))) == 0)
    hit = hit.where(agrees & same).select("value", "entry", F.size(F.array_intersect(F.array_union(phrase, F.array_union(F.array("core"), "suffix")), "has")).alias("n"))
    alias = read.select("value", F.explode("others").alias("core")).join(o, "core").select("value", "entry", F.lit(1000).alias("n"))
    by_words = scratch.write(hit.union(alias).groupBy("value", "entry").agg(F.max("n").alias("n")))

    # The rest as a whole, without blanks; digits must be the same.
    rest = v.join(by_words, "value", "left_anti").select("value", F.array_join("words", "").alias("glued"))
    glued = c.select("entry", F.explode(F.array(F.array_join(_words(F.col("name"), synonyms), ""), F.array_join(_words(F.col("other"), synonyms), ""))).alias("ref"))
    met = within_edits(rest, "glued", glued.where(F.length("ref") > 3 * EDITS), "ref", EDITS)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    met = met.where(digits(F.col("glued")) == digits(F.col("ref")))
    whole = rest.join(met, "glued").join(glued, "ref").groupBy("value").agg(F.min("edits").alias("e"), F.collect_set(F.struct("edits", "entry")).alias("all"))
    whole = whole.select("value", F.array_distinct(F.transform(F.filter("all", lambda x: x["edits"] == F.col("e")), lambda x: x["entry"])).alias("all"))
    by_whole = whole.where("size(all) = 1").select("value", F.col("all")[0].alias("entry"), F.lit(0).alias("n"))

    found = by_words.union(by_whole)
    if ambiguous:
        return found.groupBy("value").agg(F.array_sort(F.collect_set("entry")).alias("entries")).where("size(entries) > 1").select(F.col("value").alias(value), "entries")
    found = scratch.write(found.groupBy("value").agg(F.min(F.struct((-F.col("n")).alias("n"), "entry"))["entry"].alias("entry")))
    unmatched = v.join(found, "value", "left_anti").select("value", F.lit(UNLISTED).alias("entry"))
    return found.union(unmatched).select(F.col("value").alias(value), F.col("entry").alias(entry))
