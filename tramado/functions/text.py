"""Text normalisation as column expressions: one expression chain, no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and the plain letters they fold to.
ACCENTED = "áàâäãåāăąéèêëēėęěíìîïīįóòôöõøōőúùûüūůűųñńňçćčšśýÿžźżłđªº°"
PLAIN = "aaaaaaaaaeeeeeeeeiiiiiioooooooouuuuuuuunnncccssyyzzzldaoo"
# Letters as they look when UTF-8 was read as Latin-1 or Windows-1252, and what they stand for.
MISREAD = {
    "Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ", "Ã¼": "ü",
    "Ã\u0081": "Á", "Ã‰": "É", "Ã\u0089": "É", "Ã\u008d": "Í", "Ã“": "Ó", "Ã\u0093": "Ó", "Ãš": "Ú", "Ã\u009a": "Ú",
    "Ã‘": "Ñ", "Ã\u0091": "Ñ", "Â°": "°", "Âº": "º", "Âª": "ª",
}


def repair_misread(c: Column) -> Column:
    """Undo a wrong decoding of accented letters. Texts without its marks pass unchanged."""
    fixed = c
    for bad, good in MISREAD.items():
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    return F.when(c.contains("Ã") | c.contains("Â"), fixed).otherwise(c)


def fold(c: Column) -> Column:
    """Lower case without Latin accents, combining marks dropped; other scripts stay."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "\\p{Mn}+", "")


def squeeze(c: Column) -> Column:
    """Every run of characters that are neither letters nor digits becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", " "))


def plain_words(c: Column) -> Column:
    """Misreadings repaired, folded, only words with single blanks between. Null stays null."""
    return squeeze(fold(repair_misread(c)))


# What counts as no value, generic actors, words skipped in initials, and names too generic to merge.
NULL_TOKENS = ("", "null", "none", "n/a", "na", "no", "no aplica", "no especificado", "no especificada", "desconocido", "desconocida", "sin informacion", "sin información", "no identificado", "no identificada", "-", "unknown")
GENERIC_ACTORS = ("comunidades", "comunidad local", "vecinos", "habitantes", "pobladores", "ciudadanos", "organizaciones", "agrupaciones", "trabajadores", "pescadores", "autoridades", "gobierno local", "empresas", "la comunidad", "residentes")
INITIAL_STOPWORDS = ("de", "del", "la", "el", "los", "las", "y", "e", "en", "para", "por", "al", "a")
GENERIC_NAMES = ("persona", "personas", "empresa", "empresas", "proyecto", "proyectos", "diputado", "diputada", "senador", "senadora", "alcalde", "alcaldesa", "ministro", "ministra", "gobierno", "comunidad", "organizacion", "acuerdo")
FACILITIES = ("mine", "thermoelectric", "industrial_facility", "company_facility")
# Procedure families by keyword; the first family in this order wins.
FAMILIES = {
    "judicial": ("recurso judicial", "recurso de proteccion", "demanda", "reclamacion judicial", "apelacion", "casacion", "tribunal ambiental", "corte suprema", "corte de apelaciones"),
    "administrativo_autorizatorio": ("aprobacion ambiental", "permiso", "resolucion de calificacion", "calificacion ambiental", "autorizacion", "concesion"),
    "administrativo_sancionatorio": ("sancion", "multa", "procedimiento sancionatorio", "infraccion", "incumplimiento"),
    "participativo": ("consulta indigena", "consulta ciudadana", "participacion ciudadana", "consulta previa", "dialogo"),
    "manifestacion_publica": ("protesta", "declaracion publica", "rechazo formal", "denuncia publica", "manifestacion", "toma", "bloqueo", "paro"),
    "acuerdo_contractual": ("acuerdo", "contrato", "memorando", "convenio", "alianza", "asociacion"),
    "administrativo_general": ("denuncia", "reclamacion", "reclamacion formal", "fiscalizacion"),
}
_KEY_FROM = ACCENTED.replace("°", "").replace("ª", "").replace("º", "") + "ªº¹²³ "
_KEY_TO = PLAIN[: len(ACCENTED) - 3] + "ao123 "


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def norm(c: Column) -> Column:
    """The value without blanks around it; null for nothing and for tokens that say nothing."""
    v = strip(c)
    return F.when(~F.lower(v).isin(*NULL_TOKENS), v)


def accents_off(c: Column) -> Column:
    """Accents and compatibility forms of Latin letters off; case as it is for marks, lower for precomposed letters."""
    return F.regexp_replace(F.translate(c, _KEY_FROM, _KEY_TO), "\\p{Mn}+", "")


def norm_key(c: Column) -> Column:
    """Counting key: lower case, no accents, single blanks."""
    return F.trim(F.regexp_replace(accents_off(F.lower(norm(c))), "\\s+", " "))


def base_key(c: Column) -> Column:
    """Identity key of a referent: the counting key without quotes, separators, trailing marks, and without a leading
    article where at least three words are there. Null for nothing."""
    v = accents_off(F.lower(norm(c)))
    v = F.translate(v, "\"'“”;|", "      ")
    v = F.trim(F.regexp_replace(v, "\\s+", " "))
    v = F.regexp_replace(v, "[ .,]+$", "")
    v = F.when(F.size(F.split(v, " ")) >= 3, F.regexp_replace(v, "^(?:el|la|los|las) ", "")).otherwise(v)
    return F.nullif(v, F.lit(""))


def is_generic_actor(key: Column) -> Column:
    return key.rlike("^(?:" + "|".join(GENERIC_ACTORS) + ")")


def acronym_form(key: Column) -> tuple[Column, Column]:
    """Name and acronym of a key like ``name (acr)``; nulls otherwise."""
    pattern = "^(.+?)\\s*\\(([a-z0-9\\-. ]{2,15})\\)\\s*$"
    fits = key.rlike(pattern)
    return F.when(fits, F.regexp_extract(key, pattern, 1)), F.when(fits, F.replace(F.regexp_extract(key, pattern, 2), F.lit("."), F.lit("")))


def initials_match(name: Column, acronym: Column) -> Column:
    """Whether the acronym's letters are the initials of the name's words, with or without its function words."""
    letters = F.regexp_replace(acronym, "[^a-z0-9]", "")
    words = F.filter(F.split(name, " "), lambda w: w != "")
    first = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    content = F.filter(words, lambda w: ~w.isin(*INITIAL_STOPWORDS))
    return (F.length(letters) >= 2) & ((first(content) == letters) | (first(words) == letters))


def first_rule(key: Column, rules: list[tuple[str, str]], otherwise: str) -> tuple[Column, Column]:
    """Label and pattern of the first rule (pattern, label) that the key contains; ``otherwise`` and null if none."""
    label, pattern = F.lit(otherwise), F.lit(None).cast("string")
    for p, k in reversed(rules):
        label = F.when(key.rlike(p), F.lit(k)).otherwise(label)
        pattern = F.when(key.rlike(p), F.lit(p)).otherwise(pattern)
    return F.coalesce(label, F.lit(otherwise)), pattern


def family_of(key: Column) -> Column:
    """Procedure family of an action's key; ``otro`` if no keyword is in it."""
    out = F.lit("otro")
    for name, words in reversed(FAMILIES.items()):
        hit = key.contains(words[0])
        for w in words[1:]:
            hit = hit | key.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(key.isNull(), F.lit("otro")).otherwise(out)


def keywords(c: Column, least: int = 5, most: int = 6, stop: tuple[str, ...] = ()) -> Column:
    """The first different words of at least ``least`` plain letters, in order."""
    found = F.array_distinct(F.regexp_extract_all(accents_off(F.lower(c)), F.lit(f"([a-z]{{{least},}})"), 1))
    return F.slice(F.filter(found, lambda w: ~w.isin(*stop)) if stop else found, 1, most)


def token_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two texts; 0 where either has none."""
    x, y = (F.filter(F.array_distinct(F.split(F.lower(v), "\\s+")), lambda w: w != "") for v in (a, b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def labelled_field(text: Column, label: str, stops: tuple[str, ...] = (), most: int = 300) -> Column:
    """What follows a label, up to the first stop or ``most`` characters, squeezed; empty if the label isn't there."""
    part = F.regexp_extract(text, f"(?s)\\Q{label}\\E(.{{0,{most}}})", 1)
    for s in stops:
        part = F.split(part, f"\\Q{s}\\E", 2)[0]
    return F.regexp_replace(F.trim(F.regexp_replace(part, "\\s+", " ")), "^[ :]+|[ :]+$", "")


def packed_set(values: Column) -> Column:
    """A set as one string: different values, sorted, joined by semicolons."""
    return F.concat_ws(";", F.array_sort(F.array_distinct(values)))


def unpacked_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ";"), lambda v: v != ""))


def padded_id(prefix: str, digits: int, number: Column) -> Column:
    return F.format_string(f"{prefix}%0{digits}d", number.cast("long"))
