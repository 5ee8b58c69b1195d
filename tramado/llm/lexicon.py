"""What a language's names are made of, as data: the name operators take it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property


@dataclass(frozen=True, eq=False)
class Lexicon:
    """``kinds``: words and abbreviations by the kind of organisation they tell (``kinds_over`` names, for a kind, those it
    gives way to); ``heads``: words that belong to kinds without telling them apart; ``weak``: the same, only beside a
    word that does (``weak_kinds``: which kind they tell alone); ``stop``: function words; ``titles``: before people's names;
    ``given`` and ``short``: given names and their short forms; ``nobody``: what stands for nobody; ``legal``: forms of
    companies, as patterns. Empty ones are allowed: names are then told apart by their words alone."""

    kinds: dict[str, str] = field(default_factory=dict)
    kinds_over: dict[str, tuple[str, ...]] = field(default_factory=dict)
    heads: tuple[str, ...] = ()
    weak: tuple[str, ...] = ()
    weak_kinds: dict[str, str] = field(default_factory=dict)
    stop: tuple[str, ...] = ()
    titles: tuple[str, ...] = ()
    given: tuple[str, ...] = ()
    short: dict[str, str] = field(default_factory=dict)
    nobody: frozenset[str] = frozenset({""})
    legal: tuple[str, ...] = (r"inc\.?", r"corp\.?", r"llc", r"ltd\.?", r"plc", r"gmbh", r"ag", r"sarl", r"b\.?v\.?")

    @cached_property
    def kind_index(self) -> dict[str, str]:
        return mistyped(self.kinds | dict.fromkeys(self.heads, "-"), 5)

    @cached_property
    def name_index(self) -> dict[str, str]:
        return mistyped({n: n for n in self.given} | self.short, 5)

    @cached_property
    def people(self) -> frozenset[str]:
        return frozenset(self.given)


def mistyped(words: dict[str, str], least: int) -> dict[str, str]:
    """Words of ``least`` letters or more under their forms with one letter replaced or left out; all under themselves."""
    out: dict[str, str] = {}
    for w, v in words.items():
        if len(w) >= least:
            for i in range(len(w)):
                out.setdefault(w[:i] + "*" + w[i + 1 :], v)
            for i in range(len(w)):
                out.setdefault(w[:i] + w[i + 1 :], v) if len(w) > least else None
            out.setdefault("~" + w, v)
    for w, v in words.items():
        out[w] = v
    return out


def nearest(word: str, known: dict[str, str]) -> str | None:
    """What a word within one edit or one swap of neighbours stands for in ``known`` (of :func:`mistyped`)."""
    if word in known:
        return known[word]
    for i in range(len(word)):
        got = known.get(word[:i] + "*" + word[i + 1 :]) or known.get(word[:i] + word[i + 1 :]) or known.get(word[:i] + "*" + word[i:])
        if got is None and i + 1 < len(word):
            got = known.get("~" + word[:i] + word[i + 1] + word[i] + word[i + 2 :])
        if got:
            return got
    return known.get(word + "*")


# What tells the kind of an organisation, by word and by abbreviation.
_KINDS = {
    "vecinos": "jv", "vecinal": "jv", "jv": "jv", "jjvv": "jv",
    "defensa": "cda", "def": "cda", "cda": "cda",
    "pescadores": "spa", "pesc": "spa", "spa": "spa",
    "regantes": "ar", "ar": "ar",
    "indigena": "ci", "ind": "ci", "ci": "ci",
    "campesina": "cc", "camp": "cc", "cc": "cc",
    "ambiental": "aa", "amb": "aa", "aa": "aa",
    "fundacion": "f", "fund": "f",
    "frente": "fpa", "fte": "fpa", "fpa": "fpa",
    "minera": "minera", "min": "minera", "forestal": "forestal", "for": "forestal",
    "constructora": "constructora", "constr": "constructora", "const": "constructora",
    "agricola": "agricola", "agric": "agricola",
}
# Words that belong to kinds without telling them apart; the weak ones only beside a word that does.
_HEADS = ("junta", "jta", "comite", "sindicato", "sind", "asociacion", "asoc", "comunidad", "cooperativa", "coop", "agrupacion", "agrup", "artesanales", "agua", "aguas", "empresa", "compania", "sociedad", "cia", "soc", "reg", "vec")
_WEAK = ("com", "agr", "art", "a", "c", "j", "f", "s", "cte")
_STOP = ("de", "del", "dde", "dee", "ed", "deel", "dell", "la", "el", "los", "las", "por", "para", "y", "numero", "nro", "num", "n", "no")
_TITLES = ("ing", "lic", "prof", "profa", "dr", "dra", "sr", "sra", "srta", "don", "dona", "abg", "arq")
# Given names and their short forms.
_GIVEN = (
    "agueda alberto alejandra alejandro alfredo alicia alonso amalia amanda ana andrea andres angel angela antonia antonio "
    "arturo beatriz benjamin bernarda bernardo camila carla carlos carmen carolina catalina cecilia cesar clara claudia "
    "claudio cristian cristina cristobal daniel daniela david diego dolores eduardo elena elisa emilia emilio enrique "
    "ernesto esteban eugenia eva fabian felipe fernanda fernando francisca francisco gabriel gabriela gerardo gloria "
    "gonzalo graciela gregorio guillermo gustavo hector hernan hortensia hugo humberto ignacia ignacio ines irene isabel "
    "ivan jaime javier jorge jose josefa joaquin juan juana julia julio karina laura leonardo leonor lidia lorena lorenzo "
    "lucia luis luisa magdalena manuel manuela marcela marcelo marco margarita maria mario marta martin mateo matias "
    "mauricio mercedes miguel monica nicolas octavio olga oscar pablo paola patricia patricio paula pedro pilar rafael "
    "ramon raul rebeca ricardo roberto rodrigo rosa ruben samuel sandra sebastian sergio silvia sofia susana tomas teresa "
    "ursula valentina veronica vicente victor victoria violeta wenceslao yolanda zoila"
).split()
_SHORT = {
    "goyo": "gregorio", "jano": "alejandro", "ale": "alejandro", "nacho": "ignacio", "nando": "fernando", "tencha": "hortensia",
    "tina": "cristina", "tavo": "octavio", "bea": "beatriz", "manolo": "manuel", "toña": "antonia", "tona": "antonia",
    "yoli": "yolanda", "pancho": "francisco", "paco": "francisco", "rafa": "rafael", "seba": "sebastian", "lola": "dolores",
    "chabela": "isabel", "beto": "roberto", "quique": "enrique", "kike": "enrique", "pati": "patricia", "paty": "patricia",
    "meche": "mercedes", "lalo": "eduardo", "tomi": "tomas", "wences": "wenceslao", "lucho": "luis", "nico": "nicolas",
    "chela": "graciela", "pepe": "jose", "memo": "guillermo", "concha": "concepcion", "charo": "rosario", "coni": "constanza",
    "maca": "macarena", "cata": "catalina", "caro": "carolina", "pedrito": "pedro", "panchita": "francisca", "vale": "valentina",
}
# What stands for nobody.
_NOBODY = {
    "", "s i", "si", "n a", "na", "no aplica", "desconocido", "desconocida", "no especificado", "sin informacion", "sin datos",
    "ninguno", "null", "none", "vecinos", "vecinas", "vecinos del sector", "comunidad", "comunidades", "pobladores", "habitantes",
    "organizaciones", "trabajadores", "autoridades", "empresa", "municipalidad", "varios", "otros", "anonimo",
}

SPANISH = Lexicon(
    kinds=_KINDS, kinds_over={"fpa": ("cda", "jv")}, heads=_HEADS, weak=_WEAK, weak_kinds={"agr": "agricola", "f": "f"}, stop=_STOP, titles=_TITLES,
    given=tuple(_GIVEN), short=_SHORT, nobody=frozenset(_NOBODY), legal=(r"s\.?\s?a\.?", r"ltda\.?", r"s\.?p\.?a\.", *Lexicon.legal),
)
