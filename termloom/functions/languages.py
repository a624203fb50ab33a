"""Language data behind folding, plurals, units, sentence ends, skeletons and common words."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class UnitRule:
    """``pattern`` rewritten by ``replacement`` (``\\1`` names a group); ``owns`` are words left to the rule."""

    pattern: str
    replacement: str
    term: str
    owns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    """What the engine needs to know about a language; ``letters`` is the class of characters that folding keeps."""

    code: str
    letters: str = "a-z0-9$ "
    numbers: dict[str, str] = field(default_factory=dict)
    plurals: tuple[tuple[str, str], ...] = ()
    shortest_base: int = 1
    not_plural: str = ""
    units: tuple[UnitRule, ...] = ()
    boundaries: str = ".?!;,"
    has_skeleton: bool = False
    common: frozenset[str] = frozenset()


# Number words and ordinary words; below, the plurals and units of each language.
_PT_NUMBERS = {
    "dois": "2", "duas": "2", "tres": "3", "quatro": "4", "cinco": "5", "seis": "6",
    "sete": "7", "oito": "8", "nove": "9", "dez": "10", "onze": "11", "doze": "12",
    "treze": "13", "catorze": "14", "quatorze": "14", "quinze": "15", "dezesseis": "16",
    "dezasseis": "16", "dezessete": "17", "dezassete": "17", "dezoito": "18",
    "dezenove": "19", "dezanove": "19", "vinte": "20",
}
_PT_COMMON = """
a ao aos aquela aquele aquilo as ate bem cada como com da das de dela dele depois
do dos e ela ele eles em entao entre era essa esse esta estava este eu foi for ha
isso isto ja la lhe mais mas me mesmo meu minha muito na nao nas nem no nos nossa
nosso num numa o os ou para pela pelo pode por porque pra quando que quem se sem
ser seu sua so sobre tambem tem ter tipo tudo um uma umas uns vai voce
amigo caiu cair coisa dia diz faz fazer gente hoje tira rapido divide trio oxe
"""
_EN_NUMBERS = {
    "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16",
    "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
}
_EN_COMMON = """
a about after again all also an and any are as at be because been before but by can
could did do does down each even for from get go going good got had has have he her
here him his how i if in into is it its just know like look make me more most my no
not now of off on one only or other our out over people right said say see she so some
take than that the their them then there these they thing think this those time to
two up us very was way we well were what when where which who why will with would yeah
year you your
"""

PORTUGUESE = Language(
    "pt-BR",
    numbers=_PT_NUMBERS,
    plurals=(("oes", "ao"), ("ais", "al"), ("eis", "el"), ("es", ""), ("s", "")),
    units=(
        UnitRule(r"(\d[\d.,]*)\s+(\d)\s+(B|bit|be)\b", r"\1 bi", "bi", ("B", "bit", "be")),
        UnitRule(r"(\d[\d.,]*)\s+(B|bit|be)\b(?![\w])", r"\1 bi", "bi", ("B", "bit", "be")),
        UnitRule(r"(bilh[oõ]es|milh[oõ]es)\s+deais\b", r"\1 de reais", "reais"),
    ),
    has_skeleton=True,
    common=frozenset(_PT_COMMON.split()),
)
ENGLISH = Language(
    "en",
    numbers=_EN_NUMBERS,
    plurals=(("ies", "y"), ("es", ""), ("s", "")),
    shortest_base=2,
    not_plural="ss",
    units=(
        UnitRule(r"(\d[\d.,]*)\s?(bn|B)\b(?![\w])", r"\1 billion", "billion", ("bn", "B")),
        UnitRule(r"(\d[\d.,]*)\s?(mn|M)\b(?![\w])", r"\1 million", "million", ("mn", "M")),
    ),
    common=frozenset(_EN_COMMON.split()),
)
GENERIC = Language("generic", letters=r"\p{L}\p{N}_$", boundaries=".?!;")

_REGISTRY: dict[str, Language] = {}


def register(language: Language) -> None:
    """Adds a language (or replaces one of the same code) for :func:`for_code`."""
    if not language.code or not language.boundaries:
        raise ValueError("a language needs a code and sentence boundaries")
    _REGISTRY[module_name(language.code)] = language


def module_name(code: str) -> str:
    return code.strip().lower().replace("-", "_")


def for_code(code: str | None, allow_generic: bool = False) -> Language:
    """The language of a code; an unknown one is an error unless the generic language is allowed."""
    found = _REGISTRY.get(module_name(code or ""))
    if found is not None:
        return found
    if allow_generic:
        return GENERIC
    raise LookupError(f"no language {code!r}; known: {', '.join(sorted(_REGISTRY))}")


for _language in (PORTUGUESE, ENGLISH, GENERIC):
    register(_language)
