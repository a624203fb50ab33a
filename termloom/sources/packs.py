"""Domain packs and learned layers: small YAML files, read on the driver, used as broadcast tables."""

from __future__ import annotations

import hashlib
import unicodedata
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from termloom.functions.languages import Language, for_code
from termloom.functions.text import fold_text, normalize_text
from termloom.schemas import FORMS, UNIT_CLASS

# Classes of packs that declare none, classes that every pack has, and the defaults for
# which of them are names to the phonetic source.
LEGACY_CLASSES = ("companhia", "indicador", "conceito", "unidade", "pessoa", "organizacao", "ferramenta", "sigla")
COMMON_CLASSES = ("pessoa", "organizacao", "sigla", "unidade")
LEGACY_PHONETIC = ("companhia", "pessoa")
DEFAULT_PHONETIC = ("pessoa", "organizacao")


def _yaml():
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading packs needs a YAML library; pass their content as dictionaries instead") from missing
    return yaml


def composed(text: str) -> str:
    return unicodedata.normalize("NFC", str(text))


def spaced(text: str) -> str:
    return " ".join(str(text).split())


@dataclass(frozen=True)
class Learned:
    """Human decisions: confirmed variants ``(term, variant, date, context)``, aliases ``(term, alias, date)``, rejections ``(text, term, date)``."""

    confirmed: tuple[tuple[str, str, str, tuple[str, ...]], ...] = ()
    aliases: tuple[tuple[str, str, str], ...] = ()
    rejected: tuple[tuple[str, str, str], ...] = ()


@dataclass(frozen=True)
class Form:
    """One spelling of a term, in the order in which a pack is scanned."""

    display: str
    folded: str
    term: str
    origin: str
    source: str
    exact: bool = False
    cased: bool = False
    context: tuple[str, ...] = ()
    unless_near: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    """A pack with its learned layer applied."""

    language: Language
    version: str
    terms: tuple[dict, ...]
    forms: tuple[Form, ...]
    rejected: frozenset[tuple[str, str]] = frozenset()
    classes: tuple[str, ...] = COMMON_CLASSES
    phonetic_classes: tuple[str, ...] = ()
    data: dict = field(default_factory=dict, compare=False, hash=False)

    def class_of(self) -> dict[str, str | None]:
        return {t["term"]: t["class"] for t in self.terms}

    def term_named(self, name: str) -> str | None:
        """The first term with that name or alias, compared in the pack's language."""
        wanted = normalize_text(name, self.language)
        for t in self.terms:
            if any(normalize_text(n, self.language) == wanted for n in (t["term"], *t["aliases"])):
                return t["term"]
        return None

    def owned(self) -> set[tuple[str, str]]:
        """``(term, folded word)`` pairs that only a unit rule may match."""
        found = {(self.term_named(r.term), normalize_text(w, self.language)) for r in self.language.units for w in r.owns}
        return {x for x in found if x[0] is not None}

    def fuzzy(self, f: Form) -> bool:
        """Names and curated variants may be guessed at; aliases, learned forms, units and exact terms may not."""
        return f.origin != "alias" and f.source == "pack" and not f.exact and self.class_of().get(f.term) != UNIT_CLASS

    def forms_table(self, spark: SparkSession) -> DataFrame:
        """The forms as a table (see ``schemas.FORMS``)."""
        owned, rows = self.owned(), []
        for k, f in enumerate(self.forms):
            rows.append((k, f.display, f.folded, spaced(f.folded), f.term, f.origin, f.source, f.exact, composed(spaced(f.display)) if f.cased else None, self.fuzzy(f), f.origin == "variant" and (f.term, f.folded) in owned))
        return spark.createDataFrame(rows, FORMS)


def _strings(raw: dict, key: str) -> tuple[str, ...]:
    return tuple(composed(x) for x in raw.get(key) or ())


def learned_from(data: dict | None) -> Learned:
    """A learned layer from its YAML content; plain strings stand for entries without a date."""
    data = data or {}

    def entry(x, key: str) -> tuple[str, str, tuple[str, ...]]:
        if isinstance(x, str):
            return composed(x), "", ()
        return composed(x[key]), str(x.get("date", "")), tuple(map(composed, x.get("context") or ()))

    confirmed = tuple((composed(t), *entry(x, "variant")) for t, xs in (data.get("confirmed") or {}).items() for x in xs or ())
    aliases = tuple((composed(t), *entry(x, "alias")[:2]) for t, xs in (data.get("aliases") or {}).items() for x in xs or ())
    rejected = tuple((composed(x["text"]), composed(x["term"]), str(x.get("date", ""))) for x in data.get("rejected") or ())
    return Learned(confirmed, aliases, rejected)


def read_learned(path: str | Path) -> Learned:
    """A learned layer from a file; a missing file is an empty layer."""
    path = Path(path)
    return learned_from(_yaml().safe_load(path.read_text("utf-8"))) if path.exists() else Learned()


def pack_from(data: dict, learned: Learned | None = None, allow_generic: bool = False, version: str | None = None) -> Pack:
    """A pack from its YAML content, checked, with the learned forms that it does not know already."""
    learned = learned or Learned()
    language = for_code(str(data["language"]) if data.get("language") else None, allow_generic)
    own = data.get("classes")
    classes = tuple(dict.fromkeys((*COMMON_CLASSES, *map(composed, own)))) if own is not None else LEGACY_CLASSES
    phonetic = data.get("phonetic_classes")
    default = LEGACY_PHONETIC if own is None else (*DEFAULT_PHONETIC, *(c for c in ("companhia",) if c in classes))
    phonetic = tuple(map(composed, phonetic)) if phonetic is not None else default
    if strange := [c for c in phonetic if c not in classes]:
        raise ValueError(f"phonetic classes that the pack lacks: {', '.join(strange)}")
    terms, forms = [], []
    for raw in data.get("terms") or ():
        name, exact = composed(raw["term"]), raw.get("match") == "exact"
        fold = (lambda s: fold_text(s, language)) if exact else (lambda s: normalize_text(s, language))
        aliases, variants = _strings(raw, "aliases"), _strings(raw, "variants")
        known = {fold(x) for x in (*aliases, *variants)}
        klass = composed(raw["class"]) if raw.get("class") else None
        if klass is not None and klass not in classes:
            raise ValueError(f"term {name!r} has the class {klass!r}, which is not one of {', '.join(classes)}")
        cased = {spaced(composed(x)) for x in raw.get("case_sensitive") or ()}
        if cased and not exact:
            raise ValueError(f"term {name!r} has case-sensitive forms but does not match exactly")
        new_variants = [(v, c) for t, v, _, c in learned.confirmed if t == name and fold(v) not in known]
        new_aliases = [a for t, a, _ in learned.aliases if t == name and fold(a) not in known]
        context = {fold(k): tuple(map(composed, v or ())) for k, v in (raw.get("context") or {}).items()}
        near = {fold(k): tuple(map(composed, v or ())) for k, v in (raw.get("unless_near") or {}).items()}
        for v, c in new_variants:
            if c:
                context.setdefault(fold(v), c)
        terms.append({"term": name, "class": klass, "aliases": (*aliases, *new_aliases), "variants": (*variants, *(v for v, _ in new_variants)), "exact": exact})
        spellings = [(name, "term", "pack"), *((a, "alias", "pack") for a in aliases), *((v, "variant", "pack") for v in variants)]
        spellings += [*((v, "variant", "learned") for v, _ in new_variants), *((a, "alias", "learned") for a in new_aliases)]
        for display, origin, source in spellings:
            folded = fold(display)
            conditioned = origin != "alias" and folded in context
            forms.append(Form(display, folded, name, origin, source, exact, source == "pack" and spaced(display) in cased, context[folded] if conditioned else (), near.get(folded, ()) if conditioned else ()))
    rejected = frozenset((spaced(normalize_text(x, language)), t) for x, t, _ in learned.rejected)
    shown = data.get("version")
    return Pack(language, str(shown) if shown is not None else version or "", tuple(terms), tuple(forms), rejected, classes, phonetic, data)


def read_pack(path: str | Path, learned: Learned | None = None, allow_generic: bool = False) -> Pack:
    """A pack file with the learned layer beside it (``<name>.learned.yaml``) unless one is given."""
    path = Path(path)
    content = path.read_bytes()
    if learned is None:
        learned = read_learned(path.with_suffix(".learned.yaml"))
    return pack_from(_yaml().safe_load(content) or {}, learned, allow_generic, f"sha256:{hashlib.sha256(content).hexdigest()[:12]}")
