"""Signs of text as Columns: character references of markup, and canonical composition. The tables follow from rules of
Python's own Unicode and HTML data; each is one literal that is parsed once."""

from __future__ import annotations

import functools
import html.entities
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conjoining Hangul: first and last of leading, middle and trailing letters, and the first syllable.
LEAD, VOWEL, TRAIL, SYLLABLE = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), 0xAC00


def _table(entries: dict) -> Column:
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def character(point: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")


def _numbered(point: Column) -> Column:
    """What a numeric reference stands for: bytes of Windows-1252 where markup means them, the replacement sign for what
    is no character, nothing for controls and non-characters."""
    west = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    gone = point.between(0x1, 0x8) | point.between(0xE, 0x1F) | (point == 0x7F) | (point == 0xB) | point.between(0xFDD0, 0xFDEF) | ((point % 0x10000) >= 0xFFFE)
    return (
        F.when(point.between(0x80, 0x9F), F.try_element_at(_table(west), point.cast("string")))
        .when(point.isNull() | (point == 0) | point.between(0xD800, 0xDFFF) | (point > 0x10FFFF), "�")
        .when(gone, "")
        .otherwise(character(point))
    )


def unescaped(text: Column, closed_only: bool = False) -> Column:
    """Character references decoded in one pass: named ones (the old ones also without their semicolon, as long as they
    reach), decimal and hexadecimal ones; anything else stays as it is. With ``closed_only`` so does what ends without a
    semicolon."""
    named = {k: v for k, v in html.entities.html5.items()}
    old = {k: v for k, v in named.items() if not k.endswith(";")}
    pieces = F.regexp_extract_all(text, F.lit(r"(&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&)"), 1)

    def decoded(piece: Column) -> Column:
        name = F.substring(piece, 2, 64)
        digits = F.regexp_extract(piece, "^&#0*([0-9]*)", 1)
        hexes = F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*)", 1)
        # More digits than any code point has are no character.
        plain = F.when(F.length(digits) <= 8, F.concat(F.lit("0"), digits).cast("long")).otherwise(0x110000)
        based = F.when(F.length(hexes) <= 8, F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("long")).otherwise(0x110000)
        begun = F.coalesce(*[F.when(F.length(name) > k, F.concat(F.try_element_at(_table(old), F.substring(name, 1, k)), F.substring(name, k + 1, 64))) for k in range(max(map(len, old)), 1, -1)])
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece == "&amp;", "&")
            .when(F.lit(closed_only) & ~piece.endswith(";"), piece)
            .when(piece.rlike("^&#[xX]"), _numbered(based))
            .when(piece.startswith("&#"), _numbered(plain))
            .otherwise(F.coalesce(F.try_element_at(_table(named), name), *([] if closed_only else [begun]), piece))
        )

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


@functools.cache
def _canonical() -> tuple[dict[str, str], dict[str, str], dict[str, str], str, str, str]:
    """Full decompositions of what takes part, classes of marks, composed pairs; signs that are one other sign (and
    which), and signs that composed text never holds."""
    apart, ranks, pairs, single, other, never = {}, {}, {}, [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        sign = chr(point)
        kind = unicodedata.category(sign)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if unicodedata.combining(sign):
            ranks[sign] = str(unicodedata.combining(sign))
        if SYLLABLE <= point <= 0xD7A3:
            continue
        whole = unicodedata.normalize("NFD", sign)
        if whole == sign:
            continue
        composed = unicodedata.normalize("NFC", sign)
        if composed == sign:
            apart[sign] = whole
            pair = unicodedata.decomposition(sign).split()
            pairs["".join(chr(int(p, 16)) for p in pair)] = sign
        elif len(composed) == 1:
            single.append(sign)
            other.append(composed)
        else:
            never.append(sign)
            apart[sign] = whole
    return apart, ranks, pairs, "".join(single), "".join(other), "".join(never)


def composed(text: Column) -> Column:
    """The canonical composition (NFC) of a text.

    Signs that stand for one other sign are translated; only what has marks, and the few signs that composition takes
    apart, goes through decomposition, ordering by class and pairing, a few signs at a time; conjoining Hangul letters
    are counted together.
    """
    apart, ranks, pairs, single, other, never = _canonical()
    hangul = f"[{chr(LEAD[0])}-{chr(LEAD[1])}][{chr(VOWEL[0])}-{chr(VOWEL[1])}][{chr(TRAIL[0])}-{chr(TRAIL[1])}]?|[{chr(SYLLABLE)}-힣][{chr(TRAIL[0])}-{chr(TRAIL[1])}]"
    # Some vowel signs that pairs end in are no marks.
    ends = "".join(sorted({p[1] for p in pairs if not unicodedata.category(p[1]).startswith("M")}))
    tail = rf"[\p{{M}}{ends}]"
    special = rf"(?:[^\p{{M}}{ends}]?{tail}+|[{never}]{tail}*)"

    def joined(piece: Column) -> Column:
        lead, vowel, last = (F.ascii(F.substring(piece, k, 1)) for k in (1, 2, 3))
        trail = F.when(F.length(piece) == 3, last - (TRAIL[0] - 1)).otherwise(0)
        letters = (lead - LEAD[0]) * 588 + (vowel - VOWEL[0]) * 28 + trail + SYLLABLE
        open_ = (lead - SYLLABLE) % 28 == 0
        return F.when(lead < SYLLABLE, character(letters)).when(open_, character(lead + vowel - (TRAIL[0] - 1))).otherwise(piece)

    def paired(piece: Column) -> Column:
        signs = F.filter(F.split(F.array_join(F.transform(F.split(piece, ""), lambda c: F.coalesce(F.try_element_at(_table(apart), c), c)), ""), ""), lambda c: c != "")
        start = F.array().cast("array<struct<run:int,rank:int,at:int,sign:string>>")

        def place(acc: Column, c: Column) -> Column:
            rank = F.coalesce(F.try_element_at(_table(ranks), c).cast("int"), F.lit(0))
            run = F.when(F.size(acc) == 0, 0).otherwise(F.try_element_at(acc, F.lit(-1))["run"]) + F.when(rank == 0, 1).otherwise(0)
            return F.concat(acc, F.array(F.struct(run.alias("run"), rank.alias("rank"), F.size(acc).alias("at"), c.alias("sign"))))

        order = F.array_sort(F.aggregate(signs, start, place))
        state = F.struct(F.lit("").alias("done"), F.lit("").alias("first"), F.lit("").alias("marks"), F.lit(-1).alias("last"))
        new = lambda d, f, m, k: F.struct(d.alias("done"), f.alias("first"), m.alias("marks"), k.cast("int").alias("last"))

        def step(acc: Column, x: Column) -> Column:
            pair = F.when((acc["first"] != "") & (acc["last"] < x["rank"]), F.try_element_at(_table(pairs), F.concat(acc["first"], x["sign"])))
            moved = F.concat(acc["done"], acc["first"], acc["marks"])
            return (
                F.when(pair.isNotNull(), new(acc["done"], pair, acc["marks"], acc["last"]))
                .when(x["rank"] == 0, new(moved, x["sign"], F.lit(""), F.lit(-1)))
                .otherwise(new(acc["done"], acc["first"], F.concat(acc["marks"], x["sign"]), x["rank"]))
            )

        return F.aggregate(order, state, step, lambda acc: F.concat(acc["done"], acc["first"], acc["marks"]))

    plain = F.translate(text, single, other)
    touched = text.rlike(rf"{tail}|[{never}{chr(LEAD[0])}-{chr(TRAIL[1])}]")
    pieces = F.regexp_extract_all(plain, F.lit(rf"({hangul}|{special}|(?:(?!{hangul}|{special})[\s\S])+)"), 1)
    whole = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^(?:{hangul})$"), joined(p)).when(p.rlike(rf"^{special}$"), paired(p)).otherwise(p)), "")
    return F.when(touched, whole).otherwise(plain)
