"""Indel similarity of short strings, native, with bounds that spare most pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the classic table at a time."""
    row = F.array_repeat(F.lit(0), F.length(b) + 1)
    letters = F.filter(F.split(b, ""), lambda c: c != "")

    def next_row(old: Column, letter: Column) -> Column:
        # A cell is the largest of its left, its upper and (on a match) its upper left neighbour plus one.
        start = F.struct(F.array(F.lit(0)).alias("row"), F.lit(0).alias("left"), F.lit(1).alias("j"))

        def cell(acc: Column, other: Column) -> Column:
            up, corner = F.element_at(old, acc["j"] + 1), F.element_at(old, acc["j"])
            value = F.greatest(acc["left"], up, F.when(other == letter, corner + 1).otherwise(0))
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), value.alias("left"), (acc["j"] + 1).alias("j"))

        return F.aggregate(letters, start, cell, lambda acc: acc["row"])

    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), row, next_row), -1)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * (1 - insertions and deletions / total length), as a double."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common_subsequence(a, b) / total)


def may_reach(a: Column, b: Column, percent: int) -> Column:
    """False only if the ratio can't reach ``percent``: letters of one that the other lacks never match."""
    bound = F.least(F.length(a) - F.length(F.call_function("translate", a, b, F.lit(""))), F.length(b) - F.length(F.call_function("translate", b, a, F.lit(""))))
    return F.lit(200) * bound >= F.lit(percent) * (F.length(a) + F.length(b))


#: Letters that get a bit of their own; all others are left out of the bound.
SIGNS = " $0123456789abcdefghijklmnopqrstuvwxyz"
#: Longest text whose places fit a mask without reaching the sign of a 64-bit number.
MASK_LETTERS = 62


def sign_bits(text: Column) -> Column:
    """A bit for each of ``SIGNS`` that the text holds."""
    bits = F.lit(0).cast("long")
    for k, sign in enumerate(SIGNS):
        bits = bits.bitwiseOR(F.when(text.contains(sign), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return bits


def sign_bits_of(text: str) -> int:
    return sum(1 << k for k, sign in enumerate(SIGNS) if sign in text)


def bits_reach(a: Column, a_bits: Column, b: Column, b_bits: Column, percent: int) -> Column:
    """Weaker than :func:`may_reach`, but a few integer operations: each letter that only one side has costs one match."""
    lacking = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    bound = F.least(F.length(a) - lacking(a_bits, b_bits), F.length(b) - lacking(b_bits, a_bits))
    return F.lit(200) * bound >= F.lit(percent) * (F.length(a) + F.length(b))


def places_of(text: str) -> dict[str, int] | None:
    """Each letter of a known text with the bits of its places; None for a text too long for a mask."""
    if len(text) > MASK_LETTERS:
        return None
    out: dict[str, int] = {}
    for k, letter in enumerate(text):
        out[letter] = out.get(letter, 0) | 1 << k
    return out


def ratio_by_places(a: Column, b: Column, places: Column) -> Column:
    """:func:`indel_ratio` of ``a`` and a text ``b`` whose ``places_of`` are at hand: one step a letter of ``a``.

    Bit-parallel longest common subsequence: zeros of the state are the places of ``b`` where a row of the
    classic table rises.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(b)) - F.lit(1).cast("long")

    def step(state: Column, letter: Column) -> Column:
        here = state.bitwiseAND(F.coalesce(F.try_element_at(places, letter), F.lit(0).cast("long")))
        return (state + here).bitwiseOR(state - here).bitwiseAND(full)

    state = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), full, step)
    total = F.length(a) + F.length(b)
    return F.when(places.isNull(), indel_ratio(a, b)).otherwise(F.lit(200.0) * (F.length(b) - F.bit_count(state)) / total)


def ratio_of(a: str, b: str) -> float:
    """The same on the driver, for pairs of pack names."""
    row = [0] * (len(b) + 1)
    for x in a:
        out = [0]
        for j, y in enumerate(b, 1):
            out.append(max(out[-1], row[j], row[j - 1] + (x == y)))
        row = out
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0
