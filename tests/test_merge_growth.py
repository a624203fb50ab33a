"""Names and renames of large packs: the same pairs as comparing all of them, without doing so."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from termloom.functions.similarity import ratio_of
from termloom.operators import packmerge
from termloom.schemas import DUPLICATE_AT


def test_near_names_are_those_that_all_pairs_have(spark):
    dice, names = random.Random(3), set()
    for _ in range(25):
        word = "".join(dice.choice("abc 1é") for _ in range(dice.choice([1, 2, 4, 5, 9, 10, 11, 12, 19, 20, 21, 33]))).strip() or "a"
        names.add(word)
        for _ in range(12):
            new = list(word)
            for _ in range(dice.choice([0, 1, 1, 2, 3, 5])):
                at = dice.randrange(len(new) + 1)
                new[at : at + dice.choice([0, 1])] = dice.choice(["", "a", "x"])
            names.add("".join(new).strip() or "b")
    sides = {p: ([n for n in sorted(names) if dice.random() < 0.6], [n for n in sorted(names) if dice.random() < 0.6]) for p in "pq"}
    side = lambda k, c: spark.createDataFrame([(p, n) for p, both in sides.items() for n in both[k]], f"pack string, {c} string")
    want = {(p, a, z) for p, (ours, theirs) in sides.items() for a in ours for z in theirs if ratio_of(a, z) >= DUPLICATE_AT}
    rows = packmerge._near_names(side(0, "a"), side(1, "z")).select("pack", "a", "z").collect()
    assert len(rows) == len(want) > 300 and {tuple(r) for r in rows} == want


def test_renames_are_chosen_as_one_after_the_other(spark):
    dice = random.Random(4)
    pairs = sorted({(p, dice.randrange(12), dice.randrange(12)) for p in "pq" for _ in range(45)})
    rows = [(p, f"k{a}", f"n{z}", (a, dice.randrange(-4, 0), z, f"k{a}", f"n{z}")) for p, a, z in pairs]
    df = spark.createDataFrame(rows, "pack string, key string, new_key string, place struct<key_pos:int,less:int,new_key_pos:int,key:string,new_key:string>")
    want, taken = set(), set()
    for p, k, n, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        if (p, k) not in taken and (p, n) not in taken:
            want.add((p, k, n))
            taken |= {(p, k), (p, n)}
    got = packmerge._first_pairs(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert packmerge._first_pairs(df.where(F.lit(False))).count() == 0
