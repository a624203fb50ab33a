from __future__ import annotations

import pytest

from termloom.functions.languages import ENGLISH
from termloom.operators import packmerge
from termloom.operators.packmerge import LATER, MINE, THEIRS


def table(spark, *packs):
    """Rows of ``TERMS`` from ``(pack, [term as dict, ...])``."""
    keys = [c.split()[0] for c in packmerge.TERMS.split(", ")]
    rows = [tuple(({"pack": p, "pos": k} | t).get(c) for c in keys) for p, terms in packs for k, t in enumerate(terms)]
    return spark.createDataFrame(rows, packmerge.TERMS)


def layer(spark, *rows):
    return spark.createDataFrame(list(rows), "pack string, term string, text string")


def told(spark, *rows):
    return spark.createDataFrame(list(rows), "pack string, kind string, key string, other_key string, fold string, answer string")


def shown(terms):
    return {(r["pack"], r["term"]): {c: r[c] for c in ("class", "aliases", "variants", "collocations", "context", "match", "case_sensitive") if r[c]} for r in terms.collect()}


@pytest.fixture(scope="module")
def sides(spark):
    base = [
        {"term": "Alpha", "class": "a", "aliases": ["al", "Álef"], "variants": ["v1", "v2"], "context": {"v1": ["x"]}},
        {"term": "Beta", "class": "a", "match": "exact", "case_sensitive": ["Beta"], "aliases": ["BETA"]},
        {"term": "Gamma", "variants": ["gm"]}, {"term": "Delta", "variants": ["dl"]}, {"term": "Epsilon"},
    ]
    up = [
        {"term": "Alpha", "class": "b", "aliases": ["alef", "new"], "variants": ["v1", "v2", "up"], "context": {"v1": ["x", "y"]}},
        {"term": "Beta", "class": "a", "match": "exact", "case_sensitive": ["Beta", "BETA"], "aliases": ["BETA"]},
        {"term": "Gamma Prime", "aliases": ["Gamma"], "variants": ["gm"]}, {"term": "Delta", "aliases": ["back"]}, {"term": "Zetazetazeta"},
    ]
    mine = [
        {"term": "Alpha", "class": "c", "aliases": ["al", "ÁLEF"], "variants": ["v2", "my"], "context": {"v1": ["x"]}},
        {"term": "Beta", "class": "a", "match": "exact", "case_sensitive": ["Beta"]},
        {"term": "Gamma", "variants": ["gm", "more"]}, {"term": "Delta", "variants": ["dl"]}, {"term": "Zetazetazetb", "variants": ["new"]},
    ]
    other = [{"term": "Alpha", "class": "only here"}]
    return tuple(table(spark, ("p", s), ("q", other)) for s in (base, up, mine))


def test_three_sides_with_every_field(spark, sides):
    confirmed, rejected = layer(spark, ("p", "Delta", "DL"), ("p", "Nobody", "x")), layer(spark, ("p", "delta", "back"))
    terms, conflicts, plan = packmerge.merge(*sides, confirmed, rejected, ENGLISH)
    got = shown(terms)
    # al is gone upstream, v1 is gone here; both sides' new forms stay, in my spelling where I have one.
    assert got["p", "Alpha"] == {"class": "c", "aliases": ["ÁLEF", "new"], "variants": ["v2", "up", "my"], "context": {"v1": ["x", "y"]}}
    # A cased spelling whose form the merge took away goes with it.
    assert got["p", "Beta"] == {"class": "a", "match": "exact", "case_sensitive": ["Beta"]}
    assert got["p", "Gamma"]["variants"] == ["gm", "more"] and ("p", "Gamma Prime") not in got and ("p", "Epsilon") not in got
    assert got["p", "Delta"] == {"variants": ["DL"]} and got["q", "Alpha"] == {"class": "only here"}
    assert {(r["kind"], r["key"], r["answer"], r["can_mine"], r["can_both"]) for r in conflicts.collect()} == {
        ("class", "alpha", LATER, True, False), ("renamed", "gamma", LATER, True, False), ("duplicate", "zetazetazetb", LATER, True, True),
        ("form", "zetazetazetb", LATER, True, False), ("learned-removed", "delta", LATER, True, False), ("learned-rejected", "delta", LATER, True, False),
    }
    assert {(r["key"], r["outcome"]) for r in plan.where("pack = 'p'").collect()} == {("alpha", "combined"), ("beta", "combined"), ("gamma", "kept"), ("delta", "updated"), ("epsilon", "left out"), ("zetazetazeta", "added"), ("zetazetazetb", "kept")}


def test_answers_of_several_turns_equal_those_of_one(spark, sides):
    nothing = layer(spark)
    answers = [("p", "class", "alpha", None, None, THEIRS), ("p", "renamed", "gamma", "gamma prime", None, THEIRS), ("p", "duplicate", "zetazetazetb", "zetazetazeta", None, "both"), ("p", "form", "zetazetazetb", "alpha", "new", MINE)]
    terms, conflicts, _ = packmerge.merge(*sides, nothing, nothing, ENGLISH, told(spark, *answers))
    got = shown(terms)
    assert got["p", "Alpha"]["class"] == "b" and got["p", "Alpha"]["aliases"] == ["ÁLEF"]
    assert got["p", "Gamma Prime"] == {"aliases": ["Gamma"], "variants": ["gm", "more"]} and ("p", "Gamma") not in got
    assert ("p", "Zetazetazeta") in got and got["p", "Zetazetazetb"] == {"variants": ["new"]}
    assert packmerge.unsettled(conflicts).count() == 0
    first, open_, _ = packmerge.merge(*sides, nothing, nothing, ENGLISH, told(spark, *answers[:2]))
    assert {r["kind"] for r in packmerge.unsettled(open_).collect()} == {"duplicate", "form"}
    assert shown(first)["p", "Alpha"]["class"] == "b"
    again, _, _ = packmerge.merge(*sides, nothing, nothing, ENGLISH, told(spark, *answers))
    assert shown(again) == got


def test_presets_and_answers_that_a_conflict_does_not_take(spark):
    base, up = table(spark, ("p", [{"term": "One"}])), table(spark, ("p", [{"term": "One"}, {"term": "Two"}]))
    mine = table(spark, ("p", [{"term": "One", "variants": ["two"]}]))
    nothing = layer(spark)
    for preset, answer, variants in ((MINE, LATER, ["two"]), (THEIRS, THEIRS, None), (None, LATER, ["two"])):
        terms, conflicts, _ = packmerge.merge(base, up, mine, nothing, nothing, ENGLISH, preset=preset)
        # My variant is a name of theirs: keeping mine is not possible.
        assert [(r["kind"], r["can_mine"], r["answer"]) for r in conflicts.collect()] == [("form", False, answer)]
        assert shown(terms)["p", "One"].get("variants") == variants


def test_two_sides_are_united(spark):
    up = table(spark, ("p", [{"term": "One", "class": "a", "aliases": ["x", "f"], "match": "exact"}, {"term": "New"}]))
    mine = table(spark, ("p", [{"term": "one", "class": "b", "variants": ["F", "m"]}, {"term": "Mine"}]))
    nothing = layer(spark)
    terms, conflicts, plan = packmerge.merge(table(spark, ("p", [{"term": "gone"}])), up, mine, nothing, nothing, ENGLISH, three_way=False)
    assert {(r["kind"], r["form"], r["mine"], r["theirs"]) for r in conflicts.collect()} == {("class", None, "b", "a"), ("kind", "F", "variant", "alias")}
    assert shown(terms) == {("p", "one"): {"class": "b", "aliases": ["x"], "variants": ["m", "F"], "match": "exact"}, ("p", "New"): {}, ("p", "Mine"): {}}
    theirs, _, _ = packmerge.merge(table(spark, ("p", [])), up, mine, nothing, nothing, ENGLISH, preset=THEIRS, three_way=False)
    assert shown(theirs)["p", "one"] == {"class": "a", "aliases": ["x", "F"], "variants": ["m"], "match": "exact"}


def test_renames_take_turns(spark):
    """Two base terms share a form with one new term: the earlier one takes it, the later one the next best."""
    base = table(spark, ("p", [{"term": "first", "variants": ["a"]}, {"term": "second", "variants": ["a", "b"]}]))
    up = table(spark, ("p", [{"term": "new one", "variants": ["a", "b"]}, {"term": "new b", "variants": ["b"]}]))
    keyed = [packmerge.keyed(x, ENGLISH) for x in (base, up)]
    assert sorted(tuple(r) for r in packmerge.renames(*keyed).collect()) == [("p", "first", "new one"), ("p", "second", "new b")]


def test_merging_nothing(spark):
    nothing, empty = layer(spark), table(spark)
    terms, conflicts, plan = packmerge.merge(empty, empty, empty, nothing, nothing, ENGLISH)
    assert terms.count() == conflicts.count() == plan.count() == 0
