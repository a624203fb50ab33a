from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termloom.operators import merge, packedit, registry, selection
from termloom.sources.packs import Learned, learned_from, pack_from, read_learned, read_pack
from termloom.sources.sinks import issue_link, learned_content, write_learned, write_pack

DATA = {"language": "en", "version": "1.2.3", "classes": ["word"], "terms": [{"term": "market share", "class": "word", "aliases": ["share"], "variants": ["marked chair"]}, {"term": "deck"}]}


def test_forms_keep_their_order_and_learned_forms_follow():
    layer = learned_from({"confirmed": {"deck": ["dec", {"variant": "dek", "date": "1", "context": ["share"]}]}, "aliases": {"market share": ["SHARE", "part"]}})
    pack = pack_from(DATA, layer)
    assert [(f.display, f.origin, f.source) for f in pack.forms] == [("market share", "term", "pack"), ("share", "alias", "pack"), ("marked chair", "variant", "pack"), ("part", "alias", "learned"), ("deck", "term", "pack"), ("dec", "variant", "learned"), ("dek", "variant", "learned")]
    assert pack.forms[-1].context == ("share",)


def test_checks_on_load():
    with pytest.raises(ValueError, match="class"):
        pack_from({"language": "en", "terms": [{"term": "x", "class": "none"}]})
    with pytest.raises(LookupError):
        pack_from({"language": "xq", "terms": []})
    assert pack_from({"language": "xq", "terms": []}, allow_generic=True).language.code == "generic"


def test_files_round_trip(tmp_path):
    pytest.importorskip("yaml")
    layer = Learned((("deck", "dec", "2024-01-01", ()),), (("deck", "deque", "2024-01-02"),), (("duck", "deck", "2024-01-03"),))
    write_learned(layer, tmp_path / "p.learned.yaml")
    assert read_learned(tmp_path / "p.learned.yaml") == layer and read_learned(tmp_path / "none.yaml") == Learned()
    write_pack(DATA, tmp_path / "p.yaml")
    assert read_pack(tmp_path / "p.yaml").forms[-1].display == "deque" and learned_content(layer)["version"] == 1


def test_editing_keeps_one_form_one_term():
    out, warnings = packedit.add_forms(DATA, "deck", aliases=("deques",), variants=("about that",))
    assert out["version"] == "1.2.4" and out["terms"][1] == {"term": "deck", "aliases": ["deques"], "variants": ["about that"]} and len(warnings) == 1
    with pytest.raises(packedit.EditError):
        packedit.add_forms(DATA, "deck", aliases=("Share",))
    with pytest.raises(packedit.EditError):
        packedit.add_forms(DATA, "deck", variants=("ab",))
    grown, _ = packedit.add_term(DATA, "moat", aliases=("moats wide",))
    assert [t["term"] for t in packedit.remove_term(grown, "MOAT")["terms"]] == ["market share", "deck"]
    assert packedit.remove_forms(DATA, "market share", ("share",))["terms"][0].get("aliases") is None
    assert packedit.search(DATA, "chair")[0]["term"] == "market share" and packedit.violations(DATA) == []
    assert DATA["version"] == "1.2.3" and "aliases" not in DATA["terms"][1]


def test_renames_take_the_best_overlap_once():
    up = {"language": "en", "terms": [{"term": "share of market", "aliases": ["market share"]}, {"term": "deck"}]}
    assert packedit.renames(DATA, up) == {"market share": "share of market"}


def test_merge_outcomes(spark):
    schema = "key string, term string, class string, aliases array<string>, variants array<string>"
    side = lambda *rows: spark.createDataFrame([(k, k, c, a, v) for k, c, a, v in rows], schema)
    base = side(("same", "a", [], []), ("up", "a", [], []), ("mine", "a", [], []), ("both", "a", ["x"], ["v"]), ("gone", "a", [], []), ("left", "a", [], []))
    theirs = side(("same", "a", [], []), ("up", "b", [], []), ("mine", "a", [], []), ("both", "b", ["x", "y"], []), ("new", "a", [], []), ("left", "a", [], []))
    mine = side(("same", "a", [], []), ("up", "a", [], []), ("mine", "c", [], []), ("both", "c", ["x", "z"], ["v", "w"]), ("gone", "a", [], []), ("own", "a", [], []))
    rows = {r["key"]: r for r in merge.presence(base, theirs, mine).collect()}
    assert {k: r["outcome"] for k, r in rows.items()} == {"same": "unchanged", "up": "updated", "mine": "kept", "both": "combined", "new": "added upstream", "own": "added here", "gone": "removed upstream", "left": "removed here"}
    assert rows["both"]["class_conflict"] and rows["both"]["class"] == "c"
    assert sorted(rows["both"]["aliases"]) == ["x", "y", "z"] and rows["both"]["variants"] == ["w"]
    pairs = merge.duplicates(spark.createDataFrame([("impressora",)], "key string"), spark.createDataFrame([("impresora",), ("other",)], "key string")).collect()
    assert [(r["mine"], r["theirs"]) for r in pairs] == [("impressora", "impresora")]


def test_registry_states(spark):
    index = spark.createDataFrame([(0, "a", "1.2.0", None), (1, "a", "1.10.0", "9.0"), (2, "b", "2.0.0", ""), (3, "c", "1.0.0", None)], "position int, name string, version string, min_engine string")
    assert {r["name"]: (r["usable"], r["held"]) for r in registry.newest(index, "0.8.1").collect()} == {"a": ("1.2.0", "1.10.0"), "b": ("2.0.0", None), "c": ("1.0.0", None)}
    installed = spark.createDataFrame([("a", "1.2.0", "x", "x"), ("b", "1.0.0", "x", "y"), ("z", "1", "x", "x")], "name string, version string, sha256 string, recorded_sha256 string")
    assert {r["name"]: r["state"] for r in registry.updates(installed, index, "0.8.1").collect()} == {"a": "current", "b": "edited", "c": "new", "z": "unknown"}


def test_track_and_language_choice(spark):
    rows = [("pt-BR", [], ["pt-BR-orig", "en-orig", "es"], "en"), ("", ["de"], [], "pt"), ("en", ["pt-PT", "pt-BR"], ["en-orig"], "pt"), ("", [], ["fr-orig", "it"], "it"), ("pt", [], ["ko"], "xx")]
    df = spark.createDataFrame(rows, "language string, manual array<string>, automatic array<string>, wanted string")
    got = df.select(selection.caption_language(F.col("language"), F.col("manual"), F.col("automatic")).alias("l"), selection.choose_track(F.col("wanted"), F.col("language"), F.col("manual"), F.col("automatic")).alias("t")).collect()
    assert [r["l"] for r in got] == ["pt-BR", "de", "en", "fr", "pt"]
    assert [tuple(r["t"]) if r["t"] else None for r in got] == [("en-orig", "automatic dubbed"), None, ("pt-BR", "manual"), ("it", "automatic"), None]


def test_long_links_drop_the_body():
    assert "body" in issue_link("https://e.org/new", "t", "short") and "body" not in issue_link("https://e.org/new", "t", "x" * 9000)
