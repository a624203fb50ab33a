from __future__ import annotations

import pytest

from termloom.functions.languages import ENGLISH
from termloom.operators.learned import transition
from termloom.operators.match import find_annotations
from termloom.operators.render import render_lines
from termloom.operators.reports import pending, questions, report, review_stops, summary
from termloom.operators.resolve import apply_local, fitting, pack_fit, resolve_overlaps
from termloom.operators.tokens import tokenize, windows
from termloom.sources.captions import header_field, parse_captions, parse_cues, rolling_lines
from termloom.sources.packs import Learned, learned_from, pack_from


def pack(*terms, learned=None, language="en", **more):
    return pack_from({"language": language, "version": "1", "classes": ["word", "name"], "terms": list(terms), **more}, learned or Learned())


def found(spark, text, p, lines=None):
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = find_annotations(df, p, lines).orderBy("start", "end", "rule").collect()
    return [(r["original"], r["term"], r["rule"], r["band"], r["score"]) for r in rows]


def test_tokens_offsets_and_sentences(spark):
    text = "Grew 6.7, then... (rose) 5% x,y. End"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    rows = tokenize(df, ENGLISH).orderBy("i").collect()
    assert [(r["token"], r["closes"]) for r in rows] == [("Grew", False), ("6.7", True), ("then", True), ("rose", False), ("5%", False), ("x,y", True), ("End", False)]
    assert all(text[r["start"] : r["end"]] == r["token"] for r in rows)
    spans = {(r["i"], r["n"]) for r in windows(tokenize(df, ENGLISH), ENGLISH).collect()}
    assert (0, 2) in spans and (1, 2) not in spans and (3, 3) in spans and (4, 2) in spans and (4, 3) not in spans and (5, 2) not in spans


def test_names_aliases_variants_and_plurals(spark):
    p = pack({"term": "market share", "class": "word", "aliases": ["share of market"], "variants": ["marked chair"]}, {"term": "company", "class": "word"})
    assert found(spark, "Market share, share of market! marked chair; companies.", p) == [
        ("Market share", "market share", "term:exact", "high", 100),
        ("share of market", "market share", "term:alias", "high", 100),
        ("marked chair", "market share", "term:variant", "high", 100),
        ("companies", "company", "term:alias", "high", 100),
    ]


def test_guesses_bands_and_the_demoted_variant(spark):
    p = pack({"term": "impressora", "class": "word"})
    assert found(spark, "impresora", p) == [("impresora", "impressora", "term:fuzzy", "medium", 94)]
    assert found(spark, "imprensa", p)[0][3] == "low"
    variant = pack({"term": "zz", "class": "word", "variants": ["abcdefghij"]})
    assert found(spark, "abcdefgxyj", variant) == [("abcdefgxyj", "zz", "term:fuzzy", "low", 80)]


def test_ordinary_words_and_exact_forms_guard_guesses(spark):
    assert found(spark, "impressora that", pack({"term": "impressora 3d", "class": "word"})) == []
    two = pack({"term": "dividend yield", "class": "word"}, {"term": "dividends e", "class": "word"})
    assert all(r[1] == "dividends e" for r in found(spark, "dividends e", two))


def test_rejections_end_the_window(spark):
    layer = Learned(rejected=(("impresora", "impressora", ""),))
    assert found(spark, "impresora", pack({"term": "impressora", "class": "word"}, learned=layer)) == []


def test_learned_forms_match_exactly_only(spark):
    layer = learned_from({"confirmed": {"impressora": ["emprezora"]}, "aliases": {"impressora": [{"alias": "printer", "date": "2024"}]}})
    p = pack({"term": "impressora", "class": "word"}, learned=layer)
    assert [r[2] for r in found(spark, "emprezora, printer", p)] == ["term:variant", "term:alias"]


def test_exact_only_terms_respect_case_and_number_words(spark):
    p = pack({"term": "Meta", "class": "name", "match": "exact", "case_sensitive": ["Meta"]})
    assert [r[0] for r in found(spark, "Meta and meta and Metas", p)] == ["Meta"]


def test_units_come_first(spark):
    assert found(spark, "grew 5.5 bn. and 3 M", pack()) == [("5.5 bn", "billion", "unit", "high", 100), ("3 M", "million", "unit", "high", 100)]


def test_phonetic_proposals_are_asked(spark):
    p = pack({"term": "BR Partners", "class": "name"}, language="pt-BR", phonetic_classes=["name"])
    assert ("BR Portness", "BR Partners", "term:phonetic", "ask", 93) in [r for r in found(spark, "a BR Portness caiu", p) if r[2] == "term:phonetic"] or any(r[2] == "term:fuzzy" for r in found(spark, "a BR Portness caiu", p))


@pytest.mark.parametrize(("text", "bands"), [("the dec rose", []), ("the dec rose. deck", ["ask"]), ("the dec rose. deck deck", ["high"])])
def test_context_conditions(spark, text, bands):
    p = pack({"term": "debt", "class": "word", "variants": ["dec"], "context": {"dec": ["deck"]}}, {"term": "deck", "class": "word"})
    assert [r[3] for r in found(spark, text, p) if r[1] == "debt"] == bands


def test_near_condition_by_stamp(spark):
    raw = spark.createDataFrame([("d", "0:01 the dec rose\n0:05 deck deck\n1:00 a moon\n9:00 dec again")], "doc_id string, raw string")
    lines, texts = parse_captions(raw)
    p = pack({"term": "debt", "class": "word", "variants": ["dec"], "context": {"dec": ["deck"]}, "unless_near": {"dec": ["moon"]}}, {"term": "deck", "class": "word"}, {"term": "moon", "class": "word"})
    rows = find_annotations(texts, p, lines).where("term = 'debt'").orderBy("start").collect()
    assert [r["band"] for r in rows] == ["ask", "high"]


def test_captions_offsets_header_and_rendering(spark):
    raw = spark.createDataFrame([("d", "# Title: A: b\n#x\n0:00 we saw thatin\n\nnospace\n0:05  twice thatin here \n"), ("e", None)], "doc_id string, raw string")
    lines, texts = parse_captions(raw)
    rows = lines.orderBy("line_no").collect()
    assert [(r["ts"], r["ts_sec"], r["text"], r["start"], r["end"]) for r in rows] == [("0:00", 0, "we saw thatin", 0, 13), ("0:05", 5, "twice thatin here", 14, 31)]
    assert texts.select(header_field(texts["header"], "Title").alias("t")).where("t <> ''").first()["t"] == "A: b"
    p = pack({"term": "orantion", "class": "unidade", "variants": ["thatin", "thatin twice"]})
    resolved = resolve_overlaps(find_annotations(texts, p, lines))
    assert [r["text"] for r in render_lines(lines, resolved).orderBy("line_no").collect()] == ["we saw orantion", "orantion here"]


def test_overlaps_prefer_applied_then_score_then_length(spark):
    rows = [("d", 0, 5, "x", "medium", 90), ("d", 3, 9, "x", "low", 99), ("d", 5, 9, "x", "high", 80), ("d", 20, 22, "x", "ask", 90), ("d", 19, 25, "x", "ask", 90)]
    df = spark.createDataFrame(rows, "doc_id string, start int, end int, rule string, band string, score int")
    assert [(r["start"], r["end"]) for r in resolve_overlaps(df).orderBy("start").collect()] == [(0, 5), (5, 9), (19, 25)]


def test_reports_questions_and_fit(spark):
    rows = [("d", k, k + 1, w, t, t, rule, kind, band, 90, "1") for k, (w, t, rule, kind, band) in enumerate([("a  b", "T", "term:variant", "correction", "high"), ("a b", "T", "term:variant", "correction", "high"), ("u", "U", "unit", "correction", "high"), ("n", "N", "term:alias", "alias", "high"), ("m", "M", "term:fuzzy", "correction", "medium"), ("q", "M", "term:phonetic", "correction", "ask"), ("l", "L", "term:fuzzy", "correction", "low")])]
    df = spark.createDataFrame(rows, "doc_id string, start int, end int, original string, replacement string, term string, rule string, kind string, band string, score int, pack_version string")
    assert {(r["section"], r["term"], r["total"], r["forms"]) for r in report(df).collect()} == {("terms", "T", 2, "a b"), ("unit rules", "U", 1, "u"), ("recognized (not changed)", "N", 1, "n"), ("applied, please confirm", "M", 1, "m"), ("suggested, not applied", "M", 1, "q")}
    assert [(r["form"], r["form_rank"]) for r in questions(df).orderBy("form_rank").collect()] == [("m", 1), ("q", 2)]
    answers = spark.createDataFrame([("d", "M", "m", "yes"), ("d", "M", "q", "s")], "doc_id string, term string, form string, answer string")
    assert [(r["form"], r["tag"]) for r in pending(df, answers).collect()] == [("q", "[skipped]")]
    assert [(r["form"], r["k"], r["n_stops"]) for r in review_stops(df).orderBy("k").collect()] == [("m", 1, 2), ("q", 2, 2)]
    assert pack_fit(df).first()["n_terms"] == 2 and fitting(df).count() == 0 and fitting(df, force=True).count() == 7
    assert summary(df).first()["applied"] == 4
    local = spark.createDataFrame([("d", "M", "q")], "doc_id string, term string, form string")
    changed = apply_local(df, local).where("original = 'q'").first()
    assert (changed["rule"], changed["band"]) == ("local", "high")


def test_learned_transitions(spark):
    layer = lambda *rows: spark.createDataFrame(list(rows), "term string, text string, date string")
    decisions = spark.createDataFrame([("T", "Foo", "2", "confirm"), ("T", "bar", "2", "alias"), ("T", "no", "2", "reject"), ("T", "no", "3", "reject")], "term string, text string, date string, decision string")
    c, a, r = transition(layer(("T", "bar", "1"), ("T", "foo", "1")), layer(("T", "FOO", "1")), layer(("T", "x", "1")), decisions)
    assert [(x["text"], x["date"]) for x in c.collect()] == [("foo", "1")]
    assert [x["text"] for x in a.collect()] == ["bar"]
    assert sorted(x["text"] for x in r.collect()) == ["no", "x"]


CUES = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000 align:start\n<c>one</c> &amp; two\nsame\nsame\n\n2\n00:00:04,000 --> 00:00:06,500\nsame\nnew\n\n00:01:00.000 --> 00:01:02.000\nsame\n"


def test_rolling_captions(spark):
    raw = spark.createDataFrame([("d", CUES)], "doc_id string, raw string")
    rows = rolling_lines(parse_cues(raw)).orderBy("line_no").collect()
    assert [(r["ts"], r["text"]) for r in rows] == [("0:03", "one & two"), ("0:03", "same"), ("0:03", "same"), ("0:06", "new"), ("1:02", "same")]


def test_rolling_captions_as_a_stream(spark, tmp_path):
    from termloom.schemas import CUES as SCHEMA
    from termloom.streaming.rolling import rolling_stream

    cues = parse_cues(spark.createDataFrame([("d", CUES)], "doc_id string, raw string"))
    cues.write.parquet(str(tmp_path / "cues"))
    query = rolling_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "cues"))).writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    streamed = sorted((r["ts"], r["text"]) for r in spark.table("rolled").collect())
    assert streamed == sorted((r["ts"], r["text"]) for r in rolling_lines(cues).collect())
