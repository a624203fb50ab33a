from __future__ import annotations

import os

import pytest

from termloom.operators import match, resolve, review, search
from termloom.session import settled, temporary_tables
from termloom.sources.captions import parse_captions
from termloom.sources.packs import Learned, pack_from

RAW = "0:00 we met debtor one\n0:05 the dec  rose. We\n0:09 saw dec\n1:00 dec, dec and emprezora\n2:00 end"


def pack(*terms, language="en", rejected=(), **more):
    return pack_from({"language": language, "version": "1", "classes": ["word", "name"], "terms": list(terms), **more}, Learned(rejected=tuple((x, t, "") for x, t in rejected)))


@pytest.fixture(scope="module")
def captions(spark):
    raw = spark.createDataFrame([("d", RAW), ("e", "0:01 nothing here"), ("f", "0:01 a BR Portness caiu e grew 5 bn com Meta")], "doc_id string, raw string")
    return parse_captions(raw)


PACKS = {
    "one": pack({"term": "debt", "class": "word", "variants": ["dec"], "context": {"dec": ["debtor"]}, "unless_near": {"dec": ["end"]}}, {"term": "debtor", "class": "word"}, {"term": "end", "class": "word"}, {"term": "rose", "class": "word"}),
    "two": pack({"term": "december", "class": "word", "variants": ["dec"]}, {"term": "impressora", "class": "word"}, rejected=[("emprezora", "impressora")]),
    "three": pack({"term": "impressora", "class": "word"}),
    "pt": pack({"term": "BR Partners", "class": "name"}, {"term": "Meta", "class": "name", "match": "exact", "case_sensitive": ["Meta"]}, language="pt-BR", phonetic_classes=["name"]),
}


def rows_of(df):
    return sorted(tuple(r[c] for c in match.OUTPUT) for r in df.collect())


def test_many_packs_in_one_pass_equal_each_alone(spark, captions):
    lines, texts = captions
    together = settled(match.find_annotations_of(texts, PACKS, lines), "together")
    for name, own in PACKS.items():
        alone = rows_of(match.find_annotations(texts, own, lines))
        assert rows_of(together.where(f"pack = '{name}'")) == alone and alone, name
    assert {r["rule"] for r in together.collect()} >= {"term:fuzzy", "term:variant", "term:exact", "unit"}
    with pytest.raises(ValueError):
        match.find_annotations_of(texts, {}, lines)


def test_one_scan_of_the_windows_serves_all_packs(spark, captions):
    lines, texts = captions
    windows = spark.createDataFrame([("d", 0, 1, 0, 3, "dec", "dec", "dec")], "doc_id string, i int, n int, start int, end int, raw string, folded string, run string")
    found = match.reached(windows, {k: v for k, v in PACKS.items() if k != "pt"})
    assert {(r["pack"], r["term"]) for r in found.collect()} >= {("one", "debt"), ("two", "december")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_fit_of_every_document_and_pack(spark, captions):
    _, texts = captions
    found = match.find_annotations_of(texts, PACKS)
    table = {(r["doc_id"], r["pack"]): (r["n_terms"], r["fits"]) for r in resolve.fit_table(resolve.resolve_overlaps(found), texts, PACKS).collect()}
    assert set(table) == {(d, p) for d in "def" for p in PACKS}
    assert table["d", "one"] == (3, True) and table["e", "one"] == (0, False) and table["d", "three"] == (0, False)
    assert [tuple(r) for r in resolve.best_pack(resolve.fit_table(resolve.resolve_overlaps(found), texts, PACKS)).collect()] == [("d", "one", 3)]


def test_thresholds_side_by_side_equal_runs_of_their_own(spark):
    texts = spark.createDataFrame([("d", "impresora imprensa emprezora impzzzzora abcdefgxyj"), ("e", None)], "doc_id string, text string")
    own = pack({"term": "impressora", "class": "word"}, {"term": "zz", "class": "word", "variants": ["abcdefghij"]})
    found = settled(match.find_annotations_at(texts, own, (60, 70, 80)), "marks")
    at_70 = rows_of(found.where("threshold = 70"))
    assert at_70 == rows_of(match.find_annotations(texts, own))
    assert len(rows_of(found.where("threshold = 60"))) > len(at_70) > len(rows_of(found.where("threshold = 80"))) > 0
    # A demoted guess scores 80 and ranks 79.
    assert [r["threshold"] for r in found.where("term = 'zz'").orderBy("threshold").collect()] == [60, 70]
    table = {(r["doc_id"], r["threshold"]): r["low_marks"] for r in resolve.threshold_table(resolve.resolve_overlaps(found), texts, (60, 70, 80)).collect()}
    assert set(table) == {(d, t) for d in "de" for t in (60, 70, 80)} and table["e", 60] == 0
    assert table["d", 60] >= table["d", 70] > table["d", 80] == 0
    with pytest.raises(ValueError):
        match.find_annotations_at(texts, own, (90,))


def test_tables_of_a_block_go_with_it(spark, captions):
    _, texts = captions
    with temporary_tables(spark):
        kept = settled(texts, "gone")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(os.path.dirname(path))


def test_lines_that_hold_forms_as_whole_words(spark):
    lines = spark.createDataFrame([("d", 0, "The Café, the café-bar"), ("d", 1, "decaf café_bar 日本 語"), ("e", 0, "a a a a"), ("e", 1, ""), ("e", 2, None)], "doc_id string, line_no int, text string")
    forms = spark.createDataFrame([("cafe",), ("the CAFE bar",), ("a a",), ("日本",), ("?!",), ("",), ("cafe the",), ("cafe the",)], "form string")
    got = sorted(tuple(r) for r in search.lines_with(search.word_index(lines), forms).collect())
    assert got == [("d", 0, "cafe", 2, 1), ("d", 0, "cafe the", 1, 1), ("d", 0, "the CAFE bar", 1, 2), ("d", 1, "日本", 1, 2), ("e", 0, "a a", 3, 0)]
    stamped = lines.selectExpr("doc_id", "line_no", "'0:00' AS ts", "text")
    assert [tuple(r)[:3] for r in search.first_lines(search.lines_with(search.word_index(lines), forms), stamped, 1).orderBy("form").collect()] == [("a a", "e", 0), ("cafe", "d", 0), ("cafe the", "d", 0), ("the CAFE bar", "d", 0), ("日本", "d", 1)]


def test_frequent_words_of_forms_give_no_places_and_long_forms_are_found(spark):
    long = " ".join(f"w{k}" for k in range(17))
    texts = ["the " * 500, f"x {long} {long}", long.removesuffix("16"), f"{long.removeprefix('w0 ')}", "a b " * 12, "the cat the"]
    lines = spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "doc_id string, line_no int, text string")
    forms = ["the cat", "cat the", long, "a b " * 8, "a b " * 4, "b a b a b a b a b", "w15 w16 w0"]
    index, table = search.word_index(lines), spark.createDataFrame([(f,) for f in forms], "form string")
    want = set()
    for k, t in enumerate(texts):
        for f in forms:
            at = [i for i in range(len(t.split())) if t.split()[i : i + len(f.split())] == f.split()]
            want |= {("d", k, f, len(at), at[0])} if at else set()
    assert {tuple(r) for r in search.lines_with(index, table).collect()} == want and len(want) == 7
    # Of 502 times "the" only the one that begins a form goes on.
    assert [tuple(r) for r in search.places(index, spark.createDataFrame([("the cat",)], "form string")).collect()] == [("d", 5, "the cat", 1, 0)]


@pytest.fixture(scope="module")
def in_question(spark, captions):
    lines, texts = captions
    word = lambda at, form: (at, at + len(form), form)
    text = texts.where("doc_id = 'd'").first()["text"]
    spots = [m for m in range(len(text)) if text.startswith("dec", m)]
    rows = [("d", *word(s, "dec"), "debt", "debt", "term:fuzzy", "correction", "ask", 90, "1") for s in spots]
    rows += [("d", *word(spots[0], "dec  rose"), "rose", "rose", "term:fuzzy", "correction", "medium", 85, "1"), ("d", *word(spots[2], "dec"), "december", "december", "term:fuzzy", "correction", "medium", 88, "1"), ("d", *word(text.index("emprezora"), "emprezora"), "impressora", "impressora", "term:fuzzy", "correction", "low", 75, "1")]
    return spark.createDataFrame(rows, "doc_id string, start int, end int, original string, replacement string, term string, rule string, kind string, band string, score int, pack_version string")


def test_what_a_stop_shows(spark, captions, in_question):
    lines, texts = captions
    urls = spark.createDataFrame([("d", "https://www.youtube.com/watch?v=abcdefghijk")], "doc_id string, url string")
    got = {(r["term"], r["form"]): r for r in review.stop_context(in_question, lines, texts, urls).collect()}
    first = got["debt", "dec"]
    assert (first["k"], first["n_stops"], first["n"]) == (1, 3, 4)
    assert (first["before_ts"], first["before"], first["ts"], first["shown"], first["after_ts"], first["after"]) == ("0:00", "we met debtor one", "0:05", "the «dec» rose. We", "0:09", "saw dec")
    assert first["elsewhere"] == "0:09, 1:00" and first["link"] == "https://youtu.be/abcdefghijk?t=5"
    assert got["rose", "dec rose"]["shown"] == "the «dec rose». We" and got["december", "dec"]["k"] == 3
    bare = {(r["term"], r["form"]): r["link"] for r in review.stop_context(in_question, lines, texts).collect()}
    assert set(bare.values()) == {""}


def test_answers_spread_over_the_stops_of_a_form(spark, in_question):
    stops = review.asked(in_question)
    answers = spark.createDataFrame([("d", "debt", "dec", "context", ["debtor"]), ("d", "december", "dec", "no", None), ("d", "rose", "dec rose", "no", None)], "doc_id string, term string, form string, answer string, context array<string>")
    told = review.given(stops, answers)
    assert {(r["term"], r["answer"], r["taken_by"], tuple(r["context"] or ())) for r in told.collect()} == {("debt", "context", None, ("debtor",)), ("rose", "no", None, ()), ("december", None, "debt", ())}
    assert sorted((r["term"], r["text"], r["decision"], r["context"]) for r in review.decisions(told).collect()) == [("debt", "dec", "confirm", ["debtor"]), ("rose", "dec rose", "reject", [])]
    after = [(r["start"], r["term"], r["rule"], r["band"]) for r in review.reviewed(in_question, told).orderBy("start").collect()]
    assert {x[1:] for x in after} == {("debt", "term:variant", "high"), ("impressora", "term:fuzzy", "low")} and len(after) == 5
    later = review.given(stops, answers.where("term = 'rose'"))
    assert {(r["term"], r["answer"]) for r in later.collect()} == {("debt", "later"), ("december", "later"), ("rose", "no")}
    local = review.given(stops, answers.selectExpr("doc_id", "term", "form", "'local' AS answer"))
    assert {r["form"] for r in review.local_forms(local).collect()} == {"dec", "dec rose"}
    said = review.reviewed(in_question, review.given(stops, answers.selectExpr("doc_id", "term", "form", "'alias' AS answer"))).where("term = 'debt'").first()
    assert (said["kind"], said["replacement"], said["rule"]) == ("alias", "dec", "term:alias")


def test_one_entry_gates_documents_that_a_pack_does_not_fit(spark, captions):
    from termloom.operators.normalize import normalize
    from termloom.operators.render import render_lines

    lines, texts = captions
    decisions = spark.createDataFrame([("d", "debt", "dec")], "doc_id string, term string, form string")
    run = normalize(texts, lines, PACKS["one"], decisions)
    assert {(r["doc_id"], r["n_terms"], r["fits"]) for r in run.fit.collect()} == {("d", 4, True), ("e", 0, False), ("f", 0, False)}
    assert {r["rule"] for r in run.annotations.where("term = 'debt'").collect()} == {"local"} and {r["doc_id"] for r in run.annotations.collect()} == {"d"}
    report = {r["doc_id"]: r["text"] for r in run.report.collect()}
    assert report["e"] == "the pack does not seem to fit: 0 terms found"
    assert report["d"].startswith("terms:\n  dec (4 occurrences) -> debt\n\nrecognized (not changed):\n") and run.pending.count() == 0
    text = {(r["doc_id"], r["line_no"]): r["text"] for r in run.lines.collect()}
    assert text["d", 3] == "debt, debt and emprezora" and text["f", 0].startswith("a BR Portness")
    forced = normalize(texts, lines, PACKS["one"], decisions, force=True)
    # Nothing was decided for f, and its unit stands when the gate is open.
    assert {r["doc_id"] for r in forced.annotations.collect()} == {"d", "f"} and {r["doc_id"]: r["text"] for r in forced.report.collect()}["e"] == "no annotations."
    assert {(r["doc_id"], r["corrected"], r["pairs"]) for r in forced.totals.collect()} == {("d", 4, "dec → debt"), ("f", 1, "5 bn → 5 billion")}
    assert render_lines(lines, forced.annotations).where("doc_id = 'f'").first()["text"] == "a BR Portness caiu e grew 5 billion com Meta"


def test_names_of_languages_and_runs(spark):
    from pyspark.sql import functions as F

    from termloom.functions.values import language_name, run_id

    rows = spark.createDataFrame([("pt",), ("pt-BR",), ("xx",), ("xx-YY",)], "c string").select("c", language_name(F.col("c")).alias("n")).collect()
    assert {r["c"]: r["n"] for r in rows} == {"pt": "Portuguese", "pt-BR": "Portuguese (pt-BR)", "xx": "xx", "xx-YY": "xx-YY"}
    files = [("/data/runs/abc/legenda.txt", ""), ("in/talk.en.txt", "https://youtu.be/abcdefghijk?t=4"), ("in/talk.en.txt", None), ("runs/legenda.txt", ""), (".hidden", "")]
    got = spark.createDataFrame(files, "p string, u string").select(run_id(F.col("p"), F.col("u")).alias("r")).collect()
    assert [r["r"] for r in got] == ["abc", "abcdefghijk", "talk.en", "legenda", ".hidden"]
