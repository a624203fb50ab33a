from __future__ import annotations

import datetime
import json

import pytest

from termloom.functions.languages import ENGLISH
from termloom.operators import packmerge, registry
from termloom.sources import runs, sinks
from termloom.sources.captions import parse_captions, rolling_lines
from termloom.streaming.rolling import rolling_stream

PACK = {
    "language": "en", "version": "1.2.3", "name": "Money", "description": "A \"quoted\" é", "classes": ["word", "name"], "phonetic_classes": ["name"],
    "terms": [
        {"term": "Zeta", "class": "word", "aliases": ["z, 1", "Ä"], "variants": ["zetta"], "collocations": ["of zeta"], "context": {"zetta": ["Alpha", "B"]}, "unless_near": {"zetta": ["C"]}},
        {"term": "Alpha", "match": "exact", "case_sensitive": ["Alpha"]}, {"term": "bare"},
    ],
}


def test_a_pack_goes_through_tables_and_comes_back(spark):
    terms, heads = packmerge.pack_tables(spark, {"money": PACK, "empty": {"language": "en"}})
    rows = {r["pack"]: r for r in packmerge.assembled(terms, heads).collect()}
    assert json.loads(rows["money"]["content"]) == PACK and rows["money"]["n_terms"] == 3
    assert json.loads(rows["empty"]["content"]) == {"language": "en", "terms": []} and rows["empty"]["n_terms"] == 0


def test_merged_heads_and_edit_counts(spark):
    mine = PACK | {"classes": ["word", "own"], "name": "Mine", "based_on": "money@1.0.0", "terms": [*PACK["terms"][:2], {"term": "New"}]}
    up = PACK | {"version": "1.3.0", "classes": ["word", "name", "new"], "name": "Theirs"}
    (base_terms, base_heads), (up_terms, up_heads), (my_terms, my_heads) = (packmerge.pack_tables(spark, {"money": x}) for x in (PACK, up, mine))
    nothing = spark.createDataFrame([], "pack string, term string, text string")
    merged, _, _ = packmerge.merge(base_terms, up_terms, my_terms, nothing, nothing, ENGLISH)
    merged = merged.withColumn("pos", merged["pos.at"])
    counted = packmerge.edits(merged, up_terms, ENGLISH)
    # bare is gone here, New is only here.
    assert [tuple(r) for r in counted.collect()] == [("money", 2)]
    (head,) = packmerge.merged_heads(base_heads, up_heads, my_heads, counted, ENGLISH).collect()
    assert (head["version"], head["based_on"], head["local_edits"], head["name"], head["classes"]) == ("1.3.1", "money@1.3.0", 2, "Mine", ["word", "new", "own"])
    (same,) = packmerge.merged_heads(base_heads, up_heads, my_heads, packmerge.edits(up_terms, up_terms, ENGLISH), ENGLISH).collect()
    assert (same["version"], same["local_edits"]) == ("1.3.0", 0)


def test_offers_follow_the_records_of_copies(spark):
    entry = "position int, name string, version string, min_engine string"
    index = spark.createDataFrame([(0, "a", "1.9.0", None), (1, "a", "1.10.0", None), (2, "a", "2.0.0", "9.9"), (3, "b", "1.0.0", None), (4, "c", "5.0", None)], entry)
    copies = spark.createDataFrame([("a", "1.3.1", "a@1.3.0", 1), ("a2", "1.0.0", "a2@1.0.0", 0), ("b", "1.0.0", None, None), ("c", "0.1", None, None), ("d", "1.0.0", None, None)], "name string, version string, based_on string, local_edits int")
    included = spark.createDataFrame([("a", "1.10"), ("b", "1.2.0"), ("d", "1.0.0")], "name string, version string")
    history = spark.createDataFrame([("a", "1.2.0"), ("a", "1.3.0"), ("a", "1.4.0"), ("b", "1.1.0")], "name string, version string")
    got = {r["name"]: r for r in registry.offers(copies, index, included, history, "1.0.0").collect()}
    # a2 and c have no upstream of theirs, d is not behind, a's newest is for a later engine.
    assert set(got) == {"a", "b"}
    assert (got["a"]["upstream"], got["a"]["origin"], got["a"]["base"], got["a"]["three_way"]) == ("1.10", "included", "1.3.0", True)
    assert got["a"]["line"] == "a 1.10 is available; your copy is based on 1.3.0 with 1 local edit."
    assert (got["b"]["base"], got["b"]["three_way"]) == (None, False) and got["b"]["line"].endswith("has no record of its base, so it merges two-way.")
    asked = spark.createDataFrame([("a", "1.3.5"), ("a", "1.1"), ("z", "1")], "name string, have string")
    assert sorted((r["name"], r["have"], r["base"]) for r in registry.nearest_base(asked, history).collect()) == [("a", "1.1", None), ("a", "1.3.5", "1.3.0"), ("z", "1", None)]


def test_index_files(spark, tmp_path):
    good = tmp_path / "index.json"
    good.write_text(json.dumps({"packs": [{"name": "money-en", "version": "1.0.0", "sha256": "x", "extra": 1}, {"name": "b", "version": "2"}]}))
    assert [(r["position"], r["name"], r["min_engine"]) for r in registry.read_index(spark, str(good)).orderBy("position").collect()] == [(0, "money-en", None), (1, "b", None)]
    for content in ('{"other": 1}', "no json", json.dumps({"packs": [{"name": "../up"}]})):
        bad = tmp_path / "bad.json"
        bad.write_text(content)
        with pytest.raises(ValueError):
            registry.read_index(spark, str(bad))


def test_runs_and_gold_folders_from_files(spark, tmp_path):
    root = tmp_path / "runs"
    files = {
        "r1/meta.yaml": "title: 'It''s a long title that goes on\n  and on: é'\nchannel: c\npublished: '20240305'\nfetched_at: '2025-01-02T03:04:05+00:00'\n", "r1/legenda.txt": "# Titulo: other\n0:01 x\n", "r1/gold.csv": "timestamp\n",
        "r2/meta.yaml": "title: \"A \\\"b\\\"\"\npublished: ''\nfetched_at: 2023-05-06T00:00:00+00:00\nsubtitle: no\n",
        "r3/legenda.txt": "# Titulo: Third: one\n# Publicado: \n# Baixado em: 2022-01-01\n0:01 x\n", "r4/annotations.json": "[]", "r5/other.txt": "x", "r6/deep/meta.yaml": "title: x\n", "r7/gold.csv": "timestamp\n", "r8/legenda.txt": "0:01 no header\n",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content, "utf-8")
    got = [tuple(r) for r in registry.run_catalog(runs.run_sources(spark, str(root))).orderBy("place").collect()]
    assert got == [
        ("r3", "header", "2022-01-01", "Third: one", 1), ("r2", "meta", "2023-05-06", 'A "b"', 2), ("r1", "meta", "2024-03-05", "It's a long title that goes on and on: é", 3),
        ("r4", "annotations", "", "", 4), ("r8", "header", "", "", 5),
    ]
    assert [r["run_id"] for r in runs.gold_folders(spark, str(root)).collect()] == ["r1", "r7"]


def test_state_of_silent_documents_goes(spark, tmp_path):
    """Cues by batch: a document's state goes when the watermark passes its silence, late cues are dropped."""
    schema = "doc_id string, cue_no int, start double, end double, lines array<string>, arrived timestamp"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)
    batches = [
        [("d", 0, 0.0, 2.0, ["one", "two"], at(0)), ("d", 1, 2.0, 4.0, ["two", "three"], at(1))],
        [("e", 0, 0.0, 2.0, ["x"], at(300))],
        [("d", 2, 4.0, 6.0, ["late"], at(2)), ("e", 1, 3.0, 5.0, ["x", "y"], at(301))],
        [("d", 3, 5.0, 7.0, ["two"], at(302))],
        [("f", 0, 0.0, 1.0, [], at(900))],
        [("f", 1, 1.0, 2.0, [], at(901))],
    ]
    query, rows = None, []
    source = tmp_path / "cues"
    source.mkdir()
    stream = rolling_stream(spark.readStream.schema(schema).parquet(str(source)), arrived="arrived", late="10 minutes", idle_seconds=600)
    query = stream.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            (part,) = (tmp_path / f"part{k}").glob("*.parquet")
            part.rename(source / f"{k}.parquet")
            query.processAllAvailable()
            rows.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    finally:
        query.stop()
    got = sorted((r["doc_id"], r["cue_no"], r["text"]) for r in spark.table("expiring").collect())
    # "late" is older than the watermark; "two" comes back after the state of d has gone.
    assert got == [("d", 0, "one"), ("d", 0, "two"), ("d", 1, "three"), ("d", 3, "two"), ("e", 0, "x"), ("e", 1, "y")]
    assert rows[0] == 1 and rows[-1] == 0 and max(rows) <= 2
    first = spark.createDataFrame(batches[0], schema)
    assert sorted(r["text"] for r in rolling_lines(first).collect()) == ["one", "three", "two"]


def test_captions_and_texts_are_written_in_order(spark, tmp_path):
    lines = spark.createDataFrame([(d, k, f"{k}:00", f"line {k}") for d in ("a", "b") for k in range(40)], "doc_id string, line_no int, ts string, text string").repartition(7)
    sinks.write_captions(lines, str(tmp_path / "captions"))
    sinks.write_rendered(lines, str(tmp_path / "rendered"))
    for folder, gap in (("captions", " "), ("rendered", "  ")):
        for d in ("a", "b"):
            (part,) = (tmp_path / folder / f"doc_id={d}").glob("part*.txt")
            assert part.read_text() == "".join(f"{k}:00{gap}line {k}\n" for k in range(40))
    raw = spark.read.text(str(tmp_path / "captions"), wholetext=True).select("doc_id", "value").withColumnRenamed("value", "raw")
    again, _ = parse_captions(raw)
    assert again.where("doc_id = 'b'").count() == 40
    texts = spark.createDataFrame([("a", "terms:\n  x")], "doc_id string, text string")
    sinks.write_texts(texts, str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts")).where("doc_id = 'a'").count() == 2
