from __future__ import annotations

import corpus_pipeline
from termloom.llm import toxicity

from test_duplicates import bare, near_classes, removal, shingle_sets


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k == 4:
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(after) == docs.count()
        if name == "toxicity":
            gone = set(before) - set(after)
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).collect()}
            assert gone == {i for i, p in scores.items() if p}
        elif name == "exact_dedup":
            best: dict = {}
            for i, t in before.items():
                best[bare(t)] = min(best.get(bare(t), (0, i)), (-len(t or ""), i))
            assert set(after) == {i for _, i in best.values()}
        elif name == "ngram_jaccard_join":
            classes = near_classes(shingle_sets(list(before.items())))
            assert set(after) == {i for i, root in classes.items() if i == root}
        else:
            want = {i: t if not n else kept.decode("utf-8", "ignore") for (i, t), (_, _, n, _, kept) in zip(before.items(), removal(list(before.items())), strict=True)}
            assert after == want
        before = after
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_take_the_edge_corpus_and_clashing_columns(spark, docs, corpus, tmp_path):
    """Nulls, repeated rows, blank and long texts and columns of the stages' own names pass every stage."""
    now, names = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = rows_of(now)
        stage(spark, now, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == names
        after = rows_of(now)
        if name == "exact_dedup":
            best, once = {}, set(before)
            for i, t in once:
                if i is not None:
                    best[bare(t)] = min(best.get(bare(t), (1, 0, "")), (-len(t or ""), i, t or ""))
            assert after == sorted([(i, t) for i, t in once if i is not None and best[bare(t)][:2] == (-len(t or ""), i)] + [x for x in before if x[0] is None], key=str)
        elif name == "ngram_jaccard_join":
            classes = near_classes(shingle_sets(before))
            assert after == [x for x in before if x[0] is None or classes[x[0]] == x[0]]
        elif name == "suffix_array_dedup":
            assert [i for i, _ in after] == [i for i, _ in before]
        else:
            assert set(after) <= set(before)
        assert all(x in after for x in before if x[0] is None and name != "suffix_array_dedup" and name != "toxicity")
    packed = corpus_pipeline.STAGES[4][1](spark, now, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in after}


def test_stages_take_an_empty_table(spark, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0, name
