from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from termloom.plans import catalog

DATA = os.environ.get("TERMLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(tuple(r[c] for c in order) for r in got.collect()) == key(want.select(*[f'"{c}"' for c in order]).fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["annotation_json"])
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_span_lines_are_those_of_every_token(spark):
    lines: dict = {}
    for r in catalog.QUERIES["caption_lines"](spark, DATA).collect():
        lines.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["line_no"]))
    tokens = catalog.QUERIES["token_stream"](spark, DATA).collect()
    want = sorted((t["doc_id"], t["i"], n) for t in tokens for start, end, n in lines[t["doc_id"]] if start < t["end"] + 60 and t["start"] < end)
    got = sorted(map(tuple, catalog.QUERIES["span_lines"](spark, DATA).select("doc_id", "i", "line_no").collect()))
    assert got == want and {(d, i) for d, i, _ in got} == {(t["doc_id"], t["i"]) for t in tokens}


def test_run_catalog_has_the_runs_of_all_orders(spark, duck):
    best: dict = {}
    for key, customer, date, title in duck.sql("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority FROM orders").fetchall():
        own = best.setdefault(str(customer), {}).setdefault(key % 3, [None, title])
        own[0] = own[0] if key % 4 == 0 else max(own[0] or date, date)
        own[1] = min(own[1], title)
    rows = [(run, ("meta", "header", "annotations")[min(kinds)], *kinds[min(kinds)]) for run, kinds in best.items()]
    rows.sort(key=lambda r: (r[2] or "9999", r[0]))
    got = catalog.QUERIES["run_catalog"](spark, DATA).select("run_id", "source", "date", "title", "place").collect()
    assert sorted(got, key=lambda r: r["place"]) == [(*r, k + 1) for k, r in enumerate(rows)]
