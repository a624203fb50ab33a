"""Tokens that leave with those that follow them."""

from __future__ import annotations

from termloom.functions.languages import ENGLISH
from termloom.operators import tokens

TEXTS = [("a", "One, two three four. Five 'six' $7.5, ... × eight"), ("b", None), ("c", "..."), ("d", "Éá b_c %9 (d)e; f"), ("e", "x")]


def test_followers_equal_those_that_windows_find_across_batches(spark, monkeypatch):
    monkeypatch.setattr(tokens, "ROWS", 3)
    df = spark.createDataFrame(TEXTS, "doc_id string, text string").coalesce(1)
    ahead = tokens.tokens_ahead(df, ENGLISH)
    plain = ahead.select("doc_id", "i", "token", "start", "end", "closes")
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(tokens.windows(ahead, ENGLISH)) == rows(tokens.windows(plain, ENGLISH))
    got = [(r["token"], r["closes"]) for r in plain.where("doc_id = 'a'").orderBy("i").collect()]
    assert got == [("One", True), ("two", False), ("three", False), ("four", True), ("Five", False), ("six", False), ("$7.5", True), ("eight", False)]
