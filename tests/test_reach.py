"""Windows that are turned down in batches of tokens reach nothing."""

from __future__ import annotations

import random

import pytest

from termloom.operators import match, tokens
from termloom.operators.tokens import Reach, tokens_ahead, windows
from termloom.sources.packs import Learned, pack_from

WORDS = ["market", "markets", "marke", "mark-et", "Märket", "share", "chair", "shar", "impressora", "impresora", "Impressoras", "two", "dois", "x", "øre", "ля", "ß", "2", "$5", "a_b", "thintion", "thin", "tion", "thinntiu", "leal", "lial", "ul", "bal", "companies", "company", "of", "É", "ﬁn", "İx", "3d"]
TERMS = [{"term": "market share", "class": "word", "aliases": ["share of market"], "variants": ["marked chair"]}, {"term": "company", "class": "word"}, {"term": "impressora", "class": "word", "aliases": ["impressora 2"]}, {"term": "Thintion", "class": "name", "match": "all"}, {"term": "lealbal", "class": "name"}, {"term": "øre x", "class": "word", "match": "exact"}]


@pytest.mark.parametrize("language", ["en", "pt-BR"])
@pytest.mark.parametrize("one_by_one", [True, False])
def test_no_window_that_reaches_a_form_or_a_sound_is_left_out(spark, monkeypatch, language, one_by_one):
    monkeypatch.setattr(tokens, "ROWS", 97)
    if not one_by_one:
        monkeypatch.setattr(match, "TESTED_GUESSES", 1)
    terms = [{k: v for k, v in t.items() if v != "all"} for t in TERMS]
    p = pack_from({"language": language, "version": "1", "classes": ["word", "name"], "phonetic_classes": ["name"], "terms": terms}, Learned())
    dice = random.Random(5)
    text = lambda: "".join(dice.choice(WORDS) + dice.choice([" ", " ", " ", " ", ", ", "  ", " - "]) for _ in range(300))
    df = spark.createDataFrame([(str(k), text()) for k in range(8)] + [("none", None), ("empty", "")], "doc_id string, text string").coalesce(2)
    every, some = tokens_ahead(df, p.language), tokens_ahead(df, p.language, match.reach_of({"": p}))
    rows = lambda d: sorted(map(str, d.collect()))
    found = lambda t: match.reached(windows(t, p.language, True), {"": p})
    assert rows(found(some)) == rows(found(every)) != []
    if match._sounding({"": p}):
        none = spark.createDataFrame([], "doc_id string, pack string, start int, end int, band string")
        heard = lambda w: rows(match.phonetic(w, none, {"": p}))
        assert heard(windows(some, p.language, heard=True)) == heard(windows(every, p.language)) != []
    if one_by_one:
        assert some.count() < every.count()


def test_distinct_tokens_are_forgotten_in_time(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KNOWN", 3)
    p = pack_from({"language": "en", "version": "1", "classes": ["word"], "terms": [{"term": "company", "class": "word"}]}, Learned())
    reach: Reach = match.reach_of({"": p})
    no = np.zeros(4, bool)
    for _ in range(3):
        assert (reach.sizes(pa.array(["company", "x", "y", "z"]), no, no) != 0).tolist() == [True, False, False, False]
        assert (reach.sizes(pa.array(["v", "companies", "u", "compamy"]), no, no) != 0).tolist() == [False, True, False, True]
