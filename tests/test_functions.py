from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.functions.languages import ENGLISH, GENERIC, PORTUGUESE, Language, for_code, register
from termloom.functions.similarity import bits_reach, indel_ratio, may_reach, places_of, ratio_by_places, ratio_of, sign_bits, sign_bits_of
from termloom.functions.text import clean_markup, collapse, fold, fold_text, inflection_bases, normalize, normalize_text, skeleton, skeleton_text
from termloom.functions.values import bump, caption_stamp, cue_seconds, iso_date, stamp_seconds, stamp_seconds_lenient, too_old_for, version_numbers, video_id, watch_link


def values(spark, rows, column):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("s"))).collect()]


TEXTS = ["Ação à vista", "a - b", "  ÇÃO  $5 ", "bova onze", "de onze", "dois  três", "Café İx", "um dois e onze", "", "petr quatro onze", "não; é\nisso"]


@pytest.mark.parametrize("language", [PORTUGUESE, ENGLISH])
def test_folding_and_number_words_follow_the_driver_side_definition(spark, language):
    assert values(spark, TEXTS, lambda c: fold(c, language)) == [fold_text(t, language) for t in TEXTS]
    assert values(spark, TEXTS, lambda c: normalize(c, language)) == [normalize_text(t, language) for t in TEXTS]


def test_number_words_join_a_ticker_but_not_an_ordinary_word(spark):
    assert values(spark, ["bova onze", "de onze", "bova  onze", "onze dois"], lambda c: normalize(c, PORTUGUESE)) == ["bova11", "de 11", "bova  11", "11 2"]


def test_generic_folding_keeps_letters_of_any_script(spark):
    assert values(spark, ["Ärger Ж-1"], lambda c: fold(c, GENERIC)) == ["arger ж 1"]


def test_skeleton(spark):
    assert skeleton_text("BR Portness", PORTUGUESE) == "brprtns"
    assert values(spark, ["BR Portness", "Alcântara"], lambda c: skeleton(c, PORTUGUESE)) == ["brprtns", skeleton_text("Alcântara", PORTUGUESE)]
    assert values(spark, ["x"], lambda c: skeleton(c, ENGLISH)) == [None]


def test_plural_bases(spark):
    assert sorted(values(spark, ["acoes"], lambda c: inflection_bases(c, PORTUGUESE))[0]) == ["aco", "acao", "acoe"] or sorted(values(spark, ["acoes"], lambda c: inflection_bases(c, PORTUGUESE))[0]) == ["acao", "aco", "acoe"]
    assert sorted(values(spark, ["companies"], lambda c: inflection_bases(c, ENGLISH))[0]) == ["compani", "companie", "company"]
    assert values(spark, ["class", "as", "two words"], lambda c: inflection_bases(c, ENGLISH)) == [[], [], []]


def test_ratio_by_places_is_the_indel_ratio(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc dé9") for _ in range(n))
    pairs = [(word(rng.randrange(12)), word(rng.randrange(1, 12))) for _ in range(60)] + [("a" * 70, "ab" * 31), ("ab" * 40, "ba" * 40), ("", "x"), ("abc", "abc")]
    rows = [(a, b, places_of(b), sign_bits_of(b)) for a, b in pairs]
    got = spark.createDataFrame(rows, "a string, b string, places map<string,bigint>, bits bigint")
    reach = bits_reach(F.col("a"), sign_bits(F.col("a")), F.col("b"), F.col("bits"), 70)
    for r in got.select("a", "b", ratio_by_places(F.col("a"), F.col("b"), F.col("places")).alias("r"), reach.alias("may")).collect():
        assert r["r"] == pytest.approx(ratio_of(r["a"], r["b"]))
        assert r["may"] or r["r"] < 70


def test_indel_ratio_native_and_driver_agree(spark):
    rng = random.Random(4)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    pairs += [("impressora que", "impressora 3d"), ("brprtn", "brprtnrs")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r"), may_reach(F.col("a"), F.col("b"), 70).alias("may")).collect()
    for r in rows:
        assert r["r"] == pytest.approx(ratio_of(r["a"], r["b"]))
        assert r["may"] or r["r"] < 70
    assert int(ratio_of("impressora que", "impressora 3d")) == 81


def test_stamps_dates_links(spark):
    assert values(spark, ["1:05", "1:00:00", "x:1", "5", ""], stamp_seconds) == [65, 3600, None, None, None]
    assert values(spark, ["1:05", "x:1", "5"], stamp_seconds_lenient) == [65, 1, 5]
    assert values(spark, ["00:01:02,500", "1:2.5"], cue_seconds) == [62.5, 62.5]
    assert values(spark, ["20240131", "2024-1", None], iso_date) == ["2024-01-31", "2024-1", None]
    assert values(spark, ["3725.9"], lambda c: caption_stamp(c.cast("double"))) == ["62:05"]
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&x=1", "https://youtu.be/ABCDEFGHIJ_", "https://e.org/x", ""]
    assert values(spark, urls, video_id) == ["abcdefghijk", "ABCDEFGHIJ_", None, None]
    assert values(spark, urls, lambda c: watch_link(c, F.lit("1:05"))) == ["https://youtu.be/abcdefghijk?t=65", "https://youtu.be/ABCDEFGHIJ_?t=65", "https://e.org/x at 1:05", ""]


def test_versions(spark):
    rows = spark.createDataFrame([("1.10.0", "1.9"), ("v2", "2.0.0"), ("x", "0")], "a string, b string")
    assert [r[0] for r in rows.select(version_numbers(F.col("a")) > version_numbers(F.col("b"))).collect()] == [True, False, False]
    assert values(spark, ["0.8.1", "0.9", "soon", "", None], lambda c: too_old_for(F.lit("0.8.1"), c)) == [False, True, True, False, False]
    assert values(spark, ["1.2.3", "1.2", "a"], bump) == ["1.2.4", "0.1.0", "0.1.0"]


def test_markup_and_space(spark):
    assert values(spark, ["<c.x>a</c> &amp;lt; b ", "&lt;i&gt;"], clean_markup) == ["a &lt; b", "<i>"]
    assert values(spark, ["  a \n b  "], collapse) == ["a b"]


def test_language_registry():
    register(Language("xx", plurals=(("ix", ""),), boundaries="|"))
    assert for_code("XX").plurals == (("ix", ""),)
    assert for_code("pt-BR") is PORTUGUESE
    assert for_code("qq", allow_generic=True) is GENERIC
    with pytest.raises(LookupError):
        for_code("qq")
