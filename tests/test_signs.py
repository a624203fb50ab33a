from __future__ import annotations

import html
import random
import sys
import unicodedata

from pyspark.sql import functions as F

from termloom.functions.signs import composed, unescaped

REFERENCES = [
    "a &amp; b &lt;i&gt; &quot;q&quot; &#39;x&#39; &apos;", "&middot;&copy;&nbsp;|", "&copy 2020 &copyright; &notit; &notin; &amp;lt;", "&#65;&#x41;&#X1F600;&#128512; &#0; &#x110000; &#xD800; &#150; &#x80; &#129; &#1; &#xFFFE; &#x7f;",
    "&unknown; & && &; &#; &#x; &#xg; &ltfoo &frac12 &frac123", "&NotEqualTilde; &CounterClockwiseContourIntegral; &acE;", "plain", "", "&#99999999999999; &#x00000041; &#0000000065;", "x &AMP y &AMP; &amp",
]


def test_references_are_those_of_markup(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*REFERENCES, None])], "k int, t string")
    got = {r["k"]: r["d"] for r in df.select("k", unescaped(F.col("t")).alias("d")).collect()}
    assert got == {k: html.unescape(t) for k, t in enumerate(REFERENCES)} | {len(REFERENCES): None}


def test_composition_is_canonical(spark):
    rng = random.Random(4)
    marked = [chr(p) for p in range(0xC0, 0x2000) if unicodedata.decomposition(chr(p)) and not unicodedata.decomposition(chr(p)).startswith("<")]
    marks = [chr(p) for p in range(0x300, 0x370)] + ["֑", "ְ", "़", "ೕ", "া", "̧", "゙"]
    odd = ["Å", "Ω", "क़", "⫝̸", "ײַ", "ᄀ", "ᅡ", "ᆨ", "가", "각", "일", "か", "̈́", "῁", "\U0001d15e", "😀", "ে", "ෙ", "ා", "්"]
    texts = ["Café ế ậ q̣̇", "́start", "각 각가 각ᆨ", "", "plain\ntext"]
    texts += [unicodedata.normalize("NFD", "".join(rng.choices(marked, k=12))) for _ in range(40)]
    texts += ["".join(rng.choice([rng.choice(marked), rng.choice(marks), rng.choice(odd), rng.choice("aeo un\n")]) for _ in range(25)) for _ in range(120)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string")
    got = {r["k"]: r["c"] for r in df.select("k", composed(F.col("t")).alias("c")).collect()}
    wrong = [(t, got[k], unicodedata.normalize("NFC", t)) for k, t in enumerate(texts) if got[k] != unicodedata.normalize("NFC", t)]
    assert wrong == [] and got[len(texts)] is None


def test_every_single_sign_composes(spark):
    signs = [chr(p) for p in range(0x80, min(sys.maxunicode, 0x30000)) if unicodedata.normalize("NFD", chr(p)) != chr(p)]
    text = " ".join(s for s in signs)
    df = spark.createDataFrame([(text,), (unicodedata.normalize("NFD", text),)], "t string")
    assert {r["c"] for r in df.select(composed(F.col("t")).alias("c")).collect()} == {unicodedata.normalize("NFC", text)}
