"""Whole-word search of forms in caption lines by a positional index of folded words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.languages import GENERIC, Language
from termloom.functions.text import normalize


def _words(text, language: Language):
    return F.filter(F.split(normalize(text, language), " "), lambda w: w != "")


#: Words of an index's places, and of the pieces that forms are cut into.
PIECE = 8


def word_index(lines: DataFrame, language: Language = GENERIC) -> DataFrame:
    """``doc_id, line_no, at, word, ahead``: the folded words of ``doc_id, line_no, text`` by place in their line, from 0,
    and each with those that follow it, ``PIECE`` in all."""
    worded = lines.select("doc_id", "line_no", _words(F.col("text"), language).alias("words"))
    ahead = F.transform("words", lambda _, i: F.slice(F.col("words"), i + 1, PIECE))
    return worded.select("doc_id", "line_no", F.posexplode(ahead).alias("at", "ahead")).select("doc_id", "line_no", "at", F.col("ahead")[0].alias("word"), "ahead")


def places(index: DataFrame, forms: DataFrame, language: Language = GENERIC) -> DataFrame:
    """``doc_id, line_no, form, pieces, start``: where each piece of a form of ``forms`` says that the form would begin.

    Forms are cut into pieces of ``PIECE`` words. A place of a piece's first word is one of the piece only if the words
    ahead are the piece's, which is seen at the place: no more rows come of a frequent word than of what it begins.
    A form without words is nowhere.
    """
    words = forms.select("form").distinct().withColumn("words", _words(F.col("form"), language))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PIECE).cast("int")), lambda k: F.slice(F.col("words"), k * PIECE + 1, PIECE))
    wanted = words.where(F.size("words") > 0).select("form", F.posexplode(pieces).alias("k", "piece"), F.size(pieces).alias("pieces")).withColumn("word", F.col("piece")[0])
    agrees = (F.col("i.word") == F.col("w.word")) & (F.slice("i.ahead", F.lit(1), F.size("w.piece")) == F.col("w.piece"))
    return index.alias("i").join(wanted.alias("w"), agrees).select("doc_id", "line_no", "form", "pieces", (F.col("at") - F.col("k") * PIECE).alias("start"))


def lines_with(index: DataFrame, forms: DataFrame, language: Language = GENERIC) -> DataFrame:
    """``doc_id, line_no, form, n, first_at``: lines that hold a form of ``forms`` as whole words, how often (places
    may overlap) and where first.

    A beginning that all pieces of a form agree on (see :func:`places`) is a place of the form.
    """
    whole = places(index, forms, language).groupBy("doc_id", "line_no", "form", "pieces", "start").agg(F.count(F.lit(1)).alias("agreed")).where("agreed = pieces")
    return whole.groupBy("doc_id", "line_no", "form").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_at"))


def first_lines(found: DataFrame, lines: DataFrame, limit: int) -> DataFrame:
    """``form, doc_id, line_no, ts, text``: the first ``limit`` lines of each form, by document and line.

    Ranks are taken within a document first, so that a form that every line holds is never sorted in one place.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("form", "doc_id").orderBy("line_no")
    few = found.select("form", "doc_id", "line_no").withColumn("k", F.row_number().over(own)).where(F.col("k") <= limit).drop("k")
    every = Window.partitionBy("form").orderBy("doc_id", "line_no")
    few = few.withColumn("k", F.row_number().over(every)).where(F.col("k") <= limit).drop("k")
    return few.join(lines.select("doc_id", "line_no", "ts", "text"), ["doc_id", "line_no"]).select("form", "doc_id", "line_no", "ts", "text")
