"""Corrected captions, line by line, and the annotation file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.resolve import applied
from termloom.sources.captions import touched_lines


def render_lines(lines: DataFrame, annotations: DataFrame) -> DataFrame:
    """``doc_id, line_no, ts, text`` with the applied corrections of resolved annotations written in.

    A correction that runs over a line's end is written on the line where it starts; its rest is left out
    of the next. Every line gives one line.
    """
    fixes = applied(annotations).where("kind = 'correction'").select("doc_id", "start", "end", "replacement")
    hits = touched_lines(fixes, lines).groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("fixes"))
    rows = lines.join(hits, ["doc_id", "line_no"], "left")
    cut = lambda a, b: F.substring(F.col("text"), a - F.col("start") + 1, F.greatest(b - a, F.lit(0)))
    state = F.struct(F.lit("").alias("out"), F.col("start").alias("at"))

    def step(acc, fix):
        kept = F.when(fix["start"] > acc["at"], cut(acc["at"], fix["start"])).otherwise("")
        written = F.when(fix["start"] >= F.col("start"), fix["replacement"]).otherwise("")
        return F.struct(F.concat(acc["out"], kept, written).alias("out"), F.least(fix["end"], F.col("end")).alias("at"))

    full = F.aggregate("fixes", state, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.col("end"))))
    text = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(full)
    return rows.select("doc_id", "line_no", "ts", F.regexp_replace(text, r"^\s+|\s+$", "").alias("text"))


def rendered_text(rendered: DataFrame) -> DataFrame:
    """``doc_id, value``: lines as ``stamp, two spaces, text`` in order, ready for a text sink."""
    return rendered.orderBy("doc_id", "line_no").select("doc_id", F.concat("ts", F.lit("  "), "text").alias("value"))


def annotation_json(annotations: DataFrame) -> DataFrame:
    """``doc_id, json``: a document's annotations in text order, keys in their fixed order."""
    keys = ("start", "end", "original", "replacement", "term", "rule", "kind", "band", "score")
    row = F.struct(*[F.col(k) for k in keys], F.col("band").isin("high", "medium").alias("applied"), "pack_version")
    return annotations.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))


def corrections_table(annotations: DataFrame, lines: DataFrame, terms: DataFrame) -> DataFrame:
    """A draft of gold rows: the applied annotations with stamp, form, correction, term and class."""
    from termloom.functions.text import collapse
    from termloom.sources.captions import locate

    rows = locate(applied(annotations), lines).join(terms.select("term", F.col("class").alias("klass")), "term", "left")
    form = collapse(F.col("original"))
    klass = F.when(F.col("rule") == "unit", "unidade").otherwise(F.coalesce("klass", F.lit("")))
    return rows.select("doc_id", "start", F.col("ts").alias("timestamp"), form.alias("wrong"), F.when(F.col("kind") == "alias", form).otherwise(F.col("replacement")).alias("correct"), "term", klass.alias("class"), F.lit("draft").alias("status"))
