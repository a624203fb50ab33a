"""Reviews: what a stop shows, how answers spread over stops, and what they change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import collapse
from termloom.functions.values import watch_link
from termloom.operators.reports import with_section
from termloom.schemas import QUESTION_BANDS
from termloom.sources.captions import locate, touched_lines

#: Answers to a stop: remember it, this document only, an alias said that way, no, later, and remembered on condition.
YES, LOCAL, ALIAS, NO, LATER, CONTEXT = ANSWERS = ("yes", "local", "alias", "no", "later", "context")
#: Answers that take a form for their term.
TAKING = (YES, LOCAL, ALIAS, CONTEXT)


def asked(annotations: DataFrame) -> DataFrame:
    """Annotations in question with the ``form`` that groups them, the number ``k`` of their stop and ``n_stops``.

    A stop is a form of a term; stops are numbered by their first place in the text.
    """
    rows = with_section(annotations).where(F.col("band").isin(*QUESTION_BANDS)).drop("section")
    home = Window.partitionBy("doc_id", "term", "form")
    rows = rows.withColumn("first", F.min(F.struct("start", "end")).over(home))
    order = Window.partitionBy("doc_id").orderBy("first.start", "first.end", "term", "form")
    rows = rows.withColumn("k", F.dense_rank().over(order))
    return rows.withColumn("n_stops", F.max("k").over(Window.partitionBy("doc_id")))


def stop_context(annotations: DataFrame, lines: DataFrame, texts: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """``doc_id, term, form, k, n_stops, n, before_ts, before, ts, shown, after_ts, after, elsewhere, link``: a row per stop.

    ``shown`` is the line of the first place (lines, where it straddles), the form in guillemets; ``before`` and
    ``after`` are the lines next to it; ``elsewhere`` has the other stamps, joined by commas; ``link`` leads to the
    moment, from ``doc_id, url``. Neighbours come from windows over the lines, so no line is joined with all others.
    """
    rows = asked(annotations)
    first = rows.where((F.col("start") == F.col("first.start")) & (F.col("end") == F.col("first.end")))
    counts = rows.groupBy("doc_id", "term", "form", "k", "n_stops").agg(F.count(F.lit(1)).alias("n"), F.min("first.start").alias("start"), F.min("first.end").alias("end"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    beside = lambda step, c: (F.lag if step < 0 else F.lead)(c).over(order)
    near = lines.select("doc_id", "line_no", "start", "end", F.struct(beside(-1, "ts").alias("ts"), beside(-1, "text").alias("text")).alias("before"), F.struct(beside(1, "ts").alias("ts"), beside(1, "text").alias("text")).alias("after"))
    spans = touched_lines(first.select("doc_id", "term", "form", "start", "end").distinct(), lines)
    ends = spans.groupBy("doc_id", "term", "form").agg(F.min(F.struct("line_no", "ts", "line_start")).alias("head"), F.max(F.struct("line_no", "line_end")).alias("tail"))
    head = near.select("doc_id", F.col("line_no").alias("head_no"), "before")
    tail = near.select("doc_id", F.col("line_no").alias("tail_no"), "after")
    placed = ends.select("doc_id", "term", "form", F.col("head.line_no").alias("head_no"), F.col("tail.line_no").alias("tail_no"), F.col("head.ts").alias("ts"), F.col("head.line_start").alias("low"), F.col("tail.line_end").alias("high"))
    placed = placed.join(head, ["doc_id", "head_no"]).join(tail, ["doc_id", "tail_no"])
    cut = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    shown = F.concat(cut(F.col("low"), F.col("start")), F.lit("«"), cut(F.col("start"), F.col("end")), F.lit("»"), cut(F.col("end"), F.col("high")))
    stamps = locate(rows.select("doc_id", "term", "form", "start"), lines).groupBy("doc_id", "term", "form", "ts").agg(F.min("start").alias("at"))
    stamps = stamps.groupBy("doc_id", "term", "form").agg(F.sort_array(F.collect_list(F.struct("at", "ts"))).alias("stamps"))
    others = F.array_join(F.transform(F.slice("stamps", 2, F.greatest(F.size("stamps") - 1, F.lit(0))), lambda s: s["ts"]), ", ")
    key = ["doc_id", "term", "form"]
    whole = counts.join(placed, key).join(stamps, key).join(texts.select("doc_id", "text"), "doc_id")
    link = F.lit("")
    if urls is not None:
        whole = whole.join(urls.select("doc_id", "url"), "doc_id", "left")
        link = F.when(F.coalesce("url", F.lit("")) != "", watch_link(F.col("url"), F.col("ts"))).otherwise("")
    return whole.select(*key, "k", "n_stops", "n", F.col("before.ts").alias("before_ts"), F.col("before.text").alias("before"), "ts", collapse(shown).alias("shown"), F.col("after.ts").alias("after_ts"), F.col("after.text").alias("after"), others.alias("elsewhere"), link.alias("link"))


def given(stops: DataFrame, answers: DataFrame) -> DataFrame:
    """``doc_id, term, form, k, answer, context, taken_by``: every stop of ``doc_id, term, form, k`` with its answer.

    A form that an earlier stop of the document took for another term is not asked again: its answer is null and
    ``taken_by`` names that term. A stop that ``answers`` (``doc_id, term, form, answer`` and perhaps ``context``)
    lacks is for later.
    """
    if "context" not in answers.columns:
        answers = answers.withColumn("context", F.array().cast("array<string>"))
    told = stops.select("doc_id", "term", "form", "k").distinct().join(answers.select("doc_id", "term", "form", "answer", "context"), ["doc_id", "term", "form"], "left")
    told = told.withColumn("answer", F.coalesce("answer", F.lit(LATER)))
    form = Window.partitionBy("doc_id", "form")
    taken = F.min(F.when(F.col("answer").isin(*TAKING), F.struct("k", "term"))).over(form)
    told = told.withColumn("taken", taken)
    late = F.col("k") > F.col("taken.k")
    return told.select("doc_id", "term", "form", "k", F.when(late, None).otherwise(F.col("answer")).alias("answer"), F.when(~F.coalesce(late, F.lit(False)) & (F.col("answer") == CONTEXT), F.col("context")).alias("context"), F.when(late, F.col("taken.term")).alias("taken_by"))


def decisions(told: DataFrame) -> DataFrame:
    """``term, text, decision, context``: what :func:`given` answers add to the learned layer, each once."""
    decision = F.when(F.col("answer").isin(YES, CONTEXT), "confirm").when(F.col("answer") == ALIAS, "alias").when(F.col("answer") == NO, "reject")
    rows = told.withColumn("decision", decision).where("decision is not null")
    return rows.groupBy("term", F.col("form").alias("text"), "decision").agg(F.min(F.coalesce("context", F.array().cast("array<string>"))).alias("context"))


def local_forms(told: DataFrame) -> DataFrame:
    """``doc_id, term, form`` of what holds in its document only, as :func:`termloom.operators.resolve.apply_local` takes it."""
    return told.where(F.col("answer") == LOCAL).select("doc_id", "term", "form")


def reviewed(annotations: DataFrame, told: DataFrame) -> DataFrame:
    """Annotations as they stand after a review: an answer holds for every place of its form in the document, also under
    another term that was not asked for it.

    What a form is taken for becomes a high correction (recognised, for an alias); what is no, or taken by another
    term, goes; the rest stays.
    """
    own = told.select("doc_id", "term", "form", "answer", "taken_by")
    rows = annotations.withColumn("form", collapse(F.col("original"))).join(own, ["doc_id", "term", "form"], "left")
    in_question = F.col("band").isin(*QUESTION_BANDS)
    takes = in_question & F.col("answer").isin(*TAKING)
    gone = in_question & (F.coalesce(F.col("answer") == NO, F.lit(False)) | F.col("taken_by").isNotNull())
    said = F.col("answer") == ALIAS
    change: dict[str, Column] = {
        "rule": F.when(takes & said, "term:alias").when(takes & (F.col("answer") == LOCAL), "local").when(takes, "term:variant").otherwise(F.col("rule")),
        "kind": F.when(takes & said, "alias").when(takes, "correction").otherwise(F.col("kind")),
        "replacement": F.when(takes & said, F.col("original")).when(takes, F.col("term")).otherwise(F.col("replacement")),
        "band": F.when(takes, "high").otherwise(F.col("band")),
    }
    return rows.where(~F.coalesce(gone, F.lit(False))).withColumns(change).select(annotations.columns)
