"""Report sections, review queues and summaries over annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import collapse
from termloom.schemas import EXAMPLES_PER_FORM, QUESTION_BANDS
from termloom.sources.captions import touched_lines

SECTIONS = ("terms", "unit rules", "recognized (not changed)", "applied, please confirm", "suggested, not applied")


def with_section(annotations: DataFrame) -> DataFrame:
    """Adds ``form`` and the report's ``section`` (null for low marks)."""
    fix = F.col("kind") == "correction"
    section = (
        F.when((F.col("band") == "high") & fix & (F.col("rule") != "unit"), SECTIONS[0])
        .when((F.col("band") == "high") & fix, SECTIONS[1])
        .when(F.col("band") == "high", SECTIONS[2])
        .when((F.col("band") == "medium") & fix, SECTIONS[3])
        .when(F.col("band") == "ask", SECTIONS[4])
    )
    return annotations.withColumn("form", collapse(F.col("original"))).withColumn("section", section)


def report(annotations: DataFrame) -> DataFrame:
    """``section, term, total, forms``: forms by count then first place, terms by total then name."""
    rows = with_section(annotations).where("section is not null")
    forms = rows.groupBy("section", "term", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "first", "form", "n")))
    terms = forms.groupBy("section", "term").agg(F.sum("n").alias("total"), ordered.alias("forms"))
    return terms.select("section", "term", "total", F.array_join(F.transform("forms", lambda x: x["form"]), ", ").alias("forms"))


def low_marks(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("doc_id").agg(F.sum((F.col("band") == "low").cast("int")).alias("low_marks"))


def questions(annotations: DataFrame) -> DataFrame:
    """``doc_id, term, form, n, term_total, term_rank, form_rank``: what a review asks, the busiest first."""
    asked = with_section(annotations).where(F.col("band").isin(*QUESTION_BANDS))
    forms = asked.groupBy("doc_id", "term", "form").agg(F.count(F.lit(1)).alias("n"))
    totals = forms.withColumn("term_total", F.sum("n").over(Window.partitionBy("doc_id", "term")))
    by_term = Window.partitionBy("doc_id").orderBy(F.desc("term_total"), "term")
    by_form = Window.partitionBy("doc_id", "term").orderBy(F.desc("n"), "form")
    return totals.withColumn("term_rank", F.dense_rank().over(by_term)).withColumn("form_rank", F.row_number().over(by_form))


def pending(annotations: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Questions without an answer: ``[never asked]``, or ``[skipped]`` where the answer begins with s."""
    rows = questions(annotations)
    if answers is None:
        return rows.withColumn("tag", F.lit("[never asked]"))
    given = answers.select("doc_id", "term", "form", "answer")
    tagged = rows.join(given, ["doc_id", "term", "form"], "left")
    tag = F.when(F.col("answer").isNull(), "[never asked]").when(F.col("answer").startswith("s"), "[skipped]")
    return tagged.withColumn("tag", tag).where("tag is not null").drop("answer")


def examples(on_lines: DataFrame, limit: int = EXAMPLES_PER_FORM) -> DataFrame:
    """The first ``limit`` lines of each form of each term (rows as ``captions.touched_lines`` gives them)."""
    order = Window.partitionBy("doc_id", "term", "form").orderBy("start", "line_no")
    return on_lines.withColumn("example", F.row_number().over(order)).where(F.col("example") <= limit)


def review_stops(annotations: DataFrame) -> DataFrame:
    """One stop per term and form in question, in text order, numbered ``k`` of ``n_stops``."""
    asked = with_section(annotations).where(F.col("band").isin(*QUESTION_BANDS))
    stops = asked.groupBy("doc_id", "term", "form").agg(F.min(F.struct("start", "end")).alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("doc_id").orderBy("first.start", "first.end", "term")
    return stops.select("doc_id", "term", "form", "n", F.col("first.start").alias("start"), F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n_stops"))


def summary(annotations: DataFrame) -> DataFrame:
    """Counters of each document."""
    some = lambda test: F.sum(test.cast("int"))
    fix, high, medium = F.col("kind") == "correction", F.col("band") == "high", F.col("band") == "medium"
    return annotations.groupBy("doc_id").agg(
        some(fix & (high | medium)).alias("applied"), some(~fix & high).alias("recognized"), some(medium & fix).alias("to_confirm"), some(F.col("band") == "ask").alias("suggested"), some(F.col("band") == "low").alias("low"),
        F.countDistinct("term").alias("terms"),
    )


def band_rollup(annotations: DataFrame) -> DataFrame:
    """Counts by term, rule and band with all subtotals."""
    rows = annotations.rollup("term", "rule", "band").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return rows


def frequent_terms(annotations: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent terms of each document, as offered for a context."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return annotations.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def _times(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " occurrence").otherwise(" occurrences"))


def report_texts(annotations: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``doc_id, text``: the report of each document: sections in their order, terms by total then name, forms by count
    then first place, then how many marks are low. Documents of ``docs`` without annotations say so.

    Forms are counted before they meet; a document's text is as long as its distinct forms are many.
    """
    rows = with_section(annotations)
    forms = rows.where("section is not null").groupBy("doc_id", "section", "term", "form").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start", "end")).alias("first"))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "form")))
    terms = forms.groupBy("doc_id", "section", "term").agg(F.sum("n").alias("total"), listed.alias("forms"))
    names = F.array_join(F.transform("forms", lambda x: x["form"]), ", ")
    terms = terms.withColumn("line", F.concat(F.lit("  "), names, F.lit(" ("), _times(F.col("total")), F.lit(") -> "), "term"))
    place = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    parts = terms.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("less"), "term", "line"))).alias("lines"))
    parts = parts.select("doc_id", F.struct(place.alias("place"), F.concat("section", F.lit(":\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text")).alias("part"))
    low = rows.where("band = 'low'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    low = low.select("doc_id", F.struct(F.lit(len(SECTIONS) + 1).cast("bigint").alias("place"), F.concat(F.col("n").cast("string"), F.lit(" low-confidence marks, not applied")).alias("text")).alias("part"))
    texts = parts.unionByName(low).groupBy("doc_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    texts = texts.select("doc_id", F.rtrim(F.regexp_replace(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), r"\n+$", "")).alias("text"))
    if docs is None:
        return texts
    return docs.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("no annotations.")).alias("text"))


def pending_texts(annotations: DataFrame, lines: DataFrame, answers: DataFrame | None = None, limit: int = EXAMPLES_PER_FORM) -> DataFrame:
    """``doc_id, n, text``: what is still to be answered, by term and form, each form with why it is here and the lines of
    its first ``limit`` places. Documents with nothing left have no row.
    """
    left = pending(annotations, answers)
    asked = with_section(annotations).where(F.col("band").isin(*QUESTION_BANDS))
    order = Window.partitionBy("doc_id", "term", "form").orderBy("start", "end")
    few = asked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("doc_id", "term", "form", "k", "start", "end")
    spots = touched_lines(few, lines).groupBy("doc_id", "term", "form", "k").agg(F.sort_array(F.collect_list(F.struct("line_no", "ts", "line_text"))).alias("on"))
    stamps, words = F.array_join(F.transform("on", lambda x: x["ts"]), "/"), collapse(F.array_join(F.transform("on", lambda x: x["line_text"]), " "))
    shown = spots.select("doc_id", "term", "form", "k", F.concat(F.lit("\n    "), stamps, F.lit("  "), words).alias("line"))
    shown = shown.groupBy("doc_id", "term", "form").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("shown"))
    rows = left.join(shown, ["doc_id", "term", "form"], "left")
    examples_ = F.coalesce(F.array_join(F.transform("shown", lambda x: x["line"]), ""), F.lit(""))
    rows = rows.withColumn("block", F.concat(F.lit("\n  "), "form", F.lit("  ("), _times(F.col("n")), F.lit(")  "), "tag", examples_))
    terms = rows.groupBy("doc_id", "term", "term_total", "term_rank").agg(F.count(F.lit(1)).alias("forms"), F.sort_array(F.collect_list(F.struct("form_rank", "block"))).alias("blocks"))
    terms = terms.withColumn("text", F.concat("term", F.lit("  ("), _times(F.col("term_total")), F.lit(")"), F.array_join(F.transform("blocks", lambda x: x["block"]), "")))
    texts = terms.groupBy("doc_id").agg(F.sum("forms").alias("n"), F.sort_array(F.collect_list(F.struct("term_rank", "term", "text"))).alias("texts"))
    return texts.select("doc_id", "n", F.concat(F.array_join(F.transform("texts", lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))


def run_totals(annotations: DataFrame, pairs: int = 2) -> DataFrame:
    """``doc_id, corrected, recognized, to_confirm, suggested, pairs``: what a run prints: certain corrections with the
    first ``pairs`` distinct changes, recognised names, and the distinct forms (of a term) to confirm or suggested."""
    rows = with_section(annotations)
    fix, high = F.col("kind") == "correction", F.col("band") == "high"
    form = F.struct("term", "form")
    totals = rows.groupBy("doc_id").agg(
        F.sum((fix & high).cast("int")).alias("corrected"), F.sum((~fix & high).cast("int")).alias("recognized"),
        F.countDistinct(F.when(fix & (F.col("band") == "medium"), form)).alias("to_confirm"), F.countDistinct(F.when(F.col("band") == "ask", form)).alias("suggested"),
    )
    change = F.concat("original", F.lit(" → "), "replacement").alias("change")
    first = rows.where(fix & high).groupBy("doc_id", change).agg(F.min(F.struct("start", "end")).alias("at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))
    few = first.withColumn("k", rank).where(F.col("k") <= pairs).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "change"))), lambda x: x["change"]), ", ").alias("pairs"))
    return totals.join(few, "doc_id", "left").select("doc_id", "corrected", "recognized", "to_confirm", "suggested", F.coalesce("pairs", F.lit("")).alias("pairs"))
