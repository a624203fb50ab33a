"""One entry for a run over many transcripts: pack, learned layer, local decisions, fit gate, views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import reports
from termloom.operators.match import find_annotations
from termloom.operators.render import render_lines
from termloom.operators.resolve import apply_local, fit_table, fitting, resolve_overlaps
from termloom.session import settled
from termloom.sources.packs import Pack


@dataclass(frozen=True)
class Run:
    """What a run gives, each a table by ``doc_id``: annotations that hold, lines with the corrections written in, the
    fit of every document (``n_terms, fits``), and the report, the pending forms and the totals."""

    annotations: DataFrame
    lines: DataFrame
    fit: DataFrame
    report: DataFrame
    pending: DataFrame
    totals: DataFrame


def normalize(texts: DataFrame, lines: DataFrame, pack: Pack, decisions: DataFrame | None = None, answers: DataFrame | None = None, force: bool = False) -> Run:
    """Annotates ``doc_id, text`` by a pack (its learned layer is in it), then applies what was decided for a document
    only (``doc_id, term, form``), then leaves documents alone that the pack does not fit, unless forced: their lines
    stay as they are and nothing is asked about them.

    Matching runs once; every view reads the table of annotations that it leaves.
    """
    return run_of(resolve_overlaps(find_annotations(texts, pack, lines)), texts, lines, decisions, answers, force)


def run_of(found: DataFrame, texts: DataFrame, lines: DataFrame, decisions: DataFrame | None = None, answers: DataFrame | None = None, force: bool = False) -> Run:
    """The run of annotations that were found before, with overlaps resolved: :func:`normalize` without its matching, for
    decisions on what these annotations ask."""
    if decisions is not None:
        found = apply_local(found, decisions)
    found = settled(found, "found")
    fit = fit_table(found.withColumn("pack", F.lit("")), texts, ("",)).drop("pack")
    kept = fitting(found, force)
    unfit = F.concat(F.lit("the pack does not seem to fit: "), F.col("n_terms").cast("string"), F.when(F.col("n_terms") == 1, " term").otherwise(" terms"), F.lit(" found"))
    report = reports.report_texts(kept, texts).join(fit, "doc_id")
    report = report.select("doc_id", F.when(F.col("fits") | F.lit(force), F.col("text")).otherwise(unfit).alias("text"))
    return Run(kept, render_lines(lines, kept), fit, report, reports.pending_texts(kept, lines, answers), reports.run_totals(kept))
