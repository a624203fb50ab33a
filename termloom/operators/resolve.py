"""Overlap resolution, run-local decisions and the fit of a pack."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.text import collapse
from termloom.schemas import APPLIED_BANDS, MIN_FIT_TERMS


def layers(annotations: DataFrame) -> list[str]:
    """What annotations compete within: a document, and a pack and a threshold where they have them."""
    return ["doc_id", *[c for c in ("pack", "threshold") if c in annotations.columns]]


def resolve_overlaps(annotations: DataFrame) -> DataFrame:
    """One annotation per stretch of text: applied bands first, then score, length, position and rule.

    Chains of overlapping spans are found with a running maximum, so the greedy choice is made within each
    chain, a few rows, rather than within a document. Packs and thresholds are resolved each for itself.
    """
    home = layers(annotations)
    order = Window.partitionBy(*home).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    chained = annotations.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct(
        (~F.col("band").isin(*APPLIED_BANDS)).alias("open"), (-F.col("score")).alias("o1"), (F.col("start") - F.col("end")).alias("o2"), F.col("start").alias("o3"), F.col("rule").alias("o4"),
        *[F.col(c) for c in annotations.columns if c not in home],
    )
    grouped = chained.groupBy(*home, "chain").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    none = F.slice("rows", 1, 0)
    apart = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
    kept = F.aggregate("rows", none, lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select(*home, F.explode(F.when(F.size("rows") == 1, F.col("rows")).otherwise(kept)).alias("r")).select(*home, *[F.col(f"r.{c}").alias(c) for c in annotations.columns if c not in home])


def apply_local(annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions ``doc_id, term, form`` of a run: what is not high yet becomes a high correction by rule ``local``."""
    chosen = decisions.select("doc_id", "term", collapse(F.col("form")).alias("form"), F.lit(True).alias("chosen")).distinct()
    joined = annotations.withColumn("form", collapse(F.col("original"))).join(chosen, ["doc_id", "term", "form"], "left")
    take = F.col("chosen").isNotNull() & (F.col("band") != "high")
    changed = {"rule": "local", "band": "high", "kind": "correction"}
    return joined.withColumns({c: F.when(take, v).otherwise(F.col(c)) for c, v in changed.items()}).select(annotations.columns)


def pack_fit(annotations: DataFrame) -> DataFrame:
    """``doc_id, n_terms, fits``: distinct terms of the high band without units, and whether they suffice."""
    counted = F.countDistinct(F.when((F.col("band") == "high") & (F.col("rule") != "unit"), F.col("term")))
    return annotations.groupBy(*layers(annotations)).agg(counted.alias("n_terms")).withColumn("fits", F.col("n_terms") >= MIN_FIT_TERMS)


def fitting(annotations: DataFrame, force: bool = False) -> DataFrame:
    """Only annotations of documents that the pack fits, unless forced."""
    if force:
        return annotations
    home = layers(annotations)
    return annotations.join(pack_fit(annotations).where("fits").select(*home), home, "left_semi")


def _grid(docs: DataFrame, name: str, values: Iterable) -> DataFrame:
    """``doc_id`` of every document with every value of a small list."""
    return docs.select("doc_id", F.explode(F.array(*map(F.lit, values))).alias(name))


def fit_table(annotations: DataFrame, docs: DataFrame, packs: Iterable[str]) -> DataFrame:
    """``doc_id, pack, n_terms, fits`` for every document and every pack, also where a pack finds nothing.

    ``annotations`` are those of :func:`termloom.operators.match.find_annotations_of`, with or without overlaps
    resolved; ``docs`` has a row per document.
    """
    counted = pack_fit(annotations)
    rows = _grid(docs, "pack", packs).join(counted, ["doc_id", "pack"], "left")
    return rows.select("doc_id", "pack", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms"), F.coalesce("fits", F.lit(False)).alias("fits"))


def best_pack(fits: DataFrame) -> DataFrame:
    """``doc_id, pack, n_terms``: the pack that fits a document best, by terms, then name; documents that no pack fits
    are left out."""
    first = F.min_by(F.struct("pack", "n_terms"), F.struct(-F.col("n_terms"), "pack"))
    return fits.where("fits").groupBy("doc_id").agg(first.alias("b")).select("doc_id", "b.pack", "b.n_terms")


def threshold_table(annotations: DataFrame, docs: DataFrame, thresholds: Iterable[int]) -> DataFrame:
    """``doc_id, threshold, low_marks``: marks that win their place but are not applied, for every document and mark.

    ``annotations`` are those of :func:`termloom.operators.match.find_annotations_at` with overlaps resolved.
    """
    low = annotations.where("band = 'low'").groupBy("doc_id", "threshold").agg(F.count(F.lit(1)).alias("low_marks"))
    return _grid(docs, "threshold", sorted(set(thresholds))).join(low, ["doc_id", "threshold"], "left").na.fill(0, ["low_marks"])

def applied(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("band").isin(*APPLIED_BANDS))
