"""Scoring against hand-checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.languages import Language
from termloom.functions.text import collapse, normalize
from termloom.operators.resolve import applied, resolve_overlaps
from termloom.schemas import GOLD_COLUMNS, GOLD_STATUSES
from termloom.session import settled
from termloom.sources.captions import touched_lines


def read_gold(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """A gold file with its row order; an unknown status is an error."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in GOLD_COLUMNS), multiLine=True, escape='"')
    rows = rows.withColumn("timestamp", F.regexp_replace("timestamp", "^﻿", ""))
    strange = rows.where(~F.coalesce(F.col("status"), F.lit("")).isin(*GOLD_STATUSES)).limit(1).collect()
    if strange:
        raise ValueError(f"unknown status {strange[0]['status']!r}")
    return rows.na.fill("").select(F.lit(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), *GOLD_COLUMNS)


def score(annotations: DataFrame, lines: DataFrame, gold: DataFrame, language: Language) -> dict[str, DataFrame]:
    """``rows`` (a row per scored gold row with its outcome), ``false_positives`` and ``touched`` (keep rows).

    Only applied annotations that win overlap resolution count. A row is answered by the first annotation
    on its line, in text order, that covers its words. An alias row that any correction covers is a miss
    and a false positive; a correction that answers nothing is a false positive unless it nests with one
    that does on a line they share.
    """
    key = lambda c: collapse(normalize(F.col(c), language))
    kept = applied(resolve_overlaps(annotations)).withColumn("a_id", F.struct("start", "end")).withColumn("a_key", key("original"))
    # Read by every part below, so written once.
    on_line = settled(touched_lines(kept.select("doc_id", "start", "end", "a_id", "a_key", "term", "kind", "original"), lines), "on_line")
    at = on_line.select("doc_id", F.col("ts").alias("timestamp"), "a_id", "a_key", F.col("term").alias("a_term"), "kind", "line_no", F.col("original").alias("a_original"))
    rows = settled(gold.withColumn("wrong_key", key("wrong")).withColumn("correct_key", key("correct")), "gold")
    covers = F.col("a_key").contains(F.col("wrong_key")) | F.col("wrong_key").contains(F.col("a_key"))
    met = rows.join(at, ["doc_id", "timestamp"]).where(covers)
    touched = met.where("status = 'manter' and kind = 'correction'").select("doc_id", "row_no", "timestamp", "wrong", F.col("a_original").alias("original"), F.col("a_term").alias("term")).distinct()
    scope = rows.where("status not in ('so_caixa', 'manter') and term <> ''").where("status = 'alias' or wrong_key <> correct_key")
    answers = met.groupBy("doc_id", "row_no").agg(
        F.min(F.when(F.col("kind") == "correction", F.col("a_id"))).alias("any_fix"),
        F.min(F.when((F.col("kind") == "correction") & (F.col("a_term") == F.col("term")), F.col("a_id"))).alias("fix"),
        F.min(F.when((F.col("kind") == "alias") & (F.col("a_term") == F.col("term")), F.col("a_id"))).alias("name"),
    )
    scored = scope.join(answers, ["doc_id", "row_no"], "left")
    substituted = (F.col("status") == "alias") & F.col("any_fix").isNotNull()
    used = F.when(F.col("status") == "alias", F.when(~substituted, F.col("name"))).otherwise(F.col("fix"))
    scored = scored.withColumn("substituting", F.when(substituted, F.col("any_fix"))).withColumn("used", used)
    outcome = F.when(substituted, "substituted").when(F.col("used").isNull(), "miss").when(F.col("status") == "alias", "recognized").otherwise("hit")
    scored = settled(scored.withColumn("outcome", outcome), "scored")
    fixes = on_line.where("kind = 'correction'")
    bad = scored.where("substituting is not null").select("doc_id", F.col("substituting").alias("a_id")).distinct()
    good = scored.where("used is not null").select("doc_id", F.col("used").alias("a_id")).distinct()
    credit = at.join(good, ["doc_id", "a_id"]).select("doc_id", "line_no", F.col("a_key").alias("u_key"))
    idle = fixes.select("doc_id", "a_id", "a_key", "line_no").join(good, ["doc_id", "a_id"], "left_anti").join(bad, ["doc_id", "a_id"], "left_anti")
    nested = idle.join(credit, ["doc_id", "line_no"]).where(F.col("a_key").contains(F.col("u_key")) | F.col("u_key").contains(F.col("a_key"))).select("doc_id", "a_id").distinct()
    wrong = idle.select("doc_id", "a_id").distinct().join(nested, ["doc_id", "a_id"], "left_anti").union(bad)
    home = Window.partitionBy("doc_id", "a_id").orderBy("line_no")
    placed = fixes.withColumn("k", F.row_number().over(home)).where("k = 1").select("doc_id", "a_id", "ts", "original", "term")
    false = placed.join(wrong, ["doc_id", "a_id"]).select("doc_id", F.col("a_id.start").alias("start"), "ts", "original", "term")
    return {"rows": scored.drop("any_fix", "fix", "name", "wrong_key", "correct_key"), "false_positives": false, "touched": touched}


def counts(result: dict[str, DataFrame]) -> DataFrame:
    """The six counters of each document."""
    is_ = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), 1).otherwise(0)).alias(names[0])
    rows = result["rows"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("in_scope"), is_("hit", "recognized").alias("hits"), is_("miss", "substituted").alias("misses"), is_("recognized").alias("aliases_recognized"), is_("substituted").alias("aliases_substituted"))
    false = result["false_positives"].groupBy("doc_id").agg(F.count(F.lit(1)).alias("false_positives"))
    return rows.join(false, "doc_id", "full_outer").na.fill(0)


def per_term(result: dict[str, DataFrame]) -> DataFrame:
    hit = F.sum(F.when(F.col("outcome").isin("hit", "recognized"), 1).otherwise(0))
    return result["rows"].groupBy("term").agg(hit.alias("hits"), F.count(F.lit(1)).alias("total"))


def false_forms(result: dict[str, DataFrame]) -> DataFrame:
    """``original, term, n``: false positives by what was marked and as what."""
    return result["false_positives"].groupBy("original", "term").agg(F.count(F.lit(1)).alias("n"))
