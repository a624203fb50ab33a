"""The learned layer as tables, its transitions, and what a contribution holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.text import collapse


def _same(c: str):
    return collapse(F.lower(F.col(c)))


def _keep_first(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the earliest date, then the smallest text."""
    first = F.min(F.struct("date", "text")).alias("first")
    return rows.withColumn("key", _same("text")).groupBy(*keys, "key").agg(first).select(*keys, F.col("first.text").alias("text"), F.col("first.date").alias("date"))


def transition(confirmed: DataFrame, aliases: DataFrame, rejected: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The layer after ``decisions`` (term, text, date, decision in confirm/alias/reject).

    All tables are ``term, text, date``. Confirming a form takes the alias of the same text away and vice
    versa; what is there already stays as it was; a rejection is added once.
    """
    pick = lambda d: decisions.where(F.col("decision") == d).select("term", "text", "date")
    drop = lambda rows, gone: rows.withColumn("key", _same("text")).join(gone.withColumn("key", _same("text")).select("term", "key").distinct(), ["term", "key"], "left_anti").select("term", "text", "date")
    new_confirmed, new_aliases = pick("confirm"), pick("alias")
    return (
        _keep_first(drop(confirmed, new_aliases).unionByName(new_confirmed), ["term"]),
        _keep_first(drop(aliases, new_confirmed).unionByName(new_aliases), ["term"]),
        _keep_first(rejected.unionByName(pick("reject")), ["term"]),
    )


def new_forms(layer: DataFrame, forms: DataFrame) -> DataFrame:
    """Learned forms that the pack does not have under their term (compared folded): what a contribution offers."""
    known = forms.select("term", F.col("folded").alias("key")).distinct()
    return layer.withColumn("key", F.col("folded")).join(known, ["term", "key"], "left_anti").drop("key")


def add_local(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Run-local decisions with new ones added, none twice."""
    return existing.unionByName(new).distinct()
