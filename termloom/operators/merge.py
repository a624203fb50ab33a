"""Three-way comparison of packs, and checks on term tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.similarity import indel_ratio, may_reach
from termloom.schemas import DUPLICATE_AT


def _side(terms: DataFrame, name: str) -> DataFrame:
    return terms.select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("term", "class", "aliases", "variants")], F.lit(True).alias(name))


def merge_lists(base: Column, up: Column, mine: Column) -> Column:
    """Both sides' additions, without what either side took away."""
    none = F.array().cast("array<string>")
    base, up, mine = (F.coalesce(c, none) for c in (base, up, mine))
    gone = F.array_union(F.array_except(base, up), F.array_except(base, mine))
    return F.array_except(F.array_union(mine, up), gone)


def presence(base: DataFrame, up: DataFrame, mine: DataFrame) -> DataFrame:
    """What becomes of each term (``key`` is its folded name): one full outer join per side.

    Outcomes: added upstream, added here, unchanged, updated upstream, kept (changed here), combined,
    removed upstream, removed here, left out.
    """
    rows = _side(base, "b").join(_side(up, "u"), "key", "full_outer").join(_side(mine, "m"), "key", "full_outer")
    b, u, m = (F.coalesce(F.col(x), F.lit(False)) for x in ("b", "u", "m"))
    same = lambda x, y: F.col(f"{x}_class").eqNullSafe(F.col(f"{y}_class")) & (F.array_sort(f"{x}_aliases") == F.array_sort(f"{y}_aliases")) & (F.array_sort(f"{x}_variants") == F.array_sort(f"{y}_variants"))
    both = F.when(same("u", "m"), "unchanged").when(b & same("b", "m"), "updated").when(b & same("b", "u"), "kept").otherwise("combined")
    outcome = (
        F.when(u & m, both)
        .when(u & b, "removed here")
        .when(u, "added upstream")
        .when(m & b, F.when(same("b", "m"), "removed upstream").otherwise("kept"))
        .when(m, "added here")
        .otherwise("left out")
    )
    pick = lambda c: F.when(F.col(f"u_{c}").eqNullSafe(F.col(f"b_{c}")), F.col(f"m_{c}")).otherwise(F.coalesce(F.when(F.col(f"m_{c}").eqNullSafe(F.col(f"b_{c}")), F.col(f"u_{c}")).otherwise(F.col(f"m_{c}")), F.col(f"u_{c}")))
    conflict = u & m & ~F.col("u_class").eqNullSafe(F.col("m_class")) & ~F.coalesce(b & (F.col("b_class").eqNullSafe(F.col("u_class")) | F.col("b_class").eqNullSafe(F.col("m_class"))), F.lit(False))
    # What neither side has any more has empty lists.
    none = F.array().cast("array<string>")
    lists = {c: F.when(u & m, merge_lists(F.col(f"b_{c}"), F.col(f"u_{c}"), F.col(f"m_{c}"))).when(u, F.coalesce(f"u_{c}", none)).otherwise(F.coalesce(f"m_{c}", none)) for c in ("aliases", "variants")}
    term = F.coalesce("m_term", "u_term", "b_term")
    return rows.select("key", term.alias("term"), F.when(u & m, pick("class")).otherwise(F.coalesce("u_class", "m_class")).alias("class"), lists["aliases"].alias("aliases"), lists["variants"].alias("variants"), outcome.alias("outcome"), conflict.alias("class_conflict"))


def duplicates(mine_new: DataFrame, their_new: DataFrame, percent: int = DUPLICATE_AT) -> DataFrame:
    """Pairs of new terms that resemble each other: joined by length band, bounded, then measured."""
    near = percent / (200 - percent)
    a = mine_new.select(F.col("key").alias("mine"), F.length("key").alias("size"))
    b = their_new.select(F.col("key").alias("theirs"), F.explode(F.sequence(F.ceil(F.length("key") * near).cast("int"), F.floor(F.length("key") / near).cast("int"))).alias("size"))
    pairs = a.join(b, "size").where(F.col("mine") != F.col("theirs")).where(may_reach(F.col("mine"), F.col("theirs"), percent))
    return pairs.withColumn("score", indel_ratio(F.col("mine"), F.col("theirs"))).where(F.col("score") >= percent).select("mine", "theirs", F.col("score").cast("int").alias("score"))


def collisions(forms: DataFrame) -> DataFrame:
    """Folded forms that more than one term owns."""
    return forms.groupBy("folded").agg(F.sort_array(F.collect_set("term")).alias("terms")).where(F.size("terms") > 1)


def outcomes(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def copy_changes(mine: DataFrame, base: DataFrame) -> DataFrame:
    """Forms (term, form) that a copy adds to or takes from its base."""
    added = mine.join(base, ["term", "form"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(base.join(mine, ["term", "form"], "left_anti").withColumn("change", F.lit("removed")))
