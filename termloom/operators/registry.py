"""Versioned packs, run catalogues and caption tracks: ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.values import iso_date, too_old_for, version_numbers


def newest(index: DataFrame, engine: str) -> DataFrame:
    """Per pack name the newest version that this engine can read, and the newest that it can't (``held``).

    ``index`` has ``position, name, version, min_engine``; of equal versions the later entry counts.
    """
    ranked = index.withColumn("order", version_numbers(F.col("version"))).withColumn("held", too_old_for(F.lit(engine), F.col("min_engine")))
    best = Window.partitionBy("name", "held").orderBy(F.desc("order"), F.desc("position"))
    return ranked.withColumn("k", F.row_number().over(best)).where("k = 1").groupBy("name").agg(F.max(F.when(~F.col("held"), F.col("version"))).alias("usable"), F.max(F.when(F.col("held"), F.col("version"))).alias("held"))


def updates(installed: DataFrame, index: DataFrame, engine: str) -> DataFrame:
    """Installed packs beside the index: ``state`` is new, update, current, edited or unknown.

    ``installed`` has ``name, version, sha256, recorded_sha256``; a file that differs from its record was edited here.
    """
    rows = installed.withColumnRenamed("version", "own").join(newest(index, engine), "name", "full_outer")
    edited = F.col("sha256") != F.col("recorded_sha256")
    later = version_numbers(F.col("usable")) > version_numbers(F.col("own"))
    state = F.when(F.col("own").isNull(), "new").when(F.col("usable").isNull(), "unknown").when(later & F.coalesce(edited, F.lit(False)), "edited").when(later, "update").otherwise("current")
    return rows.select("name", "own", "usable", "held", state.alias("state"))


#: Names that a registry accepts.
PACK_NAME = r"^[a-z0-9]+(-[a-z0-9]+)*$"
INDEX = "packs array<struct<name:string,version:string,language:string,description:string,path:string,sha256:string,min_engine:string>>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``position, name, version, language, description, path, sha256, min_engine`` of index files; a file without packs
    or with a name that no pack can have is an error."""
    files = spark.read.schema(INDEX).json(path, multiLine=True, mode="PERMISSIVE")
    if not files.where("packs is null").isEmpty():
        raise ValueError(f"{path} is not a packs index")
    rows = files.select(F.posexplode("packs").alias("position", "p")).select("position", "p.*")
    strange = rows.where(~F.coalesce(F.col("name").rlike(PACK_NAME), F.lit(False))).limit(1).collect()
    if strange:
        raise ValueError(f"{path}: not a pack name: {strange[0]['name']}")
    return rows


def nearest_base(asked: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``base`` to ``name, have``: the newest version of the name in ``history`` that isn't newer than ``have``.

    An as-of join: both tables in one order of versions, the last one of the history carried on.
    """
    marks = history.select("name", version_numbers(F.col("version")).alias("v"), F.lit(0).alias("kind"), F.col("version").alias("mark"), F.lit(None).alias("row")).distinct()
    points = asked.select("name", version_numbers(F.col("have")).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("mark"), F.struct(*asked.columns).alias("row"))
    upto = Window.partitionBy("name").orderBy("v", "kind", "mark").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(points).withColumn("base", F.last("mark", ignorenulls=True).over(upto))
    return both.where("kind = 1").select("row.*", F.when(F.col("v").isNotNull(), F.col("base")).alias("base"))


def offers(copies: DataFrame, index: DataFrame, included: DataFrame, history: DataFrame, engine: str) -> DataFrame:
    """``name, upstream, origin, based, own, edits, base, three_way, line``: copies whose upstream is newer than what they
    are based on.

    ``copies`` has ``name, version, based_on, local_edits``; without a record of its base, a copy is one only of a pack
    that is ``included`` (``name, version``). Upstream is the newer of the included pack and the newest of the index
    that this engine can read; of equal ones the included. ``base`` is the nearest version that ``history`` keeps, and a
    merge is three-way if it is the very one.
    """
    usable = newest(index, engine).where("usable is not null").select("name", F.col("usable").alias("upstream"), F.lit("repository").alias("origin"))
    both = included.select("name", F.col("version").alias("upstream"), F.lit("included").alias("origin")).unionByName(usable)
    best = F.max_by(F.struct("upstream", "origin"), F.struct(F.coalesce(version_numbers(F.col("upstream")), F.array().cast("array<int>")), F.col("origin") == "included"))
    best = both.groupBy("name").agg(best.alias("best"), F.max(F.col("origin") == "included").alias("here"))
    based = F.nullif(F.regexp_extract("based_on", "^.+@(.+)$", 1), F.lit(""))
    rows = copies.select("name", F.col("version").alias("own"), based.alias("based"), F.coalesce("local_edits", F.lit(0)).alias("edits")).join(best, "name")
    rows = rows.where(F.col("based").isNotNull() | F.col("here")).withColumn("have", F.coalesce("based", "own"))
    rows = rows.where(version_numbers(F.col("best.upstream")) > version_numbers(F.col("have")))
    rows = nearest_base(rows.select("name", "own", "based", "edits", "have", "best"), history)
    count = F.concat(F.col("edits").cast("string"), F.when(F.col("edits") == 1, " local edit").otherwise(" local edits"))
    known = F.concat(F.lit("your copy is based on "), "based", F.lit(" with "), count, F.lit("."))
    bare = F.concat(F.lit("your copy ("), "own", F.lit(") has no record of its base, so it merges two-way."))
    line = F.concat("name", F.lit(" "), "best.upstream", F.lit(" is available; "), F.when(F.col("based").isNull(), bare).otherwise(known))
    return rows.select("name", F.col("best.upstream").alias("upstream"), F.col("best.origin").alias("origin"), "based", "own", "edits", "base", F.coalesce(F.col("base") == F.col("based"), F.lit(False)).alias("three_way"), line.alias("line"))


def run_catalog(sources: DataFrame) -> DataFrame:
    """Runs from ``run_id, source, date, title``: metadata before header before annotations, oldest first, undated last."""
    rank = F.when(F.col("source") == "meta", 0).when(F.col("source") == "header", 1).otherwise(2)
    best = Window.partitionBy("run_id").orderBy(rank)
    rows = sources.withColumn("k", F.row_number().over(best)).where("k = 1").select("run_id", "source", iso_date(F.col("date")).alias("date"), "title")
    # Places count up over days and the beginnings of names; only those totals, a bounded number, meet in one task.
    rows = rows.withColumn("day", F.coalesce(F.nullif("date", F.lit("")), F.lit("9999"))).withColumn("part", F.substring("run_id", 1, 2))
    before = Window.orderBy("day", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("day", "part").agg(F.count(F.lit(1)).alias("n")).select("day", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("day", "part").orderBy("run_id")
    placed = rows.withColumn("k", F.row_number().over(within)).join(totals, ["day", "part"])
    return placed.select("run_id", "source", "date", "title", (F.col("earlier") + F.col("k")).cast("int").alias("place"))


def base_code(code: Column) -> Column:
    return F.lower(F.element_at(F.split(code, "[-_]"), 1))


def track_order(tracks: DataFrame, original: Column) -> DataFrame:
    """Tracks of a video in listing order: the original language, English, others; manual before automatic.

    ``tracks`` has ``video_id, code, source, translated``.
    """
    own = F.when(base_code(F.col("code")) == base_code(original), 0).when(base_code(F.col("code")) == "en", 1).otherwise(2)
    kind = F.when(F.col("source") == "manual", 0).otherwise(1)
    order = Window.partitionBy("video_id").orderBy(own, kind, "code")
    return tracks.where("not translated").withColumn("place", F.row_number().over(order))


def track_choice(tracks: DataFrame, wanted: Column, original: Column) -> DataFrame:
    """The track for a wanted language: manual, automatic of the original, automatic of a dub, translated;
    the exact code before a regional variant."""
    close = F.when(F.lower("code") == F.lower(wanted), 0).when(base_code(F.col("code")) == base_code(wanted), 1)
    kind = F.when(F.col("source") == "manual", 0).when(F.col("translated"), 3).when(base_code(F.col("code")) == base_code(original), 1).otherwise(2)
    order = Window.partitionBy("video_id").orderBy(kind, "close", "code")
    rows = tracks.withColumn("close", close).where("close is not null").withColumn("k", F.row_number().over(order)).where("k = 1")
    return rows.select("video_id", "code", "source", "translated")
