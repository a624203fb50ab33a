"""Run folders: what each holds, as rows for the catalogue; folders of gold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.values import iso_date
from termloom.sources.captions import BREAKS, header_field

#: File names of a run and of a folder of gold rows (fixed values).
META, CAPTION, ANNOTATIONS, GOLD = "meta.yaml", "legenda.txt", "annotations.json", "gold.csv"


def _files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """``run_id, file, content`` of the named files in folders directly under ``root``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    parts, home = F.split(F.col("path"), "/"), root.rstrip("/").rsplit("/", 1)[-1]
    direct = F.element_at(parts, -3) == home
    return found.where((F.size(parts) >= 3) & direct).select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("file"), "content")


def yaml_scalar(text: Column, key: str) -> Column:
    """The value of a top-level ``key`` of simple YAML, unquoted, lines that go on joined by one space; empty without."""
    lines = F.regexp_extract(F.concat(F.lit("\n"), text), rf"\n{key}:[ \t]*((?:[^\n]*)(?:\n[ \t]+[^\n]+)*)", 1)
    flat = F.trim(F.regexp_replace(lines, r"\s*\n\s*", " "))
    single = F.replace(F.substring(flat, F.lit(2), F.length(flat) - 2), F.lit("''"), F.lit("'"))
    double = F.replace(F.replace(F.substring(flat, F.lit(2), F.length(flat) - 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    value = F.when(flat.rlike("^'.*'$"), single).when(flat.rlike('^".*"$'), double).otherwise(flat)
    return F.when(flat.isin("null", "~"), "").otherwise(value)


def run_sources(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, source, date, title`` for each of the files that a run may have (see ``registry.run_catalog``, which takes
    the best): its metadata, the header of its captions, or bare annotations. Folders with none of them are no runs."""
    files = _files(spark, root, META, CAPTION, ANNOTATIONS)
    text = F.decode(F.col("content"), "UTF-8")
    meta = files.where(F.col("file") == META).select("run_id", text.alias("t"))
    published, fetched = iso_date(yaml_scalar(F.col("t"), "published")), F.substring(yaml_scalar(F.col("t"), "fetched_at"), 1, 10)
    meta = meta.select("run_id", F.lit("meta").alias("source"), F.coalesce(F.nullif(published, F.lit("")), fetched).alias("date"), yaml_scalar(F.col("t"), "title").alias("title"))
    head = files.where(F.col("file") == CAPTION).select("run_id", F.filter(F.split(text, BREAKS), lambda x: x.startswith("#")).alias("h"))
    when = [F.nullif(iso_date(header_field(F.col("h"), name)), F.lit("")) for name in ("Publicado", "Baixado em")]
    head = head.select("run_id", F.lit("header").alias("source"), F.coalesce(*when, F.lit("")).alias("date"), header_field(F.col("h"), "Titulo").alias("title"))
    bare = files.where(F.col("file") == ANNOTATIONS).select("run_id", F.lit("annotations").alias("source"), F.lit("").alias("date"), F.lit("").alias("title"))
    return meta.unionByName(head).unionByName(bare)


def gold_folders(spark: SparkSession, root: str) -> DataFrame:
    """``run_id`` of the folders directly under ``root`` that hold a file of gold rows (an empty one is none), in order."""
    return _files(spark, root, GOLD).select("run_id").distinct().orderBy("run_id")
