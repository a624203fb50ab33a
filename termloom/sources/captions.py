"""Captions and subtitles as tables of lines, and the rolling-cue de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.signs import composed
from termloom.functions.text import clean_markup, collapse
from termloom.functions.values import caption_stamp, cue_seconds, stamp_seconds
from termloom.schemas import CUE_WINDOW_SECONDS

#: Line breaks as text editors and the reference define them.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, raw``: whole caption files; the folder's name, else the file's, is the id."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.input_file_name().alias("file"))
    return whole.select(F.element_at(F.split("file", "/"), -2).alias("doc_id"), "raw")


def parse_captions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(lines, transcripts)`` of caption texts ``doc_id, raw``.

    A line is a stamp, a space and text; blank lines and lines without a space are left out; lines that
    begin with ``#`` are the header. A transcript is the texts joined by one space, and a line's offsets
    (end exclusive) point into it; all of it is in canonical composition. The rows are dealt by ``doc_id`` once; all per-document steps reuse that.
    """
    rows = raw.select(F.col("doc_id").cast("string").alias("doc_id"), F.split(composed(F.coalesce(F.col("raw"), F.lit(""))), BREAKS).alias("rows")).repartition("doc_id")
    kept = F.filter("rows", lambda x: ~x.startswith("#"))
    header = F.filter("rows", lambda x: x.startswith("#"))
    parts = rows.select("doc_id", header.alias("header"), F.filter(F.transform(kept, _trimmed), lambda x: x.contains(" ")).alias("body"))
    texts = F.transform("body", lambda x: _trimmed(F.regexp_replace(x, r"^[^ ]* ", "")))
    transcripts = parts.select("doc_id", F.array_join(texts, " ").alias("text"), "header")
    exploded = parts.select("doc_id", F.posexplode("body").alias("line_no", "row"))
    return with_offsets(exploded.select("doc_id", "line_no", F.substring_index("row", " ", 1).alias("ts"), _trimmed(F.regexp_replace("row", r"^[^ ]* ", "")).alias("text"))), transcripts


def with_offsets(lines: DataFrame) -> DataFrame:
    """Adds ``ts_sec, start, end`` to ``doc_id, line_no, ts, text`` (joined by one space in line order)."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    placed = lines.withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))
    return placed.select("doc_id", "line_no", "ts", stamp_seconds(F.col("ts")).alias("ts_sec"), "text", "start", "end")


def transcripts_of(lines: DataFrame) -> DataFrame:
    """``doc_id, text`` back from lines."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def header_field(header: Column, name: str) -> Column:
    """The value of the first ``# name:`` line, else an empty text."""
    mark = f"# {name}:"
    found = F.try_element_at(F.filter(header, lambda x: x.startswith(mark)), F.lit(1))
    return F.coalesce(F.trim(F.substring(found, len(mark) + 1, 1 << 30)), F.lit(""))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parse_cues(raw: DataFrame) -> DataFrame:
    """``doc_id, cue_no, start, end, lines`` of SRT or WebVTT texts ``doc_id, raw`` (one path for both)."""
    blocks = F.split(F.replace(F.coalesce(F.col("raw"), F.lit("")), F.lit("\r"), F.lit("")), r"\n\s*\n")
    rows = raw.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(blocks).alias("cue_no", "block"))
    rows = rows.withColumn("rows", F.split("block", "\n")).withColumn("at", F.array_position(F.transform("rows", lambda x: x.contains("-->")), True)).where("at > 0")
    clock = F.split(F.element_at("rows", F.col("at").cast("int")), "-->")
    end = F.element_at(F.split(F.trim(F.element_at(clock, 2)), r"\s+"), 1)
    return rows.select("doc_id", "cue_no", cue_seconds(F.element_at(clock, 1)).alias("start"), cue_seconds(end).alias("end"), F.slice("rows", (F.col("at") + 1).cast("int"), F.size("rows")).alias("lines"))


def rolling_lines(cues: DataFrame, seconds: float = CUE_WINDOW_SECONDS) -> DataFrame:
    """``doc_id, line_no, ts, text``: each distinct line once per ``seconds``, stamped with its cue's end.

    A line is new if no earlier cue of the last ``seconds`` had it; repeats inside a cue stay, and a repeat
    that is left out still starts the time anew.
    """
    words = cues.select("doc_id", "cue_no", "start", "end", F.posexplode("lines").alias("row", "line"))
    words = words.withColumn("line", collapse(clean_markup(F.col("line")))).where("line <> ''")
    earlier = Window.partitionBy("doc_id", "line").orderBy("cue_no").rangeBetween(Window.unboundedPreceding, -1)
    fresh = words.withColumn("before", F.max("start").over(earlier)).where(F.col("before").isNull() | (F.col("start") - F.col("before") > seconds))
    order = Window.partitionBy("doc_id").orderBy("cue_no", "row")
    return fresh.select("doc_id", (F.row_number().over(order) - 1).alias("line_no"), caption_stamp(F.col("end")).alias("ts"), F.col("line").alias("text"))


def locate(points: DataFrame, lines: DataFrame) -> DataFrame:
    """As-of join: adds ``line_no, ts`` of the last line that starts at or before ``start`` of each point."""
    at = F.struct("start", "line_no", "ts")
    marks = lines.select("doc_id", "start", F.lit(0).alias("kind"), at.alias("line"), F.lit(None).alias("point"))
    asked = points.select("doc_id", "start", F.lit(1).alias("kind"), F.lit(None).alias("line"), F.struct(*points.columns).alias("point"))
    upto = Window.partitionBy("doc_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked, allowMissingColumns=True).withColumn("line", F.last("line", ignorenulls=True).over(upto))
    return both.where("kind = 1").select("point.*", F.col("line.line_no").alias("line_no"), F.col("line.ts").alias("ts"))


def touched_lines(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Interval join: a row for each line that a span overlaps (of one document)."""
    l = lines.select("doc_id", "line_no", "ts", "ts_sec", F.col("text").alias("line_text"), F.col("start").alias("line_start"), F.col("end").alias("line_end"))  # noqa: E741
    # Equal lengths of text are cells; a span meets the lines of the cells that it reaches.
    cell = 256
    l = l.withColumn("cell", F.explode(F.sequence(F.floor(F.col("line_start") / cell), F.floor(F.greatest("line_end", "line_start") / cell))))  # noqa: E741
    s = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))))
    first = F.col("cell") == F.greatest(F.floor(F.col("start") / cell), F.floor(F.col("line_start") / cell))
    return s.join(l, ["doc_id", "cell"]).where("line_start < end and start < line_end").where(first).drop("cell")
