"""Stamps, dates, links and versions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a video's id stands in its address.
VIDEO_PATTERNS = (r"[?&]v=([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", r"youtu\.be/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", r"youtube\.com/(?:shorts|live|embed)/([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])")


def stamp_seconds(stamp: Column) -> Column:
    """``m:ss`` or ``h:mm:ss`` in seconds, null for anything else."""
    parts = F.transform(F.split(stamp, ":"), lambda p: p.try_cast("int"))
    return F.when(stamp.rlike(r"^\d+(:\d+){1,2}$"), F.aggregate(parts, F.lit(0), lambda acc, p: acc * 60 + p))


def stamp_seconds_lenient(stamp: Column) -> Column:
    """As :func:`stamp_seconds` with any number of parts, where a part that is no number counts as 0."""
    parts = F.transform(F.split(stamp, ":"), lambda p: F.when(p.rlike(r"^\d+$"), p.try_cast("int")).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc * 60 + p)


def caption_stamp(seconds: Column) -> Column:
    """Minutes (not wrapped into hours) and two digits of seconds."""
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", (whole / 60).cast("int"), whole % 60)


def cue_seconds(clock: Column) -> Column:
    """``[h:]m:s[.,]ms`` in seconds."""
    parts = F.split(F.replace(F.trim(clock), F.lit(","), F.lit(".")), ":")
    return F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p.try_cast("double"))


def iso_date(day: Column) -> Column:
    """``yyyymmdd`` with dashes; anything else stays."""
    dashed = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return F.when(day.rlike(r"^\d{8}$"), dashed).otherwise(day)


def video_id(url: Column) -> Column:
    """The first id that one of the address forms holds, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_PATTERNS])


def watch_link(url: Column, stamp: Column) -> Column:
    """A link to the moment for known videos, else address and stamp, else nothing."""
    found, blank = video_id(url), F.coalesce(url, F.lit("")) == ""
    short = F.concat(F.lit("https://youtu.be/"), found, F.lit("?t="), stamp_seconds_lenient(stamp).cast("string"))
    return F.when(blank, "").when(found.isNotNull(), short).otherwise(F.concat_ws(" at ", url, stamp))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unknown").otherwise(F.format_string("%dmin%02ds", (seconds / 60).cast("int"), seconds % 60))


def version_numbers(version: Column, width: int = 4) -> Column:
    """The leading dotted numbers, padded with zeros, as an array that orders as versions do."""
    head = F.regexp_extract(F.coalesce(version, F.lit("")), r"^\s*v?(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.filter(F.split(head, r"\."), lambda p: p != ""), lambda p: p.try_cast("int"))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), width)), 1, width)


def too_old_for(own: Column, required: Column) -> Column:
    """Whether a pack needs a later engine: an unreadable requirement does, an unknown own version does not."""
    wanted = F.coalesce(F.trim(required), F.lit(""))
    readable = wanted.rlike(r"^v?\d+(\.\d+)*")
    return F.when(wanted == "", False).when(~readable, True).when(F.coalesce(own, F.lit("")) == "", False).otherwise(version_numbers(own) < version_numbers(wanted))


def bump(version: Column) -> Column:
    """One more patch release of ``d.d.d``, else 0.1.0."""
    patch = F.regexp_extract(version, r"^(\d+)\.(\d+)\.(\d+)$", 3).try_cast("int") + 1
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), F.concat(F.regexp_extract(version, r"^(\d+\.\d+\.)", 1), patch.cast("string"))).otherwise("0.1.0")


def bump_text(version: str | None) -> str:
    found = re.fullmatch(r"(\d+\.\d+\.)(\d+)", version or "")
    return f"{found[1]}{int(found[2]) + 1}" if found else "0.1.0"


# Names of languages by base code.
LANGUAGE_NAMES = {
    "pt": "Portuguese", "en": "English", "es": "Spanish", "fr": "French", "de": "German",
    "it": "Italian", "ja": "Japanese", "ko": "Korean", "zh": "Chinese",
}


def language_name(code: Column) -> Column:
    """A language by its name, a regional one with its code beside it, an unknown one as its code."""
    base = F.substring_index(code, "-", 1)
    name = F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair]), base)
    return F.when(name.isNull(), code).when(base == code, name).otherwise(F.concat(name, F.lit(" ("), code, F.lit(")")))


def run_id(path: Column, url: Column, root: str = "runs") -> Column:
    """The run that a caption belongs to: the folder under ``root`` that it lies in, else the video of its address, else
    the file's name without its ending."""
    inside = F.regexp_extract(path, rf"(?:^|/){root}/([^/]+)/", 1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(inside, F.lit("")), F.nullif(video_id(url), F.lit("")), stem)
