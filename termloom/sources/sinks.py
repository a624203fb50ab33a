"""Outputs: tables as files (written by executors) and small files of one run or pack (written whole or not at all)."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.render import annotation_json, corrections_table
from termloom.sources.packs import Learned, _yaml

MOST_IN_LINK = 8000


def write_annotations(annotations: DataFrame, path: str) -> None:
    """One JSON text per document, dealt by document."""
    annotation_json(annotations).write.mode("overwrite").parquet(path)


def _write_lines(lines: DataFrame, between: str, path: str) -> None:
    """Plain text, one folder per document: stamp, what stands between, text, in order of ``line_no``."""
    rows = lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no")
    rows.select("doc_id", F.concat("ts", F.lit(between), "text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_rendered(rendered: DataFrame, path: str) -> None:
    """Corrected captions (``doc_id, line_no, ts, text``), two spaces after the stamp."""
    _write_lines(rendered, "  ", path)


def write_captions(lines: DataFrame, path: str) -> None:
    """Captions (``doc_id, line_no, ts, text``), as subtitles become them, in the form that ``parse_captions`` reads."""
    _write_lines(lines, " ", path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Reports or pending forms (``doc_id, text``), one folder per document."""
    texts.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_corrections(annotations: DataFrame, lines: DataFrame, terms: DataFrame, path: str) -> None:
    """The draft of gold rows as CSV with a header."""
    corrections_table(annotations, lines, terms).drop("start").write.mode("overwrite").option("header", True).csv(path)


def replace_file(path: str | Path, text: str) -> None:
    """The whole file or the old one: written beside it, then moved over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(path.name + ".new")
    new.write_text(text, encoding="utf-8")
    os.replace(new, path)


def learned_content(layer: Learned) -> dict:
    """A learned layer in the form of its file."""
    out: dict = {"version": 1, "confirmed": {}, "aliases": {}, "rejected": []}
    for term, variant, date, context in layer.confirmed:
        out["confirmed"].setdefault(term, []).append({"variant": variant, "date": date, **({"context": list(context)} if context else {})})
    for term, alias, date in layer.aliases:
        out["aliases"].setdefault(term, []).append({"alias": alias, "date": date})
    out["rejected"] = [{"text": x, "term": t, "date": d} for x, t, d in layer.rejected]
    return out


def write_learned(layer: Learned, path: str | Path) -> None:
    replace_file(path, _yaml().safe_dump(learned_content(layer), allow_unicode=True, sort_keys=False))


def write_pack(data: dict, path: str | Path) -> None:
    replace_file(path, _yaml().safe_dump(data, allow_unicode=True, sort_keys=False))


def write_meta(path: str | Path, title: str, channel: str, url: str, published: str, fetched_at: str, **more: object) -> None:
    """Facts of one run: five fields, then any others."""
    replace_file(path, _yaml().safe_dump({"title": title, "channel": channel, "url": url, "published": published, "fetched_at": fetched_at, **more}, allow_unicode=True, sort_keys=False))


def issue_link(base: str, title: str, body: str) -> str:
    """An address that opens a new issue with the body, or without it where the address would be too long."""
    from urllib.parse import urlencode

    link = f"{base}?{urlencode({'title': title, 'body': body})}"
    return link if len(link) <= MOST_IN_LINK else f"{base}?{urlencode({'title': title})}"
