"""Exact duplicates found with counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE, Scratch, free_name, id_and_text

#: Bits of the quotient that choose a slice (at least; more from so many rows a slice on), and within a slice.
SLICE_BITS, SLICE_ROWS, RUN_BITS = 10, 1 << 20, 8


class CountingQuotientFilter:
    """Fingerprints as quotient and remainder: run lengths by quotient, sorted remainders, a count for each.

    Nothing is lost: quotient and remainder together are the fingerprint, so two filters merge by merging
    the sorted remainders of each run and adding counts.
    """

    def __init__(self, bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray) -> None:
        self.bits, self.runs, self.remainders, self.counts = bits, runs, remainders, counts

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int, quotients: int) -> CountingQuotientFilter:
        """From sorted distinct values of which the low ``bits`` are the remainder."""
        runs = np.bincount((values >> np.uint64(bits)).astype(np.int64), minlength=quotients)
        return cls(bits, runs.astype(np.uint32), values & np.uint64((1 << bits) - 1), counts.astype(np.int64))

    def values(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs) << np.uint64(self.bits) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """The sum of filters of one shape; runs are sorted, so a stable merge sort joins them in one sweep."""
        every = np.concatenate([f.values() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return cls.of(every[first], np.add.reduceat(counts, first) if len(first) else counts, filters[0].bits, len(filters[0].runs))

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return self.runs.tobytes(), self.remainders.tobytes(), self.counts.tobytes()

    @classmethod
    def load(cls, bits: int, runs: bytes, remainders: bytes, counts: bytes) -> CountingQuotientFilter:
        return cls(bits, np.frombuffer(runs, np.uint32), np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64))


def repeated_fingerprints(prints: DataFrame, slice_bits: int = SLICE_BITS, run_bits: int = RUN_BITS) -> DataFrame:
    """``fp, copies``: the values of the long column ``fp`` that occur more than once.

    Each task builds a filter of its rows; slices of it by the top bits of the quotient meet the same
    slices of other tasks and are merged. A fingerprint that a third of the rows share is one entry with a
    count in each task's filter.
    """
    rest = 64 - slice_bits
    bits = rest - run_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_counts=True) for b in batches if b.num_rows]
        if not parts:
            return
        values, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(values), np.int64)
        np.add.at(counts, where, np.concatenate([p[1] for p in parts]))
        top = (values >> np.uint64(rest)).astype(np.int64)
        rows = []
        for s in np.unique(top).tolist():
            own = slice(*np.searchsorted(top, [s, s + 1]))
            rows.append((s, *CountingQuotientFilter.of(values[own] & np.uint64((1 << rest) - 1), counts[own], bits, 1 << run_bits).dump()))
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 256], strict=True)], ["slice", "runs", "remainders", "counts"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        columns = (group.column(c).to_pylist() for c in ("runs", "remainders", "counts"))
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.load(bits, *x) for x in zip(*columns, strict=True)])
        often = whole.counts > 1
        values = whole.values()[often] | np.uint64(key[0].as_py() << rest)
        return pa.table({"fp": values.view(np.int64), "copies": whole.counts[often]})

    slices = prints.select("fp").mapInArrow(build, "slice long, runs binary, remainders binary, counts binary")
    return slices.groupBy("slice").applyInArrow(merge, "fp long, copies long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per row of ``docs``.

    Texts are equal when they are identical without the white space ``[\\x20\\x09-\\x0D]``. Of equal texts
    the row whose original text has the most code points stays, then the smallest id (a null id comes last).
    Rows that agree in id and text too are one document given twice: each has its row, with the same answer.
    Null texts are empty texts, further columns are left out, an empty table gives no rows.

    Only texts whose fingerprint the merged filters count more than once are compared byte by byte (they
    are grouped by the text itself, after partial aggregation in each task).
    """
    bare = F.translate("text", SPACE, "")
    slice_bits = max(SLICE_BITS, (docs.count() // SLICE_ROWS).bit_length())
    rows = id_and_text(docs).select("doc_id", bare.alias("bare"), F.length("text").alias("points")).withColumn("fp", F.xxhash64("bare"))
    often = repeated_fingerprints(rows, slice_bits).select("fp")
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("order"))).alias("best")
    groups = (
        rows.join(often, "fp")
        .groupBy("bare")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("bare", 256).alias("text_sha256"), (-F.col("best.order")).alias("keep"), F.col("group_size"), F.lit(True).alias("grouped"))
    )
    digests = rows.select("doc_id", F.sha2("bare", 256).alias("text_sha256"))
    keep = F.when(F.col("grouped"), F.col("keep")).otherwise(F.col("doc_id"))
    return digests.join(groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts; a row with a null id always stays.

    Rows that repeat an id and a text count as one. What goes is a small part of the rows: they are named by
    id and digest, so that rows that share an id but not their text are told apart. Null texts are empty texts,
    texts of any length are compared whole, an empty table stays empty; further columns stay, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exactdedup")
    groups = scratch.write(exact_groups(docs), "groups").where("doc_id is not null")
    own_id, own_text = free_name(docs, "other_id"), free_name(docs, "other_text")
    digest = F.sha2(F.translate(F.coalesce(docs["text"], F.lit("")), SPACE, ""), 256)
    same = (docs["doc_id"] == F.col(own_id)) & (digest == F.col(own_text))
    named = lambda rows: rows.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_text))
    left = docs.join(named(groups.where("not kept")), same, "left_anti")
    twice = scratch.write(named(groups.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1")), "twice")
    if twice.isEmpty():
        return left
    mark = free_name(docs, "digest")
    again = left.join(twice, same, "left_semi").withColumn(mark, digest).dropDuplicates(["doc_id", mark]).drop(mark)
    return left.join(twice, same, "left_anti").unionByName(again)
