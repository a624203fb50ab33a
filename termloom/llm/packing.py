"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytebpe import PieceIds, Pretokenizer, character_classes, special_tokens
from ._shared import Scratch, id_and_text, release, slabs, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def plan_slots(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit over counts: longest first, each length into the fullest open sequences that still hold it.

    Open sequences with the same content are one group with a number, so the work follows the number of
    lengths, not of documents. Returns ``(length, first rank, end rank, first sequence, offset)`` rows and
    the number of sequences: the documents of that length with those ranks take that place in successive
    sequences.
    """
    open_groups: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        room = length
        while left:
            while room <= size and not open_groups[room]:
                room += 1
            space = min(room, size)
            number, content = open_groups[room].pop() if room <= size else (left, ())
            each = space // length
            filled = min(number, left // each)
            if filled:
                open_groups[space - each * length].append((filled, content + (length,) * each))
                left -= filled * each
                number -= filled
            if left and number:  # fewer than one sequence takes
                open_groups[space - left * length].append((1, content + (length,) * left))
                number, left = number - 1, 0
            if number and content:
                open_groups[space].append((number, content))
            room = length
    rows, taken, first = [], Counter(), 0
    for groups in open_groups:
        for number, content in groups:
            offset = 0
            for length in content:
                rows.append((length, taken[length], taken[length] + number, first, offset))
                taken[length] += number
                offset += length
            first += number
    return rows, first


def token_pieces(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``size`` tokens with the rank of each among its task's pieces of that length."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    classes, special = character_classes(path), special_tokens(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        split, library, task = Pretokenizer(classes, tuple(special)), PieceIds(path), TaskContext.get().partitionId()
        places: Counter = Counter()
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for ids, texts in slabs(batch, 1 << 20):
                pieces, counts = split.pieces(texts)
                known = library.learn(pieces)
                rows, at = [], 0
                for doc, n in zip(ids, counts.tolist(), strict=True):
                    data = b"".join(map(known.__getitem__, pieces[at : at + n])) + last
                    at += n
                    total = len(data) // 4
                    start, length = 0, (total - 1) % size + 1
                    for k in range(-(-total // size)):
                        rows.append((doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), task, places[length]))
                        places[length] += 1
                        start, length = start + length, size
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
                del pieces, known, rows
            release()

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    The driver sees one count per length (at most ``size``) and plans slots from them; a piece finds its
    slot by its rank within its length, which is its rank in its task plus the counts of earlier tasks, so
    that no length, however common, is sorted in one place. Null texts count as empty and take one token
    (the end id), repeated rows and null ids are packed like any other, further columns are left out, an
    empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(token_pieces(docs, size, tokenizer, end_id), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = plan_slots(counts, size)
    slots = spark.createDataFrame(plan, "length long, low long, high long, first long, offset long")
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    # The plan's size follows the number of lengths, at most ``size``: it is small at any corpus size.
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= low and rank < high")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
