"""Scratch tables, document chunks and the chunk-to-bucket exchange shared by the operators.

Several operators need a fact about every distinct key of the corpus (a word's count, whether a hash occurs
elsewhere). Instead of shuffling one row per occurrence, documents are grouped into *chunks* of a few MB;
each chunk asks about each of its distinct keys once, in compressed lists dealt to *buckets* by the key's
hash; a bucket answers in the order of the list. A key that half of the documents hold costs one list entry
per chunk, so no key makes a bucket large, and nothing passes through the driver.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import math
import os
import sys
import tempfile
import uuid
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of a chunk (a longer document is a chunk of its own) and of a bucket's share of the corpus.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
LEAST_BUCKETS = 16

SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master without one, a temporary folder is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one operator call in the shared folder or the warehouse; used instead of lineage that could be lost."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table in buckets of ``key``, whose large rows a join on it need not shuffle."""
        self.tables[name] = f"termloom_{name}_{uuid.uuid4().hex}"
        number = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.format("parquet").option("compression", "uncompressed").bucketBy(number, key).saveAsTable(self.tables[name])
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        """Deletes tables that no later result reads."""
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
                continue
            remove_folder(self.spark, f"{self.root}/{name}")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only (a null text is empty), so that further columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(table: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table has it (in any case)."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def release() -> None:
    """Gives freed memory back to the system, so that idle workers don't hold what a large chunk took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def one_thread() -> None:
    """Keeps numpy's products on this worker's own core: Spark's tasks are the parallelism, and products of narrow
    matrices gain nothing from threads."""
    if sys.platform != "linux":
        return
    with open("/proc/self/maps") as maps:
        found = {line.split()[-1] for line in maps if "openblas" in line and line.rstrip().endswith(".so")}
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("openblas_set_num_threads", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "scipy_openblas_set_num_threads64_"):
            if hasattr(library, name):
                getattr(library, name)(1)


def pack(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pack(sink.getvalue())


def unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(unpack(data)).read_all()


def pack_words(words: list[str]) -> bytes:
    return pack("\n".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    """Words hold no white space; an empty list and a list of one empty word are the same bytes, and no word is empty."""
    text = unpack(data).decode()
    return text.split("\n") if text else []


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted array of unsigned 64-bit values as differences, in 32 bits where they fit."""
    steps = np.diff(values, prepend=np.uint64(0))
    steps[:1] = 0
    small = not len(steps) or int(steps.max()) < 1 << 32
    first = (values[:1] if len(values) else np.zeros(1, np.uint64)).tobytes()
    return bytes([small]) + first + steps.astype(np.uint32 if small else np.uint64).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint32 if data[0] else np.uint64, offset=9).astype(np.uint64)
    if len(steps):
        steps[0] = np.frombuffer(data, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def slabs(batch: pa.RecordBatch | pa.Table, limit: int = 2 << 20) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of ``doc_id, text`` rows in lists of about ``limit`` bytes."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)) + 1
        part = batch.slice(at, stop - at)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()
        at = stop


def chunks(scratch: Scratch, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, measure: str = "text", shaped: Callable[[pa.Table], pa.Table] = lambda rows: rows) -> DataFrame:
    """Writes the rows as ``chunk_id, n_bytes, payload``: compressed Arrow tables of ``chunk_bytes`` of the
    column ``measure``, each in the form that ``shaped`` gives it.

    Written once, so that every later pass sees the same chunks whatever the order of the input's rows; in
    buckets of ``chunk_id``, so that the texts aren't shuffled when replies join them.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        release()

        def close() -> pa.RecordBatch:
            nonlocal made, held, size
            row = {"chunk_id": [task << 32 | made], "n_bytes": [size], "payload": [pack_table(shaped(pa.Table.from_batches(held)))]}
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=shape)

        for batch in batches:
            ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(measure)), 0).to_numpy(zero_copy_only=False), np.int64) + 64)
            at = 0
            while at < batch.num_rows:
                base = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + chunk_bytes - size, "right")))
                held.append(batch.slice(at, stop - at))
                size += int(ends[stop - 1]) - base
                at = stop
                if size >= chunk_bytes or at < batch.num_rows:
                    yield close()
            release()
        if held:
            yield close()

    shape = pa.schema([("chunk_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary())])
    return scratch.write_bucketed(docs.mapInArrow(build, "chunk_id long, n_bytes long, payload binary"), "chunks", "chunk_id")


def bucket_count(table: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return max(LEAST_BUCKETS, math.ceil(total / bucket_bytes))


Ask = Callable[[pa.Table, int, dict[int, bytes]], Iterable[tuple[int, bytes]]]
Answer = Callable[[list[bytes]], tuple]


def exchange(table: DataFrame, buckets: int, ask: Ask, answer: Answer) -> DataFrame:
    """``chunk_id, bucket, reply, total_a, total_b``: what each bucket answers each chunk.

    ``table`` holds chunks, with the replies of an earlier exchange or without. ``ask`` gives a chunk's lists
    by bucket; ``answer`` gets all lists of one bucket and returns as many replies and two numbers of the
    bucket, which stand in its first row (0 elsewhere).
    """
    has_replies = "replies" in table.columns

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, payload) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                earlier = replies_of(batch.column(2)[k]) if has_replies else {}
                rows = list(ask(unpack_table(payload.as_py()), buckets, earlier))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "chunk_id", "list"])
                del rows
                release()

    def answered(group: pa.Table) -> pa.Table:
        replies, (a, b), *more = answer(group.column("list").to_pylist())
        release()
        ids, bucket = group.column("chunk_id").to_pylist() + [-1] * len(more), group.column("bucket")[0].as_py()
        rest = [0] * (len(ids) - 1)
        return pa.table({"chunk_id": pa.array(ids, pa.int64()), "bucket": pa.array([bucket] * len(ids), pa.int32()), "reply": pa.array(replies + more, pa.binary()), "total_a": pa.array([a, *rest], pa.int64()), "total_b": pa.array([b, *rest], pa.int64())})

    lists = table.select("chunk_id", "payload", *["replies"] * has_replies).mapInArrow(asked, "bucket int, chunk_id long, list binary")
    return lists.groupBy("bucket").applyInArrow(answered, "chunk_id long, bucket int, reply binary, total_a long, total_b long")


def replies_of(value: pa.Scalar) -> dict[int, bytes]:
    return {r["bucket"]: r["reply"] for r in value.as_py() or []}


def with_replies(table: DataFrame, replies: DataFrame) -> DataFrame:
    """``chunk_id, payload, replies``: a chunk beside its replies (one per bucket it asked)."""
    gathered = replies.groupBy("chunk_id").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    return table.select("chunk_id", "payload").join(gathered, "chunk_id", "left")


def each_chunk(joined: DataFrame, finish: Callable[[int, pa.Table, dict[int, bytes]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies ``finish(chunk_id, rows, {bucket: reply})`` to every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, replies in zip(*(batch.column(k) for k in range(3)), strict=True):
                yield from finish(chunk.as_py(), unpack_table(payload.as_py()), replies_of(replies))
                release()

    return joined.mapInArrow(run, schema)


class WordNumbers(defaultdict):
    """Numbers words as they are first seen, the same in every pass over a chunk."""

    def __init__(self) -> None:
        super().__init__(itertools.count().__next__)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def see(self, words: list[str]) -> None:
        deque(map(self.__getitem__, words), maxlen=0)


def split_words(words: Iterable[str], buckets: int) -> list[list[str]]:
    """Distinct words by bucket (a hash of their bytes), each list in the order given."""
    lists: list[list[str]] = [[] for _ in range(buckets)]
    crc = zlib.crc32
    for word in words:
        lists[crc(word.encode()) % buckets].append(word)
    return lists


def split_hashes(values: np.ndarray, buckets: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted hashes of ``bits`` bits by range."""
    edges = np.append(np.searchsorted(values, np.array([(b << bits) // buckets for b in range(buckets)], np.uint64)), len(values))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, values[edges[b] : edges[b + 1]]


def shared_marks(lists: list[bytes]) -> tuple[list[bytes], tuple[int, int]]:
    """An ``answer`` for sorted hash lists: bits that mark the hashes that another chunk's list holds too."""
    parts = [unpack_sorted(x) for x in lists]
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    every.sort()
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = []
    for part in parts:
        at = np.searchsorted(twice, part)
        at[at == len(twice)] = 0
        marks.append(np.packbits(twice[at] == part if len(twice) else np.zeros(len(part), bool)).tobytes())
    return marks, (len(twice), 0)


def marked(values: np.ndarray, replies: dict[int, bytes], buckets: int, bits: int) -> np.ndarray:
    """Which of a chunk's sorted hashes the replies mark."""
    out = np.zeros(len(values), bool)
    at = 0
    for b, part in split_hashes(values, buckets, bits):
        out[at : at + len(part)] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=len(part)).astype(bool)
        at += len(part)
    return out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quiet_tokenizers() -> None:
    """One thread a worker: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
