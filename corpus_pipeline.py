"""Corpus pipeline: toxicity, exact copies, near copies, repeated passages, packing.

Every stage takes documents with null, empty, blank or very long texts, null and repeated ids, further columns of any
name, and none at all; what it does with them stands in its docstring. All but the last return the columns they got.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import exact_dedup, near_dedup, packing, repeats, toxicity
from termloom.llm._shared import remove_folder, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go: each row is decided on its own whole text, a null text as an
    empty one, so that rows with a null id or a repeated one go or stay by themselves."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays, then the smallest id; null texts are empty
    ones, of rows that repeat an id and a text one stays, rows with a null id all stay."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the smallest id stays; rows without words link with nothing, rows that share an id stay or
    go together, rows with a null id stay."""
    return near_dedup.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of a smaller id holds are cut out of the text; a text that is cut
    to nothing stays as an empty one, an uncut one as it is, null included."""
    return repeats.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each with its place in a training sequence; a null or empty text is
    one token, the end."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Learned scores and byte-pair encoding have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet in the shared folder and read again; what a stage
    has read is removed when it is done."""
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    earlier = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier:
            remove_folder(spark, earlier)
        earlier = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
