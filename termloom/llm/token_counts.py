"""Token counts by finite-state machines compiled from a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._bytebpe import MergeTransducer, Pretokenizer, Remembered, character_classes, special_tokens
from ._shared import id_and_text, slabs, tokenizer_path


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, as the vocabulary's library counts.

    A compiled transducer splits the texts of a task into pieces (chunks in lock step, their state maps
    composed by a prefix scan); a second one, whose states are made when first reached, counts each distinct
    piece's tokens. A narrow operation: no shuffle. Null texts count as empty (0 tokens), repeated rows and
    null ids each give their row, further columns are left out, an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    classes, special = character_classes(path), tuple(special_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, machine = Pretokenizer(classes, special), MergeTransducer(path)
        remembered = Remembered(f"counts {path}")
        count = lambda pieces: [1 if p in special else machine.tokens(p.encode()) for p in pieces]
        for batch in batches:
            for ids, texts in slabs(batch, 3 << 20):
                pieces, counts = split.pieces(texts)
                known = remembered.holding(pieces, count)
                sums = np.concatenate([[0], np.cumsum(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))])
                ends = np.cumsum(counts)
                tokens = sums[ends] - sums[ends - counts]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
