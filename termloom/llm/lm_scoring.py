"""Language-model scores of documents: causal self-attention over subword ids, and a unigram base."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._attention import AttentionModel, Symbols, blocks
from ._bytebpe import Library, forget
from ._shared import CHUNK_BYTES, Scratch, bucket_count, chunks, each_chunk, exchange, id_and_text, one_thread, pack, pack_words, release, remainder, replies_of, tokenizer_path, unpack, unpack_table, with_replies
from .word_bpe import IdTable, decode_ids

#: Chunks are larger than elsewhere: a chunk asks for each of its words once.
SCORE_CHUNK_BYTES = 3 * CHUNK_BYTES
#: Words of rows that are worked on at once.
SLAB_WORDS = 150_000
#: Words before a word from which the next set of mixture weights holds.
AGES = np.array([1, 8, 32, 128, 512])
#: What a mixture weighs before it is fitted: spelling, share within the first id, share, share of the text so far.
FIRST_WEIGHTS = np.array([0.35, 0.3, 0.1, 0.25])
#: Tokens that the first weights count for when weights are fitted.
PRIOR_TOKENS = 200.0
NOTHING = -1e30


def numbered(rows: pa.Table) -> pa.Table:
    """A chunk of ``doc_id, text`` as one row: ids, words a row, the words' numbers, and the distinct words with checksums.

    Words stand between ASCII white space; A-Z are put in lower case and no other letters."""
    forget()
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(rows.column("text")))
    split = pc.ascii_split_whitespace(texts)
    # A text without words is split into one empty word.
    sizes = np.where(pc.binary_length(texts).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0)
    flat = pc.list_flatten(split)
    found = flat.filter(pc.not_equal(flat, "")).combine_chunks().dictionary_encode()
    words = in_one(found.dictionary, "\n")
    checks = np.fromiter(map(zlib.crc32, words.split(b"\n") if words else ()), np.uint32, len(found.dictionary))
    lists = {"ids": rows.column("doc_id").to_pylist(), "sizes": sizes, "numbers": found.indices, "checks": checks}
    kinds = {"ids": pa.int64(), "sizes": pa.int32(), "numbers": pa.int32(), "checks": pa.uint32()}
    columns = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kinds[k])) for k, v in lists.items()}
    return pa.table(columns | {"words": pa.array([words], pa.binary())})


def in_one(words: pa.StringArray, between: str) -> bytes:
    """All words in one text; Arrow joins them faster than their Python strings are made."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), between)[0].as_py().encode()


class Numbered:
    """A chunk that :func:`numbered` made, its distinct words dealt to buckets."""

    def __init__(self, table: pa.Table, buckets: int) -> None:
        column = lambda name: table.column(name).chunk(0).flatten()
        self.ids = column("ids").to_pylist()
        self.sizes, self.numbers = (column(c).to_numpy(zero_copy_only=False) for c in ("sizes", "numbers"))
        bucket = column("checks").to_numpy(zero_copy_only=False) % np.uint32(buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.edges = np.searchsorted(bucket[self.order], np.arange(buckets + 1))
        self.words = table.column("words")[0]

    def lists(self) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """Buckets with their words and those words' numbers."""
        text = self.words.as_py().decode()
        words = np.array(text.split("\n") if text else [], object)
        for b, (low, high) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            if low < high:
                own = self.order[low:high]
                yield b, words[own].tolist(), own

    def asked(self) -> Iterator[tuple[int, int, int]]:
        """Buckets with the range of their words in the order of all replies."""
        for b, (low, high) in enumerate(zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)):
            if low < high:
                yield b, low, high


class Lookup:
    """A chunk with what its words' buckets answered: subword ids, training counts, and each row's words."""

    def __init__(self, table: pa.Table, got: dict[int, bytes], buckets: int, ends: int) -> None:
        chunk = Numbered(table, buckets)
        flats, lengths, counts = [], [], []
        for b, low, high in chunk.asked():
            n = int.from_bytes(got[b][:8], "little")
            flat, last = decode_ids(got[b][8 : 8 + n], high - low)
            flats.append(flat)
            lengths.append(np.diff(last, prepend=0))
            counts.append(np.frombuffer(unpack(got[b][8 + n :]), np.uint64))
        self.ids, self.sizes = chunk.ids, chunk.sizes.astype(np.int64)
        place = np.empty(len(chunk.order), np.int32)
        place[chunk.order] = np.arange(len(place), dtype=np.int32)
        self.words = place[chunk.numbers]
        #: The last word is the end of a text; it has one id of its own.
        self.flat = np.concatenate([*flats, np.zeros(0, np.uint16)])
        self.length = np.concatenate([*lengths, [1]]).astype(np.int64)
        self.count = np.concatenate([*counts, [ends]]).astype(np.float64)
        self.stop = np.cumsum(self.length)

    def symbols(self, symbols: Symbols) -> np.ndarray:
        return np.append(symbols.of[self.flat], np.int32(symbols.end))

    def within(self, symbols: Symbols) -> np.ndarray:
        return np.append(symbols.within[self.flat], 0.0)

    def slabs(self, wanted: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Wanted rows in lists of about ``SLAB_WORDS`` words: ids, each row's number of words, and the words, both with the ends."""
        starts = np.cumsum(self.sizes) - self.sizes
        rows = np.flatnonzero(wanted)
        share = np.cumsum(self.sizes[rows] + 1) // SLAB_WORDS
        for own in np.split(rows, np.flatnonzero(np.diff(share)) + 1):
            if len(own):
                end = np.array([len(self.length) - 1], np.int64)
                which = [x for r in own.tolist() for x in (self.words[starts[r] : starts[r] + self.sizes[r]], end)]
                yield [self.ids[r] for r in own.tolist()], self.sizes[own] + 1, np.concatenate(which).astype(np.int64)

    def sequence(self, which: np.ndarray, per_row: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of the words, symbols a row, and where each word's ids stand in ``flat``."""
        lengths = self.length[which]
        spot = np.repeat(self.stop[which] - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum()))
        return kind[spot], np.add.reduceat(lengths, np.cumsum(per_row) - per_row), spot


def score_documents(
    docs: DataFrame, tokenizer: str | None = None, modulus: int = 7, held_out: int = 2, kinds: int = 1024, updates: int = 500, chunk_bytes: int = SCORE_CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per row.

    Rows whose id's crc32 modulo ``modulus`` is not ``held_out`` are learned from; all are scored, whole.
    Tokens are the lower-cased words and one end. ``base_score`` is the add-one unigram model of the
    training tokens. ``score`` is the model's log10 probability of the words and the end. The chance of a
    word, after what stands before it in the text, is a mixture of four that each sum to at most one over
    all words: its spelling (the attention model's chance of its subword ids, given that a word begins, and
    that a word ends after them); the model's chance of its first id times its share of the training words
    that begin with that id; its share of the training tokens; its share of the text so far. All is kept
    in logarithms, so that no text is impossible.

    1. Texts are split once, into numbers of the chunk's distinct words. Chunks send those with training
       counts to buckets, which return each word's count in the corpus and its subword ids (each distinct
       word is encoded once), and the counts of subword ids.
    2. The model starts with ``updates`` updates on one chunk, so that chunks' models can be averaged. From there
       each chunk goes once through all its training texts, whole, and all of the model learns. The mean of
       all chunks' models is the model. Each chunk also fits mixture weights by expectation and maximisation
       on all its training rows: by the chances that the model gave each id before it learned from it, a row's
       own words taken off the counts.
    3. Each chunk scores its rows: windows that overlap by half, each id scored once.

    Null texts are empty (one token, the end), repeated rows and null ids (learned from as the empty id)
    each give their row, further columns are left out, an empty table gives no rows. A word of any length has a
    finite score. Without any training row the model is uniform within its groups of symbols.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    begins = _beginnings(path)
    vocabulary = len(begins)
    table = chunks(scratch, id_and_text(docs), chunk_bytes, shaped=numbered)
    buckets = bucket_count(table)
    checked = lambda ids: np.array([remainder(i, 1 << 32) for i in ids], np.int64)

    def ask(rows: pa.Table, _: int, __: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        chunk = Numbered(rows, buckets)
        learned = np.repeat(checked(chunk.ids) % modulus != held_out, chunk.sizes)
        counts = np.bincount(chunk.numbers[learned], minlength=len(chunk.order)).astype(np.uint32)
        for b, words, own in chunk.lists():
            head = pack_words(words)
            yield b, len(head).to_bytes(8, "little") + head + pack(counts[own].tobytes())

    def answer(lists: list[bytes]) -> tuple:
        texts, counts = [], []
        for x in lists:
            n = int.from_bytes(x[:8], "little")
            texts.append(unpack(x[8 : 8 + n]).decode())
            counts.append(np.frombuffer(unpack(x[8 + n :]), np.uint32))
        found = pc.list_flatten(pc.split_pattern(pa.array(texts, pa.large_string()), "\n")).dictionary_encode()
        del texts
        which = found.indices.to_numpy()
        count = np.bincount(which, np.concatenate(counts), len(found.dictionary))
        ids = IdTable(Library(path), (" " + in_one(found.dictionary.cast(pa.string()), "\n ").decode()).split("\n"))
        subwords = np.bincount(ids.flat, np.repeat(count, ids.lengths), vocabulary).astype(np.int64)
        firsts = np.bincount(ids.flat[ids.ends - ids.lengths], count, vocabulary).astype(np.int64)
        replies = []
        for own in np.split(which, np.cumsum([len(c) for c in counts])[:-1]):
            head = ids.cut(own)
            replies.append(len(head).to_bytes(8, "little") + head + pack(count[own].astype(np.uint64).tobytes()))
        used = np.flatnonzero(subwords)
        return replies, (int(count.sum()), int((count > 0).sum())), pack(np.concatenate([used.astype(np.int64), subwords[used], firsts[used]]).tobytes())

    replies = scratch.write(exchange(table, buckets, ask, answer), "replies")
    ends = id_and_text(docs).select(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus).toDF("r").where(F.col("r") != held_out).count()
    sums = replies.agg(F.sum("total_a"), F.sum("total_b")).first()
    train_tokens, distinct_tokens = (sums[0] or 0) + ends, (sums[1] or 0) + (1 if ends else 0)
    subwords, firsts = _subword_counts(replies, vocabulary)
    symbols = Symbols(subwords, begins, ends, kinds)
    joined = with_replies(table, replies.where("chunk_id >= 0"))
    spread = spark.sparkContext.broadcast((symbols, firsts))

    def train(first: np.ndarray | None):
        held = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The sum of the models of a task's chunks by positions, and of their mixture weights by tokens."""
            forget()
            one_thread()
            symbols, firsts = spread.value
            start, whole = AttentionModel.fresh(symbols), None
            for batch in batches:
                for payload, replies_ in zip(batch.column(0), batch.column(1), strict=True):
                    chunk = Lookup(unpack_table(payload.as_py()), replies_of(replies_), buckets, ends)
                    learned = checked(chunk.ids) % modulus != held_out
                    if not learned.any():
                        continue
                    model = start.filled(start.flat() if held.value is None else held.value)
                    own = taught(chunk, model, learned, firsts, train_tokens, updates if held.value is None else None)
                    whole = own if whole is None else whole + own
                    release()
            if whole is not None:
                yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["sums"])

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sum((np.frombuffer(x.as_py(), np.float64) for batch in batches for x in batch.column(0)), np.zeros(1))
        if len(whole) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["sums"])

    def learn(rows: DataFrame, first: np.ndarray | None) -> np.ndarray | None:
        """The mean; at most 32 sums reach the driver, each as large as the model."""
        own = rows.select("payload", "replies").mapInArrow(train(first), "sums binary").repartition(32).mapInArrow(summed, "sums binary")
        found = [np.frombuffer(r["sums"], np.float64) for r in own.collect()]
        return sum(found) if found else None

    model = AttentionModel.fresh(symbols)
    size, weights = len(model.flat()), np.tile(FIRST_WEIGHTS, (len(AGES) + 1, 1))
    # A chunk of ordinary size, so that it isn't one very long text.
    usual = F.col("n_bytes").between(chunk_bytes // 4, chunk_bytes * 5 // 4)
    lead = table.orderBy(F.desc(usual), F.xxhash64("chunk_id"), "chunk_id").select("chunk_id").first()
    if lead is not None and updates:
        warm = learn(joined.where(F.col("chunk_id") == lead[0]), None)
        if warm is None:  # no training row there
            warm = np.concatenate([model.flat(), [1.0]])
        found = learn(joined, warm[:size] / warm[size])
        if found is not None:
            model = model.filled(found[:size] / found[size])
            weights = _weights(found[size + 1 :])
    tuned = spark.sparkContext.broadcast((model.flat(), weights))
    scale = math.log10(train_tokens + distinct_tokens + 1)

    def finish(_: int, rows: pa.Table, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        one_thread()
        symbols, firsts = spread.value
        flat, weights = tuned.value
        chunk = Lookup(rows, got, buckets, ends)
        mixture = Mixture(chunk, AttentionModel.fresh(symbols).filled(flat), firsts, train_tokens)
        base, known = np.log10(chunk.count + 1) - scale, (chunk.count > 0).astype(np.int64)
        for ids, per_row, which in chunk.slabs(np.ones(len(chunk.ids), bool)):
            first = np.cumsum(per_row) - per_row
            parts, age = mixture.parts(per_row, which)
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp.reduce(parts + np.log(weights)[age].T, axis=0) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(checked(ids) % modulus == held_out), pa.array(per_row), pa.array(np.add.reduceat(known[which], first)),
                    pa.array(np.full(len(ids), train_tokens)), pa.array(np.add.reduceat(base[which], first)), pa.array(np.add.reduceat(mixed, first)),
                ],
                names,
            )

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = scratch.write(each_chunk(joined, finish, schema), "result")
    scratch.drop("chunks", "replies")
    return result


def taught(chunk: Lookup, model: AttentionModel, learned: np.ndarray, firsts: np.ndarray, tokens: int, updates: int | None = None) -> np.ndarray:
    """Teaches the model the learned rows: its values times the rows' positions, those positions, and the tokens that
    mixture weights account for on all these rows. With ``updates`` it is only started, and no weights are fitted."""
    symbols = model.symbols
    kind, parts = chunk.symbols(symbols), []
    for _, per_row, which in chunk.slabs(learned):
        flat, lengths, _ = chunk.sequence(which, per_row, kind)
        inputs, fresh, targets, real, _ = blocks(flat, lengths, symbols.end)
        parts.append((inputs.astype(np.int32), fresh, targets.astype(np.int32), real))
    data = [np.concatenate(x) for x in zip(*parts, strict=True)]
    del parts
    positions, fitted = float(data[3].sum()), np.zeros(0)
    if updates is not None:
        model.train(*data, updates=updates)
    else:
        # As the model stood before it learned from them; the first block of a batch's run has none before it.
        told = (np.zeros(data[0].size, np.float32), np.zeros(data[0].size, np.float32))
        model.train(*data, rate=1e-3, told=told)
        del data
        fitted = Mixture(chunk, model, firsts, tokens).fitted(learned, told)
    return np.concatenate([model.flat().astype(np.float64) * positions, [positions], fitted])


class Mixture:
    """The four parts of a word's chance over the rows of a chunk."""

    def __init__(self, chunk: Lookup, model: AttentionModel, firsts: np.ndarray, tokens: int) -> None:
        self.chunk, self.model, self.tokens = chunk, model, max(tokens, 1)
        symbols = model.symbols
        self.kind, self.within = chunk.symbols(symbols), chunk.within(symbols)
        begin = chunk.stop - chunk.length
        #: Training words that begin with the word's first id; the end is alone with its own.
        self.fellows = np.append(firsts[chunk.flat[begin[:-1]]], chunk.count[-1]).astype(np.float64)

    def parts(self, per_row: np.ndarray, which: np.ndarray, told: Callable[[int], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms (4 x words), and each word's class of age: how many words stand before it.

        With ``told``, which gives the model's logarithms for the next so many positions, each row's own words are taken
        off the counts."""
        chunk = self.chunk
        flat, lengths, spot = chunk.sequence(which, per_row, self.kind)
        inputs, fresh, targets, real, token = blocks(flat, lengths, self.model.symbols.end)
        own, boundary = told(inputs.size) if told else self.model.log_probabilities(inputs, fresh, targets)
        chosen = real.ravel()
        token = token.ravel()[chosen]
        logs, begun = np.empty(len(flat)), np.empty(len(flat) + 1)
        logs[token], begun[token] = own[chosen], boundary[chosen]
        begun[-1] = 0
        logs += self.within[spot]
        stop = np.cumsum(chunk.length[which])
        start = stop - chunk.length[which]
        ended = begun[stop]
        ended[np.cumsum(per_row) - 1] = 0  # nothing follows the end of a text
        before, earlier, own_count = _recurrence(which, per_row)
        count = chunk.count[which] - (own_count if told else 0)
        out = np.full((4, len(which)), NOTHING)
        out[0] = np.add.reduceat(logs, start) - begun[start] + ended
        seen = np.flatnonzero(count > 0)
        share = np.log(count[seen])
        out[1, seen] = logs[start[seen]] - begun[start[seen]] + share - np.log(self.fellows[which[seen]])
        out[2, seen] = share - math.log(self.tokens)
        again = np.flatnonzero(earlier)
        out[3, again] = np.log(earlier[again] / before[again])
        return out, np.searchsorted(AGES, before, "right")

    def fitted(self, wanted: np.ndarray, told: tuple[np.ndarray, np.ndarray], rounds: int = 25) -> np.ndarray:
        """Tokens that each part of each class of age accounts for on the wanted training rows, by the model's
        logarithms for their positions."""
        ages, at = len(AGES) + 1, 0
        out = np.zeros((ages, 4))

        def following(n: int) -> tuple[np.ndarray, np.ndarray]:
            nonlocal at
            at += n
            return told[0][at - n : at], told[1][at - n : at]

        found: list[list[np.ndarray]] = [[] for _ in range(ages)]
        for _, per_row, which in self.chunk.slabs(wanted):
            parts, age = self.parts(per_row, which, following)
            parts -= parts.max(0)
            likely = np.exp(parts, out=parts).astype(np.float32)
            for k in range(ages):
                found[k].append(likely[:, age == k])
        for k in range(ages):
            weight = FIRST_WEIGHTS
            for _ in range(rounds):
                single = weight.astype(np.float32)
                out[k] = weight * sum((x @ (1 / (single @ x)) for x in found[k]), np.zeros(4))
                weight = (out[k] + PRIOR_TOKENS * FIRST_WEIGHTS) / (out[k].sum() + PRIOR_TOKENS)
        return out.ravel()


def _weights(took: np.ndarray) -> np.ndarray:
    took = took.reshape(len(AGES) + 1, 4) + PRIOR_TOKENS * FIRST_WEIGHTS
    took[0, 3] = 0  # before the first word there is no text so far
    return took / took.sum(1, keepdims=True)


def _recurrence(words: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words of its row stand before each word, how many of those are the same, and how many of the row are."""
    n = len(words)
    at = np.arange(n)
    before = at - np.repeat(np.cumsum(per_row) - per_row, per_row)
    # Row, word and place in one number, so that a plain sort brings equal words of a row together in order.
    bits = max(1, n.bit_length())
    span = int(words.max(initial=0)) + 1
    if (len(per_row) * span).bit_length() + bits < 63:
        keys = np.sort((np.repeat(np.arange(len(per_row)), per_row) * span + words) << bits | at)
        place, keys = keys & ((1 << bits) - 1), keys >> bits
    else:
        keys = np.repeat(np.arange(len(per_row)), per_row) * span + words
        place = np.argsort(keys, kind="stable")
        keys = keys[place]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    many = np.diff(first, append=n)
    earlier, total = np.empty(n, np.int64), np.empty(n, np.int64)
    earlier[place], total[place] = at - np.repeat(first, many), np.repeat(many, many)
    return before, earlier, total


def _beginnings(path: str) -> np.ndarray:
    """Which ids begin a word: a word is encoded behind a blank, which no word holds."""
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 1, bool)
    for piece, i in vocab.items():
        out[i] = piece.startswith("Ġ")
    return out


def _subword_counts(replies: DataFrame, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of subword ids in the training corpus, and as first ids of words; at most one row per id reaches the driver."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for reply in batch.column(0):
                three = np.frombuffer(unpack(reply.as_py()), np.int64).reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in three], ["id", "n", "first"])

    rows = replies.where("chunk_id = -1").select("reply").mapInArrow(opened, "id long, n long, first long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("first").alias("first")).collect()
    counts, firsts = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
    for r in rows:
        counts[r["id"]], firsts[r["id"]] = r["n"], r["first"]
    return counts, firsts
