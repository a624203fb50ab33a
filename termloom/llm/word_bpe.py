"""Word-level BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._bytebpe import Library, Remembered, special_tokens
from ._shared import CHUNK_BYTES, Scratch, WordNumbers, bucket_count, chunks, each_chunk, exchange, id_and_text, pack, pack_words, quiet_tokenizers, slabs, split_words, tokenizer_path, unpack, unpack_words, with_replies

#: Characters on which the normaliser only lower-cases (and white space only separates): ASCII, Latin-1 and
#: Latin Extended-A but for one capital; and those of them that one byte of Latin-1 holds.
PLAIN = regex.compile(r"[\t-\r\x20-\x7e\xa1-įı-ſ]*+")
PLAIN_BYTES = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
#: The vocabulary's split pattern for lower-cased plain text, with its classes of letters and numbers spelled out.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼½¾]|[^\s0-9²³¹¼½¾a-zªµºß-öø-ſ]+")


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN_BYTES)
    except UnicodeEncodeError:
        return PLAIN.fullmatch(text) is not None


#: Larger chunks than elsewhere: a chunk asks for each of its words once.
WORD_CHUNK_BYTES = 3 * CHUNK_BYTES


class WordSplitter:
    """The words of a text as the vocabulary's normaliser and splitter give them; special strings stand alone."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        quiet_tokenizers()
        self.library = Tokenizer.from_file(path)
        self.special = special_tokens(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def words(self, text: str) -> list[str]:
        if "<|" in text and self.cut.search(text):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if is_plain(text):
            return WORD.findall(text.lower())
        whole = self.library.normalizer.normalize_str(text)
        return [whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)]


def code_ids(flat: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of ids (one byte, 255 where more follow) and the ids."""
    if len(flat) and int(flat.max()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    small = np.minimum(lengths, 255).astype(np.uint8)
    return pack(small.tobytes() + lengths[small == 255].astype(np.uint32).tobytes() + flat.astype(np.uint16).tobytes())


class IdTable:
    """The ids of a bucket's distinct words, each encoded once, and replies cut from them."""

    def __init__(self, library: Library, words: list[str], shown: list[str] | None = None) -> None:
        self.flat, self.ends = library.encode(shown or words)
        self.lengths = np.diff(self.ends, prepend=0)
        self.words = words

    @functools.cached_property
    def number(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.words)}

    def reply(self, words: list[str]) -> bytes:
        return self.cut(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))

    def cut(self, which: np.ndarray) -> bytes:
        """The ids of the words with these numbers."""
        lengths = self.lengths[which]
        at = np.repeat(self.ends[which] - np.cumsum(lengths), lengths) + np.arange(int(lengths.sum()))
        return code_ids(self.flat[at], lengths)


def decode_ids(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids in one array and where each list ends."""
    data = unpack(data)
    lengths = np.frombuffer(data, np.uint8, n).astype(np.int64)
    many = np.flatnonzero(lengths == 255)
    lengths[many] = np.frombuffer(data, np.uint32, len(many), n)
    return np.frombuffer(data, np.uint16, offset=n + 4 * len(many)), np.cumsum(lengths)


def encode_documents(docs: DataFrame, tokenizer: str | None = None, chunk_bytes: int = WORD_CHUNK_BYTES) -> DataFrame:
    """``doc_id, ids, pieces``: every document's ids and the decoded text, in the library's form.

    The distinct words of each chunk go to a table of words dealt by hash; there each distinct word of the
    corpus is encoded once; ids come back in the order of the chunk's list and are joined to the words by
    position. Null texts are empty, repeated rows and null ids each give their row, further columns are left
    out, an empty table gives no rows.
    """
    return _encode(docs, tokenizer, chunk_bytes, digest=False)


def encoding_digests(docs: DataFrame, tokenizer: str | None = None, chunk_bytes: int = WORD_CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of :func:`encode_documents`, made where its rows are."""
    return _encode(docs, tokenizer, chunk_bytes, digest=True)


def _encode(docs: DataFrame, tokenizer: str | None, chunk_bytes: int, digest: bool) -> DataFrame:
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession, "wordbpe")
    table = chunks(scratch, id_and_text(docs), chunk_bytes)
    buckets = bucket_count(table)

    def asked_words(numbers: WordNumbers, splitter: WordSplitter) -> list[list[str]]:
        return split_words([w for w in numbers if w not in splitter.special], buckets)

    def ask(rows: pa.Table, _: int, __: dict[int, bytes]) -> Iterable[tuple[int, bytes]]:
        splitter, numbers = WordSplitter(path), WordNumbers()
        for _ids, texts in slabs(rows):
            for text in texts:
                numbers.see(splitter.words(text))
        return [(b, pack_words(words)) for b, words in enumerate(asked_words(numbers, splitter)) if words]

    def answer(lists: list[bytes]) -> tuple[list[bytes], tuple[int, int]]:
        asked = [unpack_words(x) for x in lists]
        every = list(set().union(*asked))
        ids = IdTable(Library(path), every)
        return [ids.reply(words) for words in asked], (len(every), 0)

    def finish(_: int, rows: pa.Table, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        splitter = WordSplitter(path)
        with open(path, encoding="utf-8") as file:
            symbols = {i: piece for piece, i in json.load(file)["model"]["vocab"].items()}
        symbols |= {i: s for s, i in splitter.special.items()}
        numbers, parts = WordNumbers(), []
        for docs_ids, texts in slabs(rows):
            parts.append((docs_ids, [numbers.of(splitter.words(text)) for text in texts]))
        known, old = Remembered(f"words {path}", 200_000).turned()
        shown_ids, shown_pieces, sizes = ([""] * len(numbers) for _ in range(3))
        for word, i in splitter.special.items():
            known[word] = str(i), symbols[i], 1
            if word in numbers:
                k = numbers[word]
                shown_ids[k], shown_pieces[k], sizes[k] = known[word]
        for b, words in enumerate(asked_words(numbers, splitter)):
            if not words:
                continue
            flat, ends = decode_ids(replies[b], len(words))
            flat, at = flat.tolist(), 0
            for word, end, k in zip(words, ends.tolist(), numbers.of(words).tolist(), strict=True):
                value = known.get(word)
                if value is None:
                    value = old.get(word)
                    if value is None:
                        ids = flat[at:end]
                        value = " ".join(map(str, ids)), " ".join([symbols[i] for i in ids]), len(ids)
                    known[word] = value
                shown_ids[k], shown_pieces[k], sizes[k] = value
                at = end
        sizes = np.array(sizes, np.int64)
        for docs_ids, texts in parts:
            counts = [int(sizes[own].sum()) for own in texts]
            rows_ = [own.tolist() for own in texts]
            left = [" ".join([shown_ids[k] for k in own]) for own in rows_]
            right = [" ".join([shown_pieces[k] for k in own]) for own in rows_]
            if digest:
                sha = [[hashlib.sha256(x.encode()).hexdigest() for x in side] for side in (left, right)]
                arrays = [pa.array(docs_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sha[0]), pa.array(sha[1])]
            else:
                arrays = [pa.array(docs_ids, pa.int64()), pa.array([[int(i) for i in x.split()] for x in left], pa.list_(pa.int32())), pa.array(right)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, pieces string"
    names = [c.split()[0] for c in schema.split(", ")]
    result = each_chunk(with_replies(table, exchange(table, buckets, ask, answer)), finish, schema)
    if not digest:
        return result
    result = scratch.write(result, "result")
    scratch.drop("chunks")
    return result
