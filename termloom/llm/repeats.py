"""Removal of byte strings that an earlier document holds, by a suffix array of many documents.

A 50-byte string contains 26 strings of 25 bytes; the smallest of their hashes is its *anchor*. Equal
strings have equal anchors, so strings meet by anchor: consecutive windows with one anchor form a segment of
at most 75 bytes, and only anchors that two documents share are looked at. The segments of a bucket are the
collection whose suffix array is built column by column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytebpe import forget
from ._shared import CHUNK_BYTES, Scratch, bucket_count, chunks, each_chunk, exchange, id_and_text, marked, pack, pack_sorted, shared_marks, split_hashes, unpack, with_replies

ANCHOR_BITS = 44
#: Smaller chunks and buckets than elsewhere: hashes and segments take several times the text's memory.
REPEAT_CHUNK_BYTES, SEGMENT_BUCKET_BYTES = CHUNK_BYTES // 2, 5 << 20
LAST_ID = (1 << 63) - 1  # a null id comes after all others


class ColumnwiseSuffixArray:
    """Suffixes of a collection of short strings in order, built one symbol of every string at a time.

    Round j inserts the suffix of length j of every string: its symbol is written into the collection's
    Burrows-Wheeler transform beside the suffix of length j - 1, and its place among the suffixes with the
    same first symbol is the number of equal symbols before that in the transform. The common prefix with
    its neighbours is one more than the least one between the two equal symbols. Each round reads transform and
    common prefixes front to back and writes them anew. A collection is bounded, so they are held in memory: a
    folder of one machine would be lost with it, and a Python worker can't write to the shared one.
    """

    def __init__(self, strings: list[bytes]) -> None:
        if strings and max(map(len, strings)) > 254:
            raise ValueError("strings of at most 254 bytes")
        self._build(strings)
        self._name_suffixes(np.fromiter(map(len, strings), np.int64, len(strings)))

    def _build(self, strings: list[bytes]) -> None:
        n = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, n)
        ends = np.cumsum(sizes)
        text = np.frombuffer(b"".join(strings), np.uint8)
        # Symbols are numbered from 1, so that 0 means "none yet"; UTF-8 never uses all 256 bytes.
        used = np.unique(text)
        if len(used) > 255:
            raise ValueError("more than 255 different bytes, which UTF-8 text can't have")
        code = np.zeros(256, np.uint8)
        code[used] = np.arange(1, len(used) + 1)
        place = np.arange(n, dtype=np.int64)
        self.bwt, self.lcp = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for j in range(1, int(sizes.max(initial=0)) + 1):
            active = np.flatnonzero(sizes >= j)
            bwt, lcp = self.bwt, self.lcp
            at = place[active]
            symbol = code[text[ends[active] - j]]
            bwt[at] = symbol
            order = np.argsort(bwt, kind="stable")
            first = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=257))])
            rank = np.empty(len(bwt), np.int32)
            rank[order] = np.arange(len(bwt), dtype=np.int32)
            where = rank[at].astype(np.int64)  # index in ``order`` of the new suffix's own symbol
            target = n + where - first[1]
            before, follow = where > first[symbol], np.flatnonzero(where + 1 < first[symbol.astype(np.int64) + 1])
            low, high = order[where[before] - 1] + 1, order[where[before]]
            next_low, next_high = order[where[follow]] + 1, order[where[follow] + 1]
            least = _RangeMinimum(lcp, int(max((high - low).max(initial=0), (next_high - next_low).max(initial=0))) + 1)
            new_lcp = np.zeros(len(at), np.uint8)
            new_lcp[before] = least(low, high) + 1
            old = np.ones(len(bwt) + len(at), bool)
            old[target] = False
            self.bwt = np.zeros(len(old), np.uint8)
            self.bwt[old] = bwt
            self.lcp = np.zeros(len(old), np.uint8)
            self.lcp[old] = lcp
            self.lcp[target[follow] + 1] = least(next_low, next_high) + 1
            self.lcp[target] = new_lcp
            place[active] = target

    def _name_suffixes(self, sizes: np.ndarray) -> None:
        """String and length of every suffix: from a string's empty suffix, each step through the transform
        leads to the suffix that is one symbol longer."""
        bwt = self.bwt
        order = np.argsort(bwt, kind="stable")
        unset = int((bwt == 0).sum())
        longer = np.empty(len(bwt), np.int64)
        longer[order] = len(sizes) + np.arange(len(bwt)) - unset
        self.owner, self.length = np.zeros(len(bwt), np.uint32), np.zeros(len(bwt), np.uint8)
        at = np.arange(len(sizes))
        for j in range(int(sizes.max(initial=0)) + 1):
            own = np.flatnonzero(sizes >= j)
            if j:
                at[own] = longer[at[own]]
            self.owner[at[own]], self.length[at[own]] = own, j


class _RangeMinimum:
    """Least value of inclusive ranges, from tables of the minima of 2^k neighbours."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= min(longest, len(values)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in np.unique(level).tolist():
            own = level == k
            table = self.levels[k]
            out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k) + 1])
        return out


class Windows:
    """The windows of a chunk's texts with their anchors."""

    def __init__(self, rows: pa.Table, size: int) -> None:
        forget()
        ids = rows.column(0).to_pylist()
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        parts = [(t or "").encode() for t in rows.column(1).to_pylist()]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(self.sizes)
        self.buffer = b"".join(parts)
        self.size = size
        gram = size // 2
        data = np.frombuffer(self.buffer, np.uint8)
        starts = [np.arange(e - n, e - size + 1) for n, e in zip(self.sizes.tolist(), self.ends.tolist(), strict=True) if n >= size]
        #: Positions where a window starts, and its anchor.
        self.at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.anchor = _anchors(data, gram, size - gram + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(parts)), np.maximum(self.sizes - size + 1, 0))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and which of them two of the chunk's rows have."""
        change = np.ones(len(self.at), bool)
        change[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        anchor, doc = self.anchor[change], self.doc[change]
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        if not len(first):
            return anchor, np.zeros(0, bool)
        return anchor[first], np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)

    def segments(self, anchors: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one row with one wanted anchor: index of the first window, windows, anchor."""
        if not len(self.at):
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64)
        change = np.ones(len(self.at), bool)
        change[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(change)
        count = np.diff(first, append=len(self.at))
        keep = wanted[np.searchsorted(anchors, self.anchor[first])]
        first, count = first[keep], count[keep]
        # A text that repeats itself can keep one anchor for long; such runs are cut.
        most = self.size - self.size // 2 + 1
        pieces = -(-count // most)
        start = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
        left = np.repeat(first + count, pieces) - start
        return start, np.minimum(left, most), self.anchor[start]

    def strings(self, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        low = self.at[first]
        return [self.buffer[a:b] for a, b in zip(low.tolist(), (low + count + self.size - 1).tolist(), strict=True)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, base), np.full(n, inverse)
        up[:1] = down[:1] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _anchors(data: np.ndarray, gram: int, window: int) -> np.ndarray:
    """For each position the least hash of the ``window`` strings of ``gram`` bytes from there on (garbage at the very end)."""
    n = len(data)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        hashes = np.full(n + window, np.uint64((1 << 64) - 1))
        mixed = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        hashes[: n - gram + 1] = mixed >> np.uint64(64 - ANCHOR_BITS)
    reach = 1
    while reach * 2 <= window:
        hashes[:-reach] = np.minimum(hashes[:-reach], hashes[reach:])
        reach *= 2
    rest = window - reach
    return np.minimum(hashes[: n - rest] if rest else hashes[:n], hashes[rest:n]) if rest else hashes[:n]


def _request(anchors: np.ndarray, docs: np.ndarray, strings: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, strings), np.uint8, len(strings))
    return pack(np.array([len(strings)], np.int64).tobytes() + anchors.tobytes() + docs.tobytes() + sizes.tobytes() + b"".join(strings))


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data = unpack(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    anchors, docs = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n)
    sizes = np.frombuffer(data, np.uint8, n, 8 + 16 * n).astype(np.int64)
    ends = np.cumsum(sizes) + 8 + 17 * n
    return anchors, docs, [data[b - a : b] for a, b in zip(sizes.tolist(), ends.tolist(), strict=True)]


def earliest_holders(strings: list[bytes], docs: np.ndarray, anchors: np.ndarray, size: int, most: int = 30_000) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string, the smallest id of a document that holds the window's bytes: one array
    in the order of strings and windows, and each string's number of windows.

    Equal strings are inserted once, with the smallest of their ids. A string that is the only one of its
    anchor has no other to share a window with. ``most`` strings (more if one anchor has more) make up one
    collection.
    """
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
    single = list(number)
    del number
    least = np.full(len(single), LAST_ID)
    np.minimum.at(least, which, docs)
    anchor = np.zeros(len(single), np.uint64)
    anchor[which] = anchors
    sizes = np.fromiter(map(len, single), np.int64, len(single))
    windows_of = sizes - size + 1
    first = np.cumsum(windows_of) - windows_of
    found = np.repeat(least, windows_of)
    order = np.argsort(anchor, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
    low, many = cuts[:-1], np.diff(cuts)
    low, many = low[many > 1], many[many > 1]
    # Anchors are put together until a collection is full.
    full = np.cumsum(many)
    at = 0
    while at < len(low):
        stop = max(at + 1, int(np.searchsorted(full, (full[at - 1] if at else 0) + most, "right")))
        members = order[np.concatenate([np.arange(a, a + n) for a, n in zip(low[at:stop].tolist(), many[at:stop].tolist(), strict=True)])]
        at = stop
        array = ColumnwiseSuffixArray([single[i] for i in members.tolist()])
        whole = np.flatnonzero(array.length >= size)
        # Two neighbouring windows are equal when no common prefix between their suffixes is shorter than a window.
        border = np.cumsum(array.lcp < size)[whole]
        begin = np.flatnonzero(np.concatenate([[True], border[1:] != border[:-1]]))
        owner = members[array.owner[whole]]
        smallest = np.minimum.reduceat(least[owner], begin)
        found[first[owner] + sizes[owner] - array.length[whole]] = np.repeat(smallest, np.diff(begin, append=len(whole)))
    counts = windows_of[which]
    return found[np.repeat(first[which] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))], counts


def remove_repeats(docs: DataFrame, size: int = 50, chunk_bytes: int = REPEAT_CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes of each row's text that stay.

    A byte goes if a string of ``size`` bytes that covers it also starts in a row with a smaller ``doc_id``;
    texts are UTF-8, matches never cross rows, and what goes is judged on the input. A null text is empty, a
    null id comes after all others, rows that share an id never remove from each other, further columns are
    left out, an empty table gives no rows.
    """
    return _remove(docs, size, chunk_bytes, digest=False)


def removal_digests(docs: DataFrame, size: int = 50, chunk_bytes: int = REPEAT_CHUNK_BYTES) -> DataFrame:
    """As :func:`remove_repeats` with ``kept_sha256`` in place of ``kept``."""
    return _remove(docs, size, chunk_bytes, digest=True)


def _remove(docs: DataFrame, size: int, chunk_bytes: int, digest: bool, whole_rows: bool = False) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "repeats")
    order = docs.columns
    rest = [c for c in order if c not in ("doc_id", "text")]
    table = chunks(scratch, docs.select("doc_id", "text", *rest) if whole_rows else id_and_text(docs), chunk_bytes)
    buckets = bucket_count(table, SEGMENT_BUCKET_BYTES)

    def ask_anchors(rows: pa.Table, n: int, _: dict[int, bytes]) -> Iterable[tuple[int, bytes]]:
        return [(b, pack_sorted(part)) for b, part in split_hashes(Windows(rows, size).distinct()[0], n, ANCHOR_BITS)]

    marks = scratch.write(exchange(table, buckets, ask_anchors, shared_marks), "marks")
    once = with_replies(table, marks)

    def shared_segments(rows: pa.Table, n: int, replies: dict[int, bytes]) -> tuple[Windows, np.ndarray, np.ndarray, list[bytes], dict[bytes, int], dict[int, list[bytes]], dict[bytes, np.uint64]]:
        windows = Windows(rows, size)
        anchors, twice = windows.distinct()
        first, count, anchor = windows.segments(anchors, twice | marked(anchors, replies, n, ANCHOR_BITS))
        strings = windows.strings(first, count)
        least: dict[bytes, int] = {}
        anchor_of: dict[bytes, np.uint64] = {}
        for s, d, a in zip(strings, windows.ids[windows.doc[first]].tolist(), anchor, strict=True):
            known = least.get(s)
            if known is None:
                least[s], anchor_of[s] = d, a
            elif d < known:
                least[s] = d
        dealt: dict[int, list[bytes]] = {}
        if anchor_of:
            bucket = (np.fromiter(anchor_of.values(), np.uint64, len(anchor_of)) % np.uint64(n)).astype(np.int64)
            for s, b in zip(anchor_of, bucket.tolist(), strict=True):
                dealt.setdefault(b, []).append(s)
        return windows, first, count, strings, least, dealt, anchor_of

    def ask_segments(rows: pa.Table, n: int, replies: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        *_, least, dealt, anchor_of = shared_segments(rows, n, replies)
        for b, strings in dealt.items():
            yield b, _request(np.array([anchor_of[s] for s in strings], np.uint64), np.array([least[s] for s in strings], np.int64), strings)

    def answer_segments(lists: list[bytes]) -> tuple[list[bytes], tuple[int, int]]:
        opened = [_opened(x) for x in lists]
        strings = [s for _, _, part in opened for s in part]
        numbers = [len(part) for _, _, part in opened]
        docs_, anchors = np.concatenate([d for _, d, _ in opened]), np.concatenate([a for a, _, _ in opened])
        del opened
        found, counts = earliest_holders(strings, docs_, anchors, size)
        gone = found < np.repeat(docs_, counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *numbers])].tolist()
        return [pack(np.packbits(gone[a:b]).tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], (len(strings), 0)

    gone = scratch.write(exchange(once, buckets, ask_segments, answer_segments), "gone")
    shift = buckets  # replies of the second exchange follow those of the first
    both = marks.select("chunk_id", "bucket", "reply").union(gone.select("chunk_id", (F.col("bucket") + shift).alias("bucket"), "reply"))

    def finish(_: int, rows: pa.Table, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        windows, first, count, strings, least, dealt, _ = shared_segments(rows, buckets, replies)
        bits: dict[bytes, np.ndarray] = {}
        for b, part in dealt.items():
            own = np.frombuffer(unpack(replies[shift + b]), np.uint8)
            lengths = np.array([len(s) - size + 1 for s in part])
            flat, ends = np.unpackbits(own, count=int(lengths.sum())).astype(bool), np.cumsum(lengths)
            for s, a, e in zip(part, (ends - lengths).tolist(), ends.tolist(), strict=True):
                bits[s] = flat[a:e]
        total = len(windows.buffer)
        goes = np.zeros(total + 1, np.int32)
        ids = windows.ids[windows.doc[first]].tolist()
        for s, d, low, n in zip(strings, ids, windows.at[first].tolist(), count.tolist(), strict=True):
            goes[low : low + n] = True if d > least[s] else bits[s]
        sums = np.concatenate([[0], np.cumsum(goes[:total])])
        covered = sums[1:] > sums[np.maximum(np.arange(total) + 1 - size, 0)]
        data = np.frombuffer(windows.buffer, np.uint8)
        out: list[list] = [[] for _ in range(5)]
        for doc, n, end in zip(rows.column(0).to_pylist(), windows.sizes.tolist(), windows.ends.tolist(), strict=True):
            own = covered[end - n : end]
            removed = int(own.sum())
            kept = data[end - n : end][~own].tobytes() if removed else windows.buffer[end - n : end]
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if removed else 0
            for column, value in zip(out, (doc, n, removed, spans, hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                column.append(value)
        if whole_rows:
            yield from cut_rows(rows, out[2], out[4])
            return
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    def cut_rows(rows: pa.Table, removed: list[int], kept: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts = [k.decode("utf-8", "ignore") if n else t for n, k, t in zip(removed, kept, rows.column("text").to_pylist(), strict=True)]
        columns = {c: rows.column(c) for c in order}
        columns["text"] = pa.array(texts, rows.schema.field("text").type)
        if "n_chars" in columns:
            field = rows.schema.field("n_chars").type
            columns["n_chars"] = pa.array([len(t) if n else c for n, t, c in zip(removed, texts, columns["n_chars"].to_pylist(), strict=True)], field)
        yield from pa.table(columns).to_batches()

    if whole_rows:
        return each_chunk(with_replies(table, both), finish, docs.schema)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    result = each_chunk(with_replies(table, both), finish, schema)
    if not digest:
        return result
    result = scratch.write(result, "result")
    scratch.drop("chunks", "marks", "gone")
    return result



def without_repeats(docs: DataFrame, size: int = 50, chunk_bytes: int = REPEAT_CHUNK_BYTES) -> DataFrame:
    """``docs`` with texts cut to what :func:`remove_repeats` keeps (and ``n_chars``, if there, counted anew).

    Bytes that no longer make up a character, where a cut goes through one, are dropped too. A text that
    nothing is cut from stays as it is, null included; a text that is cut to nothing stays as an empty one.
    Rows that repeat an id or have none follow :func:`remove_repeats`; texts of any length are read whole; an empty
    table stays empty; further columns stay, whatever their names.
    """
    return _remove(docs, size, chunk_bytes, digest=False, whole_rows=True)
