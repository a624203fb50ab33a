"""Tokens with offsets and windows of one to three words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.languages import Language
from termloom.functions.similarity import MASK_LETTERS, places_of
from termloom.functions.text import collapse, fold_numbers, fold_part, fold_part_text, has_number_word, skeleton_of_folded
from termloom.schemas import MIN_SKELETON, NGRAMS, PHONETIC_AT, PHONETIC_NGRAMS

#: Letters, digits, the underscore and what else words are written with.
_PIECE = re.compile(r"[\wÀ-ÿ$%,.]").match
_LETTER = re.compile(r"\w").match
#: What a sign is: part of a piece, more than a point or a comma, a letter or digit or underscore.
_PART, _INNER, _WORD = 1, 2, 4
AHEAD = "doc_id string, i int, token string, start int, end int, closes boolean, token_1 string, end_1 int, token_2 string, end_2 int"
#: Tokens of a batch on its way from Python, roughly: texts are cut in runs of so many times six signs.
ROWS = 50_000
_SIGNS = 6


def tokenize(transcripts: DataFrame, language: Language) -> DataFrame:
    """``doc_id, i, token, start, end, closes`` of ``doc_id, text``.

    Pieces of word signs that hold a letter or a digit, without points and commas outside. A token closes a sentence if
    a boundary stands before the next token, or before the end.
    """
    return tokens_ahead(transcripts, language).select("doc_id", "i", "token", "start", "end", "closes")


def tokens_ahead(transcripts: DataFrame, language: Language, reach: Reach | None = None) -> DataFrame:
    """:func:`tokenize` with the tokens that follow in the sentence: ``token_1, end_1, token_2, end_2``, null where it ends.

    A text is read once, front to back, so that neither offsets nor neighbours need a sort or a shuffle; texts are cut in
    runs of signs as a whole (numpy), a long text in several, a run of short ones together. With ``reach`` only tokens
    leave that begin a window which may reach something, and ``sizes`` has a bit for each of these windows (see
    :meth:`Reach.sizes`).
    """
    boundaries = language.boundaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(reach, boundaries)
        for batch in batches:
            docs, texts, some, size = batch.column(0), batch.column(1), [], 0
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                if len(text) > ROWS * _SIGNS:
                    yield from rows.cut(docs, some)
                    yield from rows.cut_long(docs, k, text)
                    some, size = [], 0
                elif text:
                    some.append((k, text))
                    size += len(text)
                    if size >= ROWS * _SIGNS:
                        yield from rows.cut(docs, some)
                        some, size = [], 0
            yield from rows.cut(docs, some)

    return transcripts.select("doc_id", "text").mapInArrow(run, AHEAD if reach is None else f"{AHEAD}, sizes int")


#: Multiplier of the hash of a text, which is put together from those of its parts.
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Distinct tokens whose features a task keeps at a time.
KNOWN = 200_000


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & _MASK
    return h


def _counts(texts: Sequence[str], signs: str) -> np.ndarray:
    """How often each text holds each sign."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    row = np.cumsum(codes == 10)
    out = np.zeros((len(texts), len(signs)), np.int32)
    for k, sign in enumerate(signs):
        out[:, k] = np.bincount(row[codes == ord(sign)], minlength=len(texts))
    return out


def _hashes(texts: Sequence[str], sizes: np.ndarray, longest: int) -> np.ndarray:
    """Hash and power of texts; of more signs than ``longest`` the rest doesn't count, since no wanted text is as long."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros((len(texts), 2), np.uint64)
    out[:, 1] = 1
    base = np.uint64(_BASE)
    for k in range(min(int(sizes.max(initial=0)), longest + 1)):
        on = np.flatnonzero(sizes > k)
        out[on, 0] = out[on, 0] * base + codes[begin[on] + k] + np.uint64(1)
        out[on, 1] *= base
    return out


def _close(texts: Sequence[str], form: str, percent: int) -> np.ndarray:
    """Whether the indel ratio of each text with a form reaches ``percent``: bit-parallel longest common subsequences, a
    sign of all texts at a time."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(form) > MASK_LETTERS or not len(texts):
        return np.ones(len(texts), bool)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    places = np.zeros(len(codes), np.int64)
    for sign, bits in places_of(form).items():
        places[codes == ord(sign)] = bits
    full = np.int64((1 << len(form)) - 1)
    state, begin = np.full(len(texts), full), np.cumsum(sizes) - sizes
    for k in range(int(sizes.max())):
        on = np.flatnonzero(sizes > k)
        old = state[on]
        here = old & places[begin[on] + k]
        state[on] = ((old + here) | (old - here)) & full
    return 200 * (len(form) - np.bitwise_count(state).astype(np.int64)) >= percent * (sizes + len(form))


class Reach:
    """What windows may reach, as a test of a batch of tokens that never turns down a window which reaches something.

    Lengths, letters and hashes of a window follow from those of its tokens, so each distinct token is folded once.
    ``texts`` are whole windows, ``bases`` singulars, ``guesses`` forms to guess at from ``low`` to ``high`` signs
    (``sizes`` the lengths, if the forms are too many to be held one by one against a window), ``codes`` skeletons of one
    or two words (``code_sizes`` likewise).
    """

    def __init__(self, language: Language, texts: Iterable[str], bases: Iterable[str] = (), guesses: Iterable[tuple[str, int, int]] = (), mark: int = 0, sizes: Iterable[int] = (), codes: Iterable[str] = (), code_sizes: Iterable[int] = ()) -> None:
        runs = {" ".join(t.split()) for t in texts}
        self.language, self.mark, self.empty = language, mark, "" in runs
        self.texts, self.longest = np.array(sorted({_hash(t) for t in runs}), np.uint64), max(map(len, runs), default=0)
        self.bases, self.guesses, self.lengths = set(bases), list(guesses), np.array(sorted(sizes), np.int64)
        self.codes, self.code_sizes = list(codes), sorted(code_sizes)
        self.signs, self.code_signs = ("".join(sorted(set("".join(some)))) for some in ([g[0] for g in self.guesses], self.codes))
        self.sounds = bool(self.codes or self.code_sizes)
        spelt = [(g[0], self.signs, 0) for g in self.guesses] + [(c, self.code_signs, len(self.signs)) for c in self.codes]
        self.wanted = [([first + signs.index(x) for x in sorted(set(text))], [text.count(x) for x in sorted(set(text))]) for text, signs, first in spelt]
        self.known: dict[str, int] = {}

    def _learn(self, tokens: list[str]) -> None:
        """Adds the features of new tokens: folded length, flags, length of the skeleton, letters of both."""
        language = self.language
        parts = fold_part_text("\n".join(tokens), language, "\n").split("\n")
        runs = [" ".join(p.split()) if " " in p else p for p in parts]
        ends = tuple(a for a, _ in language.plurals)
        inflects = lambda r: any(r.endswith(a) and r[: len(r) - len(a)] + b in self.bases for a, b in language.plurals)
        sounds = skeleton_of_folded("\n".join(parts)).split("\n") if self.sounds else [""] * len(parts)
        sizes = np.array([len(r) for r in runs], np.int64)
        table = np.array([
            sizes,
            [any(w in language.numbers for w in r.split()) if " " in r else r in language.numbers for r in runs],
            [r is not p and r != p or not r for r, p in zip(runs, parts, strict=True)],
            [not r for r in runs],
            [r.endswith(ends) and " " not in r and inflects(r) for r in runs],
            [len(x) for x in sounds],
        ], np.int32)
        letters = np.concatenate([_counts(runs, self.signs), _counts(sounds, self.code_signs)], 1).astype(np.int16)
        # What a token can add to the letters that a window shares with a form or a code.
        shares = [np.minimum(letters[:, columns], counts).sum(1) for columns, counts in self.wanted]
        shares = np.array(shares, np.int16).reshape(len(self.wanted), len(tokens))
        hashes = _hashes(runs, sizes, self.longest)
        if not self.known:
            self.table, self.shares, self.letters, self.hashes = table[:, :0], shares[:, :0], letters[:0], hashes[:0]
            self.filled, self.runs = 0, []
        self.runs += runs
        need = self.filled + len(tokens)
        if need > len(self.letters):
            room = max(need, 2 * len(self.letters)) - len(self.letters)
            more = lambda a, axis=0: np.concatenate([a, np.zeros((room, a.shape[1]) if axis == 0 else (a.shape[0], room), a.dtype)], axis)
            self.table, self.shares, self.letters, self.hashes = more(self.table, 1), more(self.shares, 1), more(self.letters), more(self.hashes)
        self.table[:, self.filled : need], self.shares[:, self.filled : need] = table, shares
        self.letters[self.filled : need], self.hashes[self.filled : need] = letters, hashes
        self.known.update(zip(tokens, range(self.filled, need), strict=True))
        self.filled = need

    def sizes(self, tokens: pa.Array, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each token a bit for the window of one, two and three tokens that it begins, then one for those of one and
        two tokens that may sound like a code; ``one`` and ``two`` tell which tokens have followers in the sentence."""
        coded = tokens.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.known
        if len(known) > KNOWN:
            known.clear()
        if fresh := [t for t in distinct if t not in known]:
            self._learn(fresh)
        self.at = at = np.array([known[t] for t in distinct], np.int64)[coded.indices.to_numpy()]
        table, hashes = [row[at] for row in self.table], self.hashes[at]
        later = lambda a, k: np.concatenate([a[k:], np.zeros_like(a[:k])])
        base = np.uint64(_BASE)
        out = np.zeros(len(at), np.int32)
        total, hashed, blank = [row.copy() for row in table], hashes[:, 0].copy(), table[3] > 0
        for n in range(1, NGRAMS + 1):
            ok = np.ones(len(at), bool) if n == 1 else one if n == 2 else two
            if n > 1:
                for row, own in zip(total, table, strict=True):
                    row += later(own, n - 1)
                blank &= later(table[3], n - 1) > 0
                # The sign for the space between, then the next part.
                h = later(hashes, n - 1)
                hashed = (hashed * base + np.uint64(ord(" ") + 1)) * h[:, 1] + h[:, 0]
            some = np.isin(hashed, self.texts) | (total[1] > 0)
            # Of a window of nothing but signs that folding drops nothing is left; others of the kind are looked at later.
            some |= (total[2] > 0) & (self.empty | ~blank)
            if n == 1:
                some |= total[4] > 0
            some |= self._guessed(total, n, ok & ~some)
            out |= np.where(ok & some, 1 << (n - 1), 0).astype(np.int32)
            if self.sounds and n <= PHONETIC_NGRAMS:
                out |= np.where(ok & self._heard(total, n, ok), 1 << (NGRAMS + n - 1), 0).astype(np.int32)
        return out

    def _guessed(self, total: list[np.ndarray], n: int, ok: np.ndarray) -> np.ndarray:
        """Letters that window and form share, each as often as both hold it, bound what can match."""
        length = total[0] + (n - 1)
        some = np.isin(length, self.lengths) if len(self.lengths) else np.zeros(len(length), bool)
        for k, (form, low, high) in enumerate(self.guesses):
            near = np.flatnonzero((length >= low) & (length <= high) & ~some & ok)
            gaps = n - 1 if " " in form else 0
            near = near[200 * (self._shares(k, near, n) + gaps) >= self.mark * (length[near] + len(form))]
            near = near[200 * self._shared(k, near, n, gaps > 0) >= self.mark * (length[near] + len(form))]
            some[near[_close(self._windows(near, n, " "), form, self.mark)]] = True
        return some

    def _shares(self, k: int, starts: np.ndarray, n: int) -> np.ndarray:
        """At least as many letters as windows share with the text ``k`` of ``wanted``."""
        return sum(self.shares[k][self.at[starts + j]].astype(np.int32) for j in range(n))

    def _shared(self, k: int, starts: np.ndarray, n: int, spaced: bool = False) -> np.ndarray:
        """Letters that windows share with it, each as often as both hold it; ``spaced`` counts what is between words."""
        columns, counts = self.wanted[k]
        held = sum(self.letters[self.at[starts + j]].astype(np.int32) for j in range(n))[:, columns]
        if spaced:
            held[:, 0] += n - 1  # the blank is the first of the signs in order
        return np.minimum(held, counts).sum(1)

    def _windows(self, starts: np.ndarray, n: int, between: str) -> list[str]:
        return [between.join([self.runs[k] for k in row]) for row in self.at[starts[:, None] + np.arange(n)].tolist()]

    def _heard(self, total: list[np.ndarray], n: int, ok: np.ndarray) -> np.ndarray:
        """Where two words meet, a last sign may become another one or a sound of its own, and doubles become one."""
        less, more = (0, 0) if n == 1 else (2, 1)
        low, high = PHONETIC_AT / (200 - PHONETIC_AT), (200 - PHONETIC_AT) / PHONETIC_AT
        size, first = total[5], len(self.guesses)
        some = total[1] > 0
        if self.code_sizes:
            some = some | ((size + more >= self.code_sizes[0]) & (size - less <= self.code_sizes[-1]))
        for k, code in enumerate(self.codes, first):
            least = np.maximum(size - less, MIN_SKELETON)
            near = np.flatnonzero((size + more >= max(MIN_SKELETON, low * len(code))) & (least <= high * len(code)) & ~some & ok)
            for shared in (self._shares, self._shared):
                near = near[200 * np.minimum(more + shared(k, near, n), len(code)) >= PHONETIC_AT * (least[near] + len(code))]
            if len(near):
                sounds = skeleton_of_folded("\n".join(self._windows(near, n, ""))).split("\n")
                some[near[_close(sounds, code, PHONETIC_AT)]] = True
        return some


class _Signs:
    """What signs are, as bits by code; a sign is looked at when it first occurs."""

    def __init__(self, boundaries: str) -> None:
        self.boundaries, self.bits, self.known = boundaries, np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not self.known[codes].all():
            for code in np.unique(codes[~self.known[codes]]).tolist():
                sign = chr(code)
                if _PIECE(sign):
                    self.bits[code] = _PART | (_INNER if sign not in ".," else 0) | (_WORD if sign.isalnum() or _LETTER(sign) else 0)
                self.known[code] = True
        return self.bits[codes]

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """How many sentence ends stand before each place, one place more than there are signs."""
        out = np.zeros(len(codes) + 1, np.int64)
        hit = np.zeros(len(codes), bool)
        for sign in self.boundaries:
            hit |= codes == ord(sign)
        np.cumsum(hit, out=out[1:])
        return out


class _Rows:
    """Tokens on their way out, in order: columns ``doc, place, start, end, first, last`` (sentence ends of the text before
    the start and before the end) and the tokens' texts."""

    def __init__(self, reach: Reach | None, boundaries: str) -> None:
        self.reach, self.signs = reach, _Signs(boundaries)

    def _found(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Begin and end of the tokens of a run of signs, its sentence ends, and the tokens."""
        bits = self.signs.of(codes)
        edge = np.diff(np.concatenate([[0], bits & _PART, [0]]).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = np.concatenate([[0], np.cumsum((bits & _WORD) != 0)])
        kept = words[end] > words[begin]
        begin, end = begin[kept], end[kept]
        inner = np.flatnonzero(bits & _INNER)
        begin, end = inner[np.searchsorted(inner, begin)], inner[np.searchsorted(inner, end) - 1] + 1
        step = np.zeros(len(codes) + 1, np.int8)
        step[begin], step[end] = 1, -1
        own = codes[np.cumsum(step[:-1], dtype=np.int8) > 0]
        wide = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        at = np.concatenate([[0], np.cumsum(end - begin)])
        offsets = np.concatenate([[0], np.cumsum(wide)])[at].astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(own.tobytes().decode("utf-32-le").encode()))
        return begin, end, self.signs.ends(codes), tokens

    def cut(self, docs: pa.Array, some: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        """Tokens of whole texts; a sign that no piece has stands between them."""
        if not some:
            return
        codes = np.frombuffer("\n".join([text for _, text in some]).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(text) for _, text in some], np.int64)
        origin = np.cumsum(lengths + 1) - lengths - 1
        begin, end, ends, tokens = self._found(codes)
        text = np.searchsorted(origin, begin, "right") - 1
        first = np.searchsorted(text, np.arange(len(some)))
        columns = [np.array([k for k, _ in some], np.int64)[text], np.arange(len(begin)) - first[text], begin - origin[text], end - origin[text], ends[begin], ends[end]]
        yield self._taken(docs, columns, tokens, ends[(origin + lengths)[text]], 0)

    def cut_long(self, docs: pa.Array, doc: int, text: str) -> Iterator[pa.RecordBatch]:
        """Tokens of one text, cut where no piece goes on; the last two wait for those that follow."""
        part, size, at, seen, place = ROWS * _SIGNS, len(text), 0, 0, 0
        columns, kept = [np.zeros(0, np.int64)] * 6, pa.array([], pa.string())
        while at < size:
            to = min(at + part, size)
            while to < size and _PIECE(text[to - 1]):
                to += 1
            begin, end, ends, tokens = self._found(np.frombuffer(text[at:to].encode("utf-32-le"), np.uint32))
            fresh = [np.full(len(begin), doc), place + np.arange(len(begin)), begin + at, end + at, ends[begin] + seen, ends[end] + seen]
            columns, kept = [np.concatenate(c) for c in zip(columns, fresh, strict=True)], pa.concat_arrays([kept, tokens])
            place, at, seen = place + len(begin), to, seen + int(ends[-1])
            wait = 2 if at < size else 0
            if len(kept) > wait:
                yield self._taken(docs, columns, kept, np.full(len(kept), seen), wait)
                columns, kept = [c[len(c) - wait :] for c in columns], kept[len(kept) - wait :]

    def _taken(self, docs: pa.Array, columns: list[np.ndarray], token: pa.Array, ends: np.ndarray, keep: int) -> pa.RecordBatch:
        """All rows but the last ``keep``, whose followers are not known yet; ``ends`` are the sentence ends of their texts."""
        doc, place, start, end, first, last = columns
        known, size = len(token), len(token) - keep
        # The last token of a text has no follower, boundary or not.
        same = np.zeros(known, bool)
        same[:-1] = doc[1:] == doc[:-1]
        closes = ends > last
        closes[:-1] = np.where(same[:-1], first[1:] > last[:-1], closes[:-1])
        one = ~closes & same
        two = one.copy()
        two[:-1] &= one[1:]
        two[-1:] = False
        at = np.arange(size)
        if self.reach is not None:
            sizes = self.reach.sizes(token, one, two)[:size] if known else np.zeros(0, np.int32)
            at = np.flatnonzero(sizes)
        ints = lambda c: pa.array(c, pa.int32())
        out = [docs.take(pa.array(doc[at])), ints(place[at]), token.take(pa.array(at)), ints(start[at]), ints(end[at]), pa.array(closes[at])]
        for k, ok in ((1, one[at]), (2, two[at])):
            follow = np.minimum(at + k, max(known - 1, 0))
            out += [token.take(pa.array(follow, mask=~ok)), pa.array(end[follow], pa.int32(), mask=~ok)]
        names = [c.split()[0] for c in AHEAD.split(", ")]
        if self.reach is not None:
            out, names = [*out, ints(sizes[at])], [*names, "sizes"]
        return pa.RecordBatch.from_arrays(out, names)


def windows(tokens: DataFrame, language: Language, exact_fold: bool = False, heard: bool = False) -> DataFrame:
    """``doc_id, i, n, start, end, raw, folded, run`` of runs of one to three tokens within a sentence.

    Of tokens with ``sizes`` only the windows that it has a bit for, with ``heard`` those that may sound like a code.

    ``folded`` is the normalised text, ``run`` the same with single spaces; with ``exact_fold`` a column
    ``plain`` has the folded text without number words.
    """
    if "token_1" not in tokens.columns:
        tokens = _followed(tokens)
    sized = ["sizes"] if "sizes" in tokens.columns else []
    # Tokens are folded before they are joined, not once for each window that they stand in.
    follow = ["token", "token_1", "token_2"]
    rows = tokens.select("doc_id", "i", "start", "end", "end_1", "end_2", *sized, *follow, *[fold_part(F.col(c), language).alias(f"part{k}") for k, c in enumerate(follow)])
    rows = rows.select("*", *[has_number_word(F.col(f"part{k}"), language).alias(f"number{k}") for k in range(NGRAMS)])
    options: list[Column] = []
    for n in range(1, (PHONETIC_NGRAMS if heard else NGRAMS) + 1):
        number = F.lit(False)
        for k in range(n):
            number = number | F.col(f"number{k}")
        end = F.col(f"end_{n - 1}" if n > 1 else "end")
        raw, plain = F.concat_ws(" ", *follow[:n]), F.trim(F.concat_ws(" ", *[f"part{k}" for k in range(n)]))
        stands = end.isNotNull()
        if sized:
            stands = stands & (F.col("sizes").bitwiseAND(F.lit(1 << (n - 1 + NGRAMS * heard))) != 0)
        options.append(F.when(stands, F.struct(F.lit(n).alias("n"), end.alias("end"), raw.alias("raw"), plain.alias("plain"), number.alias("number"))))
    rows = rows.select("doc_id", "i", "start", F.explode(F.array(*options)).alias("w")).where("w is not null")
    single = lambda c: F.when(F.col(c).contains("  "), collapse(F.col(c))).otherwise(F.col(c))
    folded = F.when(F.col("w.number"), fold_numbers(F.col("w.plain"), language)).otherwise(F.col("w.plain"))
    rows = rows.select("doc_id", "i", F.col("w.n").alias("n"), "start", F.col("w.end").alias("end"), F.col("w.raw").alias("raw"), F.col("w.plain").alias("plain"), folded.alias("folded"))
    rows = rows.withColumn("run", single("folded"))
    return rows.withColumn("plain", single("plain")) if exact_fold else rows.drop("plain")


def _followed(tokens: DataFrame) -> DataFrame:
    """Tokens that came without their followers in the sentence, with them."""
    order = Window.partitionBy("doc_id").orderBy("i")
    ahead = lambda c, k: F.lead(c, k).over(order)
    rows = tokens.select("doc_id", "i", "token", "start", "end", "closes", *[ahead(c, k).alias(f"{c}_{k}") for c in ("token", "end", "closes") for k in (1, 2)])
    one, two = ~F.col("closes"), ~F.col("closes") & ~F.col("closes_1")
    return rows.withColumns({f"{c}_{k}": F.when(ok, F.col(f"{c}_{k}")) for c in ("token", "end") for k, ok in ((1, one), (2, two))})
