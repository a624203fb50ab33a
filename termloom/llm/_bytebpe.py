"""Byte-level BPE as finite-state machines: a compiled pre-tokenizer and a merge transducer.

The pre-tokenizer is a deterministic transducer over character classes. Each transition says whether a
piece starts before the current or before the previous character. A buffer of texts is cut into chunks;
every chunk's map from start states to end states is computed in lock step with all others, the maps are
composed by a parallel prefix scan, and a last lock-step pass emits the starts. Classes are read off the
library's own pre-tokenizer, so they follow its Unicode tables.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from ._shared import quiet_tokenizers, release

LETTER, STMD, RV, ELL, E, NUMBER, OTHER, QUOTE, BLANK, WHITE, END = range(11)
CLASSES = 11
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, BLANK1, WHITE1, BLANK2, WHITE2, AT_QUOTE, QUOTE_RV, QUOTE_L, CUT = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # outputs: a piece starts at this character; at the one before

_LETTERS = (LETTER, STMD, RV, ELL, E)
_FRESH = {**dict.fromkeys(_LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: AT_QUOTE, BLANK: BLANK1, WHITE: WHITE1, END: START}
_JOINED = {**dict.fromkeys(_LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHER, QUOTE: IN_OTHER}


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and output. A run of white space gives its last character to what follows it; a contraction
    after a quote is known only one or two letters later, hence the delayed outputs."""
    fresh = (_FRESH[kind], HERE)
    if state in (BLANK1, WHITE1, BLANK2, WHITE2):
        if kind in (BLANK, WHITE):
            return (BLANK2 if kind == BLANK else WHITE2), 0
        if kind == END:
            return START, HERE
        late = BEFORE if state in (BLANK2, WHITE2) else 0
        return (_JOINED[kind], late) if state in (BLANK1, BLANK2) else (_FRESH[kind], HERE | late)
    if state == IN_LETTERS and kind in _LETTERS or state == IN_NUMBERS and kind == NUMBER:
        return state, 0
    if state in (IN_OTHER, AT_QUOTE) and kind in (OTHER, QUOTE):
        return IN_OTHER, 0
    if state == AT_QUOTE and kind in (STMD, RV, ELL):
        return {STMD: CUT, RV: QUOTE_RV, ELL: QUOTE_L}[kind], 0
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else ELL):
            return CUT, 0
        return (IN_LETTERS, BEFORE) if kind in _LETTERS else (_FRESH[kind], HERE | BEFORE)
    return fresh


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    steps = [_step(s, k) for s in range(STATES) for k in range(CLASSES)]
    return np.array([s for s, _ in steps], np.uint8), np.array([o for _, o in steps], np.uint8)


@functools.cache
def character_classes(path: str) -> np.ndarray:
    """The class of every code point, found by asking the library how it splits the character's surroundings."""
    from tokenizers import Tokenizer

    quiet_tokenizers()
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    for point in [*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)]:
        c = chr(point)
        if len(split(f"a{c}a")) == 1:
            table[point] = LETTER
        elif len(split(f"1{c}1")) == 1:
            table[point] = NUMBER
        elif len(split(f"!{c}!")) != 1:
            table[point] = WHITE
    for letters, kind in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", E), ("'", QUOTE), (" ", BLANK)):
        for c in letters:
            table[ord(c)] = kind
    return table


def piece_starts(kinds: np.ndarray, most_lanes: int = 4096) -> np.ndarray:
    """Positions where a piece starts, by lock-step runs over chunks and a prefix scan of their state maps."""
    step, out = _tables()
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64)
    lanes = max(1, min(most_lanes, n // 64))
    width = -(-n // lanes)
    grid = np.full(lanes * width, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, width).T)
    # Each lane's map: all start states at once until they agree, which takes a few characters.
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (lanes, STATES)).copy()
    j = 0
    while j < min(width, 16):
        maps = step[maps.astype(np.intp) * CLASSES + grid[j][:, None]]
        j += 1
    apart = np.flatnonzero((maps != maps[:, :1]).any(1))
    some, one = maps[apart], maps[:, 0].copy()
    for k in range(j, width):
        one = step[one.astype(np.intp) * CLASSES + grid[k]]
        if len(apart):
            some = step[some.astype(np.intp) * CLASSES + grid[k][apart][:, None]]
    maps = np.repeat(one[:, None], STATES, 1)
    maps[apart] = some
    # Inclusive prefix scan: after it, maps[k] is the map of chunks 0 to k.
    reach = 1
    while reach < lanes:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    flags = np.empty((width, lanes), np.uint8)
    for k in range(width):
        at = state.astype(np.intp) * CLASSES + grid[k]
        flags[k] = out[at]
        state = step[at]
    flags = np.ascontiguousarray(flags.T).ravel()[:n]
    starts = (flags & HERE).astype(bool)
    starts[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


class Pretokenizer:
    """Pieces of many texts at once, with the special string as a piece of its own."""

    def __init__(self, classes: np.ndarray, special: tuple[str, ...]) -> None:
        self.classes, self.special = classes, special

    def pieces(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All pieces in order, and how many each text has."""
        found = [t for t in texts if any(s in t for s in self.special)]
        if found:
            return self._with_specials(texts)
        whole = "\x00".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kinds = self.classes[points]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends[:-1]] = END
        starts = piece_starts(kinds)
        stops = np.append(starts[1:], len(whole))
        keep = np.ones(len(starts), bool)
        keep[np.searchsorted(starts, ends[:-1])] = False
        starts, stops = starts[keep], stops[keep]
        counts = np.diff(np.searchsorted(starts, ends), prepend=0)
        return [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], counts

    def _with_specials(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        import re

        cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pieces, counts = [], []
        for text in texts:
            before = len(pieces)
            for part in cut.split(text):
                if part in self.special:
                    pieces.append(part)
                elif part:
                    pieces += self.pieces([part])[0]
            counts.append(len(pieces) - before)
        return pieces, np.array(counts, np.int64)


class MergeTransducer:
    """Counts the tokens of a piece byte by byte.

    The encoding of a prefix ends in one token, and what is before that token is the encoding of a shorter
    prefix; a token may follow another if no merge would have crossed their border. So each byte is a
    transition to the state of the longer prefix, and its output is the change of the number of tokens.
    States are those of a trie of the bytes read so far, made when first reached.
    """

    def __init__(self, path: str, most_states: int = 400_000) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte = {c: b for b, c in byte_symbols().items()}
        raw = lambda piece: bytes(to_byte[c] for c in piece)
        vocab = model["vocab"]
        self.back: dict[int, int] = {}  # trie of tokens read backwards: node * 256 + byte -> node
        self.token_at: dict[int, tuple[int, int]] = {}  # node -> token, length
        nodes = 1
        for piece, token in vocab.items():
            node, data = 0, raw(piece)
            for b in reversed(data):
                key = node << 8 | b
                if key not in self.back:
                    self.back[key], nodes = nodes, nodes + 1
                node = self.back[key]
            self.token_at[node] = token, len(data)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank of its merge
        for r, (a, b) in enumerate(merges):
            self.parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.fits: dict[int, bool] = {}
        self.most_states = most_states
        self._clear()

    def _clear(self) -> None:
        self.next: dict[int, int] = {}  # state * 256 + byte -> state
        self.last, self.up, self.count, self.byte = [-1], [0], [0], [0]

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens at the border from the last merge to the first, each with the rank at which it is merged away."""
        spine, until = [], 1 << 60
        while True:
            spine.append((token, until))
            if token not in self.parts:
                return spine
            left, other, until = self.parts[token]
            token = other if right else left

    def may_follow(self, first: int, second: int) -> bool:
        """Whether the library would leave the border between two tokens alone."""
        key = first << 20 | second
        found = self.fits.get(key)
        if found is None:
            found = True
            for a, a_until in self._spine(first, True):
                for b, b_until in self._spine(second, False):
                    # Of equal merges the left one comes first: the first token's own goes before, the second's after.
                    r = self.rank.get(a << 20 | b)
                    if r is not None and r < a_until and r <= b_until:
                        found = False
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def _grow(self, state: int, byte: int) -> int:
        made = len(self.last)
        self.next[state << 8 | byte] = made
        node, at, back, b = 0, state, self.back, byte
        while True:
            node = back.get(node << 8 | b, 0)
            if not node:
                raise ValueError("a byte without a token")
            hit = self.token_at.get(node)
            if hit is not None and (self.last[at] < 0 if not at else self.may_follow(self.last[at], hit[0])):
                break
            b, at = self.byte[at], self.up[at]
        self.last.append(hit[0])
        self.up.append(state)
        self.byte.append(byte)
        self.count.append(self.count[at] + 1)
        return made

    def tokens(self, piece: bytes) -> int:
        """Runs the transducer over one piece and adds up its outputs."""
        if len(self.last) > self.most_states:
            self._clear()
        state, step = 0, self.next
        for b in piece:
            after = step.get(state << 8 | b)
            state = self._grow(state, b) if after is None else after
        return self.count[state]


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(other)}}


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


#: What a worker process remembers between its tasks, by vocabulary: two generations of pieces.
_REMEMBERED: dict[str, list[dict]] = {}


class Remembered:
    """Facts about pieces that are dear to compute, kept for the worker's next tasks in two generations.

    When the younger generation is full it becomes the older one, and what is used again moves back, so
    common pieces stay. The bound is on memory; nothing depends on what is kept.
    """

    def __init__(self, key: str, most: int = 250_000) -> None:
        self.generations, self.most = _REMEMBERED.setdefault(key, [{}, {}]), most

    def turned(self) -> list[dict]:
        """The younger and the older generation, after the younger has become the older if it was full."""
        if len(self.generations[0]) > self.most:
            self.generations[:] = {}, self.generations[0]
        return self.generations

    def holding(self, pieces: list[str], compute) -> dict:
        """A dictionary that holds at least these pieces; ``compute`` gives the values of a list of others."""
        young, old = self.turned()
        missing = []
        for piece in set(pieces).difference(young):
            value = old.get(piece)
            if value is None:
                missing.append(piece)
            else:
                young[piece] = value
        young.update(zip(missing, compute(missing), strict=True))
        return young


class Library:
    """The tokenizers library on pieces that are split already, many in one call."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        quiet_tokenizers()
        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        bare["normalizer"], bare["post_processor"], bare["added_tokens"] = None, None, []
        bare["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.library = Tokenizer.from_str(json.dumps(bare))
        suffix = bare["model"]["end_of_word_suffix"] or ""
        vocab = bare["model"]["vocab"]
        #: Bytes that each token stands for (a symbol is a byte; the mark of a word's end is none).
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, token in vocab.items():
            self.sizes[token] = len(piece.removesuffix(suffix) if suffix else piece)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each piece's ids end. Each piece's bytes tell which ids are its own."""
        flat, ends, before = [], [], 0
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            ids = np.array(self.library.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            bytes_read = np.cumsum(self.sizes[ids])
            wanted = np.cumsum(np.fromiter((len(p.encode()) for p in part), np.int64, len(part)))
            if len(part) and (not len(ids) or bytes_read[-1] != wanted[-1]):
                raise ValueError("the vocabulary leaves bytes out")
            ends.append(np.searchsorted(bytes_read, wanted) + 1 + before)
            flat.append(ids)
            before += len(ids)
        empty = np.zeros(0, np.int64)
        return np.concatenate(flat or [empty.astype(np.uint32)]), np.concatenate(ends or [empty])


def forget() -> None:
    """Gives back what a worker remembers of pieces, for tasks of operators that have no use for it."""
    if any(map(any, _REMEMBERED.values())):
        _REMEMBERED.clear()
        release()


class PieceIds:
    """Ids of pieces by the library, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        self.library, self.special, self.remembered = Library(path), special_tokens(path), Remembered(f"ids {path}", 180_000)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """A dictionary that holds at least these pieces."""
        return self.remembered.holding(pieces, self._encoded)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        plain = [p for p in pieces if p not in self.special]
        flat, ends = self.library.encode(plain)
        raw, at, out = flat.astype("<u4").tobytes(), 0, {}
        for p, end in zip(plain, (4 * ends).tolist(), strict=True):
            out[p], at = raw[at:end], end
        return [out[p] if p in out else np.array([self.special[p]], "<u4").tobytes() for p in pieces]
