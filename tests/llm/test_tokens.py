from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termloom.llm import packing, token_counts, word_bpe
from termloom.llm._bytebpe import MergeTransducer, Pretokenizer, character_classes, special_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_machines_count_as_the_library_does():
    rng = random.Random(1)
    signs = "ab's'tlrevdmz  \n\t é1٣.!ñ中́😀<|endoftext|>LLl\x00\x85 "
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["x<|endoftext|> y'll we'res 'l 'r 've", "", " ", "\n", "a" * 5000, " " * 700 + "b", "'" * 90 + "ll"]
    split, machine = Pretokenizer(character_classes(BYTES), tuple(special_tokens(BYTES))), MergeTransducer(BYTES)
    pieces, counts = split.pieces(texts)
    ends = np.cumsum(counts)
    tokens = [sum(1 if p in split.special else machine.tokens(p.encode()) for p in pieces[e - n : e]) for n, e in zip(counts, ends, strict=True)]
    library = Tokenizer.from_file(BYTES)
    assert tokens == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_tokens(docs, corpus, nothing):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for i, t in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert Counter(tuple(r) for r in token_counts.count_tokens(docs).collect()) == want
    assert token_counts.count_tokens(nothing).count() == 0


def test_packing_places_every_token_once(docs, corpus, nothing):
    library = Tokenizer.from_file(BYTES)
    ids = Counter()
    for i, t in corpus:
        ids[i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    rows = packing.pack_documents(docs, size=64).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) * n for (_, x), n in ids.items())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        if r["doc_id"] is not None and r["doc_id"] != 907:
            own = next(x for (i, x), _ in ids.items() if i == r["doc_id"])
            piece = own[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
            assert r["length"] == 64 or r["piece"] == 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.1 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit_over_counts(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 33), 12)}
    plan, total = packing.plan_slots(counts, 32)
    taken = Counter()
    load: dict = {}
    for length, low, high, first, offset in plan:
        taken[length] += high - low
        for s in range(first, first + high - low):
            load.setdefault(s, []).append((offset, length))
    assert taken == counts and len(load) == total
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    # The same greedy rule, one document at a time.
    rooms: list[int] = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(32 - n)
    assert total == len(rooms)


def test_word_encoding_and_decoding(docs, corpus, nothing):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in corpus:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in word_bpe.encoding_digests(docs, chunk_bytes=20_000).collect()) == want
    assert word_bpe.encoding_digests(nothing).count() == 0
    full = {r["doc_id"]: r for r in word_bpe.encode_documents(docs, chunk_bytes=20_000).collect()}
    assert list(full[903]["ids"]) == library.encode(dict(corpus)[903], add_special_tokens=False).ids
