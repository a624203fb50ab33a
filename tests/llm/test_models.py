from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import lm_scoring, toxicity
from termloom.llm._attention import BLOCK, AttentionModel, Symbols, blocks
from termloom.llm._shared import pack
from termloom.llm.word_bpe import code_ids


def small_model(kinds: int = 20, members: int = 4, seed: int = 0) -> AttentionModel:
    rng = np.random.default_rng(seed)
    symbols = Symbols(rng.integers(0, 50, 30), rng.random(30) < 0.5, 5, kinds, members)
    return AttentionModel.fresh(symbols, 6, 8, seed)


def drawn(model: AttentionModel, n: int, seed: int = 1) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.flatnonzero(model.symbols.frequency >= 0), (n, BLOCK))


def test_gradients():
    rng, model = np.random.default_rng(0), small_model()
    model.params = {k: v.astype(np.float64) + np.where(v > -1e8, rng.standard_normal(v.shape) * 0.1, 0) for k, v in model.params.items()}
    inputs, targets, real = drawn(model, 4), drawn(model, 4, 2), rng.random((4, BLOCK)) > 0.3
    fresh = np.array([True, False, True, False])
    _, gradients = model.gradients(inputs, fresh, targets, real)
    for name, value in model.params.items():
        flat = value.ravel()
        for j in rng.integers(0, flat.size, 4):
            old = flat[j]
            flat[j] = old + 1e-5
            up = model.gradients(inputs, fresh, targets, real)[0]
            flat[j] = old - 1e-5
            down = model.gradients(inputs, fresh, targets, real)[0]
            flat[j] = old
            assert (up - down) / 2e-5 == pytest.approx(gradients[name].ravel()[j], abs=1e-6)


def test_scoring_is_the_trained_function_and_sums_to_one():
    model = small_model()
    every = np.flatnonzero(model.symbols.frequency >= 0)
    inputs = np.tile(drawn(model, 3), (len(every), 1))
    fresh = np.arange(len(inputs)) % 3 == 0
    targets = np.repeat(every, 3)[:, None] + np.zeros((1, BLOCK), np.int64)
    logs, begun = model.log_probabilities(inputs, fresh, targets, most=4 * BLOCK)
    logs = logs.reshape(len(every), 3, BLOCK)
    assert np.exp(logs.astype(np.float64)).sum(0) == pytest.approx(np.ones((3, BLOCK)), abs=1e-4)
    starts = model.symbols.begins[every // model.symbols.members]
    assert np.exp(logs[starts].astype(np.float64)).sum(0).ravel() == pytest.approx(np.exp(begun[: 3 * BLOCK]), abs=1e-4)
    loss, _ = model.gradients(inputs, fresh, targets, np.ones(inputs.shape, bool))
    assert -logs.mean() == pytest.approx(loss, abs=1e-4)
    later = inputs.copy()
    later[:, 5:] = every[0]  # what comes later changes nothing
    again, _ = model.log_probabilities(later, fresh, targets)
    assert np.allclose(again.reshape(len(every), 3, BLOCK)[:, 0, :5], logs[:, 0, :5], atol=1e-5)


def test_blocks_score_each_position_once_with_half_a_window_before():
    lengths = np.array([0, 1, 5, 32, 33, 56, 64, 400])
    flat = np.arange(lengths.sum()) + 1
    inputs, fresh, targets, real, token = blocks(flat, lengths, 0)
    assert (token[real] == np.arange(len(flat))).all() and (targets[real] == flat).all()
    starts = set((np.cumsum(lengths) - lengths).tolist())
    assert all(i == (0 if t in starts else t) for i, t in zip(inputs[real].tolist(), token[real].tolist(), strict=True))
    assert fresh.sum() == (lengths > 0).sum()
    model = small_model()
    x = drawn(model, 2)
    before = model.log_probabilities(x, np.array([True, False]), x)[0][BLOCK:]
    x[0, 1] = x[0, 0] + (x[0, 0] == x[0, 1])
    assert (model.log_probabilities(x, np.array([True, False]), x)[0][BLOCK:] != before).any()


def test_training_learns_a_pattern():
    symbols = Symbols(np.ones(9, np.int64), np.arange(9) % 2 == 0, 5, 9, 4)
    ids = symbols.of[np.arange(9)]
    rng = np.random.default_rng(3)
    data = ids[(np.arange(BLOCK + 1)[None] + rng.integers(0, 8, (1200, 1))) % 8]
    model = AttentionModel.fresh(symbols)
    rest = (data[:, :-1], np.ones(1200, bool), data[:, 1:], np.ones((1200, BLOCK), bool))
    losses = model.train(*rest, updates=150, batch=64)
    assert losses[-1] < 0.3 < losses[0]
    held = model.params["qkv"].copy()
    model.train(*rest, through=False)
    assert (model.params["qkv"] == held).all()


def chunk_of(texts: list[str], counts: dict[str, int]) -> tuple[lm_scoring.Lookup, AttentionModel, np.ndarray]:
    """A chunk whose words are their letters, a blank in front (id 0); the other ids are a to h."""
    rows = lm_scoring.numbered(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}))
    words = rows.column("words")[0].as_py().decode().split("\n")
    ids = [[0, *(ord(c) - 96 for c in w)] for w in words]
    head = code_ids(np.concatenate(ids), np.array([len(i) for i in ids]))
    reply = len(head).to_bytes(8, "little") + head + pack(np.array([counts.get(w, 0) for w in words], np.uint64).tobytes())
    symbols = Symbols(np.arange(9)[::-1].copy() * 3, np.arange(9) == 0, 4, 9, 4)
    firsts = np.zeros(9, np.int64)
    firsts[0] = sum(counts.values())
    return lm_scoring.Lookup(rows, {0: reply}, 1, 4), AttentionModel.fresh(symbols), firsts


def test_chances_of_next_words_sum_to_at_most_one():
    counts = {"ab": 5, "abc": 2, "b": 7}
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abcdefgh", repeat=n)]
    texts = [f"ab b {w}" for w in words] + ["ab b"]
    chunk, model, firsts = chunk_of(texts, counts)
    rng = np.random.default_rng(5)
    model = model.filled(model.flat() + np.where(model.flat() > -1e8, rng.standard_normal(len(model.flat())) * 0.3, 0))
    mixture = lm_scoring.Mixture(chunk, model, firsts, sum(counts.values()) + 4)
    (_, per_row, which), *more = chunk.slabs(np.ones(len(texts), bool))
    assert not more
    parts, _ = mixture.parts(per_row, which)
    third = np.cumsum(per_row) - per_row + 2
    sums = np.exp(parts[:, third]).sum(1)
    assert (sums <= 1.0001).all() and sums[1:3] == pytest.approx([1, 1], abs=1e-4) and sums[0] > 0.2


def test_what_symbols_tell_is_made_once_for_each():
    model = small_model()
    told, p, d = model._told(), model.params, model.width
    assert told.shape == (len(model.symbols.frequency), 4 * d)
    assert told[:, 2 * d : 3 * d] == pytest.approx(p["embed"] @ p["qkv"][:, 2 * d :] @ p["mix"], abs=1e-5)
    inputs = drawn(model, 5)
    f = model._inside(inputs, np.array([True, False, True, False, False]), told)
    assert (f["v"][:, BLOCK:] == told[inputs][..., 2 * d : 3 * d]).all()
    assert f["y"].shape == (inputs.size, d + 1) and (f["y"][:, d] == 1).all()


def test_words_of_a_chunk_in_several_pieces():
    odd = ["", " ", "\t\n\v\f\r ", "a b", " A  Ab\xa0c \x1c\x1d\x85 d\u2003e ", "\u0130 É ABC\x00 x", "Z" * 50, "\ufeff b\rb", "a\n\nb ", "жИзнь"]
    batch = pa.table({"doc_id": pa.array([*range(9), None], pa.int64()), "text": odd}).to_batches()[0]
    rows = pa.Table.from_batches([batch.slice(3, 4), batch.slice(0, 2), batch.slice(2, 0), batch.slice(7), batch.slice(2, 1)])
    chunk = lm_scoring.Numbered(lm_scoring.numbered(rows), 3)
    words = chunk.words.as_py().split(b"\n")
    want = [t.encode().lower().split() for t in rows.column("text").to_pylist()]
    assert chunk.ids == rows.column("doc_id").to_pylist() and chunk.sizes.tolist() == [len(w) for w in want]
    assert [words[k] for k in chunk.numbers] == [w for row in want for w in row] and len(set(words)) == len(words)
    assert sorted(w.encode() for _, own, _ in chunk.lists() for w in own) == sorted(words)
    assert not list(lm_scoring.Numbered(lm_scoring.numbered(pa.table({"doc_id": [1], "text": [" "]})), 3).lists())


def test_every_training_row_teaches_the_whole_model_and_fits_the_weights():
    counts = {"ab": 5, "abc": 2, "b": 7}
    chunk, model, firsts = chunk_of(["ab b abc " * 30, "b", "", "ab abc cab"] * 5, counts)
    held, size = model.params["qkv"].copy(), len(model.flat())
    learned = np.arange(20) % 4 != 3
    got = lm_scoring.taught(chunk, model, learned, firsts, 18)
    assert (got[:size] / got[size]).astype(np.float32) == pytest.approx(model.flat()) and (model.params["qkv"] != held).all()
    assert got[size + 1 :].sum() == pytest.approx((chunk.sizes + 1)[learned].sum())
    assert len(lm_scoring.taught(chunk, model, learned, firsts, 18, updates=3)) == size + 1


def test_training_tells_what_the_model_gave_before_it_learned():
    model = small_model()
    inputs, targets, fresh = drawn(model, 21), drawn(model, 21, 2), np.ones(21, bool)
    want, told = model.log_probabilities(inputs, fresh, targets), (np.zeros(21 * BLOCK, np.float32), np.zeros(21 * BLOCK, np.float32))
    model.train(inputs, fresh, targets, np.ones(inputs.shape, bool), batch=8, rate=0.0, told=told)
    assert np.allclose(told[0], want[0], atol=1e-5) and np.allclose(told[1], want[1], atol=1e-5)


def test_scores(docs, corpus, nothing):
    got = lm_scoring.score_documents(docs, updates=40, chunk_bytes=20_000).collect()
    counts: Counter = Counter()
    for i, t in corpus:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            counts.update([*(t or "").encode().lower().split(), "end"])
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in corpus:
        words = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        want[i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), total, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_scoring.score_documents(nothing).count() == 0


def test_shipped_scores_beat_the_base_on_held_out_rows_and_stay_finite(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000_000 + k, f"{'qz' * (10_000 if k == 1 else 100)} {k}") for k in range(14)], "doc_id long, text string")
    got = lm_scoring.score_documents(rows.union(odd)).toPandas()
    assert zlib.crc32(b"10000001") % 7 == 2 and np.isfinite(got.score).all()
    held = got[got.held_out & (got.doc_id < 10_000_000)]
    assert held.score.sum() > held.base_score.sum()


LETTERS = toxicity.CharacterModel(Counter(g for w in ["idiot", "moron", "worthless", "scum", "little", "better", "hello", "the", "and", "this"] * 20 for g in toxicity.trigrams(w)))


@pytest.mark.parametrize(("noisy", "word"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("5cuuuum", "scum"), ("w0rthle$$", "worthless"), ("idiiiiot", "idiot"), ("hello", "hello")])
def test_restoration(noisy, word):
    assert toxicity.decode(noisy, LETTERS) == word


@pytest.mark.parametrize(("text", "found"), [("you i d i o t now", ["idiot"]), ("a m.o.r.o.n!", ["moron"]), ("plain words, 2024 and 5 km", []), ("an id1ot and sooo", ["id1ot", "sooo"])])
def test_disguises(text, found):
    assert toxicity.spaced_runs(text) + toxicity.disguised(text) == found


ODD = toxicity.ToxicityModel(LETTERS, {"idiot$": 9.0, "moron$": 7.0})
FAR = "/".join(["hello"] * 12)


@pytest.mark.parametrize(("text", "evidence"), [("an idi" + "i" * 50 + "ot", 9), (f"{FAR}/1d10t/{FAR}/m0r0n", 16), (" ".join("hello" * 14 + "1d10t"), 9), ("the " + "z" * 4000 + " m0r0n", 7), ("hello/the/" * 9, 0)])
def test_disguises_of_any_length_count(text, evidence):
    assert ODD.evidence([text]) == [evidence]


@pytest.mark.parametrize(("text", "evidence"), [("an idio7", 9), ("an idio7, really", 9), ("(m0r0n)", 7), ("an iddioott", 9), ("moronn", 7), ("hello little better $5 and 7", 0)])
def test_last_signs_and_doubled_letters_count(text, evidence):
    assert ODD.evidence([text]) == [evidence]


def test_known_clean_words_are_no_disguises():
    known = toxicity.ToxicityModel(LETTERS, {"idiot$": 9.0}, known=frozenset(["iddiott"]))
    assert known.evidence(["an iddiott", "an iddioott"]) == [0, 9]


def test_marks_hold_all_that_is_found():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab²٣½5$!(é. -_\n日"), rng.integers(1, 9))) for _ in range(4000)]
    for text, mark in zip(texts, toxicity.marks(texts).tolist(), strict=True):
        assert mark & toxicity.HAS_SIGN or not toxicity.disguised(text, toxicity.HAS_SIGN)
        assert mark & toxicity.HAS_STRETCH or not toxicity.disguised(text, toxicity.HAS_STRETCH)
        assert mark & toxicity.HAS_GAPS or not toxicity.spaced_runs(text)


def test_letters_come_from_all_documents(spark):
    rows = [(k, f"alpha beta Gamma{'x' * (k % 50)}") for k in range(200)] + [(None, "жизнь alpha alpha"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(g for _, t in rows for w in set(toxicity.WORD.findall((t or "").lower())) for g in toxicity.trigrams(w))
    assert toxicity.letter_counts(docs) == toxicity.letter_counts(docs, most_held=3) == want
    marks = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.fit(docs, marks).letters.three == want


def test_toxicity_scores(spark, nothing, labels):
    filler = [f"alpha{k} beta gamma{k % 7} delta you" for k in range(300)]
    rows = [(k, t + (" moron" if k % 8 == 0 else " idiot" if k % 4 == 0 else "")) for k, t in enumerate(filler)]
    rows += [(1000, "such an 1d10t"), (1001, "such a i d i o t"), (1002, None), (1003, ""), (1004, "z" * 4000), (None, "alpha")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, toxic string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks, support=1).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in range(300))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    assert got[1000]["predicted"] == got[1001]["predicted"] == 1
    assert got[1002]["predicted"] == got[1003]["predicted"] == got[1004]["predicted"] == 0
    assert toxicity.score_toxicity(nothing, marks).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, none).collect()} == {0}
