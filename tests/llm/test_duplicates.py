from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from termloom.llm import exact_dedup, near_dedup, repeats
from termloom.llm._components import components
from termloom.llm._shared import Scratch


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 20, 4000).astype(np.uint64) << np.uint64(30) for _ in range(4)]
    build = lambda x: exact_dedup.CountingQuotientFilter.of(*np.unique(x, return_counts=True), 42, 256)
    whole = exact_dedup.CountingQuotientFilter.merged([build(p) for p in parts])
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(whole.values(), values) and np.array_equal(whole.counts, counts)
    again = exact_dedup.CountingQuotientFilter.load(42, *whole.dump())
    assert np.array_equal(again.values(), values)


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(docs, corpus, nothing):
    groups: dict = {}
    for i, t in corpus:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for i, t in corpus:
        own = groups[bare(t)]
        keep = min(own)[3]
        want[i, keep, len(own), i == keep, hashlib.sha256(bare(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == want
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert set(ids) - {None} == {k[1] for k in want if k[1] is not None} and ids[907] <= 1 and ids[None] == 2


def shingle_sets(corpus):
    out = {}
    for i, t in corpus:
        if i is None:
            continue
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        out[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()
    return out


def near_classes(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("block", "pivots", "common"), [(300, 24, 4096), (6, 2, 2)])
def test_near_duplicates(docs, corpus, block, pivots, common):
    sets = shingle_sets(corpus)
    classes = near_classes(sets)
    got = near_dedup.near_duplicates(docs, chunk_bytes=8000, block=block, pivots=pivots, common=common).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), classes[r["doc_id"]]), r["doc_id"]


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.without_near_duplicates(nothing).columns == nothing.columns


@pytest.mark.parametrize("n", range(8))
def test_shingles_of_one_short_text(n):
    (own,) = near_dedup.shingles([" ".join(f"w{k}" for k in range(n))], 5)
    assert len(own) == (max(1, n - 4) if n else 0)


def test_near_duplicates_of_one_text_of_three_words(spark):
    one = spark.createDataFrame([(1, "just three words")], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"], r["n_shingles"]) for r in near_dedup.near_duplicates(one).collect()] == [(1, 1, 1)]


def test_occurrence_search_finds_all_links():
    rng = np.random.default_rng(2)
    base = rng.choice(5000, (6, 60), replace=False).astype(np.uint64)
    sets = []
    for k in range(70):
        own = base[k % 6].copy()
        n = rng.integers(0, 14)
        own[rng.choice(60, n, replace=False)] = rng.integers(5000, 5200, n)
        sets.append(np.unique(own[: rng.integers(40, 61)]))
    sizes = np.array([len(s) for s in sets])
    left, right = near_dedup.links_between(sets, sizes, np.arange(70), np.arange(70), 75)
    want = {(a, b) for a in range(70) for b in range(70) if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(30) if k % 10 != 9] + [(100, 5), (100, 25), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["root"] for r in components(Scratch(spark, "test"), df, "t").distinct().collect()}
    assert got == {**{k: 0 for k in [*range(10), *range(20, 30), 100]}, **{k: 10 for k in range(10, 20)}}


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefgh"])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = np.random.default_rng(3)
    for _ in range(15):
        strings = [bytes(rng.choice(list(alphabet), rng.integers(1, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 20))]
        array = repeats.ColumnwiseSuffixArray(strings)
        suffixes = [strings[o][len(strings[o]) - n :] for o, n in zip(array.owner, array.length.astype(int), strict=True)]
        assert suffixes == sorted(suffixes)
        for a, b, lcp in zip(suffixes, suffixes[1:], array.lcp[1:], strict=False):
            common = 0
            while common < min(len(a), len(b)) and a[common] == b[common]:
                common += 1
            assert lcp == common


def removal(corpus, size=50):
    first: dict = {}
    rows = [((1 << 63) - 1 if i is None else i, i, (t or "").encode()) for i, t in corpus]
    for order, _, data in rows:
        for k in range(len(data) - size + 1):
            first[data[k : k + size]] = min(order, first.get(data[k : k + size], order))
    out = []
    for order, i, data in rows:
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            if first[data[k : k + size]] < order:
                gone[k : k + size] = b"\1" * size
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), sum(gone), sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1])), kept))
    return out


def test_repeats(docs, corpus, nothing):
    want = removal(corpus)
    got = repeats.removal_digests(docs, chunk_bytes=6000)
    assert Counter(tuple(r) for r in got.collect()) == Counter((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want)
    cut = repeats.without_repeats(docs, chunk_bytes=6000)
    assert cut.columns == docs.columns
    texts = Counter((i, t if not n else k.decode("utf-8", "ignore")) for (i, t), (_, _, n, _, k) in zip(corpus, want, strict=True))
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == texts
    assert repeats.removal_digests(nothing).count() == 0 and repeats.without_repeats(nothing).count() == 0
