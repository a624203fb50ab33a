from __future__ import annotations

import random

import numpy as np
import pytest

from termloom.llm import bayes_dedup
from termloom.llm.near_dedup import shingles
from termloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_force(rows, words=3, percent=85):
    """Component and set size of every row, all pairs of sets compared."""
    sets = []
    for _, text in rows:
        own = (text or "").encode().lower().split()
        sets.append({tuple(own[k : k + words]) for k in range(len(own) - words + 1)} if len(own) >= words else {tuple(own)} if own else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=str)


def result(df, **sizes):
    return sorted((tuple(r) for r in bayes_dedup.near_duplicates(df, **sizes).collect()), key=str)


def test_classes_of_the_edge_corpus_equal_brute_force(spark, docs, corpus, nothing):
    assert result(docs) == brute_force(corpus)
    assert bayes_dedup.near_duplicates(nothing).count() == 0


@pytest.fixture(scope="module")
def chain():
    """Copies that drift a word at a time, so that most pairs of a bucket don't link but all are one component, and
    copies of a base that no two of them share."""
    rng = random.Random(3)
    text = [f"v{rng.randrange(5000)}" for _ in range(90)]
    rows = []
    for k in range(160):
        text = list(text)
        text[rng.randrange(90)] = f"n{k}"
        rows.append((k, " ".join(text)))
    base = [f"u{rng.randrange(5000)}" for _ in range(120)]
    rows.append((1000, " ".join(base)))
    for k in range(120):
        own = list(base)
        for at in rng.sample(range(120), 2):
            own[at] = f"m{k}-{at}"
        rows.append((1001 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 16}, {"stars": 0, "block": 24}, {"stars": 1, "block": 8}])
def test_no_link_is_lost_in_large_buckets(spark, chain, sizes):
    df = spark.createDataFrame(chain, "doc_id long, text string").repartition(3)
    assert result(df, **sizes) == brute_force(chain)


def test_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_minhash_near_dedup"](spark, DATA).collect()), key=str)
    assert got == brute_force(rows)


def test_links_are_verified_on_words(spark, chain):
    """Signatures that always agree make candidates of everything; only words decide."""
    rows = chain[::8]
    content = spark.createDataFrame([(k, bytes(512), bayes_dedup.pack(text.encode())) for k, (_, text) in enumerate(rows)], "class long, sign binary, body binary")
    pairs = spark.createDataFrame([(i, j) for i in range(len(rows)) for j in range(i)], "a long, b long")
    want, sets = set(), [set(s.tolist()) for s in shingles([t for _, t in rows], 3)]
    for i, a in enumerate(sets):
        want |= {(i, j) for j in range(i) if 100 * len(a & sets[j]) >= 85 * len(a | sets[j])}
    got = {tuple(r) for r in bayes_dedup._verified(pairs, content, 3, 85, 1e-6).collect()}
    assert got == want and 0 < len(want) < len(rows) * (len(rows) - 1) / 2


def test_signatures_drop_what_cannot_link_and_keep_what_does():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1000, np.uint64)
    for changed, kept in ((0, True), (60, True), (600, False), (1000, False)):
        other = base.copy()
        other[:changed] = rng.integers(0, 1 << 63, changed, np.uint64)
        left, right = (bayes_dedup.signatures([s]) for s in (base, other))
        assert (len(bayes_dedup.alive(left, right, 85, 1e-6)) == 1) is kept
        assert abs((left == right).mean() - (1000 - changed) / (1000 + changed)) < 0.15
    # The posterior falls with fewer matches, and a smaller chance of a miss keeps more.
    assert bayes_dedup.least_matches(32, 85, 1e-9) < bayes_dedup.least_matches(32, 85, 1e-3) < 32


def test_overlaps_equal_sets():
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randint(0, 30))], np.int64)) for _ in range(20)]
    got = [row.tolist() for row in bayes_dedup.overlaps(sets, sets)]
    assert got == [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
