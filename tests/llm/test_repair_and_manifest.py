from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from termloom.llm import conversation_repair, merkle
from termloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(tuple(r[c] for c in order) for r in got.collect()) == key(want.select(*[f'"{c}"' for c in order]).fetchall())


def faults_of(rows):
    seen, out = set(), ""
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out += "b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    return out


def brute_force(rows, most_inserts=4):
    """Every way to edit, the cheapest first and then by its edits."""
    faults, heap = faults_of(rows), [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, sha("\n".join(lines))
        if audit.count("I") < most_inserts:
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 5, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, lines))
        if faults[i] not in "bd":
            charge = 5 * (faults[i] == "t")
            heapq.heappush(heap, (cost + charge, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(heap, (cost + charge + 1, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))


def digest_rows(rows):
    turns = [t for t, _, _ in rows if t is not None]
    faults, initials = faults_of(rows), [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, digest = brute_force(rows)
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest


@pytest.fixture(scope="module")
def conversations():
    rng, out = random.Random(5), {}
    texts = ["Yes.", "No!", "And then", "", " \t", "Why? ", "so"]
    for c in [*range(60), None]:
        rows = [(rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown"]), rng.choice(texts)) for _ in range(rng.randint(0, 6))]
        out[c] = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    return out


@pytest.mark.parametrize("sizes", [{}, {"segment_rows": 2}, {"segment_bytes": 1}])
def test_repair_equals_brute_force(spark, conversations, sizes):
    rows = [(c, *r, "x") for c, own in conversations.items() for r in own]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string").repartition(3)
    every = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_digests(df, every, **sizes).collect()}
    assert got == {c: digest_rows(own) for c, own in conversations.items()}


def test_one_long_conversation_is_mended_in_segments(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"text {k}.") for k in range(3000)] + [(7, 3000, "assistant", "text 5."), (7, 3001, None, None)]
    mended = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), segment_rows=100)
    found = sorted(mended.collect(), key=lambda r: r["segment"])
    assert len(found) > 30 and max(len(r["before"]) for r in found) <= 100
    assert "".join(r["edits"] for r in found) == "K" * 3000 + "DD" and sum(r["cost"] for r in found) == 4
    assert [t["text"] for r in found for t in r["repaired"]] == [r[3] for r in rows[:3000]]


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two?") for c in range(30) for t in (None, *range(3))] + [(None, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, conversation_repair.damaged(df).collect())) == sorted(f"Row(conv_id={a!r}, turn={b!r}, role={r!r}, text={x!r})" for a, b, r, x in want)
    only = df.where("conv_id = 1 and turn = 0").select("conv_id", "turn", "role", "text")
    gone = only.where("false")
    assert [tuple(r) for r in conversation_repair.repair_digests(gone, only).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert conversation_repair.repair_damaged(gone).count() == 0


def manifest_of(rows, arity):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(map(enc, (r[0], r[2], r[3], r[4] if r[4] is None else r[4] + more, r[1]))))

    def levels(row):
        out = [row]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + arity])) for k in range(0, len(out[-1]), arity)])
        return out

    def sides(tree, at):
        for level in tree[:-1]:
            first = at // arity * arity
            yield "".join(level[first:at]), "".join(level[at + 1 : first + arity])
            at //= arity

    langs = sorted({r[3] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[3] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    high = levels([trees[x][-1][0] for x in langs])
    for n, x in enumerate(langs):
        for at, r in enumerate(own[x]):
            path = [*sides(trees[x], at), *sides(high, n)]
            tampered = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            fold = leaf(r, int(tampered))
            for a, b in path:
                fold = sha(a + fold + b)
            yield r[0], leaf(r), trees[x][-1][0], high[-1][0], sha("".join(a + b for a, b in path)), fold, fold == high[-1][0]


@pytest.mark.parametrize(("arity", "span"), [(2, 10), (2, 2), (3, 1), (4, 2)])
def test_manifest_equals_brute_force(spark, arity, span):
    rng = random.Random(arity)
    rows = [(k, rng.choice(["é" * k, "", None]), rng.choice(["web", None]), rng.choice(["en", "en", "fr", None, "", "ü"]), rng.choice([None, k, 10**12])) for k in range(75)]
    rows += [(200, "alone", "web", "zz", 5), rows[4], rows[4], (None, None, None, None, None), (None, "x", None, "en", 3)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, at int, total int").repartition(3)
    got = merkle.manifest(df, arity, span).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(r) for r in manifest_of(rows, arity))
    assert {r["verified"] for r in got} == {True, False}


def test_a_manifest_of_nothing_and_of_one(spark, nothing):
    assert merkle.manifest(nothing).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(3, "a", "b", "c", 1)], "doc_id long, text string, source string, lang string, n_chars long")).collect()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == sha("")
