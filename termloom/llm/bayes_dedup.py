"""Near duplicates by MinHash bands, sequential Bayesian comparison of signatures and exact verification on words."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, spanning_roots
from ._shared import Scratch, WordNumbers, id_and_text, pack, release, slabs, unpack
from .near_dedup import _mixed, shingles

#: Hashes of a signature, hashes that make a band, and hashes that a pair is compared on at a time. At a similarity
#: of 0.85 a pair shares no band with a probability of (1 - 0.85 ** 4) ** 32 = 6e-11.
HASHES, BAND, BATCH = 128, 4, 32
#: Chance with which a linked pair may be dropped on its signatures.
MISS = 1e-6
#: Classes of a block, and turns in which the classes of a band's bucket are held against two of its classes only.
BLOCK, STARS = 512, 1


@functools.cache
def _hashing(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, hashes, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """A row of ``hashes`` 32-bit minima for each set of 64-bit hashes, none of them empty."""
    out = np.empty((len(sets), hashes), np.uint32)
    if sets:
        every = np.concatenate(sets)
        every = (every ^ (every >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        room = np.empty_like(every)
        for k, (a, b) in enumerate(zip(*_hashing(hashes), strict=True)):
            np.multiply(every, a, out=room)
            room += b
            out[:, k] = np.minimum.reduceat(room, starts)
    return out


@functools.cache
def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest matches among ``n`` hashes that leave a chance of ``miss`` that the similarity reaches ``percent``.

    With every similarity equally likely before, m matches make it Beta(m + 1, n - m + 1) distributed, which reaches
    t as often as n + 1 throws of a coin of chance t show m heads at most.
    """
    t, chance = percent / 100, 0.0
    for m in range(n + 1):
        chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if chance >= miss:
            return m
    return n


def alive(left: np.ndarray, right: np.ndarray, percent: int, miss: float, batch: int = BATCH) -> np.ndarray:
    """Places of the pairs of rows that no batch of their signatures rules out; each batch is compared for the pairs
    that the batches before have left."""
    at = np.arange(len(left))
    count = np.zeros(len(left), np.int32)
    hashes = left.shape[1]
    for stop in range(batch, hashes + 1, batch):
        count += (left[at, stop - batch : stop] == right[at, stop - batch : stop]).sum(1, dtype=np.int32)
        stays = count >= least_matches(stop, percent, miss * batch / hashes)
        at, count = at[stays], count[stays]
    return at


def word_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted numbers of each text's runs of ``words`` words: equal numbers are equal words, nothing is hashed."""
    numbers = WordNumbers()
    split = [numbers.of(t.split()).astype(np.int64) for t in texts]
    flat = np.concatenate(split) if split else np.zeros(0, np.int64)
    runs = flat[: max(0, len(flat) - words + 1)]
    for k in range(1, words):
        runs = np.unique(runs << 32 | flat[k : k + len(runs)], return_inverse=True)[1]
    out, at = [], 0
    for own in split:
        out.append(np.unique(runs[at : at + len(own) - words + 1]) if len(own) >= words else np.zeros(0, np.int64))
        at += len(own)
    return out


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set of ``left`` the sizes of its intersections with all of ``right``, by inverted lists."""
    member = np.repeat(np.arange(len(right)), [len(s) for s in right])
    values = np.concatenate(right) if right else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    for own in left:
        low, high = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        size = high - low
        spots = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        yield np.bincount(member[spots], minlength=len(right))


def links(both: np.ndarray, left: np.ndarray | int, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (left + right - both)


def _digest(text: str) -> tuple[bytes, bytes]:
    body = b" ".join(text.encode().lower().split())  # bytes: only A-Z and ASCII white space count
    return hashlib.sha256(body).digest(), body


def band_keys(signs: np.ndarray, band: int) -> np.ndarray:
    """A 64-bit key for each band of each signature, different for equal values of different bands."""
    parts = signs.reshape(len(signs), -1, band).astype(np.uint64)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(band):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys.view(np.int64)


def _sets(docs: DataFrame, words: int, hashes: int, band: int) -> DataFrame:
    """``doc_id, n_shingles, key, bands``: the words' SHA-256 (null without words), the keys of the signature's bands
    (null below ``words`` words, where only equal words link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slabs(batch):
                own = shingles(texts, words)
                bodies = [_digest(t) for t in texts]
                wide = [k for k, (_, body) in enumerate(bodies) if body.count(b" ") >= words - 1 and body]
                keyed: list[np.ndarray | None] = [None] * len(texts)
                for k, row in zip(wide, band_keys(signatures([own[k] for k in wide], hashes), band), strict=True):
                    keyed[k] = row
                keys = [key if body else None for key, body in bodies]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array(keys, pa.binary()), pa.array(keyed, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])
            release()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def _bodies(docs: DataFrame, wanted: DataFrame, words: int, hashes: int) -> DataFrame:
    """``class, sign, body``: signature and words of the classes ``class, key, least_id`` that ``docs`` has by id and
    key. Signatures are made again here, for the few that need them, rather than moved around for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            found = [(k, body) for k, (text, key) in enumerate(zip(texts, keys, strict=True)) for digest, body in [_digest(text)] if digest == key]
            signs = signatures(shingles([texts[k] for k, _ in found], words), hashes)
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("class").take(at), pa.array([row.tobytes() for row in signs], pa.binary()), pa.array([pack(b) for _, b in found], pa.binary())], ["class", "sign", "body"])
            release()

    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["least_id"])).select("class", "key", "text")
    # A row that the table has twice is one class still.
    return rows.mapInArrow(run, "class long, sign binary, body binary").dropDuplicates(["class"])


def _held(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of buckets with the component that they are in so far."""
    if roots is None:
        return members.withColumn("part", F.col("class"))
    return members.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").select("hash", "class", F.coalesce("root", "class").alias("part"))


def _star_pairs(members: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """``a, b``: the classes of each bucket with one class of its least and one of its greatest component."""
    held = _held(members, roots)
    one = F.struct("part", F.xxhash64("class", F.lit(turn)).alias("order"), "class")
    leads = held.groupBy("hash").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.count(F.lit(1)).alias("n"))
    # Of three classes two leaders have met all after the first turn.
    leads = leads.where(F.col("low.part") < F.col("high.part")).where(F.lit(turn == 0) | (F.col("n") > 3))
    met = held.join(leads, "hash").select("class", "part", F.explode(F.array("low", "high")).alias("lead")).where("part <> lead.part")
    return met.select(F.least("class", "lead.class").alias("a"), F.greatest("class", "lead.class").alias("b")).distinct()


def _verified(pairs: DataFrame, content: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """Those of ``a, b`` that link: signatures batch by batch, then the words of what is left."""
    side = lambda x: content.select(F.col("class").alias(x), F.col("sign").alias(f"sign_{x}"), F.col("body").alias(f"body_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
            at = alive(left, right, percent, miss)
            a, b = (batch.column(c).to_numpy()[at] for c in ("a", "b"))
            for low in range(0, len(at), 1024):
                own = at[low : low + 1024]
                number: dict[int, int] = {}
                texts = []
                for ids, bodies in ((a[low : low + 1024], batch.column("body_a")), (b[low : low + 1024], batch.column("body_b"))):
                    for i, k in zip(ids.tolist(), own.tolist(), strict=True):
                        if i not in number:
                            number[i] = len(texts)
                            texts.append(unpack(bodies[k].as_py()))
                sets = word_sets(texts, words)
                x, y = (np.array([number[i] for i in ids[low : low + 1024].tolist()], np.int64) for ids in (a, b))
                both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
                sizes = np.array([len(s) for s in sets], np.int64)
                fine = links(both, sizes[x], sizes[y], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[low : low + 1024][fine]), pa.array(b[low : low + 1024][fine])], ["a", "b"])
            release()

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "sign_a", "body_a", "sign_b", "body_b").mapInArrow(run, "a long, b long")


def _block_links(scratch: Scratch, members: DataFrame, roots: DataFrame | None, content: DataFrame, words: int, percent: int, miss: float, block: int) -> DataFrame | None:
    """``a, b``: links that join the components of buckets of which some are still apart; None if there are none.

    In such a bucket the classes outside its largest component, in blocks, meet each other and the blocks of that
    component; the pairs of a job exist in its task only.
    """
    held = _held(members, roots)
    parts = held.groupBy("hash", "part").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("hash").agg(F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1 and n > 3")
    open_ = scratch.write(open_.select("hash", F.col("top.part").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("rest"), F.ceil(F.col("top.n") / block).alias("large")), "open")
    rows = held.join(open_, "hash")
    spot = lambda k: F.pmod(F.xxhash64("class", "hash"), k)
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    job = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), side.cast("int").alias("side"))
    rest, large = F.col("rest"), F.col("large")
    inner = F.transform(upto(rest), lambda j: job(F.least(j, spot(rest)), F.greatest(j, spot(rest)), j < spot(rest)))
    outer = F.transform(upto(large), lambda j: job(spot(rest), rest + j, F.lit(0)))
    over = F.transform(upto(rest), lambda i: job(i, rest + spot(large), F.lit(1)))
    jobs = rows.select("hash", "class", "part", F.explode(F.when(F.col("part") == F.col("top"), over).otherwise(F.concat(inner, outer))).alias("j")).select("hash", "class", "part", "j.*")
    jobs = scratch.write(jobs, "jobs")
    total = jobs.count()
    if not total:
        return None
    shares = max(8, total // 2048)

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("hash", "ascending"), ("left", "ascending"), ("right", "ascending"), ("side", "ascending"), ("class", "ascending")])
        hashes, left, right, side, ids, part = (order.column(c).to_numpy() for c in ("hash", "left", "right", "side", "class", "part"))
        signs = np.frombuffer(b"".join(order.column("sign").to_pylist()), np.uint32).reshape(len(ids), -1)
        bodies = order.column("body")
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        cuts = np.append(np.flatnonzero(new), len(ids))
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = low + np.flatnonzero(side[low:high] == 0)
            there = low + np.flatnonzero(side[low:high] == 1) if left[low] != right[low] else here
            x, y = (g.ravel() for g in np.meshgrid(here, there, indexing="ij"))
            apart = part[x] != part[y] if left[low] != right[low] else (part[x] != part[y]) & (x < y)
            x, y = x[apart], y[apart]
            stay = alive_of(signs, x, y)
            x, y = x[stay], y[stay]
            if not len(x):
                continue
            some, index = np.unique(np.concatenate([x, y]), return_inverse=True)
            sets = word_sets([unpack(bodies[k].as_py()) for k in some.tolist()], words)
            sizes = np.array([len(s) for s in sets], np.int64)
            x, y = index[: len(x)], index[len(x) :]
            ups, first = np.unique(x, return_index=True)  # x is in order
            for own, begin, end, both in zip(ups.tolist(), first.tolist(), [*first[1:].tolist(), len(x)], overlaps([sets[k] for k in ups.tolist()], sets), strict=True):
                others = y[begin:end]
                found = others[links(both[others], sizes[own], sizes[others], percent)]
                out_a.append(np.full(len(found), ids[some[own]]))
                out_b.append(ids[some[found]])
        nodes, lead = spanning_roots(np.concatenate(out_a), np.concatenate(out_b))
        release()
        return pa.table({"a": pa.array(nodes, pa.int64()), "b": pa.array(lead, pa.int64())})

    def alive_of(signs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for low in range(0, len(x), 1 << 14):
            out.append(low + alive(signs[x[low : low + (1 << 14)]], signs[y[low : low + (1 << 14)]], percent, miss))
        return np.concatenate(out)

    dealt = jobs.withColumn("share", F.pmod(F.xxhash64("hash", "left", "right"), F.lit(shares))).join(content, "class")
    return scratch.write(dealt.groupBy("share").applyInArrow(run, "a long, b long").where("a <> b"), "across")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, miss: float = MISS, hashes: int = HASHES, band: int = BAND, block: int = BLOCK, stars: int = STARS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: a row per row, with the smallest id that its links reach.

    Rows link when their sets of distinct runs of ``words`` words have a Jaccard similarity of at least ``percent``
    hundredths; a row with fewer words is one run, a row without words links with nothing. Null texts are empty,
    rows that repeat an id each give their row, a null id is a row whose component is that of the ids that it links
    with (else null), a text of any length is read whole, further columns are left out, an empty table gives no rows.

    1. Rows of equal words are one class. A class is in a bucket for each of its signature's bands.
    2. Candidates are the pairs of a bucket. Their signatures are compared in batches, and a pair is dropped as soon
       as the chance that it links falls under its batch's part of ``miss``; what is left is verified on the words.
    3. A bucket's classes are first held against one class of its least and of its greatest component, ``stars``
       times; then what is still apart meets in blocks. Pairs within a component tell nothing new and are left out.
    """
    scratch = Scratch(docs.sparkSession, "bayes")
    texts = id_and_text(docs)
    sets = scratch.write(_sets(texts, words, hashes, band), "sets")
    classes = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    spread = classes.where("bands is not null").select("class", F.explode("bands").alias("hash"))
    # Buckets of the same classes in several bands count once.
    seen = spread.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y")).where("n > 1")
    buckets = scratch.write(seen.groupBy("n", "x", "y").agg(F.min("hash").alias("hash")).select("hash"), "buckets")
    members = scratch.write(spread.join(buckets, "hash").select("hash", "class"), "members")
    wanted = classes.select("class", "key", "least_id").join(members.select("class").distinct(), "class", "left_semi").select("class", "key", "least_id")
    content = scratch.write(_bodies(texts, wanted, words, hashes), "content")

    found, roots = None, None
    for turn in range(stars):
        pairs = scratch.write(_star_pairs(members, roots, turn), f"pairs{turn}")
        if pairs.isEmpty():
            break
        new = scratch.write(_verified(pairs, content, words, percent, miss), f"links{turn}")
        found = new if found is None else found.union(new)
        roots = scratch.write(components(scratch, found, f"star{turn}_"), f"roots{turn}")
    across = _block_links(scratch, members, roots, content, words, percent, miss, block)
    if across is not None:
        found = across if found is None else found.union(across)
        roots = scratch.write(components(scratch, found, "final"), "roots")
    named = classes.select("class", "key", "least_id")
    named = named.withColumn("root", F.col("class")) if roots is None else named.join(roots, F.col("class") == F.col("id"), "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component"))
    by_key = named.select("key", "root").join(names, "root").select("key", "component")
    joined = sets.select("doc_id", "n_shingles", "key").join(by_key, "key", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result = scratch.write(joined, "result")
    scratch.drop("sets", "classes", "buckets", "members", "content", "open", "jobs", "across", "roots", *[f"{x}{k}" for x in ("pairs", "links", "roots") for k in range(stars)])
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
