"""Near duplicates: all links of at least a Jaccard similarity, by T-occurrence search with DivideSkip."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, spanning_roots
from ._bytebpe import forget
from ._shared import CHUNK_BYTES, Scratch, bucket_count, chunks, each_chunk, exchange, free_name, id_and_text, marked, pack_sorted, release, shared_marks, split_hashes, unpack_sorted, with_replies

MARK_BITS = 44
#: Calls of the block search for each bucket of hashes: they grow with the corpus, their size does not.
SHARES_A_BUCKET = 64
#: A shingle of more classes than this is met in 16 salted parts first.
COMMON_POSTINGS = 4096
SALTS = 16


def shingles(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``words`` words (a shorter text is one run)."""
    digest = xxhash.xxh3_64_intdigest
    split = [t.encode().lower().split() for t in texts]  # bytes: only A-Z and ASCII white space count
    counts = [len(s) for s in split]
    with np.errstate(over="ignore"):
        flat = np.fromiter((digest(w) for s in split for w in s), np.uint64, sum(counts))
        runs = np.zeros(max(0, len(flat) - words + 1), np.uint64)
        for k in range(words):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(runs)]
        runs = _mixed(runs)
        out, at = [], 0
        for n in counts:
            if n >= words:
                own = np.sort(runs[at : at + n - words + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif n:
                whole = np.uint64(n)
                for h in flat[at : at + n]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + h
                out.append(_mixed(np.array([whole])))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class OccurrenceIndex:
    """Inverted lists of sets of hashes, searched for all sets of at least a Jaccard similarity."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.sizes = sizes
        member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, self.members = values[order], member[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.keys, self.low, self.high = values[first], first, np.append(first[1:], len(values))
        self.longest = int((self.high - self.low).max(initial=1))

    def search(self, own: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose overlap with ``own`` (of a set of ``size``) reaches ``percent`` of the union.

        A member that small sets allow must be in at least T lists. The L longest lists are set aside, the
        short ones are merged (as runs of a merge sort; a heap gives the same counts, one posting at a time), and members in at least T - L of them are looked up in the long ones by
        binary search.
        """
        need = math.ceil(percent * size / 100)
        if len(own) < need or not len(self.keys):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        if len(at) < need:
            return np.zeros(0, np.int64)
        length = self.high[at] - self.low[at]
        at = at[np.argsort(length, kind="stable")]
        longest = min(need - 1, int(need / (0.01 * math.log2(self.longest + 1) + 1)), len(at))
        short, far = at[: len(at) - longest], at[len(at) - longest :]
        member, count = self._merged(short)
        enough = count >= need - longest
        member, count = member[enough], count[enough].copy()
        # |a & b| * (100 + p) >= p * (|a| + |b|) says the same as |a & b| / |a | b| >= p / 100.
        wanted = -(-percent * (size + self.sizes[member]) // (100 + percent))
        fits = (100 * self.sizes[member] >= percent * size) & (percent * self.sizes[member] <= 100 * size)
        member, count, wanted = member[fits], count[fits], wanted[fits]
        for k, left in zip(far.tolist(), range(longest - 1, -1, -1), strict=True):
            if not len(member):
                break
            posting = self.members[self.low[k] : self.high[k]]
            spot = np.minimum(np.searchsorted(posting, member), len(posting) - 1)
            count += posting[spot] == member
            alive = count + left >= wanted
            if not alive.all():
                member, count, wanted = member[alive], count[alive], wanted[alive]
        return member[count >= wanted]

    def _merged(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the lists in order and in how many each is: a natural merge of the lists, which are the
        runs of a stable sort."""
        parts = [self.members[a:b] for a, b in zip(self.low[lists].tolist(), self.high[lists].tolist(), strict=True)]
        every = np.sort(np.concatenate([*parts, self.members[:0]]), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        return every[first], np.diff(first, append=len(every))


def links_between(sets: list[np.ndarray], sizes: np.ndarray, queries: np.ndarray, targets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs of a query position and a target position."""
    index = OccurrenceIndex([sets[i] for i in targets.tolist()], sizes[targets])
    left, right = [], []
    for q in queries.tolist():
        found = targets[index.search(sets[q], int(sizes[q]), percent)]
        found = found[found != q]
        left.append(np.full(len(found), q))
        right.append(found)
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, chunk_bytes: int = CHUNK_BYTES, block: int = 300, pivots: int = 24, common: int = COMMON_POSTINGS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: a row per row, with the smallest id its links reach.

    Rows link when their sets of distinct word shingles have a Jaccard similarity of at least ``percent``
    hundredths. A row without words links with nothing. Null texts are empty, rows that repeat an id each
    give their row, a null id is a row whose component is that of the other ids it links with (else null),
    further columns are left out, an empty table gives no rows.

    1. Chunks learn which of their shingles another chunk or row has. A row of which fewer than ``percent``
       hundredths are shared can't link. Equal sets become one class.
    2. Among classes each shingle's frequency is counted, and classes that share one of the rarest shingles
       of both (the prefix that any link must share) fall into one cluster.
    3. Within a cluster T-occurrence search finds all links: in blocks of about ``block`` classes plus some
       ``pivots`` of the cluster in each, then between blocks, but not between blocks whose members the first
       part already joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    table = chunks(scratch, id_and_text(docs), chunk_bytes)
    buckets = bucket_count(table)

    def chunk_sets(rows: pa.Table) -> list[np.ndarray]:
        texts, out, at, size = rows.column(1).to_pylist(), [], 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size > 1 << 20 or k + 1 == len(texts):
                out += shingles(texts[at : k + 1], words)
                at, size = k + 1, 0
        return out

    def distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        every = np.sort(np.concatenate([s >> np.uint64(64 - MARK_BITS) for s in sets])) if sets else np.zeros(0, np.uint64)
        if not len(every):
            return every, np.zeros(0, bool)
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return every[first], np.diff(first, append=len(every)) > 1

    def ask_marks(rows: pa.Table, n: int, _: dict[int, bytes]) -> Iterable[tuple[int, bytes]]:
        return [(b, pack_sorted(part)) for b, part in split_hashes(distinct(chunk_sets(rows))[0], n, MARK_BITS)]

    def shared_sets(_: int, rows: pa.Table, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        forget()
        sets = chunk_sets(rows)
        every, twice = distinct(sets)
        twice |= marked(every, replies, buckets, MARK_BITS)
        prints, held = [], []
        for own in sets:
            prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            shared = own[twice[np.searchsorted(every, own >> np.uint64(64 - MARK_BITS))]] if len(own) else own
            held.append(shared.tobytes() if len(own) and 100 * len(shared) >= percent * len(own) else None)
        yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks().cast(pa.int64()) if rows.num_rows else pa.array([], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "n_shingles", "print", "shared"])

    marks = exchange(table, buckets, ask_marks, shared_marks)
    sets = scratch.write(each_chunk(with_replies(table, marks), shared_sets, "doc_id long, n_shingles long, print binary, shared binary"), "sets")
    scratch.drop("chunks")

    least = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    classes = sets.where("shared is not null").groupBy("print").agg(F.min("doc_id").alias("least_id"), F.min_by(F.struct("n_shingles", "shared"), least).alias("set"))
    # In buckets of the class, so that the sets aren't shuffled when the searches join them.
    classes = classes.select(F.monotonically_increasing_id().alias("class"), "print", "least_id", F.col("set.n_shingles").alias("size"), F.col("set.shared").alias("shared"))
    classes = scratch.write_bucketed(classes, "classes", "class")
    root = _link_classes(scratch, classes, percent, block, pivots, common)
    named = classes.select("class", "print", "least_id").join(root, F.col("class") == F.col("id"), "left").withColumn("root", F.coalesce("root", "class"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component"))
    by_print = named.select("print", "root").join(names, "root").select("print", "component")
    slim = sets.select("doc_id", "n_shingles", "print")
    joined = slim.join(by_print, "print", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result = scratch.write(joined, "result")
    scratch.drop("sets", "classes", "links")
    return result


def _link_classes(scratch: Scratch, classes: DataFrame, percent: int, block: int, pivots: int, common: int) -> DataFrame:
    """``id, root`` of the classes that have a link."""
    table = chunks(scratch, classes.select("class", "size", "shared"), 2 << 20, measure="shared")
    buckets = bucket_count(table)
    shares = SHARES_A_BUCKET * buckets

    def opened(rows: pa.Table) -> tuple[list[int], list[int], list[np.ndarray]]:
        return rows.column(0).to_pylist(), rows.column(1).to_pylist(), [np.frombuffer(s, np.uint64) for s in rows.column(2).to_pylist()]

    def counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def ask_counts(rows: pa.Table, n: int, _: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        every, count = counted(opened(rows)[2])
        at = 0
        for b, part in split_hashes(every, n, 64):
            head = pack_sorted(part)
            yield b, len(head).to_bytes(8, "little") + head + count[at : at + len(part)].astype(np.uint32).tobytes()
            at += len(part)

    def answer_counts(lists: list[bytes]) -> tuple[list[bytes], tuple[int, int]]:
        parts = []
        for x in lists:
            n = int.from_bytes(x[:8], "little")
            parts.append((unpack_sorted(x[8 : 8 + n]), np.frombuffer(x, np.uint32, offset=8 + n)))
        every, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, where, np.concatenate([c for _, c in parts]).astype(np.int64))
        return [np.minimum(total[np.searchsorted(every, v)], (1 << 32) - 1).astype(np.uint32).tobytes() for v, _ in parts], (0, 0)

    def prefixes(_: int, rows: pa.Table, replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        ids, sizes, sets = opened(rows)
        every, _count = counted(sets)
        total = np.concatenate([np.frombuffer(replies[b], np.uint32) for b, _ in split_hashes(every, buckets, 64)]) if len(every) else np.zeros(0, np.uint32)
        left, right, salt = [], [], []
        for i, n, own in zip(ids, sizes, sets, strict=True):
            often = total[np.searchsorted(every, own)]
            shared, often = own[often > 1], often[often > 1]
            # The order is by frequency, then hash; shingles of this class alone come first and match nothing.
            take = n - math.ceil(percent * n / 100) + 1 - (n - len(shared))
            if take > 0:
                first = np.lexsort((shared, often))[:take]
                left.append(shared[first])
                right.append(np.full(len(first), i))
                salt.append(np.where(often[first] > common, i % SALTS, -1))
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left).view(np.int64)), pa.array(np.concatenate(salt), pa.int32()), pa.array(np.concatenate(right), pa.int64())], ["hash", "salt", "class"])

    counts = exchange(table, buckets, ask_counts, answer_counts)
    postings = each_chunk(with_replies(table, counts), prefixes, "hash long, salt int, class long")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links the classes that share a hash, within the task's share of hashes: an edge a class at most (with
        a null hash). What is left of a salted hash is its least class here, beside the hash."""
        held = [tuple(b.column(c).to_numpy() for c in ("hash", "salt", "class")) for b in batches]
        if held:
            hashes, salts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            del held
            order = np.lexsort((ids, salts, hashes))
            hashes, salts, ids = hashes[order], salts[order], ids[order]
            start = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (salts[1:] != salts[:-1])])
            lead = ids[np.maximum.accumulate(np.where(start, np.arange(len(ids)), 0))]
            nodes, roots = spanning_roots(ids, lead)
            apart = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.nulls(int(apart.sum()), pa.int64()), pa.array(nodes[apart]), pa.array(roots[apart])], ["hash", "a", "b"])
            salted = start & (salts >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[salted]), pa.array(ids[salted]), pa.array(ids[salted])], ["hash", "a", "b"])

    # Postings are dealt once; of a common hash, parts meet first, then their least classes.
    first = postings.repartition(buckets, "hash", "salt").mapInArrow(stars, "hash long, a long, b long")
    first = scratch.write(first, "leads")
    rest = first.where("hash is not null").select("hash", F.lit(-1).alias("salt"), F.col("a").alias("class")).repartition(buckets, "hash").mapInArrow(stars, "hash long, a long, b long")
    # Written first, so that a task never runs two Python workers one behind the other.
    edges = scratch.write(first.where("hash is null").union(rest).select("a", "b"), "edges")
    cluster = scratch.write(components(scratch, edges, "cluster").distinct().select(F.col("id").alias("class"), F.col("root").alias("cluster")), "clusters")
    scratch.drop("leads", "edges", "chunks")

    # Blocks of a cluster, and its pivots in every block.
    count = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    placed = cluster.join(count, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    pivot = F.pmod(F.xxhash64("class", F.lit(1)), "n") < pivots
    homes = F.when(pivot & (F.col("blocks") > 1), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = placed.select("class", "cluster", F.explode(homes).alias("left"))
    content = classes.select("class", "size", "shared")
    links = _search(scratch, inside.withColumn("right", F.lit(-1).cast("long")).withColumn("side", F.lit(0)), content, percent, "inside", shares)

    # What is left: clusters of several blocks that the links so far have not joined into one.
    wide = placed.where("blocks > 1").select("class", "cluster")
    if wide.limit(1).count():
        part = components(scratch, links, "part").distinct().select(F.col("id").alias("class"), "root")
        wide = scratch.write(wide.join(part, "class", "left").select("class", "cluster", F.coalesce("root", "class").alias("part")), "wide")
        sizes = wide.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
        alone = F.col("n") >= block
        rest = sizes.where(~alone).groupBy("cluster").agg(F.sum("n").alias("rest"))
        sizes = sizes.join(rest, "cluster", "left")
        # A large part has blocks of its own; what remains of a cluster shares mixed blocks (part null).
        parts = sizes.select("cluster", "part", F.when(alone, F.col("part")).alias("own"), F.greatest(F.lit(1), F.ceil(F.when(alone, F.col("n")).otherwise(F.col("rest")) / block)).alias("k"))
        spot = wide.join(parts, ["cluster", "part"]).withColumn("own", F.coalesce("own", F.lit(-1).cast("long"))).withColumn("slot", F.pmod(F.xxhash64("class"), "k"))
        named = spot.select("class", "cluster", "own", F.xxhash64("cluster", "own", "slot").alias("here"))
        kinds = named.groupBy("cluster", "own", "here").agg(F.count(F.lit(1)).alias("n"))
        there = kinds.select("cluster", F.col("own").alias("other"), F.col("here").alias("there"))
        # Pairs of blocks, not of rows; two blocks of one joined part have nothing to tell.
        todo = scratch.write(kinds.join(there, "cluster").where("here <= there and (own = -1 or own != other)").select("cluster", "here", "there"), "pairs")
        sides = todo.select(F.explode(F.when(F.col("here") == F.col("there"), F.array(F.struct(F.col("here").alias("at"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("here").alias("at"), F.lit(0).alias("side")), F.struct(F.col("there").alias("at"), F.lit(1).alias("side"))))).alias("s"), F.col("here").alias("left"), F.when(F.col("here") != F.col("there"), F.col("there")).alias("right"))
        sides = sides.select("s.at", "s.side", "left", F.coalesce("right", F.lit(-1).cast("long")).alias("right"))
        across = named.join(sides, F.col("here") == F.col("at")).select("class", "cluster", "left", "right", "side")
        links = links.union(_search(scratch, across, content, percent, "across", shares))
        scratch.drop("wide", "pairs")
    found = scratch.write(components(scratch, links, "final").distinct(), "roots")
    scratch.drop("clusters", "inside", "across")
    return found


def _search(scratch: Scratch, placed: DataFrame, content: DataFrame, percent: int, name: str, shares: int) -> DataFrame:
    """``a, b``: a spanning set of the links that the searches of all blocks (or pairs of blocks) find.

    Blocks are dealt to ``shares``, so that many small clusters make up one call.
    """

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("cluster", "ascending"), ("left", "ascending"), ("right", "ascending"), ("side", "ascending"), ("class", "ascending")])
        cluster, left, right, side, ids, sizes = (order.column(c).to_numpy() for c in ("cluster", "left", "right", "side", "class", "size"))
        sets = [np.frombuffer(s, np.uint64) for s in order.column("shared").to_pylist()]
        out_a, out_b = [], []
        new = np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        cuts = np.append(np.flatnonzero(new), len(ids))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here, there = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
            q, t = links_between(sets[a:b], sizes[a:b], here, there if right[a] != -1 else here, percent)
            if len(q):
                nodes, roots = spanning_roots(ids[a:b][q], ids[a:b][t])
                out_a.append(nodes)
                out_b.append(roots)
        del order, sets
        release()
        empty = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate(out_a or [empty]), pa.int64()), "b": pa.array(np.concatenate(out_b or [empty]), pa.int64())})

    tasks = placed.withColumn("share", F.pmod(F.xxhash64("cluster", "left", "right"), F.lit(shares)))
    rows = tasks.join(content, "class")
    return scratch.write(rows.groupBy("share").applyInArrow(run, "a long, b long").where("a != b"), name)


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with the row of the smallest id of each component; rows that share an id stand or fall
    together, and a row with a null id stays.

    Null texts, texts without words and texts of any length are as in :func:`near_duplicates`; an empty table stays
    empty; further columns stay, whatever their names.
    """
    own = free_name(docs, "other_id")
    gone = near_duplicates(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(own), "left_anti")
