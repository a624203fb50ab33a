"""Exact top-k inner products by best-first search in M-trees."""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch, one_thread

#: Relative slack of floating-point distances in comparisons that discard something.
SLACK = 1e-9
#: Numbers that single precision holds exactly.
EXACT = float(1 << 24)
NONE = -(1 << 62)


class MetricTree:
    """An M-tree over integer vectors, lifted to equal length so that nearer means a larger inner product.

    With R the largest norm, x becomes (x, sqrt(R^2 - |x|^2)) and a query q becomes (q, 0): the squared
    distance is |q|^2 + R^2 - 2 q.x. A page holds either routing entries (object, covering radius, distance
    to the parent's object, child page) or leaf entries (object, distance to the parent's object).
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = 64, fanout: int = 12, seed: int = 1) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.norms = (self.vectors * self.vectors).sum(1)
        self.top = float(self.norms.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.top - self.norms, 0))
        self.page, self.fanout = page, fanout
        #: (is leaf, objects, radii or None, distances to parent's object, children or None)
        self.pages: list[tuple] = []
        self.root = self._build(np.arange(len(self.ids)), None, np.random.default_rng(seed)) if len(self.ids) else -1

    def _between(self, one: int, many: np.ndarray) -> np.ndarray:
        dots = self.vectors[many] @ self.vectors[one]
        squares = self.norms[many] + self.norms[one] - 2.0 * dots + (self.lift[many] - self.lift[one]) ** 2
        return np.sqrt(np.maximum(squares, 0))

    def _build(self, members: np.ndarray, parent: int | None, rng: np.random.Generator) -> int:
        if len(members) > self.page:
            chosen = rng.choice(members, min(self.fanout, len(members)), replace=False)
            near = np.stack([self._between(int(p), members) for p in chosen])
            owner = near.argmin(0)
            groups = [(int(p), members[owner == k], near[k][owner == k]) for k, p in enumerate(chosen) if (owner == k).any()]
            if len(groups) > 1:
                objects = np.array([p for p, _, _ in groups])
                radii = np.array([d.max() for _, _, d in groups])
                children = [self._build(m, p, rng) for p, m, _ in groups]
                return self._add(False, objects, radii, parent, np.array(children))
            # All members are equally near to one object (copies): a chain of leaf pages under it.
            p, own, _ = groups[0]
            parts = [own[a : a + self.page] for a in range(0, len(own), self.page)]
            children = [self._add(True, part, None, p, None) for part in parts]
            radii = np.array([self._between(p, part).max() for part in parts])
            return self._add(False, np.full(len(parts), p), radii, parent, np.array(children))
        return self._add(True, members, None, parent, None)

    def _add(self, leaf: bool, objects: np.ndarray, radii: np.ndarray | None, parent: int | None, children: np.ndarray | None) -> int:
        distances = np.zeros(len(objects)) if parent is None else self._between(parent, objects)
        self.pages.append((leaf, objects, radii, distances, children))
        return len(self.pages) - 1

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best scores and ids of each query but its own id, ties to smaller ids (``NONE`` where there
        are fewer, or no more that reach the query's ``least`` score); and how many distances were computed.

        Queries walk the tree together: the page with the least bound of any query comes next, and of its
        entries those are computed that some query's stored distances don't rule out. A query leaves a page that
        its own bound rules out.
        """
        n = len(queries)
        scores, found = np.full((n, k), NONE, np.int64), np.full((n, k), (1 << 63) - 1, np.int64)
        if self.root < 0 or not n:
            return scores, found, 0
        queries = queries.astype(np.float64)
        sizes = (queries * queries).sum(1)
        # Single precision is exact as long as no partial sum can leave the numbers that it holds.
        small = math.sqrt(float(sizes.max()) * self.top) < EXACT
        kind = np.float32 if small else np.float64
        asked, vectors = queries.astype(kind), self.vectors.astype(kind)
        base = sizes + self.top
        far = lambda score, rows: np.sqrt(np.maximum(base[rows] - 2.0 * score, 0)) * (1 + SLACK) + SLACK
        floor = np.full(n, NONE, np.int64) if least is None else least
        limit = np.where(floor > NONE, far(floor.astype(np.float64), slice(None)), np.inf)
        everyone, computed, tick = np.arange(n), 0, 0
        queue: list[tuple] = [(0.0, 0, self.root, everyone, np.zeros(n), None)]
        while queue:
            bound, _, number, rows, bounds, to_parent = heapq.heappop(queue)
            if bound > limit.max():
                break
            here = np.flatnonzero(bounds <= limit[rows])
            if not len(here):
                continue
            rows = rows[here]
            leaf, objects, radii, distances, children = self.pages[number]
            keep = slice(None)
            if to_parent is not None:
                # Triangle inequality with stored distances: no need to compute what can't be near enough.
                apart = np.abs(distances - to_parent[here][:, None])
                possible = (apart if leaf else apart - radii) <= limit[rows][:, None]
                columns = possible.any(0)
                if not columns.any():
                    continue
                keep = np.flatnonzero(columns)
                some = possible.any(1)
                rows = rows[some]
            chosen = objects[keep]
            dots = asked[rows] @ vectors[chosen].T
            computed += dots.size
            if leaf:
                self._merge(scores, found, limit, floor, far, rows, dots, self.ids[chosen], own_ids, k)
            else:
                apart = np.sqrt(np.maximum(base[rows][:, None] - 2.0 * dots.astype(np.float64), 0))
                low = np.maximum(apart - radii[keep], 0) * (1 - SLACK)
                open_ = low <= limit[rows][:, None]
                for c, child in enumerate(children[keep].tolist()):
                    own = np.flatnonzero(open_[:, c])
                    if len(own):
                        tick += 1
                        heapq.heappush(queue, (float(low[own, c].min()), tick, child, rows[own], low[own, c], apart[own, c]))
        return scores, found, computed

    @staticmethod
    def _merge(scores, found, limit, floor, far, rows, dots, ids, own_ids, k) -> None:
        """Takes a leaf's scores into the best so far."""
        own = ids[None] == own_ids[rows][:, None]
        least = np.maximum(scores[rows, k - 1], floor[rows])
        better = np.flatnonzero(((dots >= least[:, None]) & ~own).any(1))
        if not len(better):
            return
        rows = rows[better]
        new = np.where(own[better] | (dots[better] < floor[rows][:, None]), NONE, dots[better].astype(np.int64))
        every = np.concatenate([scores[rows], new], 1)
        names = np.concatenate([found[rows], np.where(new > NONE, ids[None], (1 << 63) - 1)], 1)
        order = np.lexsort((names, -every), axis=1)[:, :k]
        scores[rows], found[rows] = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        last = np.maximum(scores[rows, k - 1], floor[rows])
        full = last > NONE
        limit[rows[full]] = far(last[full].astype(np.float64), rows[full])


def quantised(embedding: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component as integers (in doubles, whose products are exact at these sizes)."""
    return np.floor(256.0 * embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)


def stored(values: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of three types, which its size tells."""
    out: list[bytes] = []
    for row in values:
        top = np.abs(row).max(initial=0)
        out.append(row.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64).tobytes())
    return out


def loaded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    kinds = {2 * width: np.int16, 4 * width: np.int32, 8 * width: np.float64}
    rows = [np.frombuffer(x.as_py(), kinds[len(x.as_py())]) for x in column]
    return np.array(rows, np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, tree_size: int = 8192, query_block: int = 4096, most_regions: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest integer inner products of every query.

    Components become floor(256 x). Queries are the rows whose ``vec_id`` is divisible by ``every``;
    candidates are all rows of another id and of the same dimension. Ties go to the smaller id. Null vectors,
    vectors with null or non-finite components, empty ones and null ids take no part; repeated rows of one id
    and vector are one; further columns are left out; an empty table gives no rows.

    Rows fall into regions, by the nearest of at most ``most_regions`` vectors of each dimension (those of a
    sample, of the smallest id hashes), and a region into trees of about ``tree_size`` vectors. A block of at
    most ``query_block`` queries of a region searches a tree of its own region first; its queries' scores of
    rank ``k`` are then what the other trees have to reach. Every query meets every tree of its dimension, as a
    block against a tree, and only what may still enter its best ``k`` comes back. Vectors spread evenly over
    many dimensions are all about equally far from each other: there bounds rule out little, and the work
    grows with queries times rows, done as products of small matrices.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(whole).where(F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("width", F.size("embedding"))
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    wanted = widths.select("width", F.least(F.lit(most_regions), F.ceil(F.col("n") / tree_size)).cast("int").alias("regions"))
    order = Window.partitionBy("width").orderBy(F.xxhash64("vec_id"), "vec_id")
    # A sample of the smallest hashes: partial ranks keep what each task sends at most ``most_regions`` rows a width.
    sample = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_regions).join(wanted, "width").where("place <= regions").select("width", "embedding", "place")
    pivots: dict[int, list] = {}
    for r in sample.orderBy("width", "place").toLocalIterator():
        pivots.setdefault(r["width"], []).append(r["embedding"])
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    routing = spark.sparkContext.broadcast({w: np.floor(256.0 * np.array(v, np.float64)) for w, v in pivots.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w in np.unique(width).tolist():
                own = batch.filter(pa.array(width == w))
                values, lead = quantised(own.column("embedding"), w), routing.value[w]
                region = ((lead * lead).sum(1) - 2.0 * (values @ lead.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), pa.array(np.full(len(own), w), pa.int32()), pa.array(region, pa.int32()), pa.array(stored(values), pa.binary())], ["vec_id", "width", "region", "vector"])

    placed = scratch.write(rows.mapInArrow(place, "vec_id long, width int, region int, vector binary"), "placed")
    sizes = placed.groupBy("width", "region").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / tree_size).cast("int")).drop("n")
    dealt = placed.join(sizes, ["width", "region"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))

    def grow(key: tuple, group: pa.Table) -> pa.Table:
        one_thread()
        width, region, part = (x.as_py() for x in key)
        tree = MetricTree(*_unique(group.column("vec_id").to_numpy(), loaded(group.column("vector"), width)))
        tree.vectors = tree.vectors.astype(np.int16) if np.abs(tree.vectors).max(initial=0) < 1 << 15 else tree.vectors
        return pa.table({"width": pa.array([width], pa.int32()), "region": pa.array([region], pa.int32()), "part": pa.array([part], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    trees = scratch.write(dealt.groupBy("width", "region", "part").applyInArrow(grow, "width int, region int, part int, tree binary"), "trees")
    asked = placed.where(F.col("vec_id") % every == 0)
    counts = asked.groupBy("width", "region").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks"))
    asked = asked.join(counts, ["width", "region"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int")).drop("blocks")

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        width, region, block = (x.as_py() for x in key)
        ids, values = _unique(group.column("vec_id").to_numpy(), loaded(group.column("vector"), width))
        least = dict(zip(group.column("vec_id").to_pylist(), group.column("least").to_pylist(), strict=True)) if "least" in group.column_names else {}
        floor = np.array([NONE if least.get(i) is None else least[i] for i in ids.tolist()], np.int64)
        return pa.table({"width": pa.array([width], pa.int32()), "home": pa.array([region], pa.int32()), "block": pa.array([block], pa.int32()), "asked": pa.array([pickle.dumps((ids, values, floor))], pa.binary())})

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for asked_, tree_ in zip(batch.column(0), batch.column(1), strict=True):
                ids, values, floor = pickle.loads(asked_.as_py())
                tree = pickle.loads(tree_.as_py())
                for low in range(0, len(ids), 512):
                    part = slice(low, low + 512)
                    scores, found, _ = tree.search(values[part], ids[part], k, floor[part])
                    query = np.repeat(ids[part], k)
                    real = scores.ravel() > NONE
                    yield pa.RecordBatch.from_arrays([pa.array(x[real], pa.int64()) for x in (query, found.ravel(), scores.ravel())], ["query_id", "vec_id", "score"])

    shape, block_shape = "query_id long, vec_id long, score long", "width int, home int, block int, asked binary"
    # The first tree of the queries' own region.
    first = asked.groupBy("width", "region", "block").applyInArrow(gather, block_shape)
    home = first.join(trees.where("part = 0"), ["width"]).where(F.col("home") == F.col("region"))
    near = scratch.write(home.select("asked", "tree").mapInArrow(seek, shape), "near")
    # A score of rank k is what another tree's must reach; a query of repeated id has the least of its vectors'.
    repeated = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows"))
    least = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).join(repeated, F.col("query_id") == F.col("vec_id")).where((F.col("n") == k) & (F.col("rows") == 1)).select(F.col("query_id").alias("vec_id"), "least")
    blocks = scratch.write(asked.join(least, "vec_id", "left").groupBy("width", "region", "block").applyInArrow(gather, block_shape), "blocks")
    pairs = blocks.select("width", "home", "block").join(trees.select("width", "region", "part"), "width").where("home != region or part != 0")
    rest = pairs.repartition("width", "home", "block", "region", "part").join(blocks, ["width", "home", "block"]).join(trees, ["width", "region", "part"])
    found = near.union(rest.select("asked", "tree").mapInArrow(seek, shape))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unique(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows without those that repeat an id and its vector."""
    order = np.lexsort((*values.T[::-1], ids))
    ids, values = ids[order], values[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1]).any(1)
    return ids[new], values[new]
