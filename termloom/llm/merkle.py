"""Merkle manifest of documents: leaves, a tree per language, a tree over languages, and lookup proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Nodes that become one, and the levels that one pass builds: a pass gathers at most ARITY ** SPAN digests, and a
#: node is a sibling for at most as many lookups of that pass.
ARITY, SPAN = 2, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**changed: Column) -> Column:
    return digest(*[encoded(changed.get(c, F.col(c))) for c in FIELDS])


def _steps(total: Column, arity: int, span: int) -> Column:
    """Levels that a tree of ``total`` nodes still grows, ``span`` at most."""
    height = F.lit(0)
    for k in range(span):
        height = F.when(total > arity**k, k + 1).otherwise(height)
    return height


def ranked(scratch: Scratch, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``at``, the place of a row within its ``tree`` by ``order``, and the tree's ``total``.

    Rows are sorted by ranges of tree and order, never gathered by tree; a row's place is its place in its range
    plus what earlier ranges hold of the tree.
    """
    by = ["tree", *order]
    placed = scratch.write(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftright("pos", 33))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total"))
    return placed.join(runs, ["tree", "part"]).withColumn("at", F.col("pos") + F.col("shift")).drop("pos", "part", "shift")


def grow(scratch: Scratch, leaves: DataFrame, name: str, arity: int, span: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The passes' ``(leaves, nodes)`` from the lowest, and ``tree, digest`` of the roots.

    ``leaves`` have ``tree, at, total, digest``. A pass gathers runs of ``arity ** span`` leaves (``grp``) and
    materialises all nodes over them as ``tree, total, grp, level, place, digest``, places counted in the run; the
    runs' last nodes are the next pass's leaves.
    """
    width = arity**span
    most = leaves.agg(F.max("total")).first()[0] or 0
    passes = []

    def above(row: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(row) / arity).cast("int") - 1)
        return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(row, j * arity + 1, arity), ""), 256))

    while most > 1:
        own = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        groups = leaves.groupBy("tree", "total", F.expr(f"at div {width}").alias("grp")).agg(own.alias("own")).withColumn("steps", _steps(F.col("total"), arity, span))
        times = F.when(F.col("steps") > 0, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array().cast("array<int>"))
        levels = F.aggregate(times, F.array("own"), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))
        nodes = groups.select("tree", "total", "grp", "steps", F.posexplode(levels).alias("level", "row")).select("tree", "total", "grp", "steps", "level", F.posexplode("row").alias("place", "digest"))
        nodes = scratch.write(nodes, f"{name}{len(passes)}")
        passes.append((leaves, nodes))
        leaves = nodes.where("level = steps").select("tree", F.col("grp").alias("at"), F.ceil(F.col("total") / width).alias("total"), "digest")
        most = -(-most // width)
    return passes, leaves.select("tree", "digest")


def proofs(passes: list[tuple[DataFrame, DataFrame]], tops: DataFrame, arity: int, span: int) -> DataFrame:
    """``tree, at``, the columns of ``tops`` and ``path`` of every leaf of the lowest pass.

    ``path`` has, level by level, the digests that stand left and right of the own one in its run. ``tops`` are the
    roots with the ``path`` above them. The coordinates of a leaf's siblings follow from its place and its run's
    size; they are joined with the node table, ordered and concatenated. What lies above a run is looked up once
    for the run, so that no node is asked for by more leaves than a run has.
    """
    width = arity**span
    powers = F.array(*[F.lit(arity**k).cast("long") for k in range(span + 1)])
    paths = tops.withColumn("at", F.lit(0).cast("long"))
    for leaves, nodes in reversed(passes):
        size = F.least(F.lit(width).cast("long"), F.col("total") - F.expr(f"at div {width}") * width)
        mine = leaves.select("tree", "at", F.expr(f"at div {width}").alias("grp"), F.pmod("at", F.lit(width)).alias("local"), size.alias("size"), _steps(F.col("total"), arity, span).alias("steps"))

        def siblings(level: Column) -> Column:
            unit = F.element_at(powers, level + 1)
            own = F.floor(F.col("local") / unit)
            first = own - F.pmod(own, F.lit(arity))
            run = F.sequence(first, F.least(first + arity - 1, F.ceil(F.col("size") / unit) - 1))
            return F.transform(F.filter(run, lambda p: p != own), lambda p: F.struct(level.alias("level"), p.alias("place"), (p < own).alias("before")))

        levels = F.when(F.col("steps") > 0, F.sequence(F.lit(0), F.col("steps") - 1)).otherwise(F.array().cast("array<int>"))
        wanted = mine.select("tree", "at", "grp", F.explode(F.flatten(F.transform(levels, siblings))).alias("c")).select("tree", "at", "grp", F.col("c.level").alias("level"), F.col("c.place").cast("int").alias("place"), F.col("c.before").alias("before"))
        found = wanted.join(nodes.select("tree", "grp", "level", "place", "digest"), ["tree", "grp", "level", "place"])
        found = found.groupBy("tree", "at").agg(F.sort_array(F.collect_list(F.struct("level", "place", "before", "digest"))).alias("siblings"))
        siblings_ = F.coalesce("siblings", F.array().cast("array<struct<level:int,place:int,before:boolean,digest:string>>"))
        side = lambda level, before: F.array_join(F.transform(F.filter(siblings_, lambda s: (s["level"] == level) & (s["before"] == before)), lambda s: s["digest"]), "")
        own = F.transform(levels, lambda k: F.struct(side(k, True).alias("before"), side(k, False).alias("after")))
        above = paths.withColumnsRenamed({"at": "grp", "path": "above"})
        paths = mine.join(found, ["tree", "at"], "left").join(above, ["tree", "grp"]).select("tree", "at", *[c for c in tops.columns if c not in ("tree", "path")], F.concat(own, F.col("above")).alias("path"))
    return paths


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def manifest(docs: DataFrame, arity: int = ARITY, span: int = SPAN) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: a row per row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``. The leaves of a language, by id (null first,
    then by leaf), are joined by ``arity`` until one is left, the subroot; subroots by language (null first, bytes)
    likewise give the root. A proof holds a leaf's siblings up to the root; ``folded_root`` is what the leaf, with
    one added to ``n_chars`` where 7 divides crc32 of the id, and its untampered siblings lead to.

    Null fields are leaves of their own kind, a null id or length is never tampered with, rows that repeat an id or
    whole rows have a leaf each, texts of any length are digested where they are read and move nowhere, further
    columns are left out, an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    rows = docs.select("doc_id", tree.alias("tree"), leaf().alias("digest"), F.when(tampered, leaf(n_chars=F.col("n_chars") + 1)).alias("changed"))
    leaves = scratch.write(ranked(scratch, rows, ["doc_id", "digest"], "sorted"), "leaves")
    scratch.drop("sorted")
    passes, subroots = grow(scratch, leaves.select("tree", "at", "total", "digest"), "nodes", arity, span)
    # The subroots are the leaves of one more tree.
    named = ranked(scratch, subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest"), ["own"], "subroots")
    named = scratch.write(named, "languages")
    high, roots = grow(scratch, named.select("tree", "at", "total", "digest"), "high", arity, span)
    none = F.array().cast("array<struct<before:string,after:string>>")
    over = proofs(high, roots.select("tree", F.col("digest").alias("root"), none.alias("path")), arity, span)
    tops = named.join(over, ["tree", "at"]).select(F.col("own").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    tops = scratch.write(tops, "tops")
    paths = proofs(passes, tops, arity, span)
    whole = leaves.join(paths, ["tree", "at"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    again = folded(F.coalesce("changed", "digest"), F.col("path"))
    result = whole.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), again.alias("folded_root"))
    result = scratch.write(result, "result")
    scratch.drop("leaves", "subroots", "languages", "tops", *[f"nodes{k}" for k in range(len(passes))], *[f"high{k}" for k in range(len(high))])
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a short ASCII text ``s``, bit by bit: DuckDB has no such function.
CRC = """xor(list_reduce(list_transform(range(1, length({s}) + 1), lambda k: ascii({s}[k])::UBIGINT), lambda acc, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, xor(acc, b)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""


def _enc(sql: str) -> str:
    return f"coalesce(strlen(({sql})::VARCHAR) || ':' || ({sql})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_enc(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLE = f"""
    WITH RECURSIVE named AS (SELECT *, doc_id::VARCHAR AS s FROM documents), base AS (
        SELECT doc_id, coalesce('1' || lang, '0') AS tree, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN n_chars IS NOT NULL AND s IS NOT NULL AND {CRC.format(s="s")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed
        FROM named
    ), leaves AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY tree) AS n FROM base
    ), nodes AS (
        SELECT 0 AS level, tree, k, n, leaf AS d FROM leaves
        UNION ALL SELECT level + 1, tree, k // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM nodes WHERE n > 1 GROUP BY level, tree, k // 2, n
    ), subroots AS (
        SELECT tree, d, level AS height, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM nodes WHERE n = 1
    ), high AS (
        SELECT 0 AS level, k, n, d FROM subroots
        UNION ALL SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY level, k // 2, n
    ), every AS (
        SELECT tree, level, k, d FROM nodes
        UNION ALL SELECT s.tree, s.height + h.level, h.k, h.d FROM high h, subroots s
    ), steps AS (
        SELECT row_number() OVER () AS id, l.*, s.d AS subroot, s.height, s.k AS lang_k, (SELECT d FROM high WHERE n = 1) AS root, s.height + (SELECT max(level) FROM high) AS whole FROM leaves l JOIN subroots s USING (tree)
    ), fold AS (
        SELECT id, 0 AS level, coalesce(changed, leaf) AS d, '' AS proof FROM steps
        UNION ALL
        SELECT f.id, f.level + 1, sha256(CASE WHEN p % 2 = 1 THEN coalesce(e.d, '') || f.d ELSE f.d || coalesce(e.d, '') END), f.proof || coalesce(e.d, '')
        FROM (SELECT f.*, s.tree, CASE WHEN f.level < s.height THEN s.k >> f.level ELSE s.lang_k >> (f.level - s.height) END AS p FROM fold f JOIN steps s USING (id) WHERE f.level < s.whole) f
        LEFT JOIN (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM subroots s WHERE s.tree = e.tree AND s.height = e.level AND NOT EXISTS (SELECT 1 FROM high h WHERE h.level = 0 AND h.k = e.k AND h.d = e.d))) e
        ON e.tree = f.tree AND e.level = f.level AND e.k = xor(p, 1)
    )
    SELECT s.doc_id, s.leaf, s.subroot, s.root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = s.root AS verified
    FROM steps s JOIN fold f ON f.id = s.id AND f.level = s.whole
"""
