"""Conversations with faults, mended by the cheapest edits: A* on an edit lattice, in segments of bounded size."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import Scratch
from .merkle import CRC

#: Rows and text bytes of a segment (a longer row is a segment of its own).
SEGMENT_ROWS, SEGMENT_BYTES = 512, 1 << 20
#: What edits cost, and a truncated row that is not deleted.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5

BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")
ENDED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a; those in which a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1
    empties its text, 2 takes ``[.!?]`` out, 3 repeats it, 4 makes its role ``user``. Nulls read as one space (the
    turn itself stays null)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20))
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def search(faults: str, initials: str, entry: int, exits: Iterable[int], every: bool) -> dict[int, tuple[int, str]]:
    """Cost and edits of the cheapest ways from ``entry`` before the first row to ``exits`` after the last one; the
    best exit only unless ``every``.

    A node is a row and a state of the pattern. Nodes are taken by cost so far plus what the rows ahead cost at
    least (a blank, repeated or truncated row costs a deletion or more), then by the edits so far: two ways to a
    node at one cost hold as many inserts, so neither's edits begin the other's and the lesser one stays the lesser.
    """
    n = len(faults)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (DELETE if faults[i] != "." else 0)
    wanted, found, closed = set(exits), {}, set()
    heap = [(ahead[0], "", 0, entry)]
    while heap and wanted:
        key, edits, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - ahead[i]
        if i == n and state in wanted:
            found[state] = cost, edits
            wanted.discard(state)
            if not every:
                break
        for role in "ua":
            if (after := NEXT.get((state, role))) is not None and (i, after) not in closed:
                heapq.heappush(heap, (key + INSERT, edits + "I", i, after))
        if i == n:
            continue
        base = cost + ahead[i + 1]
        heapq.heappush(heap, (base + DELETE, edits + "D", i + 1, state))
        if faults[i] in "bd":
            continue
        charge = TRUNCATED if faults[i] == "t" else 0
        if (after := NEXT.get((state, initials[i]))) is not None:
            heapq.heappush(heap, (base + charge, edits + "K", i + 1, after))
        for role in "ua":
            if (after := NEXT.get((state, role))) is not None:
                heapq.heappush(heap, (base + charge + REROLE, edits + "R", i + 1, after))
    return found


class Path:
    """The cheapest edits up to a segment's end, for every state there; what all states agree on is kept once."""

    def __init__(self) -> None:
        self.agreed: list[str] = []
        self.open: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, options: list[tuple[int, int, int, str]]) -> None:
        """Goes on by a segment's ``(entry, exit, cost, edits)``."""
        new: dict[int, tuple[int, str]] = {}
        for entry, leave, cost, edits in options:
            if entry in self.open:
                before, so_far = self.open[entry]
                new[leave] = min(new.get(leave, (1 << 62, "")), (before + cost, so_far + edits))
        common = os.path.commonprefix([x for _, x in new.values()])
        self.agreed.append(common)
        self.open = {s: (c, x[len(common) :]) for s, (c, x) in new.items()}

    def edits(self) -> str:
        return "".join(self.agreed) + min(self.open[s] for s in ENDS if s in self.open)[1]


def apply_edits(rows: list[dict], edits: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits leave or insert, from a state of the pattern on."""
    at = 0
    for edit in edits:
        row = None
        if edit != "I":
            row = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            role, initial = row["role"], row["role"][:1]
        else:
            initial = "a" if state == AFTER_U else "u"
            role = ROLE[initial]
        state = NEXT[state, initial]
        yield role, row["text"] if row else ""


def _segments(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """``conv_id, segment, rows``: runs of a conversation's rows by turn (null first), role and SHA-256 of the text.

    Rows are sorted in ranges, so a long conversation lies in many tasks; numbers of segments grow along it.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "digest"]
    placed = rows.withColumn("digest", F.sha2("text", 256)).repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, own = TaskContext.get().partitionId() << 32, [], 0, None
        for batch in batches:
            done = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (conv != own or len(held) >= most_rows or size + len(text) > most_bytes):
                    done.append((own, number, held))
                    number, held, size = number + 1, [], 0
                own = conv
                held.append({"turn": turn, "role": role, "text": text})
                size += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), shape.types, strict=True)], schema=shape)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((own, number, held), shape.types, strict=True)], schema=shape)

    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    shape = pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), ("segment", pa.int64()), ("rows", pa.list_(row))])
    return placed.select("conv_id", "turn", "role", "text").mapInArrow(cut, f"conv_id {kind}, segment long, rows array<struct<turn:long,role:string,text:string>>")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``conv_id, segment, faults, edits, cost, before, repaired``: every conversation of ``conv_id, turn, role, text``
    in segments, in order of ``segment``, with its rows (``before``), a fault and an edit for each (``I`` for a new
    one) and what they become.

    Rows stand by turn (null first), then role, then SHA-256 of the text. Faults: ``b`` blank, ``d`` role and text
    seen earlier, ``t`` truncated, ``.`` none. Edits: ``K`` keep, ``R`` rerole, ``D`` delete, ``I`` insert; their
    total cost is least, of equally cheap ones the edits that read first in ASCII are taken.

    Null roles and texts read as one space, a null ``conv_id`` is a conversation, rows that repeat are duplicates,
    a text of any length is one row of one segment, further columns are left out, an empty table gives no rows.

    A segment is searched from every state of the pattern to every other, then the segments' best ways are joined
    along the conversation; so neither a task nor the driver holds all rows of a long one.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    segments = scratch.write(_segments(given, segment_rows, segment_bytes), "segments")
    # In conversations of several segments, the first place of each role and text is found by grouping.
    several = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("own"))
    spread = segments.join(several, segments["conv_id"].eqNullSafe(F.col("own")), "left_semi")
    keys = spread.select("conv_id", "segment", F.posexplode("rows").alias("at", "row")).select("conv_id", "segment", "at", F.col("row.role").alias("role"), F.sha2("row.text", 256).alias("digest"))
    first = keys.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("segment", "at")).alias("first")).groupBy(F.col("first.segment").alias("segment")).agg(F.collect_list("first.at").alias("firsts"))
    known = segments.join(first, "segment", "left").join(spread.select("segment", F.lit(True).alias("several")), "segment", "left")

    def search_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for segment, own, firsts, several in zip(*(batch.column(c).to_pylist() for c in ("segment", "rows", "firsts", "several")), strict=True):
                seen, new, faults = set(), set(firsts or ()), []
                for k, r in enumerate(own):
                    pair = r["role"], r["text"]
                    again = k not in new if several else pair in seen
                    seen.add(pair)
                    faults.append("b" if BLANK.match(r["text"]) else "d" if again else "." if ENDED.search(r["text"]) else "t")
                marks, initials = "".join(faults), "".join(r["role"][:1] or " " for r in own)
                if several:
                    options = [(s, e, *x) for s in range(4) for e, x in search(marks, initials, s, range(4), True).items()]
                else:
                    options = [(START, e, *x) for e, x in search(marks, initials, START, ENDS, False).items()]
                out.append((segment, marks, initials, [dict(zip(("entry", "exit", "cost", "edits"), x, strict=True)) for x in options]))
            if out:
                segments_, marks_, initials_, options_ = zip(*out, strict=True)
                kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(segments_, pa.int64()), pa.array(marks_), pa.array(initials_), pa.array(options_, kind)], ["conv_id", "segment", "faults", "initials", "options"])

    conv = rows.schema["conv_id"].dataType.simpleString()
    options = known.select("conv_id", "segment", "rows", "firsts", "several").mapInArrow(search_all, f"conv_id {conv}, segment long, faults string, initials string, options array<struct<entry:int,exit:int,cost:long,edits:string>>")

    def join_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, path, parts = None, None, []

        def close() -> pa.RecordBatch:
            edits, at, state, out = path.edits(), 0, START, []
            for k, (segment, faults, initials) in enumerate(parts):
                left, stop, entry = len(faults), at, state
                while stop < len(edits) and (left or edits[stop] == "I"):
                    edit = edits[stop]
                    if edit != "D":
                        state = NEXT[state, initials[len(faults) - left] if edit == "K" else "a" if state == AFTER_U else "u"]
                    left -= edit != "I"
                    stop += 1
                out.append((segment, faults, edits[at:stop], entry))
                at = stop
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["segment", "faults", "edits", "entry"])

        for batch in batches:
            for conv_id, segment, faults, initials, choices in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path is None or conv_id != own:
                    if path is not None:
                        yield close()
                    own, path, parts = conv_id, Path(), []
                path.add([(o["entry"], o["exit"], o["cost"], o["edits"]) for o in choices])
                parts.append((segment, faults, initials))
        if path is not None:
            yield close()

    chosen = options.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(join_along, "segment long, faults string, edits string, entry long")

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        price = {"K": 0, "D": DELETE, "R": REROLE, "I": INSERT}
        for batch in batches:
            costs, texts = [], []
            for own, faults, edits, entry in zip(*(batch.column(c).to_pylist() for c in ("rows", "faults", "edits", "entry")), strict=True):
                kept = (f for f, e in zip(faults, edits.replace("I", ""), strict=True) if e != "D")
                costs.append(sum(price[e] for e in edits) + TRUNCATED * sum(f == "t" for f in kept))
                texts.append([{"role": r, "text": t} for r, t in apply_edits(own, edits, entry)])
            done = [batch.column(c) for c in ("conv_id", "segment", "faults", "edits")] + [pa.array(costs, pa.int64()), batch.column("rows"), pa.array(texts, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
            yield pa.RecordBatch.from_arrays(done, ["conv_id", "segment", "faults", "edits", "cost", "before", "repaired"])

    joined = segments.join(chosen, "segment").select("conv_id", "segment", "rows", "faults", "edits", "entry")
    schema = f"conv_id {conv}, segment long, faults string, edits string, cost long, before array<struct<turn:long,role:string,text:string>>, repaired array<struct<role:string,text:string>>"
    result = scratch.write(joined.mapInArrow(mend, schema), "repaired")
    scratch.drop("segments")
    return result


def repair_digests(rows: DataFrame, every: DataFrame | None = None, **sizes: int) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of :func:`repair`: a row
    for each conversation, and one of zeros for each ``conv_id`` of ``every`` that has no rows.

    ``gaps`` counts the turns missing between the least and the greatest one, ``illegal`` the neighbours whose role
    initials are none of su, ua, au. Segments pass through in order, so only edits are held whole.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None

        def fresh() -> dict:
            return {"edits": [], "hash": hashlib.sha256(), "any": False, "last": None, "low": None, "high": None, "turns": 0, "illegal": 0, "cost": 0, "b": 0, "d": 0, "t": 0}

        def close() -> pa.RecordBatch:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            numbers = [gaps, state["b"], state["d"], state["t"], state["illegal"], state["cost"]]
            return pa.RecordBatch.from_arrays([pa.array([own], kinds), *[pa.array([x], pa.int64()) for x in numbers], pa.array(["".join(state["edits"])]), pa.array([state["hash"].hexdigest()])], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            kinds = batch.schema.field("conv_id").type
            for conv_id, faults, edits, cost, before, after in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "faults", "edits", "cost", "before", "repaired")), strict=True):
                if state is None or conv_id != own:
                    if state is not None:
                        yield close()
                    own, state = conv_id, fresh()
                for r in before:
                    initial, turn = r["role"][:1], r["turn"]
                    state["illegal"] += state["last"] is not None and state["last"] + initial not in LEGAL
                    state["last"] = initial
                    if turn is not None:
                        state["turns"] += state["high"] != turn
                        state["low"], state["high"] = turn if state["low"] is None else state["low"], turn
                for f in "bdt":
                    state[f] += faults.count(f)
                state["cost"] += cost
                state["edits"].append(edits)
                for r in after:
                    state["hash"].update(f"{chr(10) if state['any'] else ''}{r['role']}:{r['text']}".encode())
                    state["any"] = True
        if state is not None:
            yield close()

    mended = repair(rows, **sizes)
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    digests = mended.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(fold, schema)
    if every is None:
        return digests
    names = every.select("conv_id").distinct().withColumnRenamed("conv_id", "own")
    none = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()} | dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0)
    whole = names.join(digests, names["own"].eqNullSafe(digests["conv_id"]), "left")
    return whole.select(F.col("own").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(none[c])).alias(c) for c in digests.columns[1:]])


def repair_damaged(rows: DataFrame, **sizes: int) -> DataFrame:
    """:func:`repair_digests` of :func:`damaged` rows, for every ``conv_id`` that the table has."""
    return repair_digests(damaged(rows), rows, **sizes)


def _step(state: str, cost: str, edit: str) -> str:
    return f"lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}'"


_INSERTED = f"[x[1], x[2], least(x[3], {_step('least(x[1], x[2], x[4])', '5', 'I')}), least(x[4], {_step('x[3]', '5', 'I')})]"
_CLOSED = f"list_reduce([s, s, s, s], lambda x, y: {_INSERTED})"

#: States are texts of nine digits of cost and the edits, so that the least text is the cheapest and then the first.
ORACLE = rf"""
    WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations
    ), kinds AS (SELECT *, {CRC.format(s="s")} % 20 AS kind FROM named), hurt AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
        FROM kinds WHERE kind <> 0
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt), rows AS (
        SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                       WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '.' END AS fault,
               left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
        FROM placed
    ), walk AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, ['000000000', NULL, NULL, NULL] AS s FROM rows
        UNION ALL
        SELECT conv_id, i + 1, [{_step("t[1]", "2", "D")},
            least({_step("t[2]", "2", "D")}, CASE WHEN open AND c = 's' THEN {_step("t[1]", "charge", "K")} END),
            least({_step("t[3]", "2", "D")}, CASE WHEN open THEN {_step("least(t[1], t[2], t[4])", "charge + 1", "R")} END, CASE WHEN open AND c = 'u' THEN {_step("least(t[1], t[2], t[4])", "charge", "K")} END),
            least({_step("t[4]", "2", "D")}, CASE WHEN open THEN {_step("t[3]", "charge + 1", "R")} END, CASE WHEN open AND c = 'a' THEN {_step("t[3]", "charge", "K")} END)]
        FROM (SELECT w.conv_id, w.i, {_CLOSED} AS t, r.c, r.fault NOT IN ('b', 'd') AS open, CASE WHEN r.fault = 't' THEN 5 ELSE 0 END AS charge
              FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)
    ), best AS (
        SELECT conv_id, least(t[1], t[4]) AS b FROM (SELECT w.conv_id, {_CLOSED} AS t FROM walk w JOIN (SELECT conv_id, max(i) AS n FROM rows GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.i)
    ), play AS (
        SELECT conv_id, substr(b, 10) AS audit, left(b, 9)::BIGINT AS cost, 0::BIGINT AS k, 0::BIGINT AS i, '' AS last, NULL::VARCHAR AS line FROM best
        UNION ALL
        SELECT p.conv_id, p.audit, p.cost, p.k + 1, p.i + CASE WHEN e = 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN p.last WHEN 'K' THEN r.c ELSE CASE WHEN p.last = 'u' THEN 'a' ELSE 'u' END END,
               CASE WHEN e = 'K' THEN r.role || ':' || r.text WHEN e <> 'D' THEN CASE WHEN p.last = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN e = 'R' THEN r.text ELSE '' END END
        FROM (SELECT *, substr(audit, (k + 1)::BIGINT, 1) AS e FROM play WHERE k < length(audit)) p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    ), mended AS (SELECT conv_id, audit, cost, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS sha FROM play GROUP BY conv_id, audit, cost), counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
               count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
        FROM rows GROUP BY conv_id
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
           coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""
