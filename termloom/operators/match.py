"""Terms found in transcripts: units, exact forms, plurals, guesses, sounds and conditions.

One pass over the windows serves any number of packs of a language: the tables of forms, rejections, names and
conditions have a column ``pack``, and from the first join on every row belongs to a document and a pack.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.languages import Language, UnitRule
from termloom.functions.similarity import bits_reach, places_of, ratio_by_places, sign_bits, sign_bits_of
from termloom.functions.text import collapse, inflection_bases, may_inflect, normalize, normalize_text, skeleton, skeleton_text
from termloom.operators.resolve import resolve_overlaps
from termloom.operators.tokens import Reach, tokenize, tokens_ahead, windows
from termloom.schemas import (
    APPLY_AT, BROADCAST_ROWS, MARK_AT, MAX_LENGTH_GAP, MIN_FUZZY_LENGTH, MIN_SKELETON, NEAR_SECONDS, NEAR_TOKENS,
    PHONETIC_AT, PHONETIC_NGRAMS, VARIANT_APPLY_AT,
)
from termloom.session import settled
from termloom.sources.captions import locate
from termloom.sources.packs import Pack, spaced

OUTPUT = ("doc_id", "start", "end", "original", "replacement", "term", "rule", "kind", "band", "score", "pack_version")
#: Characters of a cell of text in which spans look for spans that they overlap.
CELL = 256
#: Keys that a window is tested for by a set of literals; a pack with more is reached by the join alone.
TESTED_KEYS = 20_000
#: Forms to guess at whose letters a window is held against in generated code.
TESTED_GUESSES = 40
#: What a window of a document is known by, once packs have met it.
WHERE = ("doc_id", "pack", "i", "n")

Packs = Mapping[str, Pack]


def small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast for a table of known size up to the limit; beyond it Spark chooses."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def unit_hits(transcripts: DataFrame, rules: tuple[UnitRule, ...]) -> DataFrame:
    """``doc_id, start, end, original, replacement, term``: rules in order, a later match never overlaps an earlier one.

    Only texts that some rule matches at all reach Python, a batch at a time; nothing is shuffled.
    """
    if not rules:
        return transcripts.sparkSession.createDataFrame([], "doc_id string, start int, end int, original string, replacement string, term string")
    some = F.lit(False)
    for rule in rules:
        some = some | F.col("text").rlike(rule.pattern)
    compiled = [(r.pattern, r.replacement, r.term) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(re.compile(p), new, term) for p, new, term in compiled]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                taken: list[tuple[int, int]] = []
                for pattern, new, term in patterns:
                    for m in pattern.finditer(text):
                        a, b = m.span()
                        # Taken spans are in order and apart, so only the neighbours can overlap.
                        at = bisect.bisect_left(taken, (a, b))
                        if (not at or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                            taken.insert(at, (a, b))
                            out.append((doc, a, b, m.group(), m.expand(new), term))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "start", "end", "original", "replacement", "term"])

    return transcripts.select("doc_id", "text").where(some).mapInArrow(run, "doc_id string, start int, end int, original string, replacement string, term string")


def _language(packs: Packs):
    return next(iter(packs.values())).language


def _key_rows(packs: Packs) -> list[tuple]:
    """One row per way in which a window can reach a form: equal, by run, exact only, plural base, guess by length."""
    rows = []
    for name, pack in packs.items():
        owned, explicit, bases, origins = pack.owned(), set(), {}, {}
        for k, f in enumerate(pack.forms):
            origins.setdefault((f.term, f.folded), f.origin)
            explicit.add(f.folded)
            if f.origin in ("term", "alias") and " " not in f.folded and not f.exact:
                bases.setdefault(f.folded, (k, f.term))
        for f in pack.forms:
            if f.origin == "variant" and (f.term, f.folded) in owned:
                continue
            own = sorted(set(normalize_text(f.term, pack.language).split()) | set(f.folded.split()))
            is_name, cased = f.origin in ("term", "alias"), spaced(f.display) if f.cased else None
            guessed = pack.fuzzy(f) and len(f.folded) >= MIN_FUZZY_LENGTH
            base = (f.term, f.folded, origins[f.term, f.folded], f.origin, is_name, cased, own, None, None)
            if f.exact:
                rows.append((f"x:{spaced(f.folded)}", name, "only", 0, *base))
                continue
            rows += [(f"=:{f.folded}", name, "equal", 0, *base), (f"r:{spaced(f.folded)}", name, "run", 0, *base)]
            if guessed:
                base = (*base[:-2], sign_bits_of(f.folded), places_of(f.folded))
                rows += [(f"f:{n}", name, "guess", 0, *base) for n in range(max(MIN_FUZZY_LENGTH, len(f.folded) - MAX_LENGTH_GAP), len(f.folded) + MAX_LENGTH_GAP + 1)]
        rows += [(f"b:{b}", name, "base", k, t, b, "alias", "alias", True, None, [], None, None) for b, (k, t) in bases.items()]
        rows += [(f"r:{e}", name, "explicit", 0, "", e, "", "", False, None, [], None, None) for e in explicit]
    return rows


_KEYS = "key string, pack string, mode string, ord int, term string, form string, first_origin string, origin string, name boolean, cased string, own array<string>, form_bits bigint, places map<string,bigint>"


def _may_guess(folded: Column, form: str, mark: int) -> Column:
    """False only if the ratio of the two can't reach the mark: their lengths, and the letters of the window that the form
    lacks."""
    held = F.length(folded) - F.length(F.translate(folded, "".join(sorted(set(form))), ""))
    near = F.length(folded).between(max(MIN_FUZZY_LENGTH, len(form) - MAX_LENGTH_GAP), len(form) + MAX_LENGTH_GAP)
    return near & (F.lit(200) * F.least(held, F.lit(len(form))) >= F.lit(mark) * (F.length(folded) + len(form)))


def reach_of(packs: Packs, mark: int = MARK_AT) -> Reach:
    """A test of batches of tokens, weaker than :func:`reached` and :func:`phonetic`: for
    :func:`termloom.operators.tokens.tokens_ahead`, where nearly all windows then end."""
    rows = _key_rows(packs)
    guesses = sorted({row[5] for row in rows if row[2] == "guess"})
    few = [(f, max(MIN_FUZZY_LENGTH, len(f) - MAX_LENGTH_GAP), len(f) + MAX_LENGTH_GAP) for f in guesses] if len(guesses) <= TESTED_GUESSES else []
    sizes = [] if few else {int(row[0][2:]) for row in rows if row[2] == "guess"}
    codes = sorted({c for _, _, c in _sounding(packs)})
    spans = [n for c in codes for n in _sound_sizes(c)]
    return Reach(
        _language(packs), (row[0][2:] for row in rows if row[0][0] in "=rx"), (row[0][2:] for row in rows if row[0][0] == "b"), few, mark, sizes,
        codes if len(codes) <= TESTED_GUESSES else (), spans if len(codes) > TESTED_GUESSES else (),
    )


def _sound_sizes(code: str) -> list[int]:
    """Lengths of the skeletons that may be close enough to a code."""
    low, high = PHONETIC_AT / (200 - PHONETIC_AT), (200 - PHONETIC_AT) / PHONETIC_AT
    return [n for n in range(MIN_SKELETON, int(len(code) * high) + 2) if low * len(code) <= n <= high * len(code)]


def reached(every_window: DataFrame, packs: Packs, mark: int = MARK_AT) -> DataFrame:
    """Windows with the forms of each pack that they reach: a single join on a key, a guess only where its ratio
    suffices.

    A window gets keys only if it is one of the texts that some form is reached by, or as long as some form to guess
    at; the rest, nearly all of them, ends here.
    """
    language, rows = _language(packs), _key_rows(packs)
    with_plain = "plain" in every_window.columns
    texts: dict[str, set[str]] = {"=": set(), "r": set(), "x": set(), "b": set(), "f": set()}
    for key, *_ in rows:
        texts[key[0]].add(key[2:])
    run = F.col("run")
    keys = [F.concat(F.lit("=:"), "folded"), F.concat(F.lit("r:"), "run"), *([F.concat(F.lit("x:"), "plain")] if with_plain else [])]
    keys_ = F.array(*keys)
    if texts["b"] and language.plurals:
        keys_ = F.concat(keys_, F.transform(inflection_bases(run, language), lambda b: F.concat(F.lit("b:"), b)))
    if len(rows) <= TESTED_KEYS:
        test = F.col("folded").isin(texts["="]) | run.isin(texts["r"])
        if with_plain:
            test = test | F.col("plain").isin(texts["x"])
        if texts["b"]:
            test = test | may_inflect(run, language, texts["b"])
        keys_ = F.when(test, keys_)
    none = F.array().cast("array<string>")
    guess = F.col("mode") == "guess"
    fine = F.when(F.col("mode") == "only", F.col("cased").isNull() | (F.col("cased") == F.col("raw"))).otherwise(True)
    if texts["f"]:
        guesses = sorted({row[5] for row in rows if row[2] == "guess"})
        reach = F.lit(True)
        if len(guesses) <= TESTED_GUESSES:
            # A window meets only the forms whose letters it has enough of.
            once = {(row[1], *row[4:9]): (f"f:{row[5]}", *row[1:]) for row in rows if row[2] == "guess"}
            rows = [row for row in rows if row[2] != "guess"] + list(once.values())
            spread = F.array_compact(F.array(*[F.when(_may_guess(F.col("folded"), form, mark), F.lit(f"f:{form}")) for form in guesses]))
        else:
            long_enough = F.length("folded").isin([int(n) for n in texts["f"]])
            spread = F.when(long_enough, F.array(F.concat(F.lit("f:"), F.length("folded").cast("string")))).otherwise(none)
            every_window = every_window.withColumn("bits", F.when(long_enough, sign_bits(F.col("folded"))))
            reach = bits_reach(F.col("folded"), F.col("bits"), F.col("form"), F.col("form_bits"), mark)
        keys_ = F.concat(F.coalesce(keys_, none), spread)
        fine = F.when(guess, (F.col("folded") != F.col("form")) & reach).otherwise(fine)
    table = small(every_window.sparkSession.createDataFrame(rows, _KEYS), len(rows))
    joined = every_window.withColumn("key", F.explode(keys_)).join(table, "key").where(fine)
    score = F.when(guess, ratio_by_places(F.col("folded"), F.col("form"), F.col("places"))).otherwise(100.0) if texts["f"] else F.lit(100.0)
    return joined.withColumn("score", score).where(~guess | (F.col("score") >= mark)).drop("key", "bits", "form_bits", "places")


def exact_spans(found: DataFrame) -> DataFrame:
    """``doc_id, pack, i, n, term, name``: windows that are exactly a form of a term (plurals count as names)."""
    explicit = found.where("mode = 'explicit'").select(*WHERE).distinct()
    plural = found.where("mode = 'base'").join(explicit, [*WHERE], "left_anti")
    plural = plural.groupBy(*WHERE).agg(F.min(F.struct("ord", "term", "form")).alias("b")).select(*WHERE, "b.term", F.lit(True).alias("name"), F.col("b.form").alias("base"))
    direct = found.where("mode in ('run', 'only')").select(*WHERE, "term", "name", F.lit(None).cast("string").alias("base"))
    return direct.unionByName(plural).groupBy(*WHERE, "term").agg(F.max("name").alias("name"), F.max("base").alias("base"))


def proposals(found: DataFrame, spans: DataFrame, packs: Packs, mark: int = MARK_AT) -> DataFrame:
    """Dictionary annotations before context and overlap resolution, with the first token ``i``, the ``form`` and the
    ``rank`` that must reach a mark.

    The best form of a window by (rank, score, term, form) decides; a rejected best ends the window. Guards
    then drop corrections: a window that an exact name of its own term covers, a guess that shares a token
    with an exact form of another term or holds an ordinary word of its own, and any correction that
    overlaps a longer exact name of another term.
    """
    where, language = [*WHERE], _language(packs)
    plural = spans.where("base is not null and n = 1").select(*where, F.col("term").alias("plural_term"), F.col("base").alias("plural_form"))
    place = ["start", "end", "folded", "run"]
    candidates = found.where("mode in ('equal', 'guess', 'only') and length(folded) >= 2")
    demoted = (F.col("origin") == "variant") & (F.col("folded") != F.col("form")) & F.col("score").between(APPLY_AT, VARIANT_APPLY_AT - 0.0000001)
    rank = F.when(F.col("mode") == "only", 100.0).when(demoted, float(APPLY_AT - 1)).otherwise(F.col("score"))
    best = candidates.withColumn("rank", rank).where(F.col("rank") >= mark).groupBy(*where).agg(F.max(F.struct("rank", "score", "term", "form", "mode", "first_origin", "own", *place)).alias("b")).select(*where, "b.*")
    best = best.join(plural.select(*where), where, "left_anti")
    best = settled(_not_rejected(best, packs, where), "best")
    matched = (F.col("folded") == F.col("form")) | (F.col("mode") == "only")
    best = best.withColumn("matched", matched)
    named = best.where("first_origin in ('alias', 'term') and matched")
    names = named.select(*where, "start", "end", "term", "form", F.when(F.col("first_origin") == "alias", "term:alias").otherwise("term:exact").alias("rule"), F.lit("alias").alias("kind"), F.lit("high").alias("band"), F.col("score").cast("int").alias("score"), F.lit(100.0).alias("rank"))
    base_place = found.where("mode = 'base'").select(*where, *place).distinct()
    plurals = _not_rejected(plural.join(base_place, where).withColumnRenamed("plural_term", "term"), packs, where)
    plurals = plurals.where("length(folded) >= 2").select(*where, "start", "end", "term", F.col("plural_form").alias("form"), F.lit("term:alias").alias("rule"), F.lit("alias").alias("kind"), F.lit("high").alias("band"), F.lit(100).alias("score"), F.lit(100.0).alias("rank"))

    corrections = best.where("not (first_origin in ('alias', 'term') and matched)")
    rule = F.when(F.col("matched"), F.concat(F.lit("term:"), "first_origin")).otherwise("term:fuzzy")
    corrections = corrections.withColumn("rule", rule)
    common = F.array(*map(F.lit, sorted(language.common))) if language.common else F.array().cast("array<string>")
    stray = F.exists(F.split("folded", " +"), lambda w: F.array_contains(common, w) & ~F.array_contains(F.col("own"), w))
    corrections = corrections.where(~((F.col("rule") == "term:fuzzy") & stray))
    token = F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("k")
    here = corrections.select(*where, F.col("term").alias("own_term"), "rule", token)
    there = spans.select("doc_id", "pack", F.col("i").alias("s"), (F.col("i") + F.col("n")).alias("e"), "term", "name", token)
    other = F.col("term") != F.col("own_term")
    covered = F.col("name") & (F.col("s") <= F.col("i")) & (F.col("e") >= F.col("i") + F.col("n")) & ~other
    foreign = (F.col("rule") == "term:fuzzy") & other
    longer = F.col("name") & other & (F.col("e") - F.col("s") > F.col("n"))
    guarded = here.join(there, ["doc_id", "pack", "k"]).where(covered | foreign | longer).select(*where).distinct()
    corrections = corrections.join(guarded, where, "left_anti")
    threshold = F.when(F.col("first_origin") == "variant", VARIANT_APPLY_AT).otherwise(APPLY_AT)
    band = F.when(F.col("rule") != "term:fuzzy", "high").when(F.col("score") >= threshold, "medium").otherwise("low")
    rank = F.when(F.col("rule") == "term:fuzzy", F.col("rank")).otherwise(100.0)
    fixes = corrections.select(*where, "start", "end", "term", "form", "rule", F.lit("correction").alias("kind"), band.alias("band"), F.col("score").cast("int").alias("score"), rank.alias("rank"))
    return names.unionByName(plurals).unionByName(fixes)


def _not_rejected(rows: DataFrame, packs: Packs, key: list[str]) -> DataFrame:
    """Rows (known by ``key``) whose ``pack, term`` was not turned down for their ``folded`` text or for words in it: a
    join on term and first word of what was turned down."""
    turned_down = [(name, term, text.split()[0], f" {text} ") for name, pack in packs.items() for text, term in sorted(pack.rejected) if text.split()]
    if not turned_down:
        return rows
    table = small(rows.sparkSession.createDataFrame(turned_down, "pack string, term string, word string, text string"), len(turned_down))
    whole = collapse(F.col("folded"))
    words = rows.select(*key, "term", F.concat(F.lit(" "), whole, F.lit(" ")).alias("padded"), F.explode(F.array_distinct(F.split(whole, " "))).alias("word"))
    hit = words.join(table, ["pack", "term", "word"]).where(F.col("padded").contains(F.col("text"))).select(*key, "term").distinct()
    return rows.join(hit, [*key, "term"], "left_anti")


def _sounding(packs: Packs) -> list[tuple[str, str, str]]:
    """Pack, term and skeleton of the names that may be heard."""
    out = []
    for name, pack in packs.items():
        if not pack.language.has_skeleton:
            continue
        klass = pack.class_of()
        codes = [(f.term, skeleton_text(f.folded, pack.language)) for f in pack.forms if f.origin in ("term", "alias") and klass[f.term] in pack.phonetic_classes and not f.exact]
        out += [(name, t, c) for t, c in dict.fromkeys(codes) if len(c) >= MIN_SKELETON]
    return out


def phonetic(every_window: DataFrame, taken: DataFrame, packs: Packs) -> DataFrame:
    """Names that sound alike: windows of one or two words that no applied annotation of the pack touches."""
    names, language, spark = _sounding(packs), _language(packs), every_window.sparkSession
    rows = [(n, p, t, c, sign_bits_of(c), places_of(c)) for p, t, c in names for n in _sound_sizes(c)]
    table = small(spark.createDataFrame(rows, "size int, pack string, term string, code string, code_bits bigint, places map<string,bigint>"), len(rows))
    own = every_window.where(F.col("n") <= PHONETIC_NGRAMS).select("doc_id", "i", "n", "start", "end", "folded", skeleton(F.col("raw"), language).alias("sound"))
    pairs = own.withColumn("size", F.length("sound")).withColumn("bits", sign_bits(F.col("sound"))).join(table, "size").where(bits_reach(F.col("sound"), F.col("bits"), F.col("code"), F.col("code_bits"), PHONETIC_AT))
    scored = pairs.withColumn("ratio", ratio_by_places(F.col("sound"), F.col("code"), F.col("places"))).where(F.col("ratio") >= PHONETIC_AT)
    where = [*WHERE]
    # Read four times below, so written once.
    best = settled(scored.groupBy(*where).agg(F.max(F.struct("ratio", "term", "start", "end", "folded")).alias("b")).select(*where, "b.*"), "heard")
    single = best.where("n = 1").select("doc_id", "pack", F.col("i").alias("k"), F.col("ratio").alias("alone"))
    weak = best.where("n = 2").withColumn("k", F.explode(F.array(F.col("i"), F.col("i") + 1))).join(single, ["doc_id", "pack", "k"]).where("ratio <= alone").select(*where).distinct()
    best = best.join(weak, where, "left_anti")
    # Overlaps by cells of the text: each side stands in the cells that it touches.
    cells = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("cell")
    spans = taken.where("band in ('high', 'medium')").select("doc_id", "pack", cells, F.col("start").alias("from"), F.col("end").alias("to"))
    touched = best.select(*where, "start", "end", cells).join(spans, ["doc_id", "pack", "cell"]).where((F.col("from") < F.col("end")) & (F.col("to") > F.col("start"))).select(*where).distinct()
    free = _not_rejected(best.join(touched, where, "left_anti"), packs, where)
    return free.select(*where, "start", "end", "term", F.lit(None).cast("string").alias("form"), F.lit("term:phonetic").alias("rule"), F.lit("correction").alias("kind"), F.lit("ask").alias("band"), F.col("ratio").cast("int").alias("score"), F.lit(100.0).alias("rank"))


def occurrences(spans: DataFrame) -> DataFrame:
    """``doc_id, pack, term, i, n``: distinct places of a term, the longest first, none over another.

    The choice is made within chains of overlapping places, which a running maximum tells apart, not within all
    places of a term in a document.
    """
    home = Window.partitionBy("doc_id", "pack", "term").orderBy("i", "n")
    reach = F.max(F.col("i") + F.col("n")).over(home.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("i") >= reach), 1).otherwise(0)
    chained = spans.select(*WHERE, "term").withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(home.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("size"), "i", "n")))
    start = F.array().cast("array<struct<size:int,i:int,n:int>>")
    apart = lambda kept, x: ~F.exists(kept, lambda k: (x["i"] < k["i"] + k["n"]) & (k["i"] < x["i"] + x["n"]))
    kept = F.aggregate("found", start, lambda acc, x: F.when(apart(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    grouped = chained.groupBy("doc_id", "pack", "term", "chain").agg(order.alias("found"))
    return grouped.select("doc_id", "pack", "term", F.explode(F.when(F.size("found") == 1, F.col("found")).otherwise(kept)).alias("o")).select("doc_id", "pack", "term", "o.i", "o.n")


def in_context(found: DataFrame, spans: DataFrame, starts: DataFrame, texts: DataFrame, lines: DataFrame | None, packs: Packs) -> DataFrame:
    """Forms with a condition hold only where their context terms occur in the document: never, a question, or as they
    are. ``unless_near`` terms are met in cells of the distance at which they count as near. ``starts`` has ``doc_id, i,
    start`` of the places of ``spans``."""
    language = _language(packs)
    conditions: dict[tuple[str, str, str], tuple] = {}
    for name, pack in packs.items():
        conditions |= {(name, f.term, f.folded): (f.context, f.unless_near, normalize_text(f.term, pack.language)) for f in pack.forms if f.context}
    if not conditions:
        return found
    spark = found.sparkSession
    rows = [(p, t, w, list(c), list(u), w == own) for (p, t, w), (c, u, own) in conditions.items()]
    table = small(spark.createDataFrame(rows, "pack string, term string, condition string, context array<string>, unless_near array<string>, by_name boolean"), len(rows))
    fits = (found["pack"] == table["pack"]) & (found["term"] == table["term"]) & F.when(found["rule"] == "term:phonetic", table["by_name"]).otherwise(found["form"] == table["condition"])
    bound = found.join(table, fits).select(found["*"], "context", "unless_near")
    key = [*WHERE, "rule"]
    free = found.join(bound.select(*key), key, "left_anti")
    wanted = sorted({x for c, u, _ in conditions.values() for x in (*c, *u)})
    places = settled(occurrences(spans.where(F.col("term").isin(wanted))), "places")
    uses = places.groupBy("doc_id", "pack", "term").agg(F.count(F.lit(1)).alias("uses"))
    # A term that a context names twice counts twice.
    count = bound.select(*key, F.explode("context").alias("named")).join(uses.withColumnRenamed("term", "named"), ["doc_id", "pack", "named"]).groupBy(*key).agg(F.sum("uses").alias("uses"))
    marked = bound.join(count, key)  # what no context term supports is gone
    asked = F.col("uses") == 1
    if any(u for _, u, _ in conditions.values()):
        spot = lambda rows: rows.withColumn("spot", F.col("i")).withColumn("timed", F.lit(False))
        if lines is not None:
            # Only the tokens of places and of annotations get their seconds.
            marked = settled(marked, "marked")
            few = marked.select("doc_id", "i", "start").unionByName(found_places(places, starts)).distinct()
            timed = settled(_token_seconds(few, texts, lines, language), "seconds")
            spot = lambda rows: rows.join(timed, ["doc_id", "i"], "left").withColumn("timed", F.coalesce("timed", F.lit(False))).withColumn("spot", F.when(F.col("timed"), F.col("sec")).otherwise(F.col("i"))).drop("sec")
        reach = F.when(F.col("timed"), NEAR_SECONDS).otherwise(NEAR_TOKENS)
        cell = F.floor(F.col("spot") / reach)
        here = spot(marked.select(*key, "unless_near")).select(*key, F.explode("unless_near").alias("term"), "spot", "timed", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        there = spot(places).select("doc_id", "pack", "term", F.col("spot").alias("other"), cell.alias("cell"))
        close = here.join(there, ["doc_id", "pack", "term", "cell"]).where(F.abs(F.col("spot") - F.col("other")) <= reach).select(*key, F.lit(True).alias("close")).distinct()
        marked = marked.join(close, key, "left")
        asked = asked | F.coalesce("close", F.lit(False))
    band = F.when(F.col("band").isin("high", "medium") & asked, "ask").otherwise(F.col("band"))
    return free.unionByName(marked.withColumn("band", band).select(found.columns))


def found_places(places: DataFrame, starts: DataFrame) -> DataFrame:
    """``doc_id, i, start`` of places, by the windows that they were found in."""
    return places.select("doc_id", "i").distinct().join(starts.select("doc_id", "i", "start").distinct(), ["doc_id", "i"])


def _token_seconds(few: DataFrame, texts: DataFrame, lines: DataFrame, language: Language) -> DataFrame:
    """``doc_id, i, sec, timed`` of some tokens; ``timed`` if no token of the document is on a line without seconds. Only
    documents that have such a line are cut into tokens again."""
    seconds = lines.select("doc_id", "line_no", "start", F.col("ts_sec").alias("ts"))
    unsure = lines.where("ts_sec is null").select("doc_id").distinct()
    again = tokenize(texts.join(unsure, "doc_id", "left_semi"), language)
    untimed = locate(again.select("doc_id", "start"), seconds.join(unsure, "doc_id", "left_semi")).where("line_no is not null and ts is null").select("doc_id", F.lit(False).alias("timed")).distinct()
    own = seconds.join(few.select("doc_id").distinct(), "doc_id", "left_semi")
    placed = locate(few.select("doc_id", "i", "start"), own).where("line_no is not null")
    return placed.join(untimed, "doc_id", "left").select("doc_id", "i", F.col("ts").alias("sec"), F.coalesce("timed", F.lit(True)).alias("timed"))


def _unit_rows(texts: DataFrame, packs: Packs) -> DataFrame:
    """Unit hits for every pack, under the pack's own name for the rule's term."""
    language = _language(packs)
    owners = [(name, r.term, pack.term_named(r.term) or r.term) for name, pack in packs.items() for r in dict((r.term, r) for r in language.units).values()]
    table = F.broadcast(texts.sparkSession.createDataFrame(owners, "pack string, rule_term string, term string"))
    units = unit_hits(texts, language.units).withColumnRenamed("term", "rule_term").join(table, "rule_term").drop("rule_term")
    units = _not_rejected(units.withColumn("folded", normalize(F.col("original"), language)), packs, ["doc_id", "pack", "start", "end"])
    return units.select("doc_id", "pack", "start", "end", "original", "replacement", "term", F.lit("unit").alias("rule"), F.lit("correction").alias("kind"), F.lit("high").alias("band"), F.lit(100).alias("score"), F.lit(100.0).alias("rank"))


def _find(transcripts: DataFrame, packs: Packs, lines: DataFrame | None, mark: int) -> DataFrame:
    """Proposals of packs of one language, with ``pack`` and ``rank``; a step that no pack needs is no part of the plan."""
    language = _language(packs)
    texts = transcripts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ahead, exact = tokens_ahead(texts, language, reach_of(packs, mark)), any(f.exact for p in packs.values() for f in p.forms)
    if _sounding(packs):
        ahead = settled(ahead, "ahead")
    found = settled(reached(windows(ahead, language, exact), packs, mark), "reached")
    spans = exact_spans(found)
    units = _unit_rows(texts, packs) if language.units else None
    own = proposals(found, spans, packs, mark)
    if _sounding(packs):
        plain = ["doc_id", "pack", "start", "end", "term", "rule", "kind", "band", "score"]
        taken = resolve_overlaps(own.select(*plain) if units is None else own.select(*plain).unionByName(units.select(*plain)))
        own = own.unionByName(phonetic(windows(ahead, language, heard=True), taken, packs))
    dictionary = in_context(settled(own, "own"), spans, found, texts, lines, packs)
    original = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    dictionary = dictionary.join(texts, "doc_id").select("doc_id", "pack", "start", "end", original.alias("original"), F.when(F.col("kind") == "alias", original).otherwise(F.col("term")).alias("replacement"), "term", "rule", "kind", "band", "score", "rank")
    every = dictionary if units is None else units.unionByName(dictionary)
    version = F.col("pack")
    for name, pack in packs.items():
        version = F.when(F.col("pack") == name, F.lit(pack.version)).otherwise(version)
    return every.withColumn("pack_version", version)


def find_annotations(transcripts: DataFrame, pack: Pack, lines: DataFrame | None = None) -> DataFrame:
    """All proposals of a pack for ``doc_id, text`` (see ``schemas.ANNOTATIONS``), overlaps included.

    ``lines`` give the stamps that conditions compare; without them distance is counted in tokens. Null
    texts are empty. What the windows reach, a small part of the text, is written between steps: see
    :func:`termloom.session.temporary_tables` for when it goes.
    """
    return _find(transcripts, {"": pack}, lines, MARK_AT).select(*OUTPUT)


def find_annotations_of(transcripts: DataFrame, packs: Packs, lines: DataFrame | None = None) -> DataFrame:
    """:func:`find_annotations` of many packs, with the column ``pack``: texts are read, cut and folded once for all
    packs of a language."""
    by_language: dict[str, dict[str, Pack]] = {}
    for name, pack in packs.items():
        by_language.setdefault(pack.language.code, {})[name] = pack
    out = None
    for some in by_language.values():
        found = _find(transcripts, some, lines, MARK_AT).select("pack", *OUTPUT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no packs")
    return out


def find_annotations_at(transcripts: DataFrame, pack: Pack, thresholds: Sequence[int], lines: DataFrame | None = None) -> DataFrame:
    """:func:`find_annotations` with several marks side by side: scores are computed once, down to the lowest, and
    ``threshold`` says at which mark a proposal stands. A mark above the score that is applied would change more than
    marks and is an error."""
    marks = sorted(set(thresholds))
    if not marks or marks[-1] > APPLY_AT:
        raise ValueError(f"thresholds must be given and at most {APPLY_AT}")
    found = _find(transcripts, {"": pack}, lines, marks[0])
    stands = F.filter(F.array(*map(F.lit, marks)), lambda t: t <= F.col("rank"))
    return found.withColumn("threshold", F.explode(stands)).select("threshold", *OUTPUT)
