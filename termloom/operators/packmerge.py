"""Merging packs: the terms of three sides, the conflicts that must be answered, and what answers make of them.

Packs are tables of terms (see ``TERMS``); any number of packs is merged at once, each within itself. Forms are compared
folded. Nothing is asked here: conflicts are rows, answers are rows, and what has no answer waits as ``later``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.languages import Language
from termloom.functions.similarity import indel_ratio, may_reach
from termloom.functions.text import collapse, normalize
from termloom.functions.values import bump
from termloom.schemas import DUPLICATE_AT
from termloom.session import settled

TERMS = (
    "pack string, pos int, term string, class string, aliases array<string>, variants array<string>, collocations array<string>, "
    "context map<string,array<string>>, unless_near map<string,array<string>>, match string, case_sensitive array<string>"
)
LISTS = ("aliases", "variants", "collocations")
SCALARS = ("class", "context", "unless_near", "match")
FIELDS = (*LISTS, "case_sensitive", *SCALARS)
#: What a conflict can be about, and what can be answered.
KINDS = ("class", "kind", "renamed", "duplicate", "form", "learned-removed", "learned-rejected")
MINE, THEIRS, BOTH, LATER = "mine", "theirs", "both", "later"
CONFLICTS = ["pack", "kind", "key", "other_key", "term", "form", "fold", "mine", "theirs", "can_mine", "can_both"]


_ENTRIES = "array<struct<k:string,x:string>>"


def _none() -> Column:
    return F.array().cast(_ENTRIES)


def _list(c: str) -> Column:
    return F.coalesce(F.col(c), _none())


def _folds(entries: Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda e: e["k"]))


def _written(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["x"])


def _filled(entries: Column) -> Column:
    return F.when(F.size(entries) > 0, entries)


def keyed(terms: DataFrame, language: Language) -> DataFrame:
    """Terms with ``key``, the folded name; of terms of one key the last counts, at the first one's place.

    Lists become entries of a form (``x``) and what it folds to (``k``), so that nothing is folded twice.
    """
    entries = lambda c: F.transform(c, lambda x: F.struct(normalize(x, language).alias("k"), x.alias("x"))).alias(c)
    rows = terms.select("pack", "pos", "term", normalize(F.col("term"), language).alias("key"), *[entries(c) for c in LISTS], "case_sensitive", *SCALARS)
    last = F.max_by(F.struct("term", *FIELDS), F.col("pos"))
    return rows.groupBy("pack", "key").agg(F.min("pos").alias("pos"), last.alias("t")).select("pack", "key", "pos", "t.*")


def _kept(base: Column, up: Column, mine: Column) -> Column:
    """Both sides' additions, minus what either side removed from the base, in order of base, theirs, mine."""
    gone = F.filter(base, lambda x: ~F.array_contains(up, x) | ~F.array_contains(mine, x))
    return F.array_except(F.array_distinct(F.concat(base, up, mine)), gone)


def merged_list(base: Column, up: Column, mine: Column) -> Column:
    """Entries of a list as both sides leave it, compared folded; my spelling wins, then theirs."""
    kept = _kept(*map(_folds, (base, up, mine)))
    spelled = F.concat(F.reverse(mine), F.reverse(up), base)
    return F.transform(kept, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(spelled, lambda e: e["k"] == k), F.lit(1))["x"].alias("x")))


def _cased(items: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: collapse(x)))


def _scalar(c: str, x: str) -> Column:
    """A field in a form that can be compared: a map as its sorted entries."""
    if c not in ("context", "unless_near"):
        return F.col(f"{x}.{c}")
    return F.to_json(F.array_sort(F.map_entries(F.col(f"{x}.{c}"))))


def _equal(c: str, x: str, y: str) -> Column:
    return _scalar(c, x).eqNullSafe(_scalar(c, y))


def _same(x: str, y: str) -> Column:
    """Two versions of a term are the same: same name and scalars, same forms (folded), same cased spellings."""
    lists = [F.array_sort(_folds(_list(f"{x}.{c}"))) == F.array_sort(_folds(_list(f"{y}.{c}"))) for c in LISTS]
    cased = F.array_sort(_cased(F.col(f"{x}.case_sensitive"))) == F.array_sort(_cased(F.col(f"{y}.case_sensitive")))
    return reduce(lambda a, b: a & b, [*lists, cased, *[_equal(c, x, y) for c in ("term", *SCALARS)]])


def _forms(key: Column, term: str) -> Column:
    return F.array_distinct(F.concat(F.array(key), _folds(_list(f"{term}.aliases")), _folds(_list(f"{term}.variants"))))


def renames(base: DataFrame, up: DataFrame) -> DataFrame:
    """``pack, key, new_key`` of :func:`keyed` sides: a base term gone upstream and the new upstream term that holds its
    name or forms.

    Base terms choose in their order, the term with most of their forms first (the name counts three times), earlier
    upstream terms before later ones; a term that is taken is gone. Only terms that share a form meet.
    """
    every = F.array_distinct(F.concat(F.array("key"), _folds(_list("aliases")), _folds(_list("variants"))))
    spread = lambda rows, name: rows.select("pack", F.col("key").alias(name), F.col("pos").alias(f"{name}_pos"), F.explode(every).alias("fold"))
    gone = spread(base.join(up.select("pack", "key"), ["pack", "key"], "left_anti"), "key")
    new = spread(up.join(base.select("pack", "key"), ["pack", "key"], "left_anti"), "new_key")
    score = F.sum(F.when(F.col("fold") == F.col("key"), 3).otherwise(1))
    pairs = gone.join(new, ["pack", "fold"]).groupBy("pack", "key", "key_pos", "new_key", "new_key_pos").agg(score.alias("score"))
    order = F.struct("key_pos", (-F.col("score")).alias("less"), "new_key_pos", "key", "new_key")
    return _first_pairs(pairs.select("pack", "key", "new_key", order.alias("place")))


def _first_pairs(pairs: DataFrame) -> DataFrame:
    """``pack, key, new_key``: what choosing by ``place`` leaves when each key and each new key is taken once.

    A pair that is the first one of both its sides is chosen whatever the others do; then all pairs of a chosen side are
    gone, and the rest is looked at again. Each round is two groupings by a side, so that no pack is held in one place.
    """
    rest, chosen = settled(pairs, "pairs"), None
    while not rest.isEmpty():
        first = lambda side: F.min("place").over(Window.partitionBy("pack", side))
        now = rest.withColumns({"of_key": first("key"), "of_new": first("new_key")}).where("place = of_key and place = of_new")
        now = settled(now.select("pack", "key", "new_key"), "renamed")
        chosen = now if chosen is None else chosen.unionByName(now)
        rest = settled(rest.join(now.select("pack", "key"), ["pack", "key"], "left_anti").join(now.select("pack", "new_key"), ["pack", "new_key"], "left_anti").select(rest.columns), "pairs")
    return rest.select("pack", "key", "new_key") if chosen is None else chosen


def plan(base: DataFrame, up: DataFrame, mine: DataFrame, language: Language, three_way: bool = True) -> DataFrame:
    """A row per term of any side: ``pack, key, b, u, m`` (the sides' versions, null where they lack it), ``outcome``,
    ``r`` (what the merge makes of it, null where it goes) under ``r_key``, ``pos`` (its place), ``new_key`` and
    ``new_u`` (of a term renamed upstream). Lists are entries, as :func:`keyed` makes them.

    Outcomes: added, updated, kept, combined, unchanged, removed, left out. Without a base (``three_way`` false) lists
    are united and nothing is removed. Until conflicts are answered, my side stands.
    """
    sides = {n: settled(keyed(rows, language), f"side_{n}") for n, rows in (("b", base.where(F.lit(three_way))), ("u", up), ("m", mine))}
    b, u, m = (rows.select("pack", "key", F.struct("term", *FIELDS).alias(n), F.col("pos").alias(f"{n}_pos")) for n, rows in sides.items())
    moved = settled(renames(sides["b"], sides["u"]), "renames")
    rows = b.join(u, ["pack", "key"], "full_outer").join(m, ["pack", "key"], "full_outer")
    # An upstream term of a new name stands in the row of its old one.
    rows = rows.join(moved.select("pack", F.col("new_key").alias("key")), ["pack", "key"], "left_anti")
    renamed = moved.join(u.select("pack", F.col("key").alias("new_key"), F.col("u").alias("new_u"), F.col("u_pos").alias("new_pos")), ["pack", "new_key"])
    rows = rows.join(renamed, ["pack", "key"], "left")
    has = lambda x: F.col(x).isNotNull()
    one_name, both = has("new_key"), has("u") & has("m")

    def field(c: str) -> Column:
        of = lambda x: F.col(f"{x}.{c}")
        if c in LISTS:
            return _filled(merged_list(*(_list(f"{x}.{c}") for x in "bum")))
        if c == "case_sensitive":
            return _filled(_kept(*(_cased(of(x)) for x in "bum")))
        if c == "term":
            mine = (of("m") != of("b")) & (of("u") == of("b"))
            return F.when(has("b") & ~mine, of("u")).otherwise(of("m"))
        # Where both sides changed it, mine stands until that is answered.
        return F.when(has("b"), F.when(_equal(c, "b", "m"), of("u")).otherwise(of("m"))).otherwise(F.coalesce(of("m"), of("u")))

    rows = rows.withColumn("united", F.when(both, F.struct(*[field(c).alias(c) for c in ("term", *FIELDS)])))
    rows = rows.withColumns({"mb": _same("m", "b"), "ub": _same("u", "b"), "same_m": _same("united", "m")})
    outcome = (
        F.when(one_name, F.when(~has("m"), "left out").when(F.col("mb"), "updated").otherwise("kept"))
        .when(both & ~has("b"), F.when(F.col("same_m"), "kept").otherwise("combined"))
        .when(both & F.col("mb"), F.when(F.col("ub"), "unchanged").otherwise("updated"))
        .when(both, F.when(F.col("ub"), "kept").otherwise("combined"))
        .when(has("u"), F.when(has("b"), "left out").otherwise("added"))
        .when(has("m") & has("b") & F.col("mb"), "removed")
        .when(has("m"), "kept")
        .otherwise("left out")
    )
    rows = rows.withColumn("outcome", outcome)
    fresh_name = one_name & (F.col("outcome") == "updated")
    result = (
        F.when(fresh_name, F.col("new_u"))
        .when(F.col("outcome").isin("left out", "removed"), None)
        .when(both & has("b") & F.col("mb"), F.col("u"))
        .when(both & ~(has("b") & F.col("ub")), F.col("united"))
        .otherwise(F.coalesce("m", "u"))
    )
    place = F.struct(F.coalesce("new_pos", "u_pos").isNull().alias("own"), F.coalesce("new_pos", "u_pos", "m_pos").alias("at"))
    return rows.select("pack", "key", "b", "u", "m", "new_key", "new_u", "outcome", result.alias("r"), place.alias("pos"), F.when(fresh_name, F.col("new_key")).otherwise(F.col("key")).alias("r_key"))


def _conflict(rows: DataFrame, kind: str, **columns: Column) -> DataFrame:
    given = {"other_key": F.lit(None).cast("string"), "form": F.lit(None).cast("string"), "fold": F.lit(None).cast("string"), "can_mine": F.lit(True), "can_both": F.lit(False)} | columns
    return rows.select("pack", F.lit(kind).alias("kind"), *[given[c].alias(c) for c in CONFLICTS if c not in ("pack", "kind")])


def term_conflicts(planned: DataFrame, three_way: bool = True) -> DataFrame:
    """Conflicts of the terms themselves (see ``CONFLICTS``): class, kind, renamed, duplicate."""
    both = planned.where("u is not null and m is not null and new_key is null")
    differs = ~F.col("u.class").eqNullSafe(F.col("m.class"))
    apart = F.when(F.col("b").isNotNull(), differs & ~F.col("b.class").eqNullSafe(F.col("u.class")) & ~F.col("b.class").eqNullSafe(F.col("m.class"))).otherwise(differs & F.col("u.class").isNotNull() & F.col("m.class").isNotNull())
    klass = _conflict(both.where(apart), "class", key=F.col("key"), term=F.col("m.term"), mine=F.col("m.class"), theirs=F.col("u.class"))
    # Without a base, a form that is an alias here and a variant there.
    fold = lambda c: _folds(_list(c))
    crossed = F.array_union(F.array_intersect(fold("u.aliases"), fold("m.variants")), F.array_intersect(fold("u.variants"), fold("m.aliases")))
    new = both.where("b is null").select("pack", "key", "m", fold("m.aliases").alias("own"), F.explode(crossed).alias("fold"))
    mine = F.when(F.array_contains("own", F.col("fold")), "alias").otherwise("variant")
    written = F.element_at(F.filter(F.concat(_list("m.aliases"), _list("m.variants")), lambda e: e["k"] == F.col("fold")), F.lit(1))["x"]
    kind = _conflict(new, "kind", key=F.col("key"), term=F.col("m.term"), form=written, fold=F.col("fold"), mine=mine, theirs=F.when(mine == "alias", "variant").otherwise("alias"))
    if not three_way:
        return klass.unionByName(kind)
    renamed = planned.where("new_key is not null and outcome = 'kept'")
    renamed = _conflict(renamed, "renamed", key=F.col("key"), other_key=F.col("new_key"), term=F.col("m.term"), mine=F.col("b.term"), theirs=F.col("new_u.term"))
    ours = planned.where("m is not null and b is null and u is null").select("pack", F.col("key").alias("a"), F.col("m.term").alias("a_term"), _forms(F.col("key"), "m").alias("a_forms"))
    theirs = planned.where("outcome = 'added'").select("pack", F.col("key").alias("z"), F.col("u.term").alias("z_term"), _forms(F.col("key"), "u").alias("z_forms"))
    close = _near_names(ours, theirs)
    twin = _conflict(close, "duplicate", key=F.col("a"), other_key=F.col("z"), term=F.col("a_term"), mine=F.col("a_term"), theirs=F.col("z_term"), can_both=~F.arrays_overlap("a_forms", "z_forms"))
    return klass.unionByName(kind).unionByName(renamed).unionByName(twin)


def _near_names(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pairs of names ``a`` and ``z`` of a pack whose ratio is at least ``DUPLICATE_AT``.

    Names of n and m letters are that close if at most d = (n + m) * (100 - DUPLICATE_AT) / 100 letters are put in or
    taken out. Of d + 1 pieces of ``a`` one is then whole in ``z``, moved by no more letters than were put in or taken out
    before it: names meet on such pieces, not with all names of their length.
    """
    near = DUPLICATE_AT / (200 - DUPLICATE_AT)
    n, m = F.col("size"), F.length("z")
    # d + 1 for the longest z that a may be compared with.
    pieces = (F.floor((n + F.floor(n / near + 1e-9)) * (100 - DUPLICATE_AT) / 100 + 1e-9) + 1).cast("int")
    begin = lambda k: F.floor(n * k / F.col("pieces")).cast("int")
    piece = lambda text, k, moved: F.substring(text, begin(k) + 1 + moved, begin(k + 1) - begin(k))
    left = ours.withColumn("size", F.length("a")).withColumn("pieces", pieces)
    met = left.select("pack", "size").distinct()
    left = left.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("piece", piece(F.col("a"), F.col("k"), F.lit(0)))
    sizes = F.sequence(F.ceil(m * near - 1e-9).cast("int"), F.floor(m / near + 1e-9).cast("int"))
    right = theirs.withColumn("size", F.explode(sizes)).join(met, ["pack", "size"], "left_semi").withColumn("pieces", pieces)
    most = F.floor((n + m) * (100 - DUPLICATE_AT) / 100 + 1e-9)
    out, in_ = F.floor((most - (m - n)) / 2).cast("int"), F.floor((most + (m - n)) / 2).cast("int")
    right = right.where((out >= 0) & (in_ >= 0)).withColumn("moved", F.explode(F.sequence(-out, in_))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    right = right.where((begin(F.col("k")) + F.col("moved") >= 0) & (begin(F.col("k") + 1) + F.col("moved") <= m)).withColumn("piece", piece(F.col("z"), F.col("k"), F.col("moved")))
    side = lambda rows, name: rows.select("pack", "size", "k", "piece", name).distinct()
    pairs = side(left, "a").join(side(right, "z"), ["pack", "size", "k", "piece"]).select("pack", "a", "z")
    # Few bytes and much work: dealt to all tasks, and each pair once, however many pieces it shares.
    parts = int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(parts, "pack", "a", "z").groupBy("pack", "a", "z").agg(F.count(F.lit(1)).alias("shared"))
    reach = F.when((F.col("shared") > 0) & may_reach(F.col("a"), F.col("z"), DUPLICATE_AT), indel_ratio(F.col("a"), F.col("z")))
    pairs = pairs.where(reach >= DUPLICATE_AT).drop("shared")
    return pairs.join(ours, ["pack", "a"]).join(theirs, ["pack", "z"])


def result_terms(planned: DataFrame) -> DataFrame:
    """``pack, key, pos, term`` and the fields of what a plan leaves, before any answer."""
    return planned.where("r is not null").select("pack", F.col("r_key").alias("key"), "pos", "r.*")


def form_conflicts(result: DataFrame, planned: DataFrame) -> DataFrame:
    """Forms of mine that another term has from upstream; of several places on a side the first counts."""
    of = lambda place, entries: F.transform(entries, lambda e: F.struct(F.lit(place).alias("place"), e["k"].alias("fold"), e["x"].alias("form")))
    every = F.concat(of(0, F.array(F.struct(F.col("key").alias("k"), F.col("term").alias("x")))), of(1, _list("aliases")), of(2, _list("variants")))
    places = result.select("pack", "key", "pos", "term", F.posexplode(every).alias("at", "f")).select("pack", "key", "pos", "term", "at", "f.*")
    upstream = planned.where("u is not null").select("pack", "key", F.explode(_forms(F.col("key"), "u")).alias("fold"))
    upstream = upstream.unionByName(planned.where("new_u is not null").select("pack", F.col("new_key").alias("key"), F.explode(_forms(F.col("new_key"), "new_u")).alias("fold"))).distinct()
    sided = places.join(upstream.withColumn("theirs", F.lit(True)), ["pack", "key", "fold"], "left")
    where = F.struct("pos", "at", "key", "term", "form", "place")
    met = sided.groupBy("pack", "fold").agg(F.min(F.when(F.col("theirs").isNull(), where)).alias("m"), F.min(F.when(F.col("theirs"), where)).alias("t")).where("m.key <> t.key")
    return _conflict(met, "form", key=F.col("m.key"), other_key=F.col("t.key"), term=F.col("m.term"), form=F.col("m.form"), fold=F.col("fold"), mine=F.col("m.term"), theirs=F.col("t.term"), can_mine=F.col("t.place") != 0)


def learned_conflicts(result: DataFrame, planned: DataFrame, confirmed: DataFrame, rejected: DataFrame, language: Language, three_way: bool = True) -> DataFrame:
    """Variants that I confirmed (``pack, term, text``) and upstream removed; forms that I rejected and upstream added."""
    keyed_layer = lambda rows: rows.select("pack", normalize(F.col("term"), language).alias("key"), "term", "text", normalize(F.col("text"), language).alias("fold"))
    there = planned.join(result.select("pack", "key"), ["pack", "key"], "left_semi").select("pack", "key", "b", "u", "m")
    has = lambda side, c: F.exists(_list(f"{side}.{c}"), lambda e: e["k"] == F.col("fold"))
    lost = keyed_layer(confirmed).join(there.where("b is not null and u is not null"), ["pack", "key"]).where(has("b", "variants") & ~has("u", "variants"))
    removed = _conflict(lost, "learned-removed", key=F.col("key"), term=F.col("term"), form=F.col("text"), fold=F.col("fold"), mine=F.col("text"), theirs=F.lit(None).cast("string"))
    before = "b" if three_way else "m"
    back = keyed_layer(rejected).join(there.where("u is not null"), ["pack", "key"])
    back = back.where((has("u", "aliases") | has("u", "variants")) & ~(has(before, "aliases") | has(before, "variants")))
    added = _conflict(back, "learned-rejected", key=F.col("key"), term=F.col("term"), form=F.col("text"), fold=F.col("fold"), mine=F.lit(None).cast("string"), theirs=F.col("text"))
    return removed.unionByName(added)


def answered(conflicts: DataFrame, answers: DataFrame | None = None, preset: str | None = None) -> DataFrame:
    """Conflicts with ``answer``: the one that ``answers`` (``pack, kind, key, other_key, fold, answer``) has, else the
    preset, else later. An answer that a conflict does not take is later too."""
    given = F.lit(preset or LATER)
    rows = conflicts
    if answers is not None:
        blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        told = answers.select("pack", "kind", "key", blank("other_key").alias("other_"), blank("fold").alias("fold_"), F.col("answer").alias("told")).distinct()
        rows = rows.withColumn("other_", blank("other_key")).withColumn("fold_", blank("fold")).join(told, ["pack", "kind", "key", "other_", "fold_"], "left").drop("other_", "fold_")
        given = F.coalesce("told", given)
    allowed = F.when(given == MINE, F.col("can_mine")).when(given == BOTH, F.col("can_both")).otherwise(given.isin(THEIRS, LATER))
    return rows.withColumn("answer", F.when(allowed, given).otherwise(LATER)).select(*CONFLICTS, "answer")


def _without(c: str, folds: Column) -> Column:
    return _filled(F.filter(_list(c), lambda e: ~F.array_contains(folds, e["k"])))


def _with_term_answers(planned: DataFrame, told: DataFrame) -> DataFrame:
    """The result after answers to class, kind, renamed and duplicate conflicts."""
    result = result_terms(planned)
    takes = told.groupBy("pack", "key").agg(
        F.max(F.when((F.col("kind") == "class") & (F.col("answer") == THEIRS), F.struct("theirs"))).alias("klass"),
        F.collect_list(F.when(F.col("kind") == "kind", F.struct(F.col("fold").alias("k"), F.col("form").alias("x"), F.when(F.col("answer") == THEIRS, F.col("theirs")).otherwise(F.col("mine")).alias("as")))).alias("kinds"),
        F.max((F.col("kind") == "renamed") & (F.col("answer") == THEIRS)).alias("renamed"),
        F.max((F.col("kind") == "duplicate") & (F.col("answer") == THEIRS)).alias("gives_way"),
    )
    yields = told.where("kind = 'duplicate' and answer in ('mine', 'later')").select("pack", F.col("other_key").alias("key")).distinct()
    rows = result.join(yields, ["pack", "key"], "left_anti").join(takes, ["pack", "key"], "left")
    kinds = F.coalesce("kinds", F.array().cast("array<struct<k:string,x:string,as:string>>"))
    put = lambda name: F.transform(F.filter(kinds, lambda x: x["as"] == name), lambda x: F.struct(x["k"].alias("k"), x["x"].alias("x")))
    lists = {c: _filled(F.concat(F.coalesce(_without(c, _folds(kinds)), _none()), put(name))) for c, name in (("aliases", "alias"), ("variants", "variant"))}
    rows = rows.where(~(F.coalesce("renamed", F.lit(False)) | F.coalesce("gives_way", F.lit(False))))
    rows = rows.withColumns(lists | {"class": F.when(F.col("klass").isNotNull(), F.col("klass.theirs")).otherwise(F.col("class"))}).select(result.columns)
    named = told.where("kind = 'renamed' and answer = 'theirs'").select("pack", "key")
    moved = planned.join(named, ["pack", "key"], "left_semi")
    own = lambda c: F.filter(merged_list(_list(f"b.{c}"), _list(f"new_u.{c}"), _list(f"m.{c}")), lambda e: e["k"] != F.col("new_key"))
    fresh = {c: F.when(F.size(own(c)) > 0, own(c)).otherwise(F.col(f"new_u.{c}")) if c in ("aliases", "variants") else F.col(f"new_u.{c}") for c in FIELDS}
    moved = moved.select("pack", F.col("new_key").alias("key"), "pos", F.col("new_u.term").alias("term"), *[fresh[c].alias(c) for c in FIELDS])
    return rows.unionByName(moved)


def _with_form_answers(result: DataFrame, told: DataFrame) -> DataFrame:
    """The result after answers to form and learned conflicts; then cased spellings whose form is gone are dropped."""
    from_mine = told.where("kind = 'form' and answer = 'theirs' or kind = 'learned-rejected' and answer in ('mine', 'later')").select("pack", "key", "fold")
    from_theirs = told.where("kind = 'form' and answer = 'mine'").select("pack", F.col("other_key").alias("key"), "fold")
    drops = from_mine.unionByName(from_theirs).groupBy("pack", "key").agg(F.collect_set("fold").alias("drops"))
    adds = told.where("kind = 'learned-removed' and answer in ('mine', 'later')").groupBy("pack", "key").agg(F.sort_array(F.collect_set(F.struct(F.col("fold").alias("k"), F.col("form").alias("x")))).alias("adds"))
    rows = result.join(drops, ["pack", "key"], "left").join(adds, ["pack", "key"], "left")
    none = F.array().cast("array<string>")
    cut = {c: _without(c, F.coalesce("drops", none)) for c in ("aliases", "variants")}
    cut["variants"] = _filled(F.concat(F.coalesce(cut["variants"], _none()), F.coalesce("adds", _none())))
    rows = rows.withColumns(cut).select(result.columns)
    own = _cased(F.concat(F.array("term"), _written(_list("aliases")), _written(_list("variants"))))
    listed = F.filter(F.coalesce("case_sensitive", none), lambda x: F.array_contains(own, collapse(x)))
    return rows.withColumn("case_sensitive", F.when(F.col("match") == "exact", _filled(listed)))


def merge(base: DataFrame, up: DataFrame, mine: DataFrame, confirmed: DataFrame, rejected: DataFrame, language: Language, answers: DataFrame | None = None, preset: str | None = None, three_way: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(terms, conflicts, plan)`` of a merge: the merged terms with ``key`` and ``pos``, every conflict with its
    answer, and the plan with the outcomes.

    Conflicts of terms are answered first; what they leave may collide in forms or with the learned layer, which is
    asked then. Merging again with more answers changes nothing that was answered before, so answers may come in any
    number of turns; ``later`` keeps my side.
    """
    planned = settled(plan(base, up, mine, language, three_way), "plan")
    asked = settled(term_conflicts(planned, three_way), "asked")
    return _answered_merge(planned, asked, confirmed, rejected, language, answers, preset, three_way)


def _answered_merge(planned: DataFrame, asked: DataFrame, confirmed: DataFrame, rejected: DataFrame, language: Language, answers: DataFrame | None, preset: str | None, three_way: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    first = answered(asked, answers, preset)
    between = settled(_with_term_answers(planned, first), "between")
    then = form_conflicts(between, planned).unionByName(learned_conflicts(between, planned, confirmed, rejected, language, three_way))
    then = settled(answered(then, answers, preset), "conflicts")
    merged = _with_form_answers(between, then)
    return merged.withColumns({c: _written(F.col(c)) for c in LISTS}), first.unionByName(then), planned


def merges(base: DataFrame, up: DataFrame, mine: DataFrame, confirmed: DataFrame, rejected: DataFrame, language: Language, presets: Iterable[str], three_way: bool = True) -> DataFrame:
    """The merged terms of :func:`merge` under several presets (column ``preset``), from one plan and one search for
    conflicts of terms."""
    planned = settled(plan(base, up, mine, language, three_way), "plan")
    asked = settled(term_conflicts(planned, three_way), "asked")
    parts = [_answered_merge(planned, asked, confirmed, rejected, language, None, p, three_way)[0].withColumn("preset", F.lit(p)) for p in presets]
    return reduce(DataFrame.unionByName, parts)


HEADS = (
    "pack string, language string, version string, min_engine string, name string, field string, description string, "
    "classes array<string>, phonetic_classes array<string>, based_on string, local_edits int"
)
#: Heads that a copy keeps for itself, and lists that are merged as those of terms are.
OWN_HEADS, HEAD_LISTS = ("name", "field", "based_on", "local_edits"), ("classes", "phonetic_classes")


def edits(terms: DataFrame, up: DataFrame, language: Language) -> DataFrame:
    """``pack, local_edits``: terms that differ from upstream's, that it lacks or that it has beside them."""
    side = lambda rows, n: keyed(rows, language).select("pack", "key", F.struct("term", *FIELDS).alias(n))
    beside = side(terms, "m").join(side(up, "u"), ["pack", "key"], "full_outer")
    differs = F.col("m").isNull() | F.col("u").isNull() | ~_same("m", "u")
    return beside.groupBy("pack").agg(F.sum(differs.cast("int")).cast("int").alias("local_edits"))


def merged_heads(base: DataFrame, up: DataFrame, mine: DataFrame, counted: DataFrame, language: Language) -> DataFrame:
    """Heads of merged packs: upstream's, but the copy's own ones, with both sides' classes and the record of what they
    are based on; an edited pack gets a version of its own."""
    side = lambda rows, n: rows.select("pack", F.struct(*[c.split()[0] for c in HEADS.split(", ")[1:]]).alias(n))
    rows = side(up, "u").join(side(mine, "m"), "pack", "left").join(side(base, "b"), "pack", "left").join(counted.withColumnRenamed("local_edits", "edits"), "pack", "left")
    entries = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(normalize(x, language).alias("k"), x.alias("x")))
    picked = {c.split()[0]: F.col(f"u.{c.split()[0]}") for c in HEADS.split(", ")[1:]}
    picked |= {c: F.coalesce(F.col(f"m.{c}"), F.col(f"u.{c}")) for c in OWN_HEADS}
    for c in HEAD_LISTS:
        united = _written(merged_list(*(entries(f"{x}.{c}") for x in "bum")))
        picked[c] = F.when(F.col(f"u.{c}").isNotNull() | F.col(f"m.{c}").isNotNull(), united)
    changed = F.coalesce("edits", F.lit(0))
    picked |= {"version": F.when(changed > 0, bump(F.col("u.version"))).otherwise(F.col("u.version")), "based_on": F.concat_ws("@", "pack", "u.version"), "local_edits": changed}
    return rows.select("pack", *[v.alias(c) for c, v in picked.items()])


def assembled(terms: DataFrame, heads: DataFrame) -> DataFrame:
    """``pack, n_terms, content``: each pack as one JSON text, its heads first and its terms nested again in their order;
    what is null or empty is left out, so that it reads as the file that the tables came from."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    fields = [F.col("term"), F.col("class"), *[filled(c) for c in LISTS], filled("context"), filled("unless_near"), F.col("match"), filled("case_sensitive")]
    nested = terms.select("pack", "pos", F.to_json(F.struct(*fields)).alias("term_json"))
    nested = nested.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("pos", "term_json"))).alias("terms"))
    rows = heads.join(nested, "pack", "left")
    inner = F.array_join(F.transform("terms", lambda t: t["term_json"]), ",")
    head = F.to_json(F.struct(*[filled(c) if c in HEAD_LISTS else F.col(c) for c in heads.columns if c != "pack"]))
    listed = F.concat(F.lit('"terms":['), F.coalesce(inner, F.lit("")), F.lit("]}"))
    body = F.substring(head, F.lit(1), F.length(head) - 1)
    return rows.select("pack", F.greatest(F.coalesce(F.size("terms"), F.lit(0)), F.lit(0)).alias("n_terms"), F.concat(body, F.when(body == "{", "").otherwise(","), listed).alias("content"))


def pack_tables(spark: SparkSession, packs: Mapping[str, dict]) -> tuple[DataFrame, DataFrame]:
    """``(terms, heads)`` of packs given as their files' content."""
    names = [c.split()[0] for c in TERMS.split(", ")]
    terms = [tuple(({"pack": p, "pos": k} | t).get(c) for c in names) for p, data in packs.items() for k, t in enumerate(data.get("terms") or ())]
    own = [c.split()[0] for c in HEADS.split(", ")]
    heads = [tuple(({**data, "pack": p}).get(c) for c in own) for p, data in packs.items()]
    return spark.createDataFrame(terms, TERMS), spark.createDataFrame(heads, HEADS)


def unsettled(conflicts: DataFrame) -> DataFrame:
    """What a later turn has to ask."""
    return conflicts.where(F.col("answer") == LATER)
