"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text."""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytebpe import forget
from ._shared import id_and_text, release, remainder, slabs

#: What a sign may stand for besides itself.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou",
}
#: Costs in nats of what a writer does to a letter.
SWAP, REPEAT, KEEP_SIGN = 1.5, 1.0, 6.0
#: Letters of the longest word looked for within a run of spaced letters.
PART_LENGTH = 16
#: Letters of the longest disguise whose word is remembered.
REMEMBERED_LENGTH = 60
#: Log odds below which a feature is left out: in long texts weak ones would add up.
LEAST_WEIGHT = 3.0
WORD = re.compile(r"[^\W\d_]+")
#: Runs of single letters or signs with the same separator between any two.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|€£])([ .\-_*~])(?:[^\W_]|[@$!|€£])(?:\1(?:[^\W_]|[@$!|€£])(?![^\W_]))+")
#: What separators leave of a token: letters, digits and signs.
PART = re.compile(r"(?:[^\W_]|[@$!|+€£(*#])+")
#: Signs before letters, and those that end a part (other signs there are punctuation).
SIGNED = re.compile(r"[0-9@$!|+€£(*#][^\W\d_]|[^\W\d_][0-9@$€£]+[!|+(*#]*\Z")
#: A letter twice in a row.
DOUBLED = re.compile(r"([^\W\d_])\1")
LETTER_BIT, SIGN_BIT, GAP_BIT, DIGIT_BIT, TAIL_BIT = 1, 2, 4, 8, 16
HAS_STRETCH, HAS_SIGN, HAS_GAPS = 1, 2, 4


@functools.cache
def _bits() -> np.ndarray:
    every = [chr(c) for c in range(0x110000)]
    table = np.fromiter((LETTER_BIT * (c.isalnum() and not c.isdecimal()) | DIGIT_BIT * c.isdecimal() for c in every), np.uint8, 0x110000)
    for c in "0123456789@$!|+€£(*#":
        table[ord(c)] |= SIGN_BIT
    for c in "0123456789@$€£":
        table[ord(c)] |= TAIL_BIT
    for c in " .-_*~":
        table[ord(c)] |= GAP_BIT
    return table


def marks(texts: list[str]) -> np.ndarray:
    """Which disguises each lower-case text can hold, found for all texts at once: all that the expressions find, and more."""
    whole = "\n\n\n\n".join(["", *texts, ""])
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    bits = _bits()[points]
    letter, sign, gap = bits & LETTER_BIT, bits & SIGN_BIT > 0, bits & GAP_BIT > 0
    single = (bits & (LETTER_BIT | DIGIT_BIT) > 0) | sign
    same = points[1:] == points[:-1]
    ends = np.cumsum(np.fromiter((len(t) + 4 for t in texts), np.int64, len(texts))) + 4
    out = np.zeros(len(texts), np.uint8)
    stretched = same & (letter[1:] > 0)
    signed = sign[:-1] & (letter[1:] > 0)
    signed |= (letter[:-1] > 0) & (bits[1:] & TAIL_BIT > 0)
    spaced = single[:-4] & gap[1:-3] & single[2:-2] & gap[3:-1] & single[4:] & (points[1:-3] == points[3:-1])
    for found, bit in ((stretched, HAS_STRETCH), (signed, HAS_SIGN), (spaced, HAS_GAPS)):
        out[np.unique(np.searchsorted(ends, np.flatnonzero(found), "right"))] |= bit
    return out


class CharacterModel:
    """Interpolated trigrams over the letters of words, with marks for both ends."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three, self.two, self.one = Counter(), Counter(), Counter()
        pair, single, total = Counter(), Counter(), 0
        for gram, n in counts.items():
            self.three[gram] += n
            self.two[gram[1:]] += n
            self.one[gram[2]] += n
            pair[gram[:2]] += n
            single[gram[1]] += n
            total += n
        self.pair, self.single, self.total, self.kinds = pair, single, max(total, 1), len(self.one) + 1
        self.known: dict[str, float] = {}

    def cost(self, before: str, letter: str) -> float:
        """Nats of ``letter`` after the two letters ``before``."""
        key = before + letter
        found = self.known.get(key)
        if found is None:
            p1 = (self.one[letter] + 0.1) / (self.total + 0.1 * self.kinds)
            p2 = (self.two[key[1:]] + 4 * p1) / (self.single[before[1]] + 4)
            p3 = (self.three[key] + 4 * p2) / (self.pair[before] + 4)
            found = self.known[key] = -math.log(p3)
        return found


#: Lengths of the word beginnings that count as evidence beside whole words.
BEGINNINGS = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    """The word, closed by a mark, and its beginnings."""
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if k < len(word))]


def trigrams(word: str) -> list[str]:
    marked = f"^^{word}$"
    return [marked[k : k + 3] for k in range(len(marked) - 2)]


def decode(noisy: str, model: CharacterModel) -> str:
    """The likeliest word behind ``noisy`` (lower case, separators removed): Viterbi over its lattice.

    A run of one character is a letter written once, twice or as often as it stands there; a sign is
    itself or a letter it may stand for. The states are the last two letters.
    """
    runs = [(m.group(0)[0], len(m.group(0))) for m in re.finditer(r"(.)\1*", noisy, re.S)]
    paths: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    done = ""
    for at, (sign, n) in enumerate(runs):
        if at % 32 == 31:  # what all paths begin with is settled, so that long texts aren't copied at each step
            shared = len(os.path.commonprefix([text for _, text in paths.values()]))
            done += next(iter(paths.values()))[1][:shared]
            paths = {state: (cost, text[shared:]) for state, (cost, text) in paths.items()}
        arcs: dict[str, float] = {}
        for letter in (sign, *SIGNS.get(sign, "")):
            price = 0.0 if letter == sign and sign.isalpha() else KEEP_SIGN if letter == sign else SWAP
            for k in {1, 2, n} if n > 1 else (1,):
                if k <= n:
                    arcs[letter * k] = price * (1 if letter != sign else k) + (REPEAT if k != n else 0.0)
        following: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in paths.items():
            for out, price in arcs.items():
                spent, now = cost + price, state
                for letter in out:
                    spent += model.cost(now, letter)
                    now = now[1] + letter
                known = following.get(now)
                if known is None or (spent, text + out) < known:
                    following[now] = spent, text + out
        paths = following
    return done + min((cost + model.cost(state, "$"), text) for state, (cost, text) in paths.items())[1]


def disguised(text: str, mark: int = HAS_STRETCH | HAS_SIGN) -> list[str]:
    """The words of a lower-case text whose lattice has more than one path."""
    found = [part.strip("()") for part in PART.findall(text) if SIGNED.search(part)] if mark & HAS_SIGN else []
    if mark & HAS_STRETCH:
        found += [w for w in WORD.findall(text) if DOUBLED.search(w)]
    return [w for w in dict.fromkeys(found) if len(w) > 1]


def collapsed(word: str) -> str:
    """Every run of a letter once."""
    return "".join(a for a, b in zip(word, "\0" + word, strict=False) if a != b)


def spaced_runs(text: str) -> list[str]:
    """Runs of spaced letters of a lower-case text without their separators."""
    return list(dict.fromkeys(m.group(0)[::2] for m in SPACED.finditer(text)))


@dataclass
class ToxicityModel:
    """Weights of words and word beginnings, and the logistic curve over their sum."""

    letters: CharacterModel
    weights: dict[str, float]
    slope: float = 1.0
    shift: float = 0.0
    #: Words with doubled letters that the labelled rows know as clean ones: no disguises.
    known: frozenset[str] = frozenset()
    restored: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.starts = {f.rstrip("$")[:4] for f in self.weights}
        self.bare_starts = {collapsed(f) for f in self.starts}

    def evidence(self, texts: list[str]) -> list[float]:
        """The evidence of each text. Only texts that can hold a disguise are searched for one."""
        lower = [t.lower() for t in texts]
        return [self._of(t, m) for t, m in zip(lower, marks(lower).tolist(), strict=True)]

    def _of(self, text: str, mark: int) -> float:
        words = set(WORD.findall(text))
        if mark:
            words.update(self.restore(w) for w in disguised(text, mark) if self.can_count(w))
        for run in spaced_runs(text) if mark & HAS_GAPS else ():
            # A run can hold more than one word, so its parts are words too.
            whole = self.restore(run)
            words.update(whole[a : a + n] for a in range(len(whole)) for n in range(3, min(PART_LENGTH, len(whole) - a) + 1))
        return self.of_words(words)

    def can_count(self, noisy: str) -> bool:
        """Whether what is behind a disguise can have weight: signs stand for other letters, repetition only for the same."""
        if noisy in self.known:
            return False
        bare = collapsed(noisy) if noisy.isalpha() else ""
        return not bare or any(bare[:k] in self.bare_starts for k in range(1, 5))

    def restore(self, noisy: str) -> str:
        """The likeliest word behind a disguise of any length; short ones are remembered."""
        if len(noisy) > REMEMBERED_LENGTH:
            return decode(noisy, self.letters)
        word = self.restored.get(noisy)
        if word is None:
            if len(self.restored) > 100_000:
                self.restored.clear()
            word = self.restored[noisy] = decode(noisy, self.letters)
        return word

    def of_words(self, words: set[str]) -> float:
        """The sum over distinct words of the strongest weight among a word's features."""
        weights = self.weights
        begun = {w for w in words if w[:4] in self.starts}
        return sum(max((weights.get(f, 0.0) for f in features(w)), default=0.0) for w in begun)

    def scores(self, texts: list[str]) -> list[float]:
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * e + self.shift)))) for e in self.evidence(texts)]


def letter_counts(docs: DataFrame, most_held: int = 200_000) -> dict[str, int]:
    """Trigrams of the words of all documents, a word once per document; a task counts before it sends,
    whenever it holds ``most_held`` words and at its end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words: Counter = Counter()

        def sums() -> pa.RecordBatch:
            grams: Counter = Counter()
            for w, n in words.items():
                for g in trigrams(w):
                    grams[g] += n
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], ["gram", "n"])

        for batch in batches:
            for _, texts in slabs(batch):
                for text in texts:
                    words.update(set(WORD.findall(text.lower())))
                    if len(words) >= most_held:
                        yield sums()
        yield sums()
        release()

    rows = id_and_text(docs).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in rows.collect()}


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most_labelled: int = 20_000, most_words: int = 4_000, support: int = 4) -> ToxicityModel:
    """Learns from at most ``most_labelled`` labelled rows, those whose id has the smallest checksum.

    A word counts for a class once per document, and documents that resemble each other (one smallest word
    hash) count together, so that the other words of a toxic text with many copies don't look toxic. At
    most ``most_words`` words are kept, those with the strongest evidence. The letters of the words of all
    documents, labelled or not, make the character model.
    """
    spark = docs.sparkSession
    wanted = F.crc32(F.col("labelled").cast("string")) % modulus != held_out
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = one.where(wanted).orderBy(F.crc32(F.col("labelled").cast("string")), "labelled").limit(most_labelled)
    sample = [(r["labelled"], r["toxic"]) for r in sample.collect()]
    chosen = spark.createDataFrame(sample or [(None, None)], "labelled long, toxic int")
    # At most ``most_labelled`` ids: broadcast, so that no text is shuffled.
    rows = id_and_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        tally: dict[str, list] = {}
        for batch in batches:
            for toxic, texts in slabs(batch):
                for t, text in zip(toxic, texts, strict=True):
                    words = set(WORD.findall(text.lower()))
                    kind = min((zlib.crc32(w.encode()) for w in words), default=0)
                    for w in {f for word in words for f in features(word)}:
                        own = tally.setdefault(w, [0, 0, None])
                        own[t == 1] += 1
                        if t == 1:
                            own[2] = own[2] or set()
                            if len(own[2]) < 64:
                                own[2].add(kind)
        names = ["key", "clean", "toxic", "kinds"]
        items = [(f"w{w}", a, b, sorted(k or ())) for w, (a, b, k) in tally.items()]
        for at in range(0, len(items), 20_000):
            part = list(zip(*items[at : at + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.list_(pa.int64()))], names)
        del tally, items
        release()

    counts = rows.mapInArrow(count, "key string, clean long, toxic long, kinds array<long>").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    counts = counts.persist()
    grams = letter_counts(docs)
    seen = counts.where(f"key like 'w%' and kinds >= {support}")
    positives = sum(t == 1 for _, t in sample)
    negatives = len(sample) - positives
    # The log odds less one standard error and a half: rare features need to be purer.
    odds = (F.col("toxic") + 0.5) / (positives + 1.0) / ((F.col("clean") + 0.5) / (negatives + 1.0))
    doubt = 1.5 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)) * (F.col("clean") > 0).cast("int")
    strong = seen.withColumn("weight", F.log(odds) - doubt).where(f"weight > {LEAST_WEIGHT}").orderBy(F.desc(F.col("weight") * F.least(F.col("kinds"), F.lit(50))), "key").limit(most_words)
    weights = {r["key"][1:]: r["weight"] for r in strong.collect()}
    # Of the words that clean rows hold, those whose doubled letters could otherwise be taken for a disguise.
    bare = sorted({collapsed(f.rstrip("$")[:4]) for f in weights})
    word = F.regexp_replace("key", r"^w|\$$", "")
    single = F.regexp_replace(word, r"(.)\1+", "$1")
    clean = counts.where("key like 'w%$' and clean > toxic").where(word.rlike(r"(.)\1")).where(F.arrays_overlap(F.array(*(F.substring(single, 1, k) for k in range(1, 5))), F.lit(bare or [""])))
    known = frozenset(r["word"] for r in clean.select(word.alias("word")).collect())
    counts.unpersist()
    model = ToxicityModel(CharacterModel(grams), weights, known=known)
    model.slope, model.shift = _curve(rows, model, positives, negatives)
    return model


def _curve(rows: DataFrame, model: ToxicityModel, positives: int, negatives: int) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, from counts of rounded evidence."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for toxic, texts in slabs(batch):
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([round(min(e, 60.0), 1) for e in model.evidence(texts)], pa.float64())], ["toxic", "evidence"])

    if not positives or not negatives:
        return 0.0, 8.0 if positives else -8.0
    found = rows.mapInArrow(weigh, "toxic int, evidence double").groupBy("evidence").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("evidence").collect()
    x, a, n = (np.array([float(r[c]) for r in found]) for c in ("evidence", "a", "n"))

    def likelihood(w: np.ndarray) -> float:
        z = w[0] * x + w[1]
        return float((a * z - n * np.logaddexp(0, z)).sum() - 0.05 * w[0] ** 2 - 0.005 * w[1] ** 2)

    w = np.array([0.5, -2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w[0] * x + w[1], -30, 30)))
        v = n * p * (1 - p)
        g = np.array([((a - n * p) * x).sum() - 0.1 * w[0], (a - n * p).sum() - 0.01 * w[1]])
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        move = np.linalg.solve(h, g)
        # A full step can overshoot where the classes part cleanly; it is halved until it helps.
        while np.abs(move).max() > 1e-9 and likelihood(w + move) < likelihood(w):
            move /= 2
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    slope, shift = w
    return float(slope), float(shift)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, **bounds: int) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``docs``.

    Labels count only where crc32 of the id's text modulo ``modulus`` is not ``held_out``; a score reads the
    whole text and nothing else. Null texts are empty, repeated rows and null ids each give their row (of
    contradicting labels the toxic one counts), without labels every score is the same low one, an empty
    table gives no rows, further columns are left out.
    """
    out = lambda i: remainder(i, modulus) == held_out
    model = fit(docs, labels, modulus, held_out, **bounds)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for ids, texts in slabs(batch):
                scores = spread.value.scores(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([out(i) for i in ids]), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`score_toxicity` predicts toxic, decided on each row's own text.

    A null text is scored as an empty one and stays null, rows that repeat and null ids are decided each for itself,
    texts of any length are scored whole, an empty table stays empty; further columns stay, whatever their names.
    """
    model = fit(docs, labels)
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keep = [p < 0.5 for _, texts in slabs(batch.select(["doc_id", "text"])) for p in spread.value.scores([t or "" for t in texts])]
            yield batch.filter(pa.array(keep, pa.bool_()))
            release()

    return docs.mapInArrow(clean, docs.schema)
