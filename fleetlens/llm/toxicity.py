"""Toxic texts by a weighted lexicon (operator 6).

Texts are folded: letters to lower case without accents, compatible forms (full-width, mathematical,
circled) and look-alike letters of other scripts to Latin ones, digits that stand for letters to those
letters, everything that is no letter to a space.  What can be read in two ways is read in both: words
with a sign for a letter inside ("id!ot") and letters that stand apart ("i d i o t", "i.d.i.o.t") are also
added to the text as the word they spell.  Entries of the lexicon are beginnings of words, matched by one
Aho-Corasick automaton; a match inside an exception doesn't count.  The summed weights, plain and
normalised by length, go through a calibrated logistic curve.

The lexicon starts from a few insults and learns more from labelled training rows: beginnings of
words that occur in toxic texts and (nearly) never in others.  They are counted and tested in Spark over
a bounded sample, without a cap on their number; among those whose lower bound of the log odds passes, a
greedy cover picks, until every toxic text of the sample holds some entries or none is held by `least`
texts that need one.

Defined results: a null or empty text has no match and scores like one.  Without labels of both
kinds a fixed curve is used.  Ties in learning go to the longer, then to the first entry in order.
Repeated rows score alike; other columns play no part.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.labelled import labelled_sample
from fleetlens.llm.quality import calibrate
from fleetlens.llm.scratch import store

# Insults to start from, all with the same weight, and phrases in which they are harmless.
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "dumbass", "bastard", "imbecile",
         "retard", "asshole", "bitch")
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "clownfish", "scumble", "pond scum", "pathetic fallacy",
              "worthless check", "morone", "losers bracket")
SEED_WEIGHT = 4.0

# Digits and signs that stand for letters, and look-alike letters of other scripts.
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a"}
_ALIKE = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
          "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
          "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g"}
_FOLD = str.maketrans(_ALIKE | dict.fromkeys("\u200b\u200c\u200d\u00ad\ufeff"))
_MARKS = re.compile("[\u0300-\u036f]+")

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
_PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)
_PLAIN[0x80:] = np.arange(0x80, 0x100)
for _a, _b in _LEET.items():
    _PLAIN[ord(_a)] = ord(_b)
# lead bytes of accented, compatible and look-alike letters, combining marks and invisible characters
_ODD = np.zeros(256, bool)
_ODD[0xC2:0xD5] = True
_ODD[[0xE1, 0xE2, 0xEF, 0xF0]] = True

# Signs that stand for letters where a letter follows.
_SIGNS = bytes.maketrans(b"!$|", b"isl")
_SIGNED = re.compile(rb"[!$|][A-Za-z0-9@]")
_APART = re.compile(r"(?<![^ \n])(?:[a-z] {1,3}){2,}[a-z](?![^ \n])")

_WORD_END = re.compile(r"s?(?:[ \n]|$)")
SHORTEST, LONGEST = 3, 12


def _latin(text: str) -> str:
    """Lower case, compatible forms, no accents, look-alikes as Latin letters."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", text.lower())).lower().translate(_FOLD)


def _signed(raw: np.ndarray, offsets: np.ndarray) -> dict[int, str]:
    """For texts with a sign before a letter, the words with letters for these signs."""
    sign = (raw == 0x21) | (raw == 0x24) | (raw == 0x7C)
    at = np.flatnonzero(sign[:-1] & (_PLAIN.take(raw[1:]) != 0x20) & ~sign[1:])
    out = {}
    for k in np.unique(np.searchsorted(offsets, at, "right") - 1).tolist():
        words = [w for w in raw[offsets[k]:offsets[k + 1]].tobytes().split() if _SIGNED.search(w)]
        if words:
            out[k] = b" ".join(words).translate(_SIGNS).decode("latin-1")
    return out


def fold(column: pa.Array) -> tuple[str, np.ndarray]:
    """All texts folded, each behind a line feed and a space, as one string with a character for each byte; and where
    each begins."""
    data, offsets = bw.raw_bytes(column)
    odd = bw.sum_by(_ODD.take(data).astype(np.int32), offsets) > 0
    if odd.any():
        texts = column.to_pylist()
        for k in np.flatnonzero(odd):
            texts[k] = _latin(texts[k])
        data, offsets = bw.raw_bytes(pa.array(texts, pa.large_string()))
    data = data[:offsets[-1]]
    spelled = _signed(data, offsets) if len(data) > 1 else {}
    raw = np.insert(_PLAIN.take(data), np.repeat(offsets[:-1], 2), np.tile(np.array([0x0A, 0x20], np.uint8), len(offsets) - 1))
    text, begins = raw.tobytes().decode("latin-1"), offsets[:-1] + 2 * np.arange(len(offsets) - 1)
    for m in _APART.finditer(text):
        k = int(np.searchsorted(begins, m.start(), "right")) - 1
        spelled[k] = f"{spelled.get(k, '')} {m.group().replace(' ', '')}"
    if not spelled:
        return text, begins
    parts, done = [], 0
    longer = np.zeros(len(begins), np.int64)
    for k in sorted(spelled):
        more = " " + _PLAIN.take(np.frombuffer(spelled[k].encode("latin-1"), np.uint8)).tobytes().decode("latin-1")
        end = int(begins[k + 1]) if k + 1 < len(begins) else len(text)
        parts += [text[done:end], more]
        done, longer[k] = end, len(more)
    return "".join([*parts, text[done:]]), begins + np.cumsum(longer) - longer


def folded(word: str) -> str:
    return fold(pa.array([word], pa.string()))[0][2:]


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(" " + entry, (weight, len(entry)))
        for phrase in exceptions:  # a single word is a beginning as entries are; a phrase goes to the end of its last word
            self.automaton.add_word(" " + folded(phrase), (0.0 if " " in phrase else -1.0, len(folded(phrase))))
        self.automaton.make_automaton()

    def weigh(self, column: pa.Array) -> np.ndarray:
        """Features of each text: damped weight, and damped weight per hundred words."""
        text, begins = fold(column)
        found = []
        barred: dict[int, int] = {}
        for end, (weight, length) in self.automaton.iter(text):
            if weight > 0:
                found.append((end - length + 1, weight))
            elif weight < 0 or _WORD_END.match(text, end + 1):
                barred[end - length + 1] = max(end, barred.get(end - length + 1, 0))
        # the heaviest entry at a place, and none where an exception phrase covers the place
        best: dict[int, float] = {}
        for at, weight in found:
            best[at] = max(weight, best.get(at, 0.0))
        covered = {k for lo, hi in barred.items() for k in range(lo, hi + 1)}
        total = np.zeros(len(begins))
        if best:
            places = np.array([at for at in best if at not in covered], np.int64)
            weights = np.array([w for at, w in best.items() if at not in covered])
            np.add.at(total, np.searchsorted(begins, places, "right") - 1, weights)
        words = np.maximum(bw.split_words(column).per_doc, 20)
        return np.stack([np.log1p(total), np.log1p(100 * total / words)], axis=1)


def _entries(text: str) -> set[str]:
    """Beginnings of the words of a folded text."""
    out = set()
    for word in set(text.replace("\n", " ").split(" ")):
        out.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


def _each(column: pa.Array) -> Iterator[str]:
    for k in range(len(column)):
        yield fold(column.slice(k, 1))[0]


def _frequencies(rows: DataFrame) -> DataFrame:
    """(entry, n): number of texts with each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 0, bw.BLOCK_BYTES // 3):
                seen: Counter[str] = Counter()
                for text in _each(block.column(0)):
                    seen.update(_entries(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])

    return rows.mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def _tested(toxic: DataFrame, clean: DataFrame, n1: int, n0: int, least: int) -> dict[str, tuple[float, int]]:
    """Log odds and number of toxic texts of the entries that the test of their odds lets pass.

    The lower bound of the log odds (95 % one-sided) is at least 0.5, and at most 2 % as many other texts hold them.
    """
    often = _frequencies(toxic).where(F.col("n") >= least)
    both = often.join(_frequencies(clean).withColumnRenamed("n", "m"), "entry", "left").fillna(0, "m")
    odds = F.log((F.col("n") + 0.5) / (n1 + 1)) - F.log((F.col("m") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("n") + 0.5) + 1 / (F.col("m") + 0.5))
    both = both.withColumn("odds", odds).where((odds > 1.5) & (odds - 1.64 * error >= 0.5) & (F.col("m") <= 0.02 * F.col("n")))
    return {r.entry: (r.odds, r.n) for r in both.select("entry", "odds", "n").toLocalIterator()}


def _choose(toxic: list[set[str]], weights: dict[str, float], need: int, least: int) -> list[str]:
    """Greedy cover: entries that most texts with fewer than `need` entries hold."""
    holders: dict[str, set[int]] = {}
    for k, own in enumerate(toxic):
        for e in own:
            holders.setdefault(e, set()).add(k)
    covered = Counter()
    open_texts = set(range(len(toxic)))
    chosen: list[str] = []
    queue = [(-len(h), -weights[e], -len(e), e) for e, h in holders.items()]
    heapq.heapify(queue)
    while queue and -queue[0][0] >= least:
        _, weight, length, entry = heapq.heappop(queue)
        # what begins like a chosen entry finds nothing new, and nothing shorter is cleaner
        if any(e.startswith(entry) or entry.startswith(e) for e in chosen):
            continue
        now = (-len(holders[entry] & open_texts), weight, length, entry)
        if queue and now > queue[0]:  # it covers less than when it was queued; others may cover more
            heapq.heappush(queue, now)
            continue
        if -now[0] < least:
            break
        chosen.append(entry)
        for k in holders[entry]:
            covered[k] += 1
            if covered[k] >= need:
                open_texts.discard(k)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, label: str = "toxic", modulus: int = 3, remainder: int = 1,
        id_col: str = "doc_id", text_col: str = "text", least: int = 3) -> dict:
    """Weights of the lexicon and the curve, from at most `most` training rows of each label."""
    rows = store(labelled_sample(docs, labels, label, most, modulus, remainder, id_col, text_col), "toxic")
    sizes = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    weights = {folded(w): SEED_WEIGHT for w in SEEDS}
    if not n1 or not n0:
        return {"weights": weights, "slope": [1.0, 1.0], "shift": -2.0}
    toxic = rows.where("_label = 1").dropDuplicates(["_text"]).select("_text")
    clean = rows.where("_label = 0").select("_text")
    passed = _tested(toxic, clean, n1, n0, least)
    good = {e: w for e, (w, _) in passed.items()}
    # an entry that always goes on in one way says less than its longer form
    closed = _closed({e: n for e, (_, n) in passed.items()})
    shared = docs.sparkSession.sparkContext.broadcast(closed)

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(_entries(t) & shared.value) for t in _each(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["own"])

    held = [set(r.own) for r in toxic.mapInArrow(holding, "own array<string>").toLocalIterator()]
    for e in _choose(held, good, 3, least):
        weights[e] = max(SEED_WEIGHT / 2, min(good[e], 8.0))
    lexicon = docs.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lexicon(lexicon.value)
        for batch in batches:
            for block in bw.blocks(batch, 1):
                x = found.weigh(block.column(1))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["_label", "a", "b"])

    scored = rows.select("_label", "_text").mapInArrow(weigh, "_label int, a double, b double").collect()
    y = np.array([r["_label"] for r in scored])
    x = np.array([[r.a, r.b] for r in scored])
    slope, shift = calibrate(x.sum(axis=1), y, 0.5)
    return {"weights": weights, "slope": [slope, slope], "shift": shift}


def _closed(often: dict[str, int]) -> set[str]:
    return set(often) - {e[:-1] for e, n in often.items() if often.get(e[:-1]) == n}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col and score."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = Lexicon(model["weights"])
        for batch in batches:
            for block in bw.blocks(batch, 1):
                z = lexicon.weigh(block.column(1)) @ np.array(model["slope"]) + model["shift"]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p, pa.float64())], ["_id", "score"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, score double").withColumnRenamed("_id", id_col)
