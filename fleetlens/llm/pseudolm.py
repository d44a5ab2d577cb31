"""Masked pseudo-likelihood of whole texts (operator 7).

A word's probability given its neighbours is that of its class, from a network over the `WINDOW`
classes on either side (a group of `GROUP` classes, then the class within the group), times that of the
word within its class, from corpus counts.  The most
frequent words are classes of their own; the others fall into classes by their ending.  The score of
a text is the sum of the logarithms over all its words, each masked in turn.

Counts cover every word of every document: they are added up in a block, then in Spark.  Of them the
driver gets the SHARED most frequent words and one row for each class; the other words, each at most
about 1 / SHARED of all, meet their counts in a join, so every word scores with its own count.  A
model that is fitted with `listed` words has no counts beyond them: these share what their class has left.  The network is trained where the texts are: in each round every task
starts from the same weights, takes steps over one position in `stride` of all of its words (other
ones in each round), and the weights are averaged in Spark, in rows of WIDTH.  There are as many
rounds as `stride`, so every position of every document is a target once.

Defined results: a null, empty or wordless text has n_tokens 0, log_prob 0 and no mean.  An empty
table gives an empty result.  Repeated rows count as often as they are there and score alike; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.scratch import store

OWN, ENDINGS, WINDOW, HIDDEN = 128, 128, 3, 24
CLASSES = OWN + ENDINGS
GROUP = 16  # classes that stand together: the network tells groups apart, then the classes of one
GROUPS = CLASSES // GROUP
_SHIFTS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
_SHAPES = {"embed": (2 * WINDOW, CLASSES + 1, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, GROUPS),
           "shift": (GROUPS,), "inner": (GROUPS, HIDDEN, GROUP), "inner_shift": (GROUPS, GROUP)}
BATCH, STEP = 4096, 2048  # positions scored, and trained on, at once
MOST = 60  # size of a logit
WIDTH = HIDDEN  # weights that travel in one row
FIRST_MEMORY = 1e-5  # squares of gradients before the first step
SHARED = 65_536  # words whose counts are sent to all tasks


def endings(words: bw.Words) -> np.ndarray:
    """Class of each word by its last three bytes."""
    end = words.start + words.length
    code = words.buf[end - 1].astype(np.uint64)
    for back in (2, 3):
        code = code * np.uint64(257) + np.where(words.length >= back, words.buf[np.maximum(end - back, 0)], 0).astype(np.uint64)
    return OWN + (bw.mix(code + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, ending, n) over all documents; words by their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 0):
                words = bw.split_words(block.column(0), lower=True)
                h, first, n = np.unique(bw.hash_words(words), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(endings(words)[first], pa.int32()), pa.array(n)],
                    ["word", "ending", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word long, ending int, n long")
    return counted.groupBy("word", "ending").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, listed: int) -> dict[str, np.ndarray]:
    """Hashes of the listed words (sorted), their class and log share of it; for each class the log share of an unlisted
    word in it, and of the class.

    Listed are the most frequent words, down to a frequency at which they are at most `listed`.
    """
    step = F.floor(F.log2("n") * 16)  # of their frequency; one row for each goes to the driver
    sizes = {r.step: r.words for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    least, words = max(sizes, default=0) + 1, 0
    while least - 1 >= min(sizes, default=1) and words + sizes.get(least - 1, 0) <= listed:
        least -= 1
        words += sizes.get(least, 0)
    top = sorted(counts.where(step >= least).collect(), key=lambda r: (-r.n, r.word))
    rest = counts.where(step < least).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    own = np.array([k if k < OWN else r.ending for k, r in enumerate(top)], np.int64)
    n = np.array([r.n for r in top], float)
    total = np.bincount(own, n, CLASSES)
    left, kinds = np.ones(CLASSES), np.ones(CLASSES)  # one unseen word in each class
    for r in rest:
        left[r.ending] += r.n
        kinds[r.ending] += r.words
    left[:OWN] = 0
    total = total + left
    order = np.argsort(np.array([r.word for r in top], np.int64).view(np.uint64))
    with np.errstate(divide="ignore", invalid="ignore"):
        within = np.log(n / np.maximum(total[own], 1e-9))
        unlisted = np.log(left / kinds / np.maximum(total, 1e-9))
    with np.errstate(divide="ignore"):
        mass = np.log(total)
    return {"mass": mass, "word": np.array([r.word for r in top], np.int64).view(np.uint64)[order], "own": own[order],
            "within": within[order], "unlisted": unlisted, "classes": np.log((total + 1) / (total + 1).sum())}


def encode(words: bw.Words, vocab: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word and the log share of the word in it."""
    ending = endings(words)
    if not len(vocab["word"]):
        return ending, vocab["unlisted"][ending]
    h = bw.hash_words(words)
    at = np.minimum(np.searchsorted(vocab["word"], h), len(vocab["word"]) - 1)
    listed = vocab["word"][at] == h
    own = np.where(listed, vocab["own"][at], ending)
    return own, np.where(listed, vocab["within"][at], vocab["unlisted"][ending])


def contexts(own: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes around the positions; CLASSES where the text has no word."""
    doc = np.searchsorted(first, at, "right") - 1
    out = np.full((len(at), 2 * WINDOW), CLASSES, np.int16)
    for k, shift in enumerate(_SHIFTS):
        there = at + shift
        inside = (there >= first[doc]) & (there < first[doc + 1])
        out[inside, k] = own[there[inside]]
    return out


def hidden(net: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    total = net["embed"][0].take(around[:, 0], axis=0)
    for k in range(1, 2 * WINDOW):
        total += net["embed"][k].take(around[:, k], axis=0)
    total += net["bias"]
    return np.tanh(total, out=total)


def by_group(target: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of the targets by their group of classes, and where each group begins and the last ends."""
    group = (target // GROUP).astype(np.uint8)
    return np.argsort(group, kind="stable"), [0, *np.cumsum(np.bincount(group, minlength=GROUPS))]


def shares(net: dict[str, np.ndarray], h: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the groups, and of the classes in the target's group; rows come by group."""
    groups, inner = h @ net["out"], np.empty((len(h), GROUP), h.dtype)
    groups += net["shift"]
    for g in range(GROUPS):
        part = slice(ends[g], ends[g + 1])
        np.matmul(h[part], net["inner"][g], out=inner[part])
        inner[part] += net["inner_shift"][g]
    for z in (groups, inner):
        np.clip(z, -MOST, MOST, out=z)
        np.exp(z, out=z)
        z /= (z @ np.ones(z.shape[1], z.dtype))[:, None]  # faster than a sum of short rows
    return groups, inner


def log_probs(net: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of the target classes, in batches."""
    out = np.empty(len(target))
    for lo in range(0, len(target), BATCH):
        order, ends = by_group(target[lo:lo + BATCH])
        y, rows = target[lo + order], np.arange(len(order))
        groups, inner = shares(net, hidden(net, around[lo + order]), ends)
        out[lo + order] = np.log(groups[rows, y // GROUP]) + np.log(inner[rows, y % GROUP])
    return out


def start(vocab: dict[str, np.ndarray], seed: int = 0) -> dict[str, np.ndarray]:
    """Weights to begin with: the classes' own shares, whatever stands around."""
    rng = np.random.default_rng(seed)
    net = {k: np.zeros(s, np.float32) for k, s in _SHAPES.items()}
    for k in ("embed", "out", "inner"):
        net[k] = rng.normal(0, 0.1, _SHAPES[k]).astype(np.float32)
    own = vocab["classes"].reshape(GROUPS, GROUP)
    net["shift"] = np.log(np.exp(own).sum(axis=1)).astype(np.float32)
    net["inner_shift"] = (own - net["shift"][:, None]).astype(np.float32)
    return net


def steps(net: dict[str, np.ndarray], memory: dict[str, np.ndarray], around: np.ndarray, target: np.ndarray,
          rate: float) -> None:
    """Adagrad steps over batches of positions, in place."""
    places = np.arange(2 * WINDOW, dtype=np.int16) * np.int16(CLASSES + 1)
    flat = {"net": net["embed"].reshape(-1, HIDDEN), "memory": memory["embed"].reshape(-1, HIDDEN)}
    for lo in range(0, len(target), STEP):
        order, ends = by_group(target[lo:lo + STEP])
        x, y = around[lo + order], target[lo + order]
        rows, h = np.arange(len(y)), hidden(net, x)
        groups, inner = shares(net, h, ends)
        groups[rows, y // GROUP] -= 1
        inner[rows, y % GROUP] -= 1
        groups /= len(y)
        inner /= len(y)
        back = groups @ net["out"].T
        grads = {"out": h.T @ groups, "shift": groups.sum(axis=0), "inner": np.empty_like(net["inner"]),
                 "inner_shift": np.empty_like(net["inner_shift"])}
        for g in range(GROUPS):
            part = slice(ends[g], ends[g + 1])
            back[part] += inner[part] @ net["inner"][g].T
            np.matmul(h[part].T, inner[part], out=grads["inner"][g])
            inner[part].sum(axis=0, out=grads["inner_shift"][g])
        back *= 1 - h * h
        grads["bias"] = back.sum(axis=0)
        code = (x.astype(np.int16) + places).ravel()  # all places' rows of the embedding in one sort
        order = np.argsort(code, kind="stable")
        code = code[order]
        at = np.flatnonzero(np.diff(code, prepend=-1))
        touched, grad = code[at], np.add.reduceat(back.take(order // (2 * WINDOW), axis=0), at)
        seen = flat["memory"][touched] + grad * grad
        flat["memory"][touched] = seen
        flat["net"][touched] -= rate * grad / np.sqrt(seen)
        for k, grad in grads.items():
            memory[k] += grad * grad
            net[k] -= rate * grad / np.sqrt(memory[k])


def _rows(net: dict[str, np.ndarray]) -> np.ndarray:
    """All weights in rows of WIDTH, filled up with zeros."""
    flat = np.concatenate([net[k].ravel() for k in _SHAPES])
    return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[k] = flat[at:at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def positions(n: int, r: int, stride: int) -> np.ndarray:
    """Targets of round r among n words: over `stride` rounds, each of them once."""
    return np.arange(r % stride, n, stride)


def train(docs: DataFrame, vocab: dict[str, np.ndarray], text_col: str, rounds: int, stride: int, rate: float) -> dict:
    net = start(vocab)
    columns = [f"w{j}" for j in range(WIDTH)]
    context = docs.sparkSession.sparkContext
    shared_vocab = context.broadcast(vocab)
    for r in range(rounds):
        shared = context.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], r=r, shared=shared) -> Iterator[pa.RecordBatch]:
            own_net = {k: v.copy() for k, v in shared.value.items()}
            memory = {k: np.full(v.shape, FIRST_MEMORY, np.float32) for k, v in own_net.items()}
            seen = 0
            for batch in batches:
                for block in bw.blocks(batch, 0, bw.SMALL_BLOCK):
                    words = bw.split_words(block.column(0), lower=True)
                    own, _ = encode(words, shared_vocab.value)
                    rng = np.random.default_rng(len(own) * rounds + r)
                    at = rng.permutation(positions(len(own), r, stride))
                    steps(own_net, memory, contexts(own, words.first, at), own[at], rate)
                    seen += len(at)
            if seen:
                rows = _rows(own_net).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), seen)),
                     *(pa.array(rows[:, j]) for j in range(WIDTH))], ["k", "n", *columns])
            bw.give_back()

        added = docs.select(text_col).mapInArrow(
            run, f"k int, n long, {', '.join(f'{c} double' for c in columns)}").groupBy("k").agg(
            *((F.sum(c) / F.sum("n")).alias(c) for c in columns))
        means = added.toPandas().sort_values("k")  # as many rows as the network has, whatever the tasks
        if len(means):
            net = _shaped(means[columns].to_numpy().ravel())
    return net


def fit(docs: DataFrame, text_col: str = "text", listed: int | None = None, rounds: int = 2, stride: int = 2,
        rate: float = 0.2) -> dict:
    """Vocabulary and network for a table of documents, and the counts of all words unless only `listed` ones are to count."""
    counts = store(word_counts(docs, text_col), "words")
    vocab = vocabulary(counts, SHARED if listed is None else listed)
    net = train(docs, vocab, text_col, rounds, stride, rate)
    return {"vocab": vocab, "net": net, "counts": counts if listed is None else None}


def pseudo_likelihood(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_tokens, log_prob (sum over all words) and mean_log_prob."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counts = model.get("counts")
    own_counts = counts is not None
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("vocab", "net")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = shared.value["vocab"], shared.value["net"]
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for block in bw.blocks(batch, 1, bw.SMALL_BLOCK):
                words = bw.split_words(block.column(1), lower=True)
                own, within = encode(words, vocab)
                n = words.per_doc
                rare, sizes = np.zeros(0, np.uint64), np.zeros(len(n), np.int64)
                if own_counts:
                    h = bw.hash_words(words)
                    away = np.flatnonzero(~np.isin(h, vocab["word"]))
                    within[away] = -vocab["mass"][own[away]]  # the count's logarithm comes by the join
                    rare, sizes = h[away], np.bincount(words.doc()[away], minlength=len(n))
                for lo in range(0, len(own), 1 << 18):  # contexts of some words at a time
                    at = np.arange(lo, min(lo + (1 << 18), len(own)))
                    within[at] += log_probs(net, contexts(own, words.first, at), own[at])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.arange(row, row + len(n))), pa.array(n, pa.int64()),
                     pa.array(bw.sum_by(within, words.first)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare.view(np.int64)))],
                    ["_id", "_row", "n_tokens", "log_prob", "rare"])
                row += len(n)
        bw.give_back()

    scored = rows.mapInArrow(
        run, f"_id {dict(rows.dtypes)['_id']}, _row long, n_tokens long, log_prob double, rare array<long>")
    if own_counts:
        scored = store(scored, "scored")
        # a word that no document of the model has stands for the one unseen word of its class
        rest = scored.select("_row", F.explode("rare").alias("word")).join(
            counts.select("word", F.log("n").alias("log_n")), "word").groupBy("_row").agg(F.sum("log_n").alias("more"))
        scored = scored.join(rest, "_row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return scored.select(F.col("_id").alias(id_col), "n_tokens", "log_prob").withColumn(
        "mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
