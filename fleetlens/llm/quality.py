"""Text quality from positive and unlabelled rows (operator 10).

Trusted positives are training rows with label 1; the unlabelled rows are a sample of all training
documents, whatever their label.  A small network over surface features of the whole text minimises
the non-negative unbiased risk

    prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0))

with the class prior estimated from the labelled training rows.  Its output is then calibrated on
labelled training rows so that a score is a probability.  Features are scale-free shares, so a long
text is judged as a whole; no id, language or source is read.

The samples are bounded (`most` rows each) and their features, not their texts, go to the driver.
Scoring is one pass.

Defined results: a null text counts as empty and gets the score of an empty text; ties and repeated
rows score alike.  Without positives or without unlabelled rows every document gets the prior (1 if
there are no labels) as score. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.labelled import held_out, labelled_sample

_ORDINARY = np.zeros(256, bool)  # marks that plain prose has
_ORDINARY[[ord(c) for c in ".,;:'\"-()?"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LOWER = np.zeros(256, bool)
_LOWER[0x61:0x7B] = _LOWER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = ~(_ORDINARY | _UPPER | _LOWER | _DIGIT | bw.WHITE)

FEATURES = ("upper", "digits", "marks", "symbols", "exclamations", "bars", "symbol_ends", "repeats", "distinct",
            "word_length", "line_words", "again", "size", "tiny")


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    words = bw.split_words(column)
    _, offsets = bw.raw_bytes(column)
    n_docs = len(words.first) - 1
    raw = words.buf[:offsets[-1]]
    n_words = words.per_doc
    n_bytes = np.maximum(np.diff(offsets), 1)

    def share(table: np.ndarray) -> np.ndarray:
        return bw.sum_by(table.take(raw).astype(np.int32), offsets).astype(float)

    def marked(byte: int) -> np.ndarray:
        return bw.sum_by((raw == byte).astype(np.int32), offsets).astype(float)

    upper, lower = share(_UPPER), share(_LOWER)
    some = np.maximum(n_words, 1)
    last = words.buf[words.start + words.length - 1]
    hashes = bw.hash_words(words)
    doc = words.doc()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])

    def distinct_share(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        keys = bw.mix(values ^ bw.mix(owner.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        keys, o = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return np.bincount(o[new], minlength=n_docs) / np.maximum(np.bincount(o, minlength=n_docs), 1)

    pairs = doc[1:] == doc[:-1]
    bigrams = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[pairs]
    out = np.zeros((n_docs, len(FEATURES)), np.float32)
    for k, x in enumerate((
            upper / np.maximum(upper + lower, 1), share(_DIGIT) / n_bytes, share(_ORDINARY) / n_bytes,
            share(_SYMBOL) / n_bytes, marked(0x21) / some, marked(0x7C) / some,
            bw.sum_by(_SYMBOL.take(last).astype(np.int32), words.first) / some,
            bw.sum_by(same.astype(np.int32), words.first) / some,
            distinct_share(hashes, doc) * np.log1p(n_words) / 6,
            np.minimum(bw.sum_by(words.length, words.first) / some, 20) / 10,
            np.log1p(n_words / (marked(0x0A) + 1)) / 5,
            1 - distinct_share(bigrams, doc[1:][pairs]),
            np.log1p(n_words) / 8, n_words < 4)):
        out[:, k] = x
    return out


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, steps: int = 600,
          rate: float = 0.01, seed: int = 0) -> dict[str, np.ndarray]:
    """Network weights that minimise the non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    n, m = len(positive), len(unlabelled)
    x = np.clip((x - mean) / scale, -8, 8)
    w = {"a": rng.normal(0, 0.4, (x.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, 0.4, hidden),
         "d": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        h = np.tanh(x @ w["a"] + w["b"])
        s = 1 / (1 + np.exp(-np.clip(h @ w["c"] + w["d"], -30, 30)))
        slope = s * (1 - s)
        negative = s[n:].mean() - prior * s[:n].mean()
        g = np.empty(n + m)
        if negative >= 0:
            g[:n] = (-prior * slope[:n] - prior * slope[:n]) / n  # loss as 1 is 1 - s, as 0 it is s
            g[n:] = slope[n:] / m
        else:  # step back from a negative part
            g[:n] = prior * slope[:n] / n
            g[n:] = -slope[n:] / m
        back = np.outer(g, w["c"]) * (1 - h * h)
        grads = {"a": x.T @ back, "b": back.sum(axis=0), "c": h.T @ g, "d": np.array([g.sum()])}
        for k, grad in grads.items():
            grad = grad + 1e-5 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return w | {"mean": mean, "scale": scale}


def raw_scores(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    x = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.tanh(x @ model["a"] + model["b"]) @ model["c"] + model["d"]


def calibrate(score: np.ndarray, label: np.ndarray, share: float, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * score + shift) a probability where `share` of the rows have label 1."""
    weight = np.where(label == 1, share / max((label == 1).sum(), 1), (1 - share) / max((label == 0).sum(), 1))
    centre, spread = score.mean(), score.std() + 1e-9
    x = np.stack([(score - centre) / spread, np.ones(len(score))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 1e-3 * w * [1, 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        move = np.linalg.solve(curve, grad)
        w = w - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * centre / spread)


def _features_of(rows: DataFrame) -> DataFrame:
    """_label and the features of (_id, _text, _label)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1, bw.SMALL_BLOCK):
                x = features(block.column(1))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(list(x), pa.list_(pa.float32()))], ["_label", "x"])

    return rows.select("_label", "_text").mapInArrow(run, "_label int, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, most: int = 10_000, label: str = "quality", modulus: int = 4, remainder: int = 2,
        id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """The model, from at most `most` rows of each label and `most` unlabelled rows outside the held-out part."""
    sample = _features_of(labelled_sample(docs, labels, label, most, modulus, remainder, id_col, text_col)).collect()
    own = labels.where(F.col(label).isin(0, 1) & ~held_out(id_col, modulus, remainder))
    share = own.agg(F.avg(F.col(label).cast("double"))).first()[0]
    prior = float(np.clip(1.0 if share is None else share, 0.02, 0.98))
    web = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, modulus, remainder))
    chosen = web.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = web.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    unlabelled = _features_of(rows.withColumn("_label", F.lit(-1))).collect()
    x = np.array([r.x for r in sample], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["_label"] for r in sample])
    u = np.array([r.x for r in unlabelled], np.float64).reshape(-1, len(FEATURES))
    if not (y == 1).any() or not len(u):
        return {"constant": 1.0 if share is None else prior}
    model = train(x[y == 1], u, prior)
    score = raw_scores(model, x)
    if (y == 0).any():
        model["slope"], model["shift"] = calibrate(score, y, prior)
    else:
        model["slope"], model["shift"] = 1.0, 0.0
    return model


def scores(model: dict, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    if "constant" in model:
        return np.full(len(column), model["constant"])
    raw = model["slope"] * raw_scores(model, features(column)) + model["shift"]
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1, bw.SMALL_BLOCK):
                p = scores(shared.value, block.column(1))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(p, pa.float64())], ["_id", "score"])

    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, score double").withColumnRenamed("_id", id_col)


def keep_quality(docs: DataFrame, model: dict, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score is at least `least`, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, at, bw.SMALL_BLOCK):
                yield block.filter(pa.array(scores(shared.value, block.column(at)) >= least))
        bw.give_back()

    return docs.mapInArrow(run, docs.schema)
