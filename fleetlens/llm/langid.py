"""Language by nearest centroid (operator 8).

A text is a vector of hashed character trigrams (UTF-8 bytes of letters, A-Z lower-cased, everything
else one space), damped counts times inverse document frequency, of length one.  Each language has
several centroids, made by spherical k-means over a bounded sample; a text gets the language of the
centroid with the largest cosine.  It is marked as rejected where that cosine is below what nearly
all training texts of the centroid reach.

Document frequencies count every training document, in Spark; only a vector of fixed size returns.
The sample has at most `most` documents of each language.  Vectors, not texts, go to the driver.

Defined results: `und` with score 0 for a null text or one without a letter, and for every text if
there is nothing to learn from. Rows with a null language teach nothing.  Ties go to the language
that sorts first.  Repeated rows score alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.labelled import held_out

SIZE = 4096
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[_LETTER == 0] = 0x20
DOCS_AT_ONCE = 512


def trigrams(column: pa.Array) -> np.ndarray:
    """Damped counts of hashed trigrams, one row for each text."""
    data, offsets = bw.raw_bytes(column)
    raw = _LETTER.take(data)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    if len(raw) < 3:
        return np.zeros((n, SIZE), np.float32)
    h = raw[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)
    h += raw[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    h += raw[2:].astype(np.uint32) * np.uint32(0x27D4EB2F)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0x165667B1)
    cell = (h >> np.uint32(20)).astype(np.int32)
    blank = (raw[:-2] == 0x20) & (raw[1:-1] == 0x20) | (raw[1:-1] == 0x20) & (raw[2:] == 0x20)
    own = (doc[:-2] == doc[2:]) & ~blank
    counts = np.bincount(doc[:-2][own] * np.int32(SIZE) + cell[own], minlength=n * SIZE)
    return np.log1p(counts.reshape(n, SIZE).astype(np.float32))


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    x = trigrams(column) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _small_blocks(batch: pa.RecordBatch, text: int | str) -> Iterator[pa.RecordBatch]:
    for block in bw.blocks(batch, text, bw.BLOCK_BYTES // 3):
        for at in range(0, block.num_rows, DOCS_AT_ONCE):
            yield block.slice(at, DOCS_AT_ONCE)


def cluster(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Spherical k-means; at most k centroids of length one."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) for j in range(len(centres))])
        full = np.linalg.norm(sums, axis=1) > 0
        centres = sums[full] / np.linalg.norm(sums[full], axis=1, keepdims=True)
    return centres.astype(np.float32)


def fit(docs: DataFrame, most: int = 500, centroids: int = 4, modulus: int = 3, remainder: int = 1, reject: float = 0.005,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model from training documents: idf over all of them, centroids over at most `most` of each language."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
                      & ~held_out(id_col, modulus, remainder))
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for block in _small_blocks(batch, 0):
                seen += (trigrams(block.column(0)) > 0).sum(axis=0)
                n += block.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, SIZE), pa.int32()), pa.array(np.append(n, seen))], ["cell", "n"])

    counted = rows.select("_text").mapInArrow(frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = {r.cell: r.n for r in counted.collect()}
    total = counts.pop(-1, 0)
    if not total:
        return None
    idf = np.array([np.log((1 + total) / (1 + counts.get(c, 0))) + 0.1 for c in range(SIZE)], np.float32)

    # two rounds of ranking keep the rows of a language from meeting in one task
    slim = rows.select("_id", "_lang", F.xxhash64("_id").alias("_h")).withColumn("_part", F.pmod("_h", F.lit(64)))
    order = [F.col("_h"), F.col("_id")]
    near = slim.withColumn("_n", F.row_number().over(Window.partitionBy("_lang", "_part").orderBy(*order))).where(
        F.col("_n") <= most)
    chosen = near.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy(*order))).where(
        F.col("_n") <= most).select("_id", "_lang")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _small_blocks(batch, 1):
                x = vectors(block.column(1), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([v.tobytes() for v in x], pa.binary())],
                                                 ["_lang", "x"])

    found = rows.join(F.broadcast(chosen), ["_id", "_lang"]).select("_lang", "_text").mapInArrow(
        sample, "_lang string, x binary").toArrow()
    lang = np.array(found.column(0).to_pylist(), dtype=object)
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16).astype(np.float32) for v in found.column(1)])
    names, centres, limits = [], [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        own = own[np.lexsort(own[:, :8].T)]  # the same centroids whatever order the rows arrive in
        made = cluster(own, centroids)
        best = (own @ made.T)
        nearest = best.argmax(axis=1)
        for j in range(len(made)):
            mine = best[nearest == j, j]
            limits.append(float(np.quantile(mine, reject)) if len(mine) else 0.0)
        names += [name] * len(made)
        centres.append(made)
    return {"idf": idf, "names": names, "centres": np.concatenate(centres), "limits": np.array(limits)}


def _has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = bw.raw_bytes(column)
    ascii_letter = np.zeros(256, np.int32)
    ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = 1
    found = bw.sum_by(ascii_letter.take(data), offsets) > 0
    for k in np.flatnonzero(~found & (bw.sum_by((data >= 0x80).astype(np.int32), offsets) > 0)):
        found[k] = any(c.isalpha() for c in column[int(k)].as_py())
    return found


def detect(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text",
           sharpness: float = 20.0) -> DataFrame:
    """One row per document: id_col, lang_pred, score (share of the best language, by its cosine) and rejected."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(rows.dtypes)['_id']}, lang_pred string, score double, rejected boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in _small_blocks(batch, 1):
                lang, score, rejected = _nearest(block.column(1), model, sharpness)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                    ["_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _nearest(column: pa.Array, model: dict | None, sharpness: float) -> tuple[list, np.ndarray, np.ndarray]:
    n = len(column)
    if model is None:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    cosine = vectors(column, model["idf"]) @ model["centres"].T
    nearest = cosine.argmax(axis=1)
    names = np.array(model["names"], dtype=object)
    languages = sorted(set(model["names"]))
    best = np.stack([cosine[:, names == name].max(axis=1) for name in languages], axis=1).astype(float)
    share = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
    score = share.max(axis=1) / share.sum(axis=1)
    letters = _has_letter(column)
    lang = np.where(letters, names[nearest], "und").tolist()
    return lang, np.where(letters, score, 0.0), ~letters | (cosine.max(axis=1) < model["limits"][nearest])
