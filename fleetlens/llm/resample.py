"""Importance resampling towards a target distribution (operator 13).

Features of a text are its runs of one to three words, hashed into buckets by CRC-32.  How often each
bucket occurs in all documents and in the target texts gives the bucket a gain, the logarithm of the
ratio of its smoothed shares.  A document's weight is the sum of the gains of its features; with
Gumbel noise from its id the highest scores are a draw without replacement.

Two passes over the texts: one counts buckets (an array for each task, summed up in Spark; `buckets`
numbers reach the driver), one adds up gains.  CRCs of all runs of a block are made at once, byte by
byte over all words; a run's CRC goes on from that of the run without its last word.

Ranks come from a distributed radix sort, least significant digit first.  The key is made of the
negated score, the id and, for rows that repeat an id, the number of features; its bits are counted
on the data and cut into equal digits.  A pass keeps the rows in blocks of neighbouring positions and
counts each digit in each block.  The prefix sums of these counts, over digits first and blocks
second, give every block the place of its first row with a digit; a row's own place follows from
the rows before it in its block with the same digit, so equal digits stay in order.  Rows go into
the next pass by that place, which is their rank at the end.  A block holds at most `block_rows` rows
whatever the keys are, so a digit that all rows share is no hot group.  Each pass is stored.

Defined results: a null text has no words, weight 0 and, like any text with fewer than `least_words`
words, no rank.  A null id hashes as `42:` and comes after all others among equal scores.  Repeated
rows are drawn one by one, each with a rank of its own.  Without target texts the gains rest on the
documents alone.  An empty table gives no row.  Ids must be integers.  Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.scratch import store

RUN = 3  # words in the longest feature
DIGIT_BITS = 16  # of a digit at most: its values, which the driver adds up, are 65,536 then
_LONG_WORD = 512
_INTEGERS = {"tinyint", "smallint", "int", "bigint"}


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def extend_crc(crc: np.ndarray, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts with these CRCs, each followed by a byte range of the buffer."""
    out = crc.copy()
    order = np.argsort(-length, kind="stable")
    order = order[np.searchsorted(-length[order], -_LONG_WORD):]
    size, at, state = length[order], start[order], ~crc[order]
    left = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0))  # ranges longer than each step
    for step, n in enumerate(left.tolist()):
        own = state[:n]
        state[:n] = _CRC[(own ^ buf[at[:n] + step]) & np.uint32(0xFF)] ^ (own >> np.uint32(8))
    out[order] = ~state
    for k in np.flatnonzero(length > _LONG_WORD):
        out[k] = zlib.crc32(buf[start[k]:start[k] + length[k]], int(crc[k]))
    return out


def features(column: pa.Array, buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For runs of one, two, ... words: the bucket of each and the border of each text; and the words of each text."""
    words = bw.joined(bw.split_words(column, bw.ALNUM, lower=True))
    n_words = words.per_doc
    crc = np.zeros(len(words.start), np.uint32)
    begin, size = words.start, words.length
    word = np.arange(len(words.start))
    end = np.repeat(words.first[1:], n_words)
    out = []
    for k in range(RUN):
        if k:  # go on over the space and the next word, where the text has one
            some = word + k < end[word]
            word, crc = word[some], crc[some]
            begin, size = words.start[word + k] - 1, words.length[word + k] + 1
        crc = extend_crc(crc, words.buf, begin, size)
        out.append(((crc % np.uint32(buckets)).astype(np.int64),
                    np.concatenate([[0], np.cumsum(np.maximum(n_words - k, 0))])))
    return out, n_words


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in bw.blocks(batch, 0):
                for found, _ in features(block.column(0), buckets)[0]:
                    n += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text_col)).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, object)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) for each bucket."""
    buckets = len(source)
    s, t = float(sum(source) + buckets), float(sum(target) + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t)))
                     for a, b in zip(source, target)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(_id, n_words, n_features, weight) of each document."""
    own = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                found, n_words = features(block.column(1), len(own.value))
                n = sum(np.diff(first) for _, first in found)
                weight = sum(bw.sum_by(own.value[bucket], first) for bucket, first in found)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))],
                    ["_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first eight hex digits of the SHA-256 of `seed:id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def digit_of(parts: list[tuple[str, int]], low: int, width: int) -> Column:
    """Bits low to low + width of a key whose parts, most significant first, are columns with numbers of bits."""
    out, at = F.lit(0).cast("long"), 0
    for name, bits in reversed(parts):
        lo, hi = max(low, at), min(low + width, at + bits)
        if lo < hi:
            piece = F.shiftrightunsigned(F.col(name), lo - at).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(piece, lo - low))
        at += bits
    return out


def counting_pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """The rows with `pos` moved to their places in the stable order of a digit; positions are distinct before, and
    0, 1, 2, ... after."""
    rows = rows.withColumn("block", F.expr(f"pos div {block_rows}")).withColumn("digit", digit)
    counts = store(rows.groupBy("block", "digit").agg(F.count("*").alias("n")), "digit-counts")
    totals = sorted((r.digit, r["n"]) for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
    base, before = [], 0
    for value, n in totals:
        base.append((value, before))
        before += n
    base = rows.sparkSession.createDataFrame(base, "digit long, base long")  # at most 2 ** DIGIT_BITS rows
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    places = counts.withColumn("earlier", earlier).join(F.broadcast(base), "digit").select(
        "block", "digit", (F.col("base") + F.col("earlier")).alias("place"))
    own = F.row_number().over(Window.partitionBy("block", "digit").orderBy("pos")) - 1
    return rows.withColumn("own", own).join(places, ["block", "digit"]).withColumn(
        "pos", F.col("place") + F.col("own")).drop("block", "digit", "own", "place")


def radix_sort(rows: DataFrame, parts: list[tuple[str, int]], block_rows: int) -> DataFrame:
    """The rows, with distinct `pos`, at their positions 0, 1, 2, ... in the order of the key made of `parts`."""
    bits = sum(n for _, n in parts)
    passes = max(1, -(-bits // DIGIT_BITS))
    width = max(1, -(-bits // passes))
    for k in range(passes):
        rows = store(counting_pass(rows, digit_of(parts, k * width, width), block_rows), f"pass-{k}")
    return rows


def _blocks(spark, n: int, block_rows: int) -> int:
    """Rows of a block: block_rows, or fewer where tasks would have nothing to do."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(block_rows, -(-n // (4 * tasks))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42,
             block_rows: int = 65_536) -> DataFrame:
    """One row per document: id_col, n_words, n_features, weight, score and rank (null: not drawn)."""
    if dict(docs.dtypes)[id_col] not in _INTEGERS:
        raise ValueError(f"{id_col} must be an integer column, as ties are broken by its digits")
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    scored = weights(docs, gains, id_col, text_col).select(
        F.col("_id").cast("long").alias("_id"), "n_words", "n_features", "weight",
        (F.col("weight") + gumbel("_id", seed)).alias("score"), F.monotonically_increasing_id().alias("_row"))
    scored = store(scored, "scored")

    able = scored.where(F.col("n_words") >= least_words)
    r = able.agg(F.count("*"), F.min("score"), F.max("score"), F.min("_id"), F.max("_id"), F.max("n_features")).first()
    n, low, high, first, last, most = (x or 0 for x in r)
    if last - first < 1 << 62:  # a null id after all others
        number, span = F.coalesce(F.col("_id") - F.lit(first).cast("long"), F.lit(last - first + 1).cast("long")), last - first + 1
    else:
        number, span = F.coalesce(F.col("_id"), F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), (1 << 64) - 1
    keyed = able.select(F.col("_row").alias("pos"), "_row", (F.lit(high).cast("long") - F.col("score")).alias("k1"),
                        number.alias("k2"), F.col("n_features").alias("k3"))
    parts = [("k1", (high - low).bit_length()), ("k2", span.bit_length()), ("k3", most.bit_length())]
    placed = radix_sort(keyed, parts, _blocks(docs.sparkSession, n, block_rows))
    drawn = placed.where(F.col("pos") < percent * n // 100).select("_row", (F.col("pos") + 1).alias("rank"))
    return scored.join(drawn, "_row", "left").select(
        F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")
