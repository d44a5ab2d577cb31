"""Documents packed into token sequences of a fixed window (operator 2).

A document is its token ids and one end id.  It is cut into full windows and a tail; a full window
is a sequence of its own.  Tails are packed by length only: their histogram (one count for each
length below the window) goes to the driver.  Combinations of one, two or three lengths that fill
the window exactly are enumerated, non-negative least squares finds how often to repeat each so that
the histogram is met, the solution is rounded and cut to what is there, and the remaining counts are
packed greedily, exact fills first.  The plan lists patterns with their repeats, so its size depends
on the window alone.

Every piece then finds its place by arithmetic: pieces of a length are numbered, in small groups
whose sizes are summed up, and a number falls into one range of the plan.  No sequence is put
together in one place.

Defined results: a null or empty text is the end id alone.  Repeated rows, and rows with a null id,
are packed one by one.  An empty table gives no piece.  Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm import tokens
from fleetlens.llm.scratch import store

PATTERN_LIMIT = 3  # lengths in an enumerated combination


def combinations_of(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of three ascending lengths (0: none) out of those given that fill the window."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = window - a - b
    good = (a <= b) & (b <= c)
    good &= there[np.where(good, c, 0)] & (c > 0)
    return np.stack([a[good], b[good], c[good]], axis=1)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x of the combinations that minimise the squared distance to the histogram."""
    def made(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, k], x, len(histogram)) for k in range(PATTERN_LIMIT))
        out[0] = 0
        return out

    def pull(r: np.ndarray) -> np.ndarray:
        r = np.where(np.arange(len(r)) == 0, 0, r)
        return r[combos].sum(axis=1)

    target = histogram.astype(float)
    target[0] = 0
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    v = np.random.default_rng(0).random(len(combos))
    for _ in range(20):  # largest curvature
        v = pull(made(v))
        top = np.linalg.norm(v)
        v /= top
    y, t = x, 1.0
    for _ in range(rounds):  # accelerated projected gradient
        new = np.maximum(y - pull(made(y) - target) / (1.02 * top), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_patterns(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each at most `window` in sum, with repeats that use up the histogram exactly."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: list[int], most: int) -> None:
        uses = {n: pattern.count(n) for n in pattern}
        k = min([most, *(int(left[n]) // m for n, m in uses.items())])
        if k > 0:
            out.append((tuple(sorted(pattern, reverse=True)), k))
            for n, m in uses.items():
                left[n] -= k * m

    combos = combinations_of(np.flatnonzero(left), window)
    repeats = np.rint(least_squares(combos, left)).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        take([int(n) for n in combos[i] if n], int(repeats[i]))
    while left.any():
        pattern = [int(np.flatnonzero(left)[-1])]
        left[pattern[0]] -= 1
        while (space := window - sum(pattern)) > 0:
            free = np.flatnonzero(left[:space + 1])
            if not len(free):
                break
            rest = space - free
            pairs = free[(left[rest] > (rest == free)) & (rest > 0)]
            more = [space] if left[space] else [int(pairs[-1]), space - int(pairs[-1])] if len(pairs) else [int(free[-1])]
            for n in more:
                left[n] -= 1
            pattern += more
        for n in pattern:
            left[n] += 1
        take(pattern, int(left.max()))
    return out


def plan_ranges(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Ranges of piece numbers by length: number -> sequence and offset, sorted by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, k in patterns:
        offset, total = 0, sum(pattern)
        for n in pattern:
            lo = used.get(n, 0)
            rows.append((n, lo, sequence, offset, total))
            used[n] = lo + k
            offset += n
        sequence += k
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {c: table[:, i] for i, c in enumerate(["length", "lo", "sequence", "offset", "total"])}


def cut_documents(docs: DataFrame, path: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """(_id, doc_tokens, crcs): tokens of each document with its end id, and the CRC-32 of each piece's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                yield _cut(block, path, window, end_id)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, doc_tokens long, crcs array<long>")


def _with_end(block: pa.RecordBatch, path: str, end_id: int) -> Iterator[np.ndarray]:
    found, offsets = tokens.ids(block.column(1), path)
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.append(found[lo:hi], np.uint32(end_id)).astype("<u4", copy=False)


def _cut(block: pa.RecordBatch, path: str, window: int, end_id: int) -> pa.RecordBatch:
    sizes, crcs = [], []
    for own in _with_end(block, path, end_id):
        data = memoryview(own).cast("B")
        sizes.append(len(own))
        crcs.append([zlib.crc32(data[k:k + 4 * window]) for k in range(0, len(data), 4 * window)])
    return pa.RecordBatch.from_arrays(
        [block.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
        ["_id", "doc_tokens", "crcs"])


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024,
         end_id: int = 0, group_rows: int = 100_000) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the tokens in its
    sequence (sequence_tokens) and its length with padding (sequence_length)."""
    cut = store(cut_documents(docs, path, id_col, text_col, window, end_id), "pieces")
    pieces = cut.select("_id", "doc_tokens", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "_id", "doc_tokens", "ids_crc32", (F.col("k").cast("long") * window).alias("start"),
        F.least(F.lit(window).cast("long"), F.col("doc_tokens") - F.col("k") * window).alias("length"))

    counts = {int(r.length): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(window + 1, np.int64)
    for n, k in counts.items():
        histogram[n] = k
    whole = int(histogram[window])
    histogram[window] = 0
    patterns = plan_patterns(histogram, window)
    if whole:
        patterns.append(((window,), whole))
    ranges = plan_ranges(patterns)

    # number the pieces of each length, in groups whose sizes are summed up
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(tasks, sum(counts.values()) // group_rows)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("_id", "start"), F.lit(groups)))
    sizes = pieces.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = sizes.select("length", "group", (F.sum("n").over(
        Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "group").orderBy("_id", "start", "doc_tokens", "ids_crc32")
    numbered = pieces.withColumn("own", F.row_number().over(own)).join(before, ["length", "group"]).select(
        "_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own") - 1).alias("number"))
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = ["sequence_id", "offset", "sequence_tokens"]
    key = (ranges["length"] << 44) + ranges["lo"]
    plan = docs.sparkSession.sparkContext.broadcast((key, ranges))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ranges = plan.value
        for batch in batches:
            number = batch.column("number").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + number, "right") - 1
            columns = [ranges["sequence"][at] + number - ranges["lo"][at], ranges["offset"][at], ranges["total"][at]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), *(pa.array(c, pa.int64()) for c in columns)], names + placed)

    id_type = dict(cut.dtypes)["_id"]
    schema = f"_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:] + placed)
    total = F.col("sequence_tokens")
    power = F.bit_count(total) == 1
    return numbered.mapInArrow(place, schema).withColumnRenamed("_id", id_col).withColumn(
        "sequence_length", F.when(power, total).otherwise(F.lit(window).cast("long")))


def sequences(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 0) -> DataFrame:
    """The token sequences themselves: sequence_id and input_ids without padding.  Ids must be unique in docs.

    Texts are encoded again, so that no token has to travel before its place is known.
    """
    parts = placed.groupBy(id_col).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    rows = docs.select(id_col, text_col).join(parts, id_col).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                out = []
                for own, parts in zip(_with_end(block, path, end_id), block.column(2).to_pylist()):
                    out += [(p["sequence_id"], p["offset"], own[p["start"]:p["start"] + p["length"]]) for p in parts]
                sequence, offset, found = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
                     pa.array([x.tolist() for x in found], pa.list_(pa.int64()))], ["sequence_id", "offset", "ids"])

    cut = rows.mapInArrow(run, "sequence_id long, offset long, ids array<long>")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"))
