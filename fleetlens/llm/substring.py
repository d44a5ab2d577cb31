"""Repeated word windows across documents (operator 1).

Every window of `size` consecutive words gets a rolling Rabin-Karp hash modulo 2**64 over hashes of
its words.  Windows are first counted inside a block of some megabytes of text; what the block can
decide itself (a smaller id with the same window in the block) is decided there.  For each window of
a block, the occurrences in its smallest document travel on, packed by hash range into one binary
row for each range.  A range therefore gets at most one document for each window and block, however
often a window occurs.  There the smallest id of all is found, and occurrences in other documents
are to be removed.  Positions return, again packed, to the part of the documents that theirs belongs
to, and merge into maximal intervals.

Equal hashes count as equal windows; n windows are expected to give n**2 / 2**65 false matches
(0.0005 for 130 million).

Positions of one window in one text travel as runs of equal steps, so a text that repeats a word or a
line a million times sends a few numbers to the range of its windows.

Defined results: a null or empty text has no words; it keeps the empty text.  Rows with a null id
keep all words and remove none.  Rows that repeat an id are each judged by their own text: a word goes
only by a window that a smaller id has too, so windows shared only among them stay.  Ids of any type that
can be sorted will do; the smaller one is that which sorts first.  Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm.scratch import store

_BASE = 0x2545F4914F6CDD1D
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_BASE = np.uint64(_BASE)

PASS = pa.schema([("bucket", pa.int32()), ("decided", pa.bool_()), ("payload", pa.binary())])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each `size` consecutive numbers, at the index of the first."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    down = np.full(n, _INVERSE)
    down[0] = 1
    down = np.multiply.accumulate(down)
    up = np.full(n, _BASE)
    up[0] = 1
    up = np.multiply.accumulate(up)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * down)])
    return bw.mix((total[size:] - total[:-size]) * up[:n - size + 1])


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, with as many planes as the largest needs."""
    values = values.astype("<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    width = data[0]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data[1:1 + width * n], np.uint8).reshape(width, n).T
    return planes.view("<u8").ravel(), data[1 + width * n:]


def _group_starts(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _runs(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first, step and number of positions of each run: one hash in one row, at equal distances.

    The input is sorted by hash, then row, then position.  A text that repeats a word or a line thus gives a few runs.
    """
    linked = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    step = np.where(linked, np.diff(at), 0)
    new = np.ones(len(h), bool)
    new[1:] = ~linked
    new[2:] |= linked[:-1] & (step[1:] != step[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    return first, np.where(count > 1, np.append(step, 0)[first], 0), count


def _pack_runs(at: np.ndarray, step: np.ndarray, count: np.ndarray) -> bytes:
    """Runs; single positions cost nothing beside their position."""
    long = np.flatnonzero(count > 1)
    return b"".join([pack(at), len(long).to_bytes(8, "little"), pack(np.diff(long, prepend=0)), pack(step[long]),
                     pack(count[long] - 2)])


def _unpack_runs(data: memoryview, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, data = unpack(data, n)
    m = int.from_bytes(data[:8], "little")
    long, data = unpack(data[8:], m)
    step, count = np.zeros(n, np.int32), np.ones(n, np.int32)
    long = np.cumsum(long.astype(np.int64))
    step[long], data = unpack(data, m)
    count[long] = unpack(data, m)[0].astype(np.int32) + 2
    return at.astype(np.int32), step, count


def _by_part(docs: np.ndarray, form: np.ndarray, at: np.ndarray, step: np.ndarray, count: np.ndarray,
             parts: int) -> Iterator[tuple[int, bytes]]:
    """Documents and runs of positions packed for each part of the documents."""
    if not len(docs):
        return
    part = (bw.mix(docs.view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.lexsort((docs, part))
    part, docs, form, at, step, count = (x[order] for x in (part, docs, form, at, step, count))
    edges = [*_group_starts(part).tolist(), len(part)]
    for lo, hi in zip(edges, edges[1:]):
        steps = np.diff(docs[lo:hi], prepend=docs[lo]).astype(np.uint64)
        yield int(part[lo]), b"".join([np.array([hi - lo, docs[lo]], "<i8").tobytes(), pack(steps), pack(form[lo:hi]),
                                       _pack_runs(at[lo:hi], step[lo:hi], count[lo:hi])])


def _rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, decided, payload = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(decided), pa.array(payload, pa.binary())], schema=PASS)


def _block_rows(block: pa.RecordBatch, size: int, buckets: int) -> list[tuple[int, bool, bytes]]:
    ids = block.column(0).to_numpy(zero_copy_only=False)
    forms = block.column(2).to_numpy(zero_copy_only=False)
    words = bw.split_words(block.column(1))
    n = np.maximum(words.per_doc - size + 1, 0)
    first = bw.ragged(words.first[:-1], n)
    if not len(first):
        return []
    h = window_hashes(bw.hash_words(words), size)[first]
    del words, first
    order = np.argsort(h, kind="stable")
    h = h[order]
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
    at = bw.ragged(np.zeros(len(n), np.int64), n)[order]
    del order
    begin, step, count = _runs(h, row, at)
    h, row, at = h[begin], row[begin], at[begin]
    doc, form = ids[row], forms[row]
    starts = _group_starts(h)
    least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
    later = doc > least
    out = [(part, True, payload) for part, payload in
           _by_part(doc[later], form[later], at[later], step[later], count[later], buckets)]

    h, doc, form, at, step, count = (x[~later] for x in (h, doc, form, at, step, count))
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    base = int(doc.min())
    edges = [*_group_starts(bucket).tolist(), len(h)]
    for lo, hi in zip(edges, edges[1:]):
        payload = b"".join([np.array([hi - lo, base], "<i8").tobytes(), pack(np.diff(h[lo:hi], prepend=np.uint64(0))),
                            pack((doc[lo:hi] - base).astype(np.uint64)), pack(form[lo:hi]),
                            _pack_runs(at[lo:hi], step[lo:hi], count[lo:hi])])
        out.append((int(bucket[lo]), False, payload))
    return out


def _decide(key: tuple, table: pa.Table, parts: int) -> pa.Table:
    """One hash range: what blocks decided for the part of the same number passes; the rest is compared across blocks."""
    decided = table.column("decided")
    out_part = [key[0].as_py()] * pa.compute.sum(decided).as_py()
    out = table.filter(decided).column("payload").to_pylist()
    found = []
    for payload in table.filter(pa.compute.invert(decided)).column("payload"):
        data = memoryview(payload.as_buffer())
        n, base = np.frombuffer(data[:16], "<i8").tolist()
        h, data = unpack(data[16:], n)
        doc, data = unpack(data, n)
        form, data = unpack(data, n)
        found.append((np.cumsum(h), doc.astype(np.int64) + base, form, *_unpack_runs(data, n)))
    if found:
        h, doc, *rest = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        starts = _group_starts(h)
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(h))))
        later = doc > least
        for part, payload in _by_part(doc[later], *(x[order[later]] for x in rest), parts):
            out_part.append(part)
            out.append(payload)
    return pa.table([pa.array(out_part, pa.int32()), pa.array(out, pa.binary())], ["part", "payload"])


def _gather(table: pa.Table) -> pa.Table:
    """One part of the documents: all positions of each, in order."""
    found = []
    for payload in table.column("payload"):
        data = memoryview(payload.as_buffer())
        n, base = np.frombuffer(data[:16], "<i8").tolist()
        steps, data = unpack(data[16:], n)
        form, data = unpack(data, n)
        at, step, count = _unpack_runs(data, n)
        at = np.repeat(at, count) + np.repeat(step, count) * bw.ragged(np.zeros(n, np.int64), count)
        docs = np.cumsum(steps.astype(np.int64)) + base
        found.append((np.repeat(docs, count), np.repeat(form.view(np.int64), count), at.astype("<i4")))
    docs, form, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, form, docs))
    docs, form, at = docs[order], form[order], at[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (form[1:] != form[:-1])
    starts = np.flatnonzero(new)
    edges = [*starts.tolist(), len(docs)]
    return pa.table([pa.array(docs[starts], pa.int64()), pa.array(form[starts], pa.int64()),
                     pa.array([at[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:])], pa.binary())],
                    ["doc", "form", "found"])


def _numbered(rows: DataFrame, broadcast_ids: int) -> DataFrame:
    """(_id, _text) with _doc, a number in the order of the ids, and _form, which tells texts of one id apart.

    Integers are their own numbers; ids of any other type are sorted once.  _form is 0 for an id that one row has, else a
    hash of the text.  Repeated ids are few as a rule and then broadcast; more than ``broadcast_ids`` are joined.
    """
    if dict(rows.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("_doc", F.col("_id").cast("long"))
    else:
        ids = rows.select("_id").where("_id is not null").distinct().orderBy("_id")
        rows = rows.join(store(ids.select("_id", F.monotonically_increasing_id().alias("_doc")), "id_order"), "_id", "left")
    repeated = rows.where("_doc is not null").groupBy("_doc").count().where("count > 1")
    repeated = store(repeated.select("_doc", F.lit(True).alias("_again")), "repeated_ids")
    n = repeated.count()
    if not n:
        return rows.withColumn("_form", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(repeated) if n <= broadcast_ids else repeated, "_doc", "left")
    return rows.withColumn("_form", F.when(F.col("_again"), F.xxhash64("_text")).otherwise(F.lit(0).cast("long")))


def repeated_positions(rows: DataFrame, size: int, range_windows: int) -> DataFrame:
    """(doc, form, found) of rows (_doc, _text, _form): start positions, packed as 32-bit numbers, of windows that begin
    in a smaller document as well."""
    rows = rows.where("_doc is not null and _text is not null").select("_doc", "_text", "_form")
    # a word takes six bytes or so
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = int(max(1, total // (6 * range_windows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                found = _block_rows(block, size, buckets)
                if found:
                    yield _rows(found)

    def decide(key: tuple, table: pa.Table) -> pa.Table:
        return _decide(key, table, buckets)

    sent = rows.mapInArrow(run, "bucket int, decided boolean, payload binary")
    decided = sent.groupBy("bucket").applyInArrow(decide, "part int, payload binary")
    return decided.groupBy("part").applyInArrow(_gather, "doc long, form long, found binary")


def _texts(words: bw.Words, kept: np.ndarray) -> pa.Array:
    """Kept words of each document, joined by one space."""
    n = bw.sum_by(kept.astype(np.int64), words.first)
    some = bw.Words(words.buf, words.start[kept], words.length[kept], np.concatenate([[0], np.cumsum(n)]))
    out = bw.joined(some)
    size = bw.sum_by(some.length + 1, some.first)
    ends = np.cumsum(size)
    data = np.delete(out.buf[:ends[-1] if len(ends) else 0], ends[size > 0] - 1)  # no space after the last word
    offsets = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13,
                     range_windows: int = 500_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, spans (start word and length of each removed interval) and
    kept_text, the kept words joined by one space."""
    rows = _numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), broadcast_ids)
    found = repeated_positions(rows, size, range_windows).hint("shuffle_hash")
    rows = rows.join(found, (F.col("_doc") == F.col("doc")) & (F.col("_form") == F.col("form")), "left")
    rows = rows.select("_id", "_text", "found")
    id_type = dict(docs.dtypes)[id_col]
    schema = "_id {}, n_words long, n_removed long, spans array<struct<start:int,length:int>>, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                yield _cut(block, size)

    return rows.mapInArrow(run, schema.format(id_type)).withColumnRenamed("_id", id_col)


def _cut(block: pa.RecordBatch, size: int) -> pa.RecordBatch:
    words = bw.split_words(block.column(1))
    n_words = words.per_doc
    change = np.zeros(len(words.start) + 1, np.int64)
    for k, found in enumerate(block.column(2)):
        if found.is_valid:
            at = np.frombuffer(found.as_buffer(), "<i4")
            at = at[at + size <= n_words[k]].astype(np.int64) + words.first[k]
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
    gone = np.cumsum(change[:-1]) > 0
    removed = bw.sum_by(gone.astype(np.int64), words.first)

    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = words.first[:-1][n_words > 0]
    begins[inner] = gone[inner]
    ends = gone.copy()
    ends[:-1] &= ~gone[1:]
    inner = words.first[1:][n_words > 0] - 1
    ends[inner] = gone[inner]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of = np.searchsorted(start, words.first)
    local = start - np.repeat(words.first[:-1], np.diff(of))
    spans = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(local, pa.int32()), pa.array(end - start, pa.int32())], ["start", "length"]))
    return pa.RecordBatch.from_arrays(
        [block.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), spans,
         _texts(words, ~gone).cast(pa.string())], ["_id", "n_words", "n_removed", "spans", "kept_text"])
