"""Token ids in ORC files in the order of the document ids, read by stripes and by id (operator 12).

A document is the token ids of its text and one end id.  Files hold rows of at most `row_ids` ids, so a
very long text is several rows and no row, batch or stripe grows with a text.  The columns are the
document's id, the row's number among the document's rows and how many there are (`chunk`, `chunks`),
the file's number (`part`), the place of the row's first id in the file (`position`), `length`, and `ids`,
integers that ORC run-length encodes.  Stripes and row groups have their sizes as options; a row index
and a Bloom filter on the document's id let a reader skip files, stripes and row groups that do not hold
an id.

The texts are dealt out by ranges of the id, and of the text's hash and the row's number behind it, so rows
that share an id may fill several files; each task sorts its range, encodes it text by text and writes
one file.  Ids of tokens never cross a shuffle and are stored in the files alone.  A row's place among
all ids is its file's offset and its position.  The offsets are prefix sums over one number for each file,
read from narrow columns alone.

Reading is parallel by stripe and needs no order: each row knows its place.  `read_token_ids` filters by
document ids, which reach the files as search arguments.

Defined results: a null or empty text is the end id alone.  Null ids come first; rows that repeat an id are
documents of their own, in the order of their texts' hashes.  An empty table gives no row.  Other
columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm import tokens
from fleetlens.llm.scratch import store

ROW_IDS = 2048
FILE_BYTES = 256 << 20
STRIPE_BYTES, INDEX_ROWS = 64 << 20, 1000
UNIT_BITS, UNIT_POOL = 22, 16_000_000  # 130 MB of units a worker remembers
_WRITE_BYTES = 1 << 20
_OFFSET_GROUP = 1000


def _encode(block: pa.RecordBatch, path: str, end_id: int, row_ids: int, part: int, position: int) -> pa.RecordBatch:
    """Rows of a block of (id, text) documents, the first of them at this position of the file."""
    found, offsets = tokens.ids(block.column(1), path, UNIT_BITS, UNIT_POOL)
    data = np.insert(found.astype(np.int32), offsets[1:], end_id)
    sizes = np.diff(offsets) + 1
    chunks = -(-sizes // row_ids)
    chunk = bw.ragged(np.zeros(len(chunks), np.int64), chunks)
    doc = np.repeat(np.arange(len(sizes)), chunks)
    length = np.minimum(sizes[doc] - chunk * row_ids, row_ids)
    ends = np.concatenate([[0], np.cumsum(length)])
    return pa.RecordBatch.from_arrays(
        [block.column(0).take(pa.array(doc)), pa.array(chunk), pa.array(chunks[doc]),
         pa.array(np.full(len(doc), part), pa.int32()), pa.array(position + ends[:-1]), pa.array(length, pa.int32()),
         pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data))],
        ["doc_id", "chunk", "chunks", "part", "position", "length", "ids"])


def write_token_ids(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                    row_ids: int = ROW_IDS, file_bytes: int = FILE_BYTES, stripe_bytes: int = STRIPE_BYTES,
                    index_rows: int = INDEX_ROWS, bloom_fpp: float = 0.01) -> None:
    """Write the documents' token ids to ORC files under `out`, in ascending order of their ids.

    A file holds the ids of about file_bytes of text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, position = TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in bw.blocks(batch, 1, _WRITE_BYTES):
                rows = _encode(block, path, end_id, row_ids, part, position)
                position += int(rows.column("length").to_numpy().sum())
                yield rows

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_tie"),
                       F.monotonically_increasing_id().alias("_row"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // file_bytes)
    order = ["_id", "_tie", "_row"]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("_id", "_text")
    schema = (f"doc_id {dict(rows.dtypes)['_id']}, chunk long, chunks long, part int, position long, length int, "
              "ids array<int>")
    ordered.mapInArrow(run, schema).write.options(**{
        "orc.create.index": "true", "orc.row.index.stride": str(index_rows), "orc.stripe.size": str(stripe_bytes),
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp)}).orc(out)


def file_offsets(files: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before each; sums of groups of files first, then inside each group."""
    sizes = files.groupBy("part").agg(F.sum("length").alias("n")).withColumn("group", F.expr(f"part div {_OFFSET_GROUP}"))
    groups = sizes.groupBy("group").agg(F.sum("n").alias("n"))
    groups = groups.select("group", (F.sum("n").over(Window.orderBy("group")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n")
    return sizes.withColumn("inside", inside).join(groups, "group").select(
        "part", (F.col("base") + F.col("inside")).alias("before"))


def read_token_ids(spark: SparkSession, out: str, doc_ids: Sequence | None = None, row_ids: int = ROW_IDS) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before this one), chunk, chunks, length and ids.

    With doc_ids only rows of these documents; the filter reaches the files' statistics and Bloom filters.
    """
    files = spark.read.orc(out)
    offsets = file_offsets(files.select("part", "length"))
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin(list(doc_ids)))
    return rows.join(F.broadcast(offsets), "part").select(  # two numbers for each file
        "doc_id", (F.col("before") + F.col("position") - F.col("chunk") * row_ids).alias("start"), "chunk", "chunks",
        "length", "ids")


def whole_documents(rows: DataFrame) -> DataFrame:
    """doc_id, start and input_ids, all ids of a document with its end id, from rows of `read_token_ids`."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    return rows.groupBy("doc_id", "start").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"))


def joined_crc(crcs: Sequence[int], sizes: Sequence[int]) -> int:
    """CRC-32 of data whose pieces have these CRCs and sizes in bytes."""
    out = crcs[0]
    for crc, size in zip(crcs[1:], sizes[1:]):
        zeros = bytes(size)
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros) ^ crc
    return out


def token_summary(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (with the end id) and ids_crc32, over little-endian unsigned 32-bit ids."""
    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()) * 4
            data = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), "<i4")).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "chunk", "chunks")),
                 pa.array(np.diff(ends) // 4, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "chunk", "chunks", "n", "crc"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("pieces").to_pylist()
            crc = [joined_crc([p["crc"] for p in own], [4 * p["n"] for p in own]) for own in pieces]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(rows.dtypes)["doc_id"]
    found = store(rows.mapInArrow(crcs, f"doc_id {kind}, start long, chunk long, chunks long, n long, crc long"), "crcs")
    whole = found.where("chunks = 1").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    long = found.where("chunks > 1").groupBy("doc_id", "start").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "crc", "n"))).alias("pieces"), F.sum("n").alias("n_tokens"))
    return whole.unionByName(long.mapInArrow(join, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"))
