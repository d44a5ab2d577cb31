"""Token ids and token counts of whole texts (operator 9; also used by packing).

Batches are cut by bytes, not by rows.  Texts are split where no token can reach across: before
white space that follows another character.  A unit (white space and what follows it) encodes alone
as it does in its text, so each unit is encoded once for a block and the ids or counts are gathered
for all its places; a worker also remembers units between blocks, in tables of fixed size.  A single
text that is longer than a block goes through in pieces that end at unit borders.

Units are told apart by 64 bits of hash.  The vocabulary file is a parameter; it must be readable
under the same path on every machine.  A null text is an empty text.  Other columns play no part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw

_encoders: dict[tuple, UnitEncoder] = {}


class UnitEncoder:
    """Counts or ids of units, with a direct-mapped table of units seen before."""

    def __init__(self, path: str, with_ids: bool, bits: int = 20, pool: int = 4_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has its own tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.with_ids, self.mask = with_ids, np.uint64((1 << bits) - 1)
        self.count = np.zeros(1 << bits, np.int32)
        self.begin = np.zeros(1 << bits, np.int32)
        self.pool = np.zeros(pool if with_ids else 0, np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.key = ~np.arange(len(self.count), dtype=np.uint64)  # belongs to no hash of its place
        self.used = 0

    def look_up(self, units: bw.Words) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each unit and, with ids, where they begin in the pool."""
        h = bw.hash_words(units)
        slot = (h & self.mask).astype(np.int64)
        missing = np.flatnonzero(self.key[slot] != h)
        count, begin = self.count[slot], self.begin[slot]
        if not len(missing):
            return count, begin
        new, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
        at = missing[first]
        raw = units.buf.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(units.start[at].tolist(), (units.start + units.length)[at].tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        if self.with_ids:
            total = int(sizes.sum())
            if self.used + total > len(self.pool) and self.used:
                self._forget()
                return self.look_up(units)
            if total > len(self.pool):
                self.pool = np.zeros(total, np.uint32)
            self.pool[self.used:self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
            begins = self.used + np.cumsum(sizes) - sizes
            self.used += total
            begin[missing] = begins[inverse]
            self.begin[slot[at]] = begins
        count[missing] = sizes[inverse]
        self.count[slot[at]] = sizes
        self.key[slot[at]] = new
        return count, begin


def units_of(buf: np.ndarray, offsets: np.ndarray) -> bw.Words:
    """Units of each text of a padded buffer.

    A unit begins at white space after a character that is none.  Unicode's other white space counts as unknown: behind bytes that may end such
    a character no unit begins.
    """
    n = int(offsets[-1])
    white = bw.WHITE.take(buf[:n])
    begins = white.copy()
    if n:
        begins[0] = False
        before = buf[:n - 1]
        safe = (before > 0x20) & (before < 0x80)
        lead = np.zeros(n - 1, bool)
        lead[1:] = (buf[:n - 2] >= 0xC3) & (buf[:n - 2] <= 0xDF) if n > 1 else False
        begins[1:] &= safe | (lead & (before >= 0x80))
    borders = np.unique(offsets[:-1][np.diff(offsets) > 0])
    begins[borders] = True
    start = np.flatnonzero(begins)
    return bw.Words(buf, start, np.diff(np.append(start, n)), np.searchsorted(start, offsets))


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """One long text in pieces of about `size` bytes that end at unit borders."""
    while len(data) > size:
        units = units_of(bw.padded(data[:size]), np.array([0, size]))
        cut = int(units.start[-1])
        if not cut:  # no border in sight
            size *= 2
            continue
        yield data[:cut]
        data = data[cut:]
    yield data


def encoder(path: str, with_ids: bool, *size: int) -> UnitEncoder:
    """The worker's encoder for a vocabulary, with tables of this size."""
    if (path, with_ids, *size) not in _encoders:
        _encoders[path, with_ids, *size] = UnitEncoder(path, with_ids, *size)
    return _encoders[path, with_ids, *size]


def counts(column: pa.Array, path: str) -> np.ndarray:
    """Number of tokens of each text."""
    if path.endswith(".model"):
        return _piece_counts(column, path)
    found = encoder(path, False)
    data, offsets = bw.raw_bytes(column)
    if len(column) == 1:
        return np.array([sum(int(found.look_up(units_of(bw.padded(p), np.array([0, len(p)])))[0].sum())
                             for p in _pieces(data, 2 * bw.BLOCK_BYTES))])
    units = units_of(bw.padded(data), offsets)
    return bw.sum_by(found.look_up(units)[0].astype(np.int64), units.first)


def _piece_counts(column: pa.Array, path: str) -> np.ndarray:
    import sentencepiece

    model = _encoders.setdefault((path, False), sentencepiece.SentencePieceProcessor(model_file=path))
    return np.array([len(x) for x in model.encode(column.fill_null("").to_pylist(), num_threads=1)], np.int64)


def ids(column: pa.Array, path: str, *size: int) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of the texts of a block, and the offsets of each text; `size`: bits and pool of the encoder's tables."""
    found = encoder(path, True, *size)
    data, offsets = bw.raw_bytes(column)
    if len(column) == 1 and len(data) > 2 * bw.BLOCK_BYTES:
        parts = []
        for p in _pieces(data, 2 * bw.BLOCK_BYTES):
            count, begin = found.look_up(units_of(bw.padded(p), np.array([0, len(p)])))
            parts.append(found.pool[bw.ragged(begin.astype(np.int64), count.astype(np.int64))])
        out = np.concatenate(parts)
        return out, np.array([0, len(out)])
    units = units_of(bw.padded(data), offsets)
    count, begin = (x.astype(np.int64) for x in found.look_up(units))
    total = np.concatenate([[0], np.cumsum(count)])
    return found.pool[bw.ragged(begin, count)], total[units.first]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes and n_tokens, without begin, end or other added tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in bw.blocks(batch, 1):
                _, offsets = bw.raw_bytes(block.column(1))
                n = counts(block.column(1), path)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())],
                    ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {dict(rows.dtypes)['_id']}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
