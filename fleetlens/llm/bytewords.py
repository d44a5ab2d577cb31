"""Words of a whole Arrow column of texts as numpy arrays, without a Python object per word.

A block is a slice of an Arrow batch.  Its UTF-8 bytes are scanned once; words are described by
their start, length and document.  A null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PAD = 40  # readable bytes behind the last word, for lane-wise hashing
BLOCK_BYTES = 4 << 20
SMALL_BLOCK = 1 << 20  # where nothing is gained from words that repeat in a block

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITE = ~WHITE  # words [^\x20\x09-\x0D]+

ALNUM = np.zeros(256, bool)  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


@dataclass
class Words:
    buf: np.ndarray  # bytes of the block, padded
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray  # index of the first word of each document, and the number of words

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers stay alive, idle, beside an executor's other memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batch: pa.RecordBatch, text: int | str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text, of one row at least."""
    if not batch.num_rows:
        return
    _, offsets = raw_bytes(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return data + (((data - np.uint8(0x41)) < 26).view(np.uint8) << 5)


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(PAD, np.uint8)])


def split_words(column: pa.Array, word_byte: np.ndarray = NOT_WHITE, lower: bool = False) -> Words:
    data, offsets = raw_bytes(column)
    buf = padded(lower_ascii(data) if lower else data)
    return words_of(buf, offsets, word_byte)


def words_of(buf: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> Words:
    inside = word_byte.take(buf[:offsets[-1]])
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]  # a document's border also parts words
    at = offsets[:-1][full]
    begins[at] = inside[at]
    at = offsets[1:][full] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(begins)
    return Words(buf, start, np.flatnonzero(ends) + 1 - start, np.searchsorted(start, offsets))


def joined(words: Words) -> Words:
    """The same words in a new buffer, each followed by one space."""
    at = np.cumsum(words.length + 1) - (words.length + 1)
    total = int(at[-1] + words.length[-1] + 1) if len(at) else 0
    buf = np.full(total + PAD, 0x20, np.uint8)
    shift = np.repeat(at - words.start, words.length)
    source = np.repeat(words.start - np.cumsum(words.length) + words.length, words.length)
    source += np.arange(len(source))
    buf[source + shift] = words.buf[source]
    return Words(buf, at, words.length, words.first)


def lanes(buf: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The unsigned number that begins at each byte."""
    width = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - width + 1,), kind, buf, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _S32)
    h *= _M1
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """64 well-mixed bits for each word, from its bytes and length."""
    view = lanes(words.buf)
    h = mix(words.length.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
    h = mix(h ^ (view[words.start] & _MASK[np.minimum(words.length, 8)]))
    rest = np.flatnonzero(words.length > 8)
    done = 8
    while len(rest):
        left = words.length[rest] - done
        h[rest] = mix(h[rest] ^ (view[words.start[rest] + done] & _MASK[np.minimum(left, 8)]))
        rest = rest[left > 8]
        done += 8
    return h


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one padded buffer."""
    view8, view4 = lanes(buf), lanes(buf, "<u4")
    s, at = np.uint64(seed), start.astype(np.int64).copy()
    h = np.full(len(at), s + _P5, np.uint64)
    big = np.flatnonzero(length >= 32)
    if len(big):
        with np.errstate(over="ignore"):
            acc = [np.full(len(big), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        stripes, active, done = length[big] // 32, np.arange(len(big)), 0
        while len(active):
            for k in range(4):
                acc[k][active] = _round(acc[k][active], view8[at[big[active]] + 8 * k])
            at[big[active]] += 32
            done += 1
            active = active[stripes[active] > done]
        whole = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for k in range(4):
            whole = (whole ^ _round(np.zeros(len(big), np.uint64), acc[k])) * _P1 + _P4
        h[big] = whole
    h += length.astype(np.uint64)
    left = length % 32
    for k in range(3):
        i = np.flatnonzero(left >= 8 * (k + 1))
        if not len(i):
            break
        h[i] = _rotate(h[i] ^ _round(np.zeros(len(i), np.uint64), view8[at[i]]), 27) * _P1 + _P4
        at[i] += 8
    i = np.flatnonzero(left % 8 >= 4)
    h[i] = _rotate(h[i] ^ (view4[at[i]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[i] += 4
    for k in range(3):
        i = np.flatnonzero(left % 4 > k)
        h[i] = _rotate(h[i] ^ (buf[at[i]].astype(np.uint64) * _P5), 11) * _P1
        at[i] += 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> _S29
    h *= _P3
    h ^= h >> _S32
    return h


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one after the other."""
    total = np.cumsum(length)
    out = np.repeat(start - total + length, length)
    out += np.arange(len(out))
    return out


def sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[k]:first[k + 1]] for each k."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
