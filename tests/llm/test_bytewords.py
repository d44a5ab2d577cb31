import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import bytewords as bw
from fleetlens.llm.substring import pack, unpack, window_hashes

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB 1\n\tÉß漢\x0b|", max_size=40)), max_size=8)


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(column):
    for table, pattern in ((bw.NOT_WHITE, rb"[^\x20\x09-\x0D]+"), (bw.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = bw.split_words(pa.array(column, pa.string()), table, lower=True)
        joined = bw.joined(words)
        for k, text in enumerate(column):
            at = range(words.first[k], words.first[k + 1])
            want = re.findall(pattern, lower(text))
            assert [words.buf[words.start[i]:words.start[i] + words.length[i]].tobytes() for i in at] == want
            assert [joined.buf[joined.start[i]:joined.start[i] + joined.length[i]].tobytes() for i in at] == want


def test_xxh64_equals_the_library_at_every_length():
    data = np.random.default_rng(0).integers(0, 256, 400).astype(np.uint8)
    buf = bw.padded(data)
    start = np.repeat([0, 3, 7], 150)
    length = np.tile(np.arange(150), 3)
    want = [xxhash.xxh64(data[s:s + n].tobytes(), seed=42).intdigest() for s, n in zip(start, length)]
    assert bw.xxh64(buf, start, length).tolist() == want


def test_word_hashes_tell_words_apart():
    column = pa.array(["a b aa ab a\x00 12345678 123456789 1234567890123456 a"])
    h = bw.hash_words(bw.split_words(column))
    assert len(set(h.tolist())) == 8 and h[0] == h[-1]


def test_blocks_cover_all_rows_and_hold_one_at_least():
    batch = pa.record_batch([pa.array(["x" * 50, None, "", "y" * 500, "z"])], ["t"])
    parts = list(bw.blocks(batch, 0, 60))
    assert sum(p.num_rows for p in parts) == 5 and all(p.num_rows for p in parts)
    assert not list(bw.blocks(batch.slice(0, 0), 0))


def test_window_hashes_depend_on_the_window_alone():
    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    again = np.concatenate([words[20:45], words[:30]])
    a, b = window_hashes(words, 13), window_hashes(again, 13)
    assert len(a) == 38 and a[20:33].tolist() == b[:13].tolist() and a[:18].tolist() == b[25:].tolist()
    assert len(set(a.tolist())) == 38
    swapped = words.copy()
    swapped[[0, 1]] = swapped[[1, 0]]
    assert window_hashes(swapped, 13)[0] != a[0]
    assert len(window_hashes(words[:5], 13)) == 0


@given(st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_packed_numbers_come_back(values):
    got, rest = unpack(memoryview(pack(np.array(values, np.uint64)) + b"rest"), len(values))
    assert got.tolist() == values and bytes(rest) == b"rest"
