import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetlens.llm import packing, tokens
from tests.llm.conftest import ROWS

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def library_ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB's1 \n\t\x0b\x1c\x85\xa0 　Éé́漢.<|>", max_size=30),
                          st.sampled_from([" <|endoftext|> a<|endoftext|>", "I'll  don't\n\n x ", "a <|startoftext|>b"])),
                min_size=1, max_size=5))
def test_units_give_the_librarys_ids(path, column):
    texts = pa.array(column, pa.string())
    want = [library_ids(path, t) for t in column]
    assert tokens.counts(texts, path).tolist() == [len(x) for x in want]
    found, offsets = tokens.ids(texts, path)
    assert [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    monkeypatch.setattr(tokens.bw, "BLOCK_BYTES", 200)
    for text in ("some words, and more  of them\n\n" * 200, "x" * 3000, " é " * 900):
        want = library_ids(BYTE, text)
        assert tokens.counts(pa.array([text]), BYTE).tolist() == [len(want)]
        assert tokens.ids(pa.array([text]), BYTE)[0].tolist() == want


def test_a_small_memory_of_units_forgets_and_goes_on(monkeypatch):
    monkeypatch.setitem(tokens._encoders, (BYTE, True), tokens.UnitEncoder(BYTE, True, bits=3, pool=50))
    for k in range(30):
        text = " ".join(f"word{k + j}" for j in range(12))
        assert tokens.ids(pa.array([text, "again " + text]), BYTE)[0].tolist() == library_ids(BYTE, text) + library_ids(BYTE, "again " + text)


def test_counts_of_awkward_rows(odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.token_counts(odd_docs, WORD).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), len(library_ids(WORD, t))) for i, t in ROWS), key=str)
    assert tokens.token_counts(no_docs, WORD).collect() == []


def test_sentence_pieces_are_counted_too(odd_docs):
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(odd_docs, path).collect()), key=str)
    assert got == sorted(((i, len(model.encode(t or ""))) for i, t in ROWS), key=str)


def check_packing(rows, pieces, window=1024):
    """Every id in one piece, sequences gapless and within the window; returns the share of padding."""
    docs = {}
    for i, text in rows:
        docs.setdefault(i, []).append(library_ids(BYTE, text) + [0])
    by_doc, by_sequence, used, padded = {}, {}, 0, 0
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(docs)
    for i, parts in by_doc.items():
        expected = sorted((s, min(window, len(x) - s), zlib.crc32(np.array(x[s:s + window], "<u4").tobytes()), len(x))
                          for x in docs[i] for s in range(0, len(x), window))
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in parts) == expected
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == parts[0].sequence_tokens <= window
        assert parts[0].sequence_length == (at if at & (at - 1) == 0 else window)
        used, padded = used + at, padded + parts[0].sequence_length
    return 1 - used / padded


def test_packing_of_awkward_rows(odd_docs, no_docs):
    check_packing(ROWS, packing.pack(odd_docs, BYTE).collect())
    check_packing(ROWS, packing.pack(odd_docs, BYTE, group_rows=2).collect())
    assert packing.pack(no_docs, BYTE).collect() == []


def test_packing_of_the_documents(llm_spark):
    docs = llm_spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(rows, packing.pack(docs, BYTE).collect()) < 0.01


def test_sequences_hold_the_documents_ids(llm_spark, sf_dir):
    docs = llm_spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30")
    placed = packing.pack(docs, BYTE)
    made = {r.sequence_id: r.input_ids for r in packing.sequences(docs, placed, BYTE).collect()}
    for p in placed.collect():
        part = made[p.sequence_id][p.offset:p.offset + p.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=33, max_size=33))
def test_plans_use_up_any_histogram(counts):
    histogram = np.array(counts)
    histogram[0] = 0
    used = np.zeros(33, int)
    for pattern, k in packing.plan_patterns(histogram, 32):
        assert sum(pattern) <= 32 and k > 0
        for n in pattern:
            used[n] += k
    assert (used == histogram).all()


def test_least_squares_finds_exact_repeats():
    combos = packing.combinations_of(np.array([200, 300, 500, 724, 824]), 1024)
    assert [0, 200, 824] in combos.tolist() and [0, 300, 724] in combos.tolist()
    histogram = np.zeros(1025)
    histogram[[200, 824]] = 40
    histogram[[300, 724]] = 7
    x = packing.least_squares(combos, histogram)
    assert {tuple(c): round(v) for c, v in zip(combos.tolist(), x) if v > 0.5} == {(0, 200, 824): 40, (0, 300, 724): 7}
