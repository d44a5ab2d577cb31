"""Token ids in ORC files: round trip against the tokenizer library, order, and what reads skip."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from fleetlens.llm import orcids
from fleetlens.session import scratch_path
from tests.llm.conftest import ROWS

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    found = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids
    return found + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_round_trip(spark, out, rows):
    got = orcids.read_token_ids(spark, out, row_ids=16)
    summary = orcids.token_summary(got).collect()
    whole = {(r.doc_id, r.start): r.input_ids for r in orcids.whole_documents(got).collect()}
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in summary) == sorted(
        (str(i), len(ids_of(t)), crc(ids_of(t))) for i, t in rows)
    place = 0
    for r in sorted(summary, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
        assert crc(whole[r.doc_id, r.start]) == r.ids_crc32 and len(whole[r.doc_id, r.start]) == r.n_tokens
    order = [r.doc_id for r in sorted(summary, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))  # null first
    assert len(whole) == len(rows)


def test_round_trip_of_awkward_rows(odd_docs, no_docs):
    spark = odd_docs.sparkSession
    out = scratch_path(spark, "orc")
    orcids.write_token_ids(odd_docs, out, PATH, row_ids=16)
    check_round_trip(spark, out, ROWS)
    out = scratch_path(spark, "orc")
    orcids.write_token_ids(no_docs, out, PATH)
    assert orcids.token_summary(orcids.read_token_ids(spark, out)).collect() == []


def test_rows_that_share_an_id_fill_several_files(llm_spark):
    rows = [(5, f"text number {k} " * 20) for k in range(200)] + [(k, "other") for k in range(10)] + [(None, "x")] * 3
    out = scratch_path(llm_spark, "orc")
    orcids.write_token_ids(llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(3), out, PATH, row_ids=16)
    check_round_trip(llm_spark, out, rows)
    full = llm_spark.read.orc(out).where("doc_id = 5").select("part").distinct().count()
    assert full > 2


def test_files_have_stripes_a_row_index_and_bloom_filters(llm_spark):
    rows = [(3 * k, f"word{k} " * (k % 7 * 40)) for k in range(6000)]
    plain, bloom = scratch_path(llm_spark, "orc"), scratch_path(llm_spark, "orc")
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string")
    tasks = llm_spark.conf.get("spark.sql.shuffle.partitions")
    llm_spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orcids.write_token_ids(docs, bloom, PATH, stripe_bytes=200_000, index_rows=1000)
        orcids.write_token_ids(docs, plain, PATH, stripe_bytes=200_000, index_rows=1000, bloom_fpp=0.5)
    finally:
        llm_spark.conf.set("spark.sql.shuffle.partitions", tasks)
    files = sorted(Path(bloom).glob("*.orc"))
    assert len(files) == 1
    meta = orc.ORCFile(str(files[0]))
    assert meta.nstripes > 1 and meta.row_index_stride == 1000 and meta.nrows == 6000
    size = sum(p.stat().st_size for p in files)
    assert size > sum(p.stat().st_size for p in Path(plain).glob("*.orc"))  # sharper filters take more room

    def rows_read(ids):
        df = orcids.read_token_ids(llm_spark, bloom, ids)
        got = sorted(r.doc_id for r in df.select("doc_id").collect())
        scanned = llm_spark.read.orc(bloom).where(f"doc_id in ({','.join(map(str, ids))})").select("doc_id", "ids")
        plan = scanned._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [In(doc_id" in plan.toString() or "EqualTo(doc_id" in plan.toString()
        scanned.collect()
        node = plan
        while node.children().size():
            node = node.children().apply(0)
        return got, node.metrics().apply("numOutputRows").value()

    everything = 6000
    got, n = rows_read([3 * 4321, 3 * 4322])
    assert got == [3 * 4321, 3 * 4322] and n <= 1000  # one row group
    got, n = rows_read([3 * 4321 + 1, 3 * 10 + 2])  # between the ids: only Bloom filters can tell
    assert got == [] and n < everything / 2


@pytest.mark.parametrize("sizes", [[5], [8, 8, 3], [0, 4], [4, 0, 4]])
def test_crc_of_pieces(sizes):
    data = bytes(range(1, sum(sizes) + 1))
    pieces, at = [], 0
    for n in sizes:
        pieces.append(data[at:at + n])
        at += n
    assert orcids.joined_crc([zlib.crc32(p) for p in pieces], sizes) == zlib.crc32(data)
