"""Importance resampling and its radix sort against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import resample as rs
from tests.llm.conftest import ROWS


def features_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(rows, target, buckets=10_000, least=20, percent=5):
    """(id, n_features, weight, score, rank) of each row; among equal keys ranks are dealt out in any order."""
    source, wanted = [0] * buckets, [0] * buckets
    for texts, into in (([t for _, t in rows], source), (target, wanted)):
        for text in texts:
            for f in features_of(text)[1]:
                into[zlib.crc32(f.encode()) % buckets] += 1
    s_all, t_all = sum(source), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(source, wanted)]
    out = []
    for i, text in rows:
        n, found = features_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def random_rows(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "of", "Été", "漢字", "x" * 700, "b2b", "zebra", "don't"] + [f"w{k}" for k in range(40)]
    return [(rng.choice([k, -k, k << 40]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(n)]


def test_resampling_equals_plain_python(llm_spark):
    rows = random_rows(1)
    target = ["the zebra of w1 w2", "w3 zebra zebra", None, ""]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = llm_spark.createDataFrame([(t,) for t in target], "text string")
    for percent, block_rows in ((5, 65_536), (60, 7)):
        got = rs.resample(docs, bench, percent=percent, block_rows=block_rows)
        assert found(got) == expected(rows, target, percent=percent)


def test_resampling_of_awkward_rows(odd_docs, no_docs):
    target = ["the quick fox", "one two three"]
    bench = odd_docs.sparkSession.createDataFrame([(t,) for t in target], "text string")
    rows = [(i, t) for i, t in ROWS]
    assert found(rs.resample(odd_docs, bench, least_words=1, percent=50)) == expected(rows, target, least=1, percent=50)
    assert found(rs.resample(odd_docs, bench.where("false"), percent=100)) == expected(rows, [], percent=100)
    assert rs.resample(no_docs, bench).collect() == []


def test_equal_rows_have_ranks_of_their_own(llm_spark):
    text = " ".join(["same"] * 25)
    docs = llm_spark.createDataFrame([(k % 3, text) for k in range(60)] + [(None, text)] * 20, "doc_id long, text string")
    got = rs.resample(docs.repartition(5), docs.limit(0), percent=50).where("rank is not null")
    ranks = {r["rank"]: r.doc_id for r in got.collect()}
    want = expected([(k % 3, text) for k in range(60)] + [(None, text)] * 20, [], percent=50)
    assert sorted(ranks) == list(range(1, 41))
    assert sorted((r[0], r[4]) for r in want if r[4]) == sorted((i, k) for k, i in ranks.items())


def test_ids_must_be_integers(llm_spark):
    docs = llm_spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(ValueError):
        rs.resample(docs, docs)


def test_crcs_of_word_runs():
    texts = ["A bc  DEF gh", None, "", "é " + "y" * 1300 + " z", "one", "!!!", "q" * 512 + " " + "r" * 513]
    found, n_words = rs.features(pa.array(texts), 1 << 31)
    for k, text in enumerate(texts):
        n, want = features_of(text)
        assert n_words[k] == n
        got = [int(x) for bucket, first in found for x in bucket[first[k]:first[k + 1]]]
        assert got == [zlib.crc32(f.encode()) % (1 << 31) for f in want]


@pytest.mark.parametrize("block_rows", [1, 5, 1000])
def test_radix_sort_orders_composite_keys(llm_spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(k * 3, rng.choice([0, 0, 5, rng.getrandbits(20)]), rng.choice([7, -1, -2**63, rng.getrandbits(63)])) for k in range(120)]
    df = llm_spark.createDataFrame(rows, "pos long, a long, b long").repartition(4)
    got = rs.radix_sort(df.withColumn("row", df.pos), [("a", 20), ("b", 64)], block_rows).collect()
    assert sorted(r.pos for r in got) == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (r[1], r[2] % 2**64, r[0]))  # stable
    assert [r.row for r in sorted(got, key=lambda r: r.pos)] == [r[0] for r in want]


def test_gains_of_large_counts():
    source, target = np.zeros(4, object), np.zeros(4, object)
    source[:] = [10**15, 0, 3, 10**18]
    target[:] = [0, 7, 3, 1]
    s, t = sum(source) + 4, sum(target) + 4
    want = [math.floor(1000 * math.log(float(b + 1) * float(s) / (float(a + 1) * float(t)))) for a, b in zip(source, target)]
    assert rs.bucket_gains(source, target).tolist() == want
