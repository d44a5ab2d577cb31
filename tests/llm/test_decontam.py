import random

import pytest

from fleetlens.llm import decontam
from tests.llm.conftest import ROWS

ITEMS = [("a", "two three four five six seven eight nine ten ELEVEN twelve"), ("b", "QUICK, brown fox"), ("c", None), ("d", "..."),
         ("e", "quick brown"), ("e", "quick brown"), (None, "word"), ("f", "fox the")]


def words_of(text):
    import re
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(rows, items, window):
    out = []
    for i, text in rows:
        w, hit, names = words_of(text), set(), set()
        for name, item in items:
            v = words_of(item)
            n = min(window, len(v))
            windows = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names.add(name)
        out.append((i, len(w), len(hit), sorted(names - {None})))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [20, 400_000])
def test_awkward_rows(llm_spark, odd_docs, no_docs, shard_bytes):
    bench = llm_spark.createDataFrame([(a, b, 1) for a, b in ITEMS], "item_id string, text string, doc_id int")
    assert found(decontam.contamination(odd_docs, bench, shard_bytes=shard_bytes)) == expected(ROWS, ITEMS, 10)
    assert decontam.contamination(no_docs, bench).collect() == []
    none = decontam.contamination(odd_docs, bench.where("false"))
    assert found(none) == expected(ROWS, [], 10)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_over_few_words(llm_spark, seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(rng.randint(0, n)))
    items = [(str(k), make(9)) for k in range(6)]
    rows = [(k, make(60)) for k in range(40)]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = llm_spark.createDataFrame(items, "item_id string, text string")
    assert found(decontam.contamination(docs, bench, window=4)) == expected(rows, items, 4)


def test_spans_are_cut_and_covered_documents_dropped(llm_spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    after = "! and much that follows after it" * 5
    rows = [(1, f"before it, {item.upper()}{after}", "x"), (2, item, "y"), (3, "nothing here", "z"), (4, None, "w")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string, _text string")
    bench = llm_spark.createDataFrame([("i", item)], "item_id string, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, max_coverage=0.5).collect()}
    assert got == {1: f"before it, {after}", 3: "nothing here", 4: None}
    strict = decontam.decontaminate(docs, bench, max_coverage=0.0)
    assert strict.columns == docs.columns and sorted(r.doc_id for r in strict.collect()) == [3, 4]
