"""Source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm.divergence import divergence, kept_terms, pair_sums, term_tables

SCHEMA = "doc_id long, text string, lang string, source string, _id string, rank int, value long, item string"


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def expected(rows, least=10, top=10):
    """Rows of the audit from (text, lang, source)."""
    counts, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        for s in sources:
            langs[lang].update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        own, q = {s: shares(counts[lang, s]) for s in sources}, shares(langs[lang])
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            words = [(t, f(own[s][t], q[t])) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:most], 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, 2, "y") for k, r in enumerate(rows)], SCHEMA).repartition(3)


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé漢") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["Same", "SAME", "x9y"]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None]), f"s{min(rng.randint(0, 12), 7)}"
        out.append((" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), lang, source))
    return out


@pytest.mark.parametrize("source_block,term_block", [(64, 4096), (3, 7)])
def test_audit_equals_plain_python(llm_spark, source_block, term_block):
    rows = random_rows(1) + [
        (None, "en", None), ("", None, ""), ("only these words here", "fr", "alone"), (None, "xx", "a"), ("q", "xx", "b"),
        ("same " * 30_000, "en", "s1"), ("a" * 70_000, "en", "s2"), ("1 2 3 !!", "en", "numbers"), ("same", "en", "s1")]
    got = divergence(frame(llm_spark, rows), source_block=source_block, term_block=term_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found(got) == expected(rows)


def test_a_threshold_of_one_keeps_every_term(llm_spark):
    rows = random_rows(2, 40) + [("z" * 5000, "en", "s1")]
    assert found(divergence(frame(llm_spark, rows), least=1, top=3)) == expected(rows, 1, 3)


def test_no_documents_and_no_terms(llm_spark):
    assert found(divergence(frame(llm_spark, random_rows(3, 1)).where("false"))) == set()
    rows = [(None, "en", "a"), ("", "en", "b"), ("12 34", "en", "c")]
    assert found(divergence(frame(llm_spark, rows))) == expected(rows)


@pytest.mark.parametrize("filter_bits", [8, 1 << 20])
@pytest.mark.parametrize("first_length", [1, 4])
def test_kept_terms_do_not_depend_on_levels_or_bitmap(llm_spark, filter_bits, first_length):
    rows = random_rows(4) + [("prefix" * 6 + c, "en", "s") for c in "ab" * 11] + [("prefix" * 6, "en", "s")] * 9
    tables = term_tables(frame(llm_spark, rows).select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]))
    got = {(r.lang, r.term): r.docs for r in kept_terms(tables, 10, first_length, filter_bits).collect()}
    docs = Counter((lang or "", t) for text, lang, _ in rows for t in set(terms_of(text)))
    assert got == {k: n for k, n in docs.items() if n >= 10}
    assert ("en", "prefix" * 6 + "a") in got and ("en", "prefix" * 6) not in got


def test_pair_sums_of_absent_terms(llm_spark):
    cells = llm_spark.createDataFrame([("en", 0, "a", 900), ("en", 1, "a", 100), ("en", 1, "b", 50)],
                                      "lang string, i long, term string, p long")
    sources = llm_spark.createDataFrame([("en", 0, 10, 5), ("en", 1, 20, 5), ("en", 2, 30, 5)],
                                        "lang string, i long, p0 long, terms long")

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    want = {(0, 1): f(900, 100) + f(10, 50) + 3 * f(10, 20), (0, 2): f(900, 30) + 4 * f(10, 30),
            (1, 2): f(100, 30) + f(50, 30) + 3 * f(20, 30)}
    for block in (1, 2, 64):
        got = pair_sums(cells, sources, 5, block, 1)
        assert {(r.i, r.j): r.value for r in got.collect()} == want
