"""Classifiers and the language model: held-out accuracy on the given tables, awkward rows, invariants."""

import inspect
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import bytewords as bw
from fleetlens.llm import langid, pseudolm, quality, toxicity
from fleetlens.llm.labelled import held_out
from fleetlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(llm_spark):
    return llm_spark.read.parquet(f"{SF}/labels.parquet")


def held_accuracy(rows, labels, label):
    own = rows.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id")
    return own.agg(F.avg((F.col(label) == F.col("predicted")).cast("int"))).first()[0]


def test_quality_on_held_out_rows(llm_spark, labels):
    rows = QUERIES["op10_quality"](llm_spark, SF)
    assert held_accuracy(rows, labels, "quality") > 0.95
    assert rows.where("score is null or score < 0 or score > 1").count() == 0 and rows.count() == 1000


def test_toxicity_on_held_out_rows(llm_spark, labels):
    rows = QUERIES["op6_toxicity"](llm_spark, SF)
    assert held_accuracy(rows, labels, "toxic") > 0.92
    assert rows.where("score is null or score < 0 or score > 1").count() == 0


def test_language_on_held_out_rows(llm_spark):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op8_language"](llm_spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_held_out_rows_and_other_columns_teach_nothing(llm_spark, labels):
    """Scores stay when the labels of held-out rows, and lang and source, are changed."""
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    turned = labels.withColumn("quality", F.when(held_out("doc_id", 4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.score_quality(docs, quality.fit(docs, labels)).orderBy("doc_id").toPandas()
    b = quality.score_quality(docs.drop("lang", "source"), quality.fit(docs.drop("lang"), turned)).orderBy("doc_id").toPandas()
    assert np.allclose(a["score"], b["score"])


def test_awkward_rows_get_scores(llm_spark, odd_docs, no_docs):
    labels = llm_spark.createDataFrame(
        [(k, k % 2, (k + 1) % 2) for k in range(1, 15)] + [(3, None, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int")
    for rows in (quality.score_quality(odd_docs, quality.fit(odd_docs, labels)),
                 toxicity.score_toxicity(odd_docs, toxicity.fit(odd_docs, labels)),
                 langid.detect(odd_docs, langid.fit(odd_docs))):
        got = rows.collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 7}) == 1
    und = {r.doc_id for r in langid.detect(odd_docs, langid.fit(odd_docs)).where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6, 11, None} or und == {4, 5, 6, 11}
    for fit, score in ((quality.fit, quality.score_quality), (toxicity.fit, toxicity.score_toxicity)):
        assert len(score(odd_docs, fit(odd_docs, labels.where("false"))).collect()) == odd_docs.count()
        assert score(no_docs, fit(no_docs, labels)).collect() == []
    assert langid.detect(no_docs, langid.fit(no_docs)).collect() == []
    assert quality.keep_quality(odd_docs, quality.fit(odd_docs, labels), 0.0).columns == odd_docs.columns


def test_non_negative_risk_separates_positives_in_unlabelled_rows():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.6, (700, 3)), rng.normal(-1, 0.6, (300, 3))
    model = quality.train(good[:300], np.concatenate([good[300:], bad[:200]]), prior=2 / 3)
    assert (quality.raw_scores(model, good) > 0).mean() > 0.9
    assert (quality.raw_scores(model, bad) < 0).mean() > 0.9


def test_calibrated_scores_are_probabilities():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.5 * z - 0.5)))).astype(int)
    slope, shift = quality.calibrate(z, y, y.mean())
    assert abs(slope - 1.5) < 0.2 and abs(shift + 0.5) < 0.2


def test_look_alikes_digits_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0})
    texts = ["you IDIOT", "you 1d10t", "you іdіоt", "you ｉｄｉｏｔ", "you idi​ot", "an idiotic thing", "the trash can is full", "trash talk",
             "trash can and trash", "nonidiot", "", None]
    found = lexicon.weigh(pa.array(texts, pa.string()))[:, 0] > 0
    assert found.tolist() == [True] * 6 + [False, True, True, False, False, False]


def test_accents_other_letters_signs_and_letters_apart():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0, "loser": 4.0, "asshole": 4.0})
    bad = ["IDÍOT", "ìdiot", "i\u0301diot", "\U0001d422\U0001d41d\U0001d422\U0001d428\U0001d42d", "id!ot", "!diot", "a$$hole", "i d i o t",
           "you i.d.i.o.t!", "I-D-I-O-T", "great!idiot", "sore loser", "TRASH!", "ÏDIÖT"]
    good = ["trash can", "Trash cans.", "the trash can", "i d i", "a b c d e", "x!idi", "an id!om", "it costs $500", "fine!", "", "a | b"]
    apart = ["x i d", "i o t"]  # letters of neighbouring texts are no word
    found = lexicon.weigh(pa.array(bad + good + apart, pa.string()))[:, 0] > 0
    assert found.tolist() == [True] * len(bad) + [False] * (len(good) + 2)
    assert (lexicon.weigh(pa.array(["trash canister talk", "scumbled"], pa.string()))[:, 0] > 0).tolist() == [True, False]
    long = "漢" * 300_000 + "!ab " + "i d i o t " * 50_000
    assert lexicon.weigh(pa.array([long]))[0, 0] > 0


def test_toxicity_scores_equal_plain_python(llm_spark):
    """Entries at word beginnings, weights of the heaviest entry at a place, and the curve, one text at a time."""
    model = {"weights": {"idi": 2.0, "idiot": 4.0, "scum": 3.0}, "slope": [0.7, 0.3], "shift": -1.5}
    texts = ["you idiot", "Idiom and IDIOT, scum!", "the pond scum", "fine words " * 40 + "scum", "pond scum scummy idi", "", None, "1d1ot"]
    want = []
    for k, text in enumerate(texts):
        plain = "".join({"1": "i"}.get(c, c if c.isalpha() else " ") for c in (text or "").lower()).split()
        total = sum(4.0 if w.startswith("idiot") else 2.0 if w.startswith("idi") else 3.0 if w.startswith("scum") else 0.0
                    for j, w in enumerate(plain) if not (w == "scum" and j and plain[j - 1] == "pond"))
        words = max(len((text or "").split()), 20)
        z = 0.7 * np.log1p(total) + 0.3 * np.log1p(100 * total / words) - 1.5
        want.append((k, 1 / (1 + np.exp(-z))))
    docs = llm_spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, model).collect())
    assert np.allclose(got, want)


def test_cover_is_greedy_and_rare_entries_need_evidence(llm_spark):
    texts = [{"aaaa"}, {"aaaa", "bbbb"}, {"aaaa", "bbbb"}, {"bbbb", "cccc"}, {"aaaaa", "cccc"}]
    assert toxicity._choose(texts, {"aaaa": 2, "aaaaa": 9, "bbbb": 2, "cccc": 2}, 1, 1) == ["aaaa", "cccc"]
    assert toxicity._choose(texts, {"aaaa": 2, "aaaaa": 9, "bbbb": 2, "cccc": 2}, 3, 3) == ["bbbb", "aaaa"][::-1]
    rows = [(k, "zorgon filler" if k < 40 else "quux filler" if k < 43 else "filler", int(k < 100)) for k in range(200)]
    docs = llm_spark.createDataFrame([(k, f"{t} {k}") for k, t, _ in rows], "doc_id long, text string")
    labels = llm_spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels, modulus=1, remainder=1)["weights"]
    assert any(e.startswith("zorg") for e in weights) and not any(e.startswith("quu") or e.startswith("fil") for e in weights)


def test_longer_clean_text_lowers_the_weight():
    lexicon = toxicity.Lexicon({"idiot": 4.0})
    x = lexicon.weigh(pa.array(["idiot", "idiot " + "fine " * 500]))
    assert x[0, 0] == x[1, 0] and x[0, 1] > x[1, 1]


def brute_log_prob(model, text):
    """Each word masked in turn, one probability at a time."""
    words = bw.split_words(pa.array([text]), lower=True)
    own, within = pseudolm.encode(words, model["vocab"])
    net, total = {k: v.astype(float) for k, v in model["net"].items()}, 0.0
    for i in range(len(own)):
        h = net["bias"].copy()
        for k, shift in enumerate([-3, -2, -1, 1, 2, 3]):
            j = i + shift
            h += net["embed"][k][own[j] if 0 <= j < len(own) else pseudolm.CLASSES]
        h, (group, member) = np.tanh(h), divmod(own[i], pseudolm.GROUP)
        p = np.exp(h @ net["out"] + net["shift"])
        q = np.exp(h @ net["inner"][group] + net["inner_shift"][group])
        total += np.log(p[group] / p.sum()) + np.log(q[member] / q.sum()) + within[i]
    return total


def test_pseudo_likelihood_equals_one_word_at_a_time(llm_spark, sf_dir, odd_docs, no_docs):
    docs = llm_spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pseudolm.fit(docs, listed=200, rounds=1, stride=4)
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 12").collect()}
    got = {r.doc_id: r.log_prob for r in pseudolm.pseudo_likelihood(docs.where("doc_id < 12"), model).collect()}
    for i, text in texts.items():
        assert got[i] == pytest.approx(brute_log_prob(model, text), rel=1e-4)
    odd = {r.doc_id: (r.n_tokens, r.log_prob, r.mean_log_prob) for r in pseudolm.pseudo_likelihood(odd_docs, model).collect()}
    assert odd[4] == odd[5] == odd[6] == (0, 0.0, None) and odd[9][0] == 16000 and odd[9][1] < 0
    assert pseudolm.pseudo_likelihood(no_docs, pseudolm.fit(no_docs)).collect() == []


def test_training_beats_word_counts_alone(llm_spark):
    docs = llm_spark.read.parquet(f"{SF}/documents.parquet")
    model = pseudolm.fit(docs)
    counts_alone = model | {"net": {k: v if "shift" in k else np.zeros_like(v) for k, v in pseudolm.start(model["vocab"]).items()}}
    mean = lambda m: pseudolm.pseudo_likelihood(docs, m).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert mean(model) > mean(counts_alone) + 0.1


def test_word_shares_within_classes_sum_to_one(llm_spark, sf_dir):
    docs = llm_spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = pseudolm.word_counts(docs, "text")
    vocab = pseudolm.vocabulary(counts, 500)
    total = np.bincount(vocab["own"], np.exp(vocab["within"]), pseudolm.CLASSES)
    assert np.allclose(total[:pseudolm.OWN], 1)
    assert (total[pseudolm.OWN:] < 1).all()


def test_every_word_scores_with_its_own_count(llm_spark, monkeypatch):
    monkeypatch.setattr(pseudolm, "SHARED", 3)
    rows = [(1, "the cat the cat the cat nation nation station"), (2, "the ration dog"), (2, "the ration dog"),
            (3, None), (4, "nation nation nation ration the")]
    docs = llm_spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = pseudolm.fit(docs)
    model["net"] = {k: np.zeros_like(v) for k, v in model["net"].items()}  # all classes alike
    counts = {}
    for _, text in rows:
        for w in (text or "").split():
            counts[w] = counts.get(w, 0) + 1
    one = lambda text: pa.array([text])
    split = {w: bw.split_words(one(w), lower=True) for w in counts}
    own = {w: pseudolm.encode(x, model["vocab"])[0][0] for w, x in split.items()}
    total = {c: sum(counts[w] for w in counts if own[w] == c) + (c >= pseudolm.OWN) for c in own.values()}
    want = [(i, sum(np.log(counts[w] / total[own[w]] / pseudolm.CLASSES) for w in (text or "").split())) for i, text in rows]
    got = [(r.doc_id, r.log_prob) for r in pseudolm.pseudo_likelihood(docs, model).collect()]
    assert [i for i, _ in sorted(got)] == [i for i, _ in sorted(want)]
    assert np.allclose([x for _, x in sorted(got)], [x for _, x in sorted(want)], rtol=1e-4)
    assert any(c >= pseudolm.OWN for c in own.values())
    assert len({own[w] for w in ("station", "ration")}) == 1 and counts["station"] != counts["ration"]


def test_registered_pseudo_likelihood_equals_plain_words(llm_spark, sf_dir):
    """The query's own path: a trained network and every word's own count, in plain Python over the same classes."""
    docs = llm_spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = pseudolm.fit(docs)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)) for i, text in texts}
    counts = Counter(w for ws in words.values() for w in ws)
    kinds = list(counts)
    own = dict(zip(kinds, pseudolm.encode(bw.split_words(pa.array([" ".join(kinds)]), lower=True), model["vocab"])[0]))
    total = Counter()
    for w, n in counts.items():
        total[own[w]] += n
    net = {k: v.astype(float) for k, v in model["net"].items()}
    got = {r.doc_id: r.log_prob for r in pseudolm.pseudo_likelihood(docs, model).collect()}
    assert got.keys() == words.keys()
    for i in list(words)[:25]:
        ws, want = words[i][:], 0.0
        for at, w in enumerate(ws):
            h = net["bias"].copy()
            for k, shift in enumerate([-3, -2, -1, 1, 2, 3]):
                h += net["embed"][k][own[ws[at + shift]] if 0 <= at + shift < len(ws) else pseudolm.CLASSES]
            h, (group, member) = np.tanh(h), divmod(own[w], pseudolm.GROUP)
            p = np.exp(h @ net["out"] + net["shift"])
            q = np.exp(h @ net["inner"][group] + net["inner_shift"][group])
            unseen = own[w] >= pseudolm.OWN  # such a class holds one unseen word more
            want += np.log(p[group] / p.sum() * q[member] / q.sum() * counts[w] / (total[own[w]] + unseen))
        assert got[i] == pytest.approx(want, rel=1e-4), i


def test_classes_shares_sum_to_one():
    rng = np.random.default_rng(1)
    net = {k: rng.normal(0, 1, v) for k, v in pseudolm._SHAPES.items()}
    around = np.tile(rng.integers(0, pseudolm.CLASSES + 1, (1, 2 * pseudolm.WINDOW)), (pseudolm.CLASSES, 1))
    every = np.arange(pseudolm.CLASSES)
    assert np.exp(pseudolm.log_probs(net, around, rng.permutation(every))).sum() == pytest.approx(1)


def test_every_position_is_a_training_target():
    default = {k: p.default for k, p in inspect.signature(pseudolm.fit).parameters.items()}
    for n in (0, 1, 5, 16, 1000):
        at = [pseudolm.positions(n, r, default["stride"]) for r in range(default["rounds"])]
        assert sorted(np.concatenate(at)) == list(range(n))
