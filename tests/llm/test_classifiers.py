from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hygroflow.llm import language_id, toxicity

RNG = random.Random(12)
SYLLABLES = {
    "aa": ["tha", "ing", "ou", "er", "st"], "bb": ["zu", "sch", "ä", "keit", "un"], "cc": ["ción", "que", "ll", "os", "ña"],
}


def sentence(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = [], []
    for i in range(1500):
        lang = RNG.choice(list(SYLLABLES))
        text = sentence(lang, RNG.randrange(5, 200)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                text.insert(RNG.randrange(len(text)), RNG.choice(["blorp", "gromf", "zwick" + RNG.choice(["a", "en", "ung"])]))
        docs.append((i, " ".join(text), lang if i % 10 else None))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs += [(5000, None, "aa"), (5001, "", None), (5002, "123 !?", "bb"), (5002, "123 !?", "bb"), (None, "tha ing", None)]
    labels += [(5000, 0), (5001, None), (None, 1), (0, 1), (7000, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, lang string, label int, vector int")
    return df.repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int"), docs


def test_languages_held_out(labelled):
    docs, _, rows = labelled
    got = language_id.predicted(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    tried = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1500 and truth[r["doc_id"]][2]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][2] for r in tried]) > 0.97
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (5000, 5001, 5002)} == {("und", 0.0)}


def test_sample_is_exact_per_language(spark, monkeypatch):
    """Null and repeated identifiers, copies, and more languages than fit the common bound."""
    rows = [(None, f"text {i}", "aa") for i in range(300)] + [(7, f"words {i}", "bb") for i in range(300)]
    rows += [(i, "one copy", "cc") for i in range(5)] + [(9, "same row", "dd")] * 500 + [(9, f"other {i}", "dd") for i in range(60)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(language_id, "TRAINING_TEXTS", 8)
    got = [tuple(r) for r in language_id.sampled(known).collect()]
    count = lambda lang: sum(g[0] == lang for g in got)
    assert [count(x) for x in ("aa", "bb", "cc", "dd")] == [8, 8, 5, 8]
    assert got.count(("dd", "same row")) <= 1
    assert sorted(got) == sorted(tuple(r) for r in language_id.sampled(known.repartition(3)).collect())
    many = spark.createDataFrame([(i, f"t {i}", f"l{i % 150}") for i in range(900)], "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "ALL_TEXTS", 300)
    got = language_id.sampled(many).groupBy("lang").count().collect()
    assert len(got) == 150 and {r["count"] for r in got} == {2}


def test_table_rows_equal_the_network():
    net = language_id.Network(["a", "b"])
    rows, sizes = language_id.windows(np.frombuffer(("some text " * 60).encode(), np.uint8))
    assert len(rows) == 3 and sizes.tolist() == [256, 256, 88]
    np.testing.assert_allclose(language_id.Tables(net).logits(rows), net.logits(rows), atol=1e-4)


def test_gradients_match_differences():
    net = language_id.Network(["a", "b", "c"])
    rng = np.random.default_rng(1)
    rows, labels = rng.integers(0, 256, (6, language_id.LENGTH)).astype(np.uint8), rng.integers(0, 3, 6)
    loss = lambda: -np.log(language_id.softmax(net.logits(rows).astype(float))[np.arange(6), labels]).mean()
    found = net.gradients(rows, labels)
    for name, at in (("out", (3, 1)), ("conv3", (5, 2)), ("bias2", (4,)), ("embed", (int(rows[0, 9]), 1))):
        before, h = net.weights[name][at], 1e-2
        net.weights[name][at] = before + h
        up = loss()
        net.weights[name][at] = before - h
        down = loss()
        net.weights[name][at] = before
        assert abs((up - down) / (2 * h) - found[name][at]) < 5e-3, name


def test_no_labelled_text(spark, no_documents):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.predicted(docs).collect()[0]["lang_pred"] == "und"
    assert language_id.predicted(no_documents).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scores(docs, labels).collect()] == [0.0]
    assert toxicity.scores(no_documents, labels).count() == 0


def test_toxic_documents_held_out(labelled):
    docs, labels, rows = labelled
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    tried = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1500 and (r["held_out"] or r["doc_id"] % 2)]
    wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in tried)
    assert wrong <= 0.02 * len(tried), wrong
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 - r["predicted"] for r in got)


def test_features_see_what_they_name():
    text = b"YOU are a blorp!!! h3y bl0rp x y z soooo %%%"
    hashes = toxicity.entries(np.frombuffer(b"blorp", np.uint8), np.zeros(1, np.int64))[1][0]
    row = toxicity.features(np.frombuffer(text, np.uint8), np.zeros(1, np.int64), (hashes, np.array([3.0])))[0]
    f = dict(zip(toxicity.FEATURES, row, strict=True))
    assert f["word_max"] == 3 and f["alike_sum"] == 6 and f["hits"] == f["hits_near"] == 1
    assert f["capital_words"] > 0 and f["exclamations"] > 0 and f["digits_inside"] > 0 and f["tripled"] > 0


def test_features_of_a_batch_take_little_memory():
    texts = pa.array([sentence("aa", 500) for _ in range(1500)])
    assert texts.nbytes > 3 << 20
    lexicon = (np.empty(0, np.uint64), np.empty(0))
    tracemalloc.start()
    rows = sum(len(toxicity.features(data, firsts, lexicon)) for _, _, data, firsts in toxicity._slices(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and most < 70 << 20


def test_scores_do_not_depend_on_the_rates_of_the_sample(spark, monkeypatch):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(3000):
        text = sentence("aa", rng.randrange(10, 40)).split()
        doubtful = i % 5 == 0
        if doubtful:
            text.insert(rng.randrange(len(text)), "gromf")
        docs.append((i, " ".join(text)))
        labels.append((i, int(rng.random() < (0.3 if doubtful else 0.01))))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "MOST_OTHER", 400)
    got = [r for r in toxicity.scores(docs, labels).collect() if r["doc_id"] % 5 == 0]
    assert np.mean([r["score"] for r in got]) < 0.45
    assert np.mean([r["predicted"] for r in got]) < 0.1


def test_fitting_asks_for_few_results(labelled, monkeypatch):
    docs, labels, _ = labelled
    asked, frame = [], type(docs)
    for name in ("collect", "count", "first", "toPandas"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name), n=name: asked.append(n) or f(self, *a))
    scorer = toxicity.Scorer(docs, labels)
    assert scorer.trees is not None and scorer.curve is not None
    assert len(asked) <= 5


def test_share_without_trees(spark):
    docs = spark.createDataFrame([(i, f"tha ing {i}") for i in range(40)], "doc_id long, text string")
    for label in (0, 1):
        labels = spark.createDataFrame([(i, label) for i in range(40)], "doc_id long, toxic int")
        assert {r["score"] for r in toxicity.scores(docs, labels).collect()} == {float(label)}
