from __future__ import annotations

import random
import re

import pytest

from hygroflow.llm import components, jaccard_join, tables, words


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, num, den):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * common >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(
        ((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    originals = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 160))] for _ in range(n // 6)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        text = list(rng.choice(originals[:5] if i % 3 == 0 else originals))
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if i % 4 == 0:
            text += passage
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("k", "num", "long"), [(3, 90, 100), (3, 90, 3), (5, 80, 3), (2, 60, 5)])
def test_against_brute_force(table, monkeypatch, k, num, long):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    rows = near_copies(k * num, 360)
    docs = table(rows).repartition(4)
    assert found(jaccard_join.similar_groups(docs, k, num, 100)) == brute(rows, k, num, 100)


def test_edge_cases(edge_documents):
    rows = [(r["doc_id"], r["text"]) for r in edge_documents.select("doc_id", "text").collect()]
    assert found(jaccard_join.similar_groups(edge_documents)) == brute(rows, 5, 80, 100)


def test_rows_without_or_with_shared_identifiers_cost_no_more(table, monkeypatch):
    """Each class meets its own text alone, whatever its identifier."""
    rows = [(None if i % 2 else 7, t) for i, t in near_copies(4, 300)]
    rows += rows[:20]
    made = []
    monkeypatch.setattr(jaccard_join, "stored", lambda df, label, f=jaccard_join.stored: made.append((label, f(df, label))) or made[-1][1])
    assert found(jaccard_join.similar_groups(table(rows).repartition(3), 3, 90, 100)) == brute(rows, 3, 90, 100)
    for label, df in made:
        if label == "differences":
            assert df.count() == df.select("cid").distinct().count() <= 300


def test_empty(no_documents):
    assert jaccard_join.similar_groups(no_documents).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, i) for i in range(1001, 1400)]
    random.Random(5).shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {(r["u"], r["v"]) for r in got.collect()} == {(i, 0) for i in range(1, 501)} | {(i, 1000) for i in range(1001, 1400)}


def test_hashes_of_long_texts_equal_those_of_their_words(monkeypatch):
    import pyarrow as pa

    texts = ["Some Words  here\tand\nthere", "x" * 5000, "", None, "a b " * 3000]
    whole = [h.tolist() for _, h, b in words.hashed(pa.array(texts)) for h in [h[s:e] for s, e in zip(b[:-1], b[1:], strict=True)]]
    monkeypatch.setattr(words, "SEGMENT", 64)
    cut = [h.tolist() for _, h, b in words.hashed(pa.array(texts)) for h in [h[s:e] for s, e in zip(b[:-1], b[1:], strict=True)]]
    assert whole == cut
    assert [len(x) for x in whole] == [5, 1, 0, 0, 6000]


def test_a_group_of_near_copies_is_not_laid_out_in_pairs(table, monkeypatch):
    """Independent edits of one text, some far from all others, and versions of an edited copy."""
    monkeypatch.setattr(jaccard_join, "LONG", 3)
    rng = random.Random(11)
    original = [f"w{i}" for i in range(150)]
    version = original[:20] + [f"z{i}" for i in range(12)] + original[32:]
    rows = []
    for i in range(260):
        text = list(version if i % 5 == 0 else original)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(text)))
    made = {}

    def counting(df, label, f=jaccard_join.stored):
        df = f(df, label)
        made[label] = made.get(label, 0) + (df.count() if label in ("close-pairs", "met") else 0)
        return df

    monkeypatch.setattr(jaccard_join, "stored", counting)
    want = brute(rows, 3, 90, 100)
    assert len({c for _, _, c in want}) > 20
    assert found(jaccard_join.similar_groups(table(rows).repartition(3), 3, 90, 100)) == want
    assert made["met"] + made["close-pairs"] < 260 * 260 / 8


def test_texts_travel_in_small_batches(spark, table, monkeypatch):
    described, most = jaccard_join._described, tables.BATCH_BYTES

    def watched(rule):
        inner = described(rule)

        def one(batch):
            assert batch.nbytes < 2 * most, "too much at once"
            yield from inner(batch)

        return one

    monkeypatch.setattr(jaccard_join, "_described", watched)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = table([(i, " ".join(f"{i}x{k}" for k in range(4000))) for i in range(600)]).coalesce(1)
    assert jaccard_join.similar_groups(docs, 3, 90).where("component_id = doc_id and n_shingles = 3998").count() == 600
    assert spark.conf.get(name) == before


def test_stored_edges_are_not_written_again(spark, monkeypatch):
    from hygroflow.llm import components as cc

    edges, written = cc.stored(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"), "given"), []
    monkeypatch.setattr(cc, "stored", lambda df, label, f=cc.stored: written.append(label) or f(df, label))
    assert sorted(map(tuple, cc.components(edges).collect())) == [(2, 1), (3, 1), (8, 7)]
    assert written == ["stars"]


def test_dropped_keys_are_dealt_once(spark, table):
    rows, gone = table([(1, "a"), (2, "b"), (2, "c"), (None, "d")]), table([(2, ""), (2, ""), (None, "")])
    left = tables.without(rows, "doc_id", gone)
    assert "keys=[__key" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["text"] for r in left.collect()) == ["a", "d"]
