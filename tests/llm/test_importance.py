"""Importance resampling against a version that reads the definition word by word."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from hygroflow.llm import importance


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, orders, buckets):
    words = words_of(text)
    runs = [words[i : i + k] for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
    return [crc32(" ".join(r).encode()) % buckets for r in runs]


def brute(docs, target, orders, buckets, share, least, seed):
    s = Counter(b for _, t in docs for b in buckets_of(t, orders, buckets))
    t = Counter(b for x in target for b in buckets_of(x, orders, buckets))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for doc_id, text in docs:
        found = buckets_of(text, orders, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    long = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long[: share * len(long) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "émigré", "x1", "TOKEN", "a", "東京", "Ünder", "seven", "re-use", "o'clock"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) + rng.choice((".", "\n", "")) for _ in range(n)]


@pytest.mark.parametrize("orders", [1, 3])
def test_equals_brute_force(table, monkeypatch, orders):
    monkeypatch.setattr("hygroflow.llm.words.SEGMENT", 300)  # many batches, some of one long text
    docs = [(i, t) for i, t in enumerate(texts(300, 1))] + [(5, None), (None, "the " * 30), (7, "")]
    target = texts(20, 2) + [None]
    got = importance.resampled(table(docs), table([(t,) for t in target], "text string"), 25, 9, orders, 50, 10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, orders, 50, 25, 10, 9)


def test_runs_stay_inside_documents(table):
    rows = importance.weighted(table([(1, "a b"), (2, "c"), (3, ""), (4, "d e f")]), importance.gains(*[importance.np.zeros(9, int)] * 2), 2)
    assert [(r["doc_id"], r["n_words"], r["n_features"]) for r in rows.collect()] == [(1, 2, 3), (2, 1, 1), (3, 0, 0), (4, 3, 5)]


def test_edge_cases(edge_documents, no_documents, table):
    target = table([("one two",)], "text string")
    rows = importance.resampled(edge_documents, target).collect()
    assert len(rows) == edge_documents.count() and all(r["weight"] == 0 for r in rows if not r["n_features"])
    assert importance.resampled(no_documents, target).collect() == []
    assert len(importance.resampled(edge_documents, target.where("text = ''")).collect()) == len(rows)


def test_repeated_rows_are_ranked_one_by_one(table):
    docs = table([(1, "w " * 30)] * 50)
    rows = importance.resampled(docs, table([("w",)], "text string"), share=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 26))
