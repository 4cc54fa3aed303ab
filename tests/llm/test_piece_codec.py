"""The prefix table against merging by definition and against the public library."""

from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from hygroflow.llm import piece_codec


@pytest.fixture(scope="module")
def ours():
    return piece_codec.codec(piece_codec.model_file())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_file())


def random_texts(n, seed=5):
    rng = random.Random(seed)
    signs = "  ▁abtheinTing.,\n\té東😀0\x00ﬁ²́﻿\r<s>"
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_equal_the_library(ours, library):
    texts = random_texts(3000) + ["", " ", "   leading", "trailing  ", " " * 5000, "ab" * 3000, "<s></s><0x41>", "a▁b"]
    assert [ours.encode(t).tolist() for t in texts] == [library.encode(t, add_eos=True) for t in texts]


def test_every_prefix_has_the_last_token_of_merging(ours):
    for text in ["▁the▁thing,", "▁▁▁▁▁x▁▁", "▁東é\x00ing"]:
        last = ours.last_tokens(text)
        for n in range(1, len(text) + 1):
            assert (last[n] or text[n - 1]) == ours._merged(text[:n])[-1]


def test_texts_of_ids_equal_the_library(ours, library):
    rng = random.Random(6)
    kinds = [lambda: rng.randrange(3), lambda: rng.randrange(3, 259), lambda: rng.randrange(259, 32000), lambda: 28705]
    for _ in range(5000):
        ids = [rng.choice(kinds)() for _ in range(rng.randrange(10))]
        assert ours.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_whole_table_and_round_trip(edge_documents, no_documents, library):
    file = piece_codec.model_file()
    rows = piece_codec.decoded(piece_codec.encoded(edge_documents, file), file).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in edge_documents.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["doc_id"], r["text"]) for r in rows], key=key) == sorted(texts, key=key)
    want = {t: library.encode(t, add_eos=True) for _, t in texts}
    assert all(list(r["ids"]) == want[r["text"]] for r in rows)
    assert piece_codec.encoded(no_documents, file).count() == 0


def test_output_batches_are_bounded(table, monkeypatch, ours):
    monkeypatch.setattr(piece_codec, "BATCH_IDS", 10)
    rows = [(i, "one two three four " * (i % 5)) for i in range(40)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    parts = list(piece_codec._encode(piece_codec.model_file())(batch))
    assert len(parts) > 10 and [i for p in parts for i in p["doc_id"].to_pylist()] == list(range(40))
    assert [i for p in parts for i in p["ids"].to_pylist()] == [ours.encode(t).tolist() for _, t in rows]
