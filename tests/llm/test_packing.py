from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from hygroflow.llm import packing, tables

ODD = [
    "it's 'start' ,'s we'LL DON'T İstanbul ΣΑΣ é a\x1cb <|endoftext|> x<|endoftext|>y ² ½ ª 東京 \u200b …–x",
    "naïve ß ÀÉ 12345 a1b2 --''re", "\u0301abc \u0301", "A\u0300B", "", "  ", "word " * 5000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_file())


def check(rows, pieces, tokenizer):
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for _, t in rows]
    expected = {d: np.array(i, "<u4") for (d, _), i in zip(rows, ids, strict=True)}
    seen = {d: 0 for d, _ in rows}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = expected[p["doc_id"]]
        assert p["start"] == seen[p["doc_id"]] and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        assert p["doc_tokens"] == len(own)
        seen[p["doc_id"]] += p["length"]
    assert seen == {d: len(own) for d, own in expected.items()}
    at = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == at.get(p["sequence_id"], 0)
        at[p["sequence_id"]] = p["offset"] + p["length"]
    # every sequence is full or a power of two: nothing is padded
    assert all(n == packing.LENGTH or (n < packing.LENGTH and n & (n - 1) == 0) for n in at.values())


def test_every_id_in_one_piece(table, tokenizer):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None)]
    rows += [(100 + i, " ".join(rng.choice(("the", "of", "Blend,", "x1")) for _ in range(rng.randrange(900)))) for i in range(200)]
    check(rows, packing.packed(table(rows).repartition(3), packing.tokenizer_file()).collect(), tokenizer)


def test_costs_are_balanced():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 400) for _ in range(1000)]
    pieces, sizes = packing.placed(lengths, 2048)
    cost = [0.0] * len(sizes)
    for _, _, length, q in pieces:
        cost[q] += packing.LINEAR * length + packing.QUADRATIC * length * length
    full = [c for c, n in zip(cost, sizes, strict=True) if n == 2048]
    assert max(full) < 1.15 * min(full)
    assert sum(n for _, _, n, _ in pieces) == sum(sizes) == sum(lengths)


def test_edge_cases(edge_documents, no_documents):
    pieces = packing.packed(edge_documents, packing.tokenizer_file()).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 10) == 2 * pieces[[p["doc_id"] for p in pieces].index(10)]["doc_tokens"]
    assert packing.packed(no_documents, packing.tokenizer_file()).count() == 0


def test_faster_splitting_keeps_the_rule():
    rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choices("abst'' 12.<|\té-—\x01", k=rng.randint(0, 12)))
        assert packing._odd(text) == bool(packing._ODD.search(text))
        assert packing._PIECE.findall(text) == rule.findall(text)


def test_ids_of_a_piece_do_not_depend_on_its_spelling_path():
    whole = Tokenizer.from_file(packing.tokenizer_file())
    ids = packing.WordIds(packing.tokenizer_file())
    for text in ("", "It's 42 well-known (~) words!", "naïve café — don't", "a\x01b <|x|>"):
        assert np.frombuffer(ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_another_operators_step_drops_what_packing_kept():
    class Rows:
        def mapInArrow(self, run, schema):
            return list(run(iter([])))

    first = packing.word_ids(packing.tokenizer_file())
    assert packing.word_ids(packing.tokenizer_file()) is first
    assert tables.whole(Rows(), None, "") == []
    assert packing.word_ids(packing.tokenizer_file()) is not first
