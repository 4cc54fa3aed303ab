"""The trie against a version that compares whole sequences."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from hygroflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int, base string"


def brute(rows, family=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = crc32(str(c).encode()) % most, c - int(np.fmod(c, family))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        has_child = {n[:-1] for n in members if n}
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append(
            (
                min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                sum(len(n) == len(node) + 1 for n in under),
                sum(n not in has_child for n in under),
                sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in under if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if c % 11 == 3:
            continue
        for k in range(rng.choice((1, 2, 3, 5, 12))):
            role = rng.choice(("user", None)) if k % 2 == 0 else "assistant"
            rows.append((c, None if k == 0 and c % 4 == 0 else k, role, rng.choice(("é", "yes", "no", "", None)) if k > 1 else "hello"))
    rows += [(None, 1, "user", "nobody's"), (2000, 5, None, None), (2004, 1, "user", "x"), (2004, 1, "user", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("least", "shard", "chunk"), [(256, 20_000, 4096), (3, 7, 2), (1, 1, 1)])
def test_equals_brute_force(table, monkeypatch, many_ranges, least, shard, chunk):
    for name, value in (("LEAST", least), ("SHARD", shard), ("CHUNK", chunk)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = conversations(60, 8)
    df = table([(*r, "extra", 1, "extra") for r in rows], SCHEMA)
    got = prefix_trie.trie(prefix_trie.paths(df)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_as_they_are(table):
    rows = conversations(20, 9)
    df = table([(*r, "", 1, "") for r in rows], SCHEMA)
    got = prefix_trie.trie(prefix_trie.paths(df, family=1)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, family=1)


def test_long_conversations_and_hot_first_turns(table):
    rows = [(10 * c, k, "user", f"turn {k}") for c in range(3) for k in range(3000)]
    rows += [(1000 + 10 * c, 0, "user", "turn 0") for c in range(600)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(prefix_trie.paths(table(rows, "conv_id long, turn long, role string, text string"))).collect()}
    root = got[0, 0]
    assert root["n_convs"] == 603 and root["n_leaves"] == 1 and got[0, 1]["n_children"] == 1
    assert got[0, 3000]["n_convs"] == 3 and len(got) == 3001
    assert root["saved_tokens"] == 602 * 6 + sum(2 * len(f"turn {k}") for k in range(1, 3000))
    ends = ",".join(str(1000 + 10 * c) for c in range(600))
    assert got[0, 1]["ends_sha256"] == hashlib.sha256(ends.encode()).hexdigest()


def test_empty(table):
    assert prefix_trie.trie(prefix_trie.paths(table([], SCHEMA))).collect() == []


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    k = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    slots = prefix_trie.Slots(*k)
    assert sorted(slots(*k).tolist()) == list(range(5000))
    assert (slots(k[0], k[1] + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.Slots(np.array([1, 1]), np.array([2, 2]))
