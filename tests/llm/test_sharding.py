from __future__ import annotations

import random
import zlib
from collections import defaultdict

from hygroflow.llm import sharding


def held(rows, shards):
    slots, sizes = defaultdict(list), [0] * shards
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_even_sizes_and_whole_groups(table):
    rng = random.Random(6)
    rows = [(i, f"copy {i % 70} " * (1 + i % 70)) for i in range(400)]
    rows += [(400 + i, f"single {i} " * rng.randrange(1, 60)) for i in range(3000)]
    got = sharding.sharded(table(rows).repartition(4), 8).collect()
    sizes = held(got, 8)
    assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8
    text = dict(rows)
    shards = defaultdict(set)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        shards[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 2


def test_a_group_larger_than_a_shard_is_split(table):
    rows = [(i, "the same text again and again") for i in range(2000)] + [(2000 + i, f"text number {i}") for i in range(3000)]
    sizes = held(sharding.sharded(table(rows), 8).collect(), 8)
    assert max(sizes) - min(sizes) < 0.15 * sum(sizes) / 8


def test_flows_keep_quotas():
    share = sharding.flows({(0, 1): 50.0, (1, 2): 10.0, (2, 1): 30.0}, [100.0, 100.0, 100.0], 110.0)
    into = 50 * share[0, 1] + 30 * share[2, 1] - 10 * share[1, 2]
    assert 100 + into <= 110.2


def test_filling_covers_every_rank():
    plan = sharding.filled([(1, 1000, 10.0), (2, 7, 300.0), (3, 1, 5.0)], [0.0, 500.0, 20.0])
    for name, count in ((1, 1000), (2, 7), (3, 1)):
        ranks = sorted(r for c, a, b, _ in plan if c == name for r in range(a, b))
        assert ranks == list(range(count))


def test_edge_cases(edge_documents, no_documents):
    got = sharding.sharded(edge_documents).collect()
    assert len(got) == edge_documents.count()
    held(got, 40)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {16}
    assert sharding.sharded(no_documents).count() == 0
