from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from hygroflow.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for norm, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), i == keep and not kept, sha))
            kept |= i == keep
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_cases(edge_documents):
    rows = [(r["doc_id"], r["text"]) for r in edge_documents.select("doc_id", "text").collect()]
    assert found(exact_dedup.exact_groups(edge_documents)) == brute(rows)


def test_hot_group_over_many_ranges(table, many_ranges):
    rng = random.Random(1)
    rows = [(i, "the same  text") for i in range(0, 3000, 3)]
    rows += [(i, f"text {rng.randrange(900)}") for i in range(1, 3000, 3)]
    rows += [(i, f"other\n{i}") for i in range(2, 3000, 3)]
    rng.shuffle(rows)
    docs = table(rows).repartition(7)
    assert found(exact_dedup.exact_groups(docs)) == brute(rows)
    kept = sorted(r["doc_id"] for r in exact_dedup.kept_documents(docs).collect())
    assert kept == sorted(r[0] for r in brute(rows) if r[3])


def test_kept_rows_have_all_columns(edge_documents):
    kept = exact_dedup.kept_documents(edge_documents)
    assert kept.columns == edge_documents.columns
    assert kept.count() == sum(r[3] for r in brute([(r["doc_id"], r["text"]) for r in edge_documents.collect()]))
    assert sorted(r["doc_id"] for r in kept.where("text LIKE 'repeated%'").collect()) == [9, 10]


def test_empty(no_documents):
    assert exact_dedup.exact_groups(no_documents).count() == 0
    assert exact_dedup.kept_documents(no_documents).columns == no_documents.columns
