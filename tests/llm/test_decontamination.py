from __future__ import annotations

import random

from hygroflow.llm import decontamination
from tests.llm.test_jaccard_join import grams


def brute(docs, items):
    out = set()
    for d, text in docs:
        mine = grams(text, 5)
        for i, item in items:
            wanted = grams(item, 5)
            if wanted and d is not None and i is not None and 100 * len(wanted & mine) >= 80 * len(wanted):
                out.add((d, i, len(wanted), len(wanted & mine)))
    return out


def test_items_of_all_sizes_inside_long_documents(table):
    rng = random.Random(8)
    word = lambda: f"x{rng.randrange(5000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((5, 9, 20, 45, 90, 300))))) for i in range(40)]
    docs = []
    for d in range(300):
        text = [word() for _ in range(rng.randrange(1, 3000))]
        if d % 3 == 0:
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(0, 2)):
                part[rng.randrange(len(part))] = word()
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    got = decontamination.contaminated(table(docs).repartition(3), table(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)


def test_edge_cases(table, edge_documents, no_documents):
    items = [(1, None), (2, ""), (3, "one two"), (4, "no identifier"), (None, "one two"), (3, "one two"), (5, "repeated row 12345")]
    docs = [(r["doc_id"], r["text"]) for r in edge_documents.select("doc_id", "text").collect()]
    bench = table(items, "item_id long, text string")
    got = decontamination.contaminated(edge_documents, bench)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items))
    assert decontamination.contaminated(no_documents, bench).count() == 0
    assert decontamination.contaminated(edge_documents, bench.limit(0)).count() == 0
