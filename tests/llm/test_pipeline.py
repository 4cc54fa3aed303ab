"""The pipeline against its stages' brute-force versions, on a small table of its own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_jaccard_join import brute as near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: f"u{rng.randrange(3000)}"
    where = str(tmp_path_factory.mktemp("pipeline"))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(10)]
    docs, labels = [], []
    for i in range(600):
        text = [word() for _ in range(rng.randrange(1, 150))]
        if i % 7 == 0:
            text.insert(rng.randrange(len(text)), "vileword")
        if i % 11 == 0:
            text += items[i % 10][1].split()
        if i > 300 and i % 5 == 0:
            text = docs[i - 300][1].split()
            if i % 2:
                text[rng.randrange(len(text))] = word()
        docs.append((i, " ".join(text), "en", f"s{i % 3}", len(text)))
        labels.append((i, 0, int("vileword" in text)))
    docs += [(700, None, None, None, None), (701, "", "en", "s", 0), (700, None, None, None, None)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (items, "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return where, items


def test_stages_keep_what_they_should(spark, folder):
    where, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    toxic, exact, group, clean, packed = (f for _, f in corpus_pipeline.STAGES)

    docs = toxic(spark, docs, where).cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns
    assert not any("vileword" in (t or "") for _, t in rows) and len(rows) > 450

    docs = exact(spark, docs, where).cache()
    kept = sorted(r[0] for r in copies(rows) if r[3])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(d for d, _ in rows) == kept

    docs = group(spark, docs, where).cache()
    kept = sorted(d for d, _, c in near(rows, 5, 80, 100) if d == c)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert docs.columns == columns and sorted(d for d, _ in rows) == kept

    docs = clean(spark, docs, where).cache()
    dirty = {d for d, *_ in leaks(rows, items)}
    assert dirty and docs.columns == columns
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(d for d, _ in rows if d not in dirty)

    pieces = packed(spark, docs, where).collect()
    whole = corpus_pipeline.run(spark, where).collect()
    assert {(p["doc_id"], p["doc_tokens"]) for p in pieces} == {(p["doc_id"], p["doc_tokens"]) for p in whole}
    assert sum(p["length"] for p in pieces) == sum(p["length"] for p in whole)


def test_empty_tables(spark, folder, tmp_path):
    where, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_odd_rows_pass_through(spark, folder, edge_documents):
    where, _ = folder
    docs, columns = edge_documents.withColumn("__row", F.lit("own")), [*edge_documents.columns, "__row"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == columns
    rows = docs.collect()
    assert all(r["__row"] == "own" and r["row"] == 0 for r in rows)
    # one of null and blank, "one", one of "one two" and its form in other case, one of the long texts, and the single ones
    assert sorted((r["text"] or "").split()[:1] for r in rows if r["doc_id"] in (4, 9, 10, 11)) == [["one"], ["repeated"], ["repeated"], ["émigré"]]
    assert len([r for r in rows if r["doc_id"] == 10]) == 1


def test_rows_without_or_with_a_shared_identifier_are_judged_by_their_text(spark, folder):
    where, items = folder
    text = lambda tag, n=60: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, text("a")), (None, text("a") + " tail"), (1, text("b")), (2, text("c")), (1, text("c") + " tail")]
    rows += [(None, text("d")), (None, text("d") + " tail"), (3, text("e") + " " + items[0][1]), (3, text("f"))]
    rows += [(None, text("g") + " " + items[1][1]), (None, text("h"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = corpus_pipeline.near_duplicate_filter(spark, docs, where)
    docs = corpus_pipeline.decontamination_filter(spark, docs, where)
    got = sorted(((r["text"].split()[0], r["doc_id"]) for r in docs.collect()), key=repr)
    assert docs.columns == ["doc_id", "text"]
    assert got == [("a0", 1), ("b0", 1), ("c0", 1), ("d0", None), ("f0", 3), ("h0", None)]


def test_stages_read_and_send_texts_in_small_batches(spark, folder):
    where, _ = folder
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before, seen = {n: spark.conf.get(n) for n in names}, []

    def watched(spark, rows, sf_dir):
        seen.extend(int(spark.conf.get(n)) for n in names)
        return rows.limit(0)

    try:
        for n in names:
            spark.conf.unset(n)
        docs = spark.read.parquet(f"{where}/documents.parquet")
        assert corpus_pipeline.filtering(watched)(spark, docs, where).count() == docs.count()
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
    assert seen[0] <= 4 << 20 and seen[1] <= 512
