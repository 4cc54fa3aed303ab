"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words, hashed into ``BUCKETS`` buckets.  The
buckets of all documents and of all target texts are counted; a bucket's gain is
the logarithm of how much likelier the target makes it.  A document weighs the
sum of its features' gains, a draw without replacement adds seeded Gumbel noise
to the weights and takes the highest scores of the documents that are long enough.

Texts are handled by the batch: all texts of about a megabyte are joined with a
separator that belongs to no word, one pass of a pattern finds all words, a
binary search in the documents' offsets tells whose they are, runs that cross a
border are masked, and buckets and weights come from bincount.  A text longer
than that is a batch of its own, never cut.

What leaves a task of the counting pass is one row per bucket that occurs; the
sums of both sides (at most ``BUCKETS`` rows each, whatever the input) pass
through the driver, which computes the gains.  The draw ranks rows of a few
numbers by ranges of the score, so no task sees all of them and rows that repeat
one identifier and text are spread like others.

Defined cases: a null or empty text has no feature and weight 0; a null
identifier draws its noise from the empty text in place of the number, comes
last among equal scores and is ranked like any other; repeated rows are rows of
their own; without target texts every bucket gains what the corpus alone says;
an empty table gives no rows.  Extra columns are never read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored, whole
from hygroflow.llm.words import buffers, slices
from hygroflow.operators.ordering import positioned

BUCKETS = 10_000
ORDERS = 1  # longest run of words that is a feature
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents that are long enough
SEED = 2024
#: Lower-case words: digits, letters and everything beyond ASCII.  On bytes, as UTF-8
#: uses no ASCII byte inside another character.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATOR = b"\x00"


def features(texts: pa.Array, orders: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch of texts: first and last index, words per text, and of each feature its text and bucket."""
    data, offsets = buffers(texts)
    for first, last in slices(offsets):
        bounds = offsets[first : last + 1]
        joined = SEPARATOR.join([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).lower()
        begins = bounds[:-1] - bounds[0] + np.arange(last - first)
        found = list(WORD.finditer(joined))
        words = [m[0] for m in found]
        text = np.searchsorted(begins, np.fromiter((m.start() for m in found), np.int64, len(found)), "right") - 1
        hashes, owners, kept = list(map(crc32, words)), [text], []
        kept.append(np.fromiter(hashes, np.int64, len(hashes)))
        for k in range(1, orders):  # the hash of a run goes on from that of the run without its last word
            hashes = [crc32(w, crc32(b" ", h)) for h, w in zip(hashes[:-1], words[k:], strict=False)]
            inside = text[k:] == text[: len(text) - k] if len(text) > k else np.empty(0, bool)
            owners.append(text[k:][inside])
            kept.append(np.fromiter(hashes, np.int64, len(hashes))[inside])
        counts = np.bincount(text, minlength=last - first)
        yield first, last, counts, np.concatenate(owners), np.concatenate(kept) % buckets


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` (text): bucket and how many features of all texts it holds; empty buckets are left out."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch["text"], orders, buckets):
                total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(total[full])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most ``buckets`` rows on the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a natural logarithm by which the target prefers each bucket, rounded down."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_words, n_features, weight."""

    def run(batch: pa.RecordBatch):
        for first, last, words, owners, found in features(batch["text"], orders, len(gain)):
            n = last - first
            weight = np.zeros(n, np.int64)
            np.add.at(weight, owners, gain[found])
            columns = [words, np.bincount(owners, minlength=n), weight]
            ids = batch["doc_id"].slice(first, n)
            yield pa.RecordBatch.from_arrays(
                [ids, *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"]
            )

    kept = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return whole(kept, run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel variate that the seed and the identifier fix."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    seed: int = SEED,
    orders: int = ORDERS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """``docs`` (doc_id, text), ``target`` (text): weight, score and rank of every document.

    ``share`` per cent (rounded down) of the documents with at least
    ``least_words`` words are drawn; the others have no rank.
    """
    gain = gains(*[_array(bucket_counts(t, orders, buckets), buckets) for t in (docs, target)])
    rows = stored(weighted(docs, gain, orders), "weights")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    long_enough = F.col("n_words") >= least_words
    drawn = rows.where(long_enough).count() * share // 100
    order = [(~long_enough).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = positioned(rows, order, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return resampled(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "text"))


#: crc32 by its definition, a byte at a time, over the distinct words.
ORACLE_SQL = r"""
WITH steps AS (
  SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i:
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v
  FROM range(256) t(b)),
crc_table AS (SELECT list(v ORDER BY b) AS v FROM steps),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS k, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, k, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts WHERE text IS NOT NULL),
counted AS (SELECT side, k, w, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM counted GROUP BY w),
bucketed AS (
  SELECT w, xor(list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i:
             ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
           lambda c, y: xor(c // 256, v[1 + xor(c % 256, y)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM vocabulary, crc_table),
buckets AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN (SELECT side, n, bucket FROM counted JOIN bucketed USING (w)) ON bucket = b
  GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)
                                 / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS gain
  FROM buckets),
weights AS (
  SELECT k, sum(n) AS n_features, sum(n * gain) AS weight
  FROM counted JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY k),
scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (k) WHERE side = 'd')
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored)
"""
