"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated.

Words and word stems that speak for the label are learned from one part of the
labelled rows (a lexicon of log odds).  Each text becomes a row of dense
features: densities and maxima of the lexicon's weights for words, stems and
words with look-alike signs read as letters, hits near a second-person word,
rates of capitals, punctuation and obfuscation.  Trees are fitted on a second
part of the labelled rows and an isotonic curve on a third.  Fitting uses a
sample bounded by ``MOST_TOXIC`` and ``MOST_OTHER`` distinct texts, each weighted by
the inverse rate at which its class was drawn, so that 0.5 means the same at
every size; scoring covers all rows, and language, source, labels and identifiers never enter a feature.

Defined cases: null texts are empty, and empty texts are scored like others;
a document labelled twice counts as toxic if one label says so; null labels are
not learned from; without both labels among the rows to learn from, every score
is the share of toxic rows (0 without any); empty tables give no rows; repeated
rows get equal scores; a null identifier counts as an empty name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm import tables
from hygroflow.llm import words as wd
from hygroflow.llm.tables import stored

#: Labelled texts to learn from (expected number), by label.
MOST_TOXIC, MOST_OTHER = 10_000, 20_000
HELD_OUT = (5, 0)
#: Shares of those rows for the lexicon and for the trees; the rest calibrates.
LEXICON_SHARE, TREE_SHARE = 0.5, 0.3
#: Entries of the lexicon at most, texts an entry must occur in, and its least log odds.
MOST_ENTRIES, LEAST_TEXTS, LEAST_ODDS = 4000, 4, 1.5
#: Entries that occur in toxic texts and are counted in the others, at most.
MOST_CANDIDATES = 200_000
#: Bytes of a stem.
STEMS = (4, 5, 6)
TREES, DEPTH = 20, 4
#: Words between a hit and a second-person word.
NEAR = 4
#: Bytes of text whose features are made at once.  Weights are summed over all of it, so its size shows in last digits.
SLICE = 1 << 20

#: Signs that stand for letters, and second-person words.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre ti tú usted tuyo"
).split()

FEATURES = (
    "words word_max word_sum word_density stem_max stem_sum stem_density alike_max alike_sum alike_density"
    " hits hits_near second_person capitals capital_words exclamations questions marks signs digits_inside"
    " stars_inside single_letters tripled"
).split()


def held_out(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % HELD_OUT[0] == HELD_OUT[1]


def entries(data: np.ndarray, firsts: np.ndarray):
    """(run bounds, per kind of entry the hashes of all runs): words and stems."""
    runs = wd.Runs(data, firsts)
    return runs, [runs.hashes(), *[runs.hashes(k) for k in STEMS]]


def _slices(texts: pa.Array):
    data, offsets = wd.buffers(texts)
    for at, stop in wd.slices(offsets, SLICE):
        yield at, stop, data[offsets[at] : offsets[stop]], offsets[at:stop] - offsets[at]


def _text_counts(batch: pa.RecordBatch, known: np.ndarray | None):
    """In how many texts of a batch each entry (of the known ones) occurs."""
    found = []
    for _, _, data, firsts in _slices(batch["text"]):
        runs, kinds = entries(data, firsts)
        every = np.stack(kinds, 1)
        for a, b in zip(runs.bounds[:-1], runs.bounds[1:], strict=True):
            mine = wd.distinct(every[a:b].ravel())
            if known is not None and len(mine):
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                mine = mine[known[at] == mine]
            found.append(mine)
    values, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64),) * 2
    real = values != 0
    return pa.RecordBatch.from_pydict(
        {"entry": pa.array(values[real].view(np.int64)), "texts": pa.array(counts[real].astype(np.int64))}
    )


def _counted(rows: DataFrame, known=None) -> DataFrame:
    def one(batch):
        yield _text_counts(batch, known.value if known is not None else None)

    return tables.whole(rows, one, "entry long, texts long").groupBy("entry").agg(F.sum("texts").alias("texts"))


def learned_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log odds of the entries that speak for the label; ``rows``: text, toxic."""
    toxic, other = rows.where("toxic = 1").select("text"), rows.where("toxic = 0").select("text")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_other = n.get(1, 0), n.get(0, 0)
    often = _counted(toxic).where(F.col("texts") >= LEAST_TEXTS)
    often = often.orderBy(F.desc("texts"), "entry").limit(MOST_CANDIDATES).toPandas()
    often = often.sort_values("entry", key=lambda c: c.to_numpy().view(np.uint64))
    known = often["entry"].to_numpy(np.int64).view(np.uint64)
    if not len(known):
        return known, np.empty(0)
    shared = rows.sparkSession.sparkContext.broadcast(known)
    rest = _counted(other, shared).toPandas()
    counts = np.zeros(len(known))
    counts[np.searchsorted(known, rest["entry"].to_numpy(np.int64).view(np.uint64))] = rest["texts"].to_numpy()
    with_label = (often["texts"].to_numpy() + 0.5) / (n_toxic + 1)
    odds = np.log(with_label / ((counts + 0.5) / (n_other + 1)))
    # the surest entries: frequent ones with few occurrences elsewhere
    surest = np.argsort(-odds * np.sqrt(with_label), kind="stable")
    surest = surest[odds[surest] >= LEAST_ODDS][:MOST_ENTRIES]
    surest.sort()
    return known[surest], odds[surest]


def _weights(h: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, odds = lexicon
    if not len(known) or not len(h):
        return np.zeros(len(h))
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, odds[at], 0.0)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _maxima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(bounds) - 1), np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.maximum.reduceat(values, bounds[:-1][some])
    return out


def _counts(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Set flags of every stretch, without a running sum of eight bytes a flag."""
    out, some = np.zeros(len(bounds) - 1), np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(flags, bounds[:-1][some], dtype=np.int64)
    return out


_YOU = None


def _second_person() -> np.ndarray:
    global _YOU
    if _YOU is None:
        words = "".join(SECOND_PERSON).encode()
        firsts = np.cumsum([0] + [len(w.encode()) for w in SECOND_PERSON])[:-1]
        _YOU = np.sort(wd.Runs(np.frombuffer(words, np.uint8), firsts).hashes())
    return _YOU


def features(data: np.ndarray, firsts: np.ndarray, lexicon) -> np.ndarray:
    """Dense features of the texts of a buffer, one row per text."""
    runs, (word, *stems) = entries(data, firsts)
    bounds, bytes_at = runs.bounds, np.append(firsts, len(data))
    runs.sums = None  # all hashes are made, and the next runs need as much
    words = np.diff(bounds).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(np.diff(bytes_at), 1)
    by_word = _weights(word, lexicon)
    by_stem = np.maximum.reduce([_weights(s, lexicon) for s in stems])
    alike = wd.Runs(data, firsts, LOOKALIKE)
    by_alike = _weights(alike.hashes(), lexicon)
    alike.sums = None
    alike_words = np.maximum(np.diff(alike.bounds), 1)
    hit = (by_word > 0) | (by_stem > 0)
    you = np.isin(word, _second_person())
    text = np.repeat(np.arange(len(words)), np.diff(bounds))
    near = np.zeros(len(word), bool)
    for d in range(1, NEAR + 1):
        same = text[d:] == text[:-d]
        near[d:] |= you[:-d] & same
        near[:-d] |= you[d:] & same
    is_byte = np.zeros((8, 256), bool)
    is_byte[0, 65:91] = True
    is_byte[1, ord("!")] = is_byte[2, ord("?")] = True
    is_byte[3, [ord(c) for c in ".,;:'\"-()"]] = True
    is_byte[4, [ord(c) for c in "%&$*#@^~|<>=+_"]] = True
    is_byte[5, 48:58] = True
    is_byte[6, [ord(c) for c in "*#$@%"]] = True
    is_byte[7, 65:91] = is_byte[7, 97:123] = is_byte[7, 128:] = True
    kinds = is_byte[:, data]
    inside = np.zeros(len(data), bool)  # between two letters
    inside[1:-1] = kinds[7, :-2] & kinds[7, 2:]
    tripled = np.zeros(len(data), bool)
    tripled[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & kinds[7, 2:]
    capitals = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kinds[0], out=capitals[1:])
    length = runs.ends - runs.starts
    shouted = (capitals[runs.ends] - capitals[runs.starts] == length) & (length > 1)
    rate = lambda flags: _counts(flags, bytes_at) / per_byte
    return np.stack(
        [
            np.log1p(words), _maxima(by_word, bounds), _sums(by_word, bounds), _sums(by_word, bounds) / per_word,
            _maxima(by_stem, bounds), _sums(by_stem, bounds), _sums(by_stem, bounds) / per_word,
            _maxima(by_alike, alike.bounds), _sums(by_alike, alike.bounds), _sums(by_alike, alike.bounds) / alike_words,
            _sums(hit, bounds), _sums(hit & near, bounds), _sums(you, bounds) / per_word,
            rate(kinds[0]), _sums(shouted, bounds) / per_word, rate(kinds[1]), rate(kinds[2]), rate(kinds[3]),
            rate(kinds[4]), rate(kinds[5] & inside), rate(kinds[6] & inside), _sums(length == 1, bounds) / per_word,
            rate(tripled),
        ], 1,
    )


def _with_features(rows: DataFrame, carried: str, lexicon) -> DataFrame:
    """``carried`` column and the features of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def one(batch: pa.RecordBatch):
        parts = [features(data, firsts, shared.value) for _, _, data, firsts in _slices(batch["text"])]
        columns = np.concatenate(parts).T
        yield pa.RecordBatch.from_arrays(
            [batch[carried], *[pa.array(np.ascontiguousarray(c)) for c in columns]], [carried, *FEATURES]
        )

    kind = dict(rows.dtypes)[carried]
    schema = ", ".join([f"{carried} {kind}", *[f"{f} double" for f in FEATURES]])
    return tables.whole(rows.select(carried, "text"), one, schema)


def _draw(seed: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)


class Scorer:
    """Lexicon, trees and calibration learned from labelled documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
        # texts are drawn, not rows, so that each text of a class comes in at the same rate however many copies it has
        keyed = docs.select("doc_id", "text_key").join(known, "doc_id").groupBy("text_key")
        keyed = stored(keyed.agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "labelled-keys")
        texts = {r["toxic"]: r["count"] for r in keyed.groupBy("toxic").count().collect()}
        rate = F.when(F.col("toxic") == 1, min(1.0, MOST_TOXIC / max(1, texts.get(1, 0)))).otherwise(
            min(1.0, MOST_OTHER / max(1, texts.get(0, 0)))
        )
        # a text stands for 1 / rate texts of its class, so odds are those of all labelled texts at every size
        sample = keyed.where(_draw("sample") < rate).withColumn("weight", 1 / rate).withColumn("part", _draw("part"))
        # a label table of MOST_TOXIC + MOST_OTHER rows at most, so it may be broadcast
        rows = docs.join(F.broadcast(sample), ["doc_id", "text_key"]).dropDuplicates(["text"])
        rows = stored(rows.select("text", F.col("toxic").cast("int").alias("toxic"), "part", "weight"), "labelled")
        lexicon_rows = rows.where(F.col("part") < LEXICON_SHARE)
        self.lexicon = learned_lexicon(lexicon_rows)
        packed = rows.where(F.col("part") >= LEXICON_SHARE).select("text", F.struct("toxic", "part", "weight").alias("carried"))
        fit = _with_features(packed, "carried", self.lexicon).select("carried.*", *FEATURES)
        label = F.col("toxic").cast("double").alias("label")
        fit = stored(self._vector(fit).select("part", "weight", label, "vector"), "features")
        self.trees = self.curve = None
        grows = F.col("part") < LEXICON_SHARE + TREE_SHARE
        # one job for both parts: each job, however small, takes its share of the driver's memory
        of_part = fit.groupBy(grows.alias("grows")).agg(F.min("label"), F.max("label")).collect()
        both = {r["grows"] for r in of_part if r["min(label)"] != r["max(label)"]}
        if True not in both:
            counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
            self.share = counts.get(1, 0) / max(1, sum(counts.values()))
            return
        for_trees = fit.where(grows).coalesce(4)
        trees = GBTClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=17,
            maxMemoryInMB=64,
        )
        self.trees = trees.fit(for_trees)
        if False in both:
            rest = self._raw(fit.where(~grows)).select("raw", "label", "weight").coalesce(4)
            curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="score")
            self.curve = curve.fit(rest)

    @staticmethod
    def _vector(rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)

    def _raw(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    def scored(self, rows: DataFrame, carried: str) -> DataFrame:
        """``carried`` column and the score of each row's ``text``."""
        if self.trees is None:
            return rows.select(carried, F.lit(float(self.share)).alias("score"))
        made = self._raw(self._vector(_with_features(rows, carried, self.lexicon)))
        if self.curve is None:
            return made.select(carried, F.col("raw").alias("score"))
        return self.curve.transform(made.select(carried, "raw")).select(carried, "score")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic): doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    return Scorer(docs, labels).scored(docs, "doc_id").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    scorer = Scorer(docs.select("doc_id", "text"), labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return scorer.scored(rows, "row").where("score < 0.5").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    labels = tables.read(spark, folder, "labels", "doc_id", "toxic")
    return scores(tables.read(spark, folder, "documents", "doc_id", "text"), labels)
