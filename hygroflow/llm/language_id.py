"""Language of whole texts by a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, rectified and
max-pooled over windows of fixed length; a softmax layer gives the languages of a
window.  A text's score is the mean of its windows' logits, each weighed by its
bytes, so the whole text counts and batches have one shape.  The network is
trained in numpy on the driver and sent to the workers (some tens of kB).

Every label that occurs is learned.  The sample holds at most ``TRAINING_TEXTS``
texts of a language and, where languages are many, ``ALL_TEXTS`` shared evenly
among them, one of each at least.  It takes the texts with the smallest hashes of
identifier and text, so it depends neither on partitions nor on repeated rows,
and training is deterministic.

Defined cases: null text, or one without a letter, is ``und`` with score 0 (as
is everything if no labelled text exists); empty tables give no rows; repeated
rows get equal answers and are learned from once; a null label is not learned
from; a null identifier counts as an empty name, which is not held out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hygroflow.llm import tables
from hygroflow.llm import words as wd

#: Labelled texts to learn from per language and in all, and windows of each (at most).
TRAINING_TEXTS = 400
ALL_TEXTS = 40_000
TRAINING_WINDOWS = 4
#: Candidates of the sample for each text it takes, so that none is missing.
SPARE = 4
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
EPOCHS = 6
BATCH = 64
RATE = 0.01
HELD_OUT = (4, 2)
#: Windows of one forward pass.
AT_ONCE = 32


def held_out(doc_id: Column) -> Column:
    name = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(name) % HELD_OUT[0] == HELD_OUT[1]


def windows(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's bytes as rows of LENGTH (the last one filled with zeros), and the bytes in each."""
    count = max(1, -(-len(text) // LENGTH))
    rows = np.zeros(count * LENGTH, np.uint8)
    rows[: len(text)] = text
    sizes = np.full(count, LENGTH)
    sizes[-1] = len(text) - (count - 1) * LENGTH
    return rows.reshape(count, LENGTH), sizes


class Network:
    """Embedding, convolutions of several widths, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages = languages
        self.weights = {"embed": draw(256, EMBEDDED, scale=0.5)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = draw(w * EMBEDDED, FILTERS, scale=1 / np.sqrt(w * EMBEDDED))
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = draw(len(WIDTHS) * FILTERS, len(languages), scale=0.1)
        self.weights["out_bias"] = np.zeros(len(languages), np.float32)

    def _pooled(self, rows: np.ndarray, keep: bool):
        embedded = self.weights["embed"][rows]
        pooled, kept = [], {}
        for w in WIDTHS:
            spans = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1)  # (rows, positions, embedded, w)
            spans = np.ascontiguousarray(spans.transpose(0, 1, 3, 2)).reshape(-1, w * EMBEDDED)
            values = (spans @ self.weights[f"conv{w}"]).reshape(len(rows), -1, FILTERS)
            if keep:
                at = values.argmax(1)
                kept[w] = (spans.reshape(len(rows), -1, w * EMBEDDED), at)
                values = np.take_along_axis(values, at[:, None], 1)[:, 0]
            else:
                values = values.max(1)
            pooled.append(np.maximum(values + self.weights[f"bias{w}"], 0))
        return np.concatenate(pooled, 1), kept

    def logits(self, rows: np.ndarray) -> np.ndarray:
        parts = [self._pooled(rows[i : i + AT_ONCE], False)[0] for i in range(0, len(rows), AT_ONCE)]
        return np.concatenate(parts) @ self.weights["out"] + self.weights["out_bias"]

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        pooled, kept = self._pooled(rows, True)
        chance = softmax(pooled @ self.weights["out"] + self.weights["out_bias"])
        chance[np.arange(len(rows)), labels] -= 1
        chance /= len(rows)
        found = {"out": pooled.T @ chance, "out_bias": chance.sum(0), "embed": np.zeros((256, EMBEDDED), np.float32)}
        back = (chance @ self.weights["out"].T) * (pooled > 0)
        row = np.arange(len(rows))[:, None]
        for k, w in enumerate(WIDTHS):
            spans, at = kept[w]
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            chosen = spans[row, at]  # (rows, filters, w * embedded)
            found[f"conv{w}"] = np.einsum("rf,rfe->ef", g, chosen)
            found[f"bias{w}"] = g.sum(0)
            to_spans = (g[:, :, None] * self.weights[f"conv{w}"].T[None]).reshape(len(rows), FILTERS, w, EMBEDDED)
            for i in range(w):
                np.add.at(found["embed"], rows[row, at + i], to_spans[:, :, i])
        return found

    def fit(self, rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> Network:
        """Adam over shuffled batches."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(rows[pick], labels[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    size = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    self.weights[k] -= (RATE * (first[k] / (1 - 0.9**step)) / size).astype(np.float32)
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _samples(batch: pa.RecordBatch):
    """Up to TRAINING_WINDOWS rows of LENGTH bytes, evenly spread over each text."""
    data, offsets = wd.buffers(batch["text"])
    langs, rows = [], []
    for lang, a, b in zip(batch["lang"].to_pylist(), offsets[:-1], offsets[1:], strict=True):
        last = max(0, int(b - a) - LENGTH)
        for start in sorted({last * k // max(1, TRAINING_WINDOWS - 1) for k in range(TRAINING_WINDOWS)}):
            langs.append(lang)
            rows.append(data[a + start : min(b, a + start + LENGTH)].tobytes())
    yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "bytes": pa.array(rows, pa.binary())})


def sampled(known: DataFrame) -> DataFrame:
    """(lang, text) of the sample: of each language the texts with the smallest hashes, repeated rows once.

    Texts beyond a generous hash limit go before anything is shuffled; the limit
    follows from the number of different hashes, so copies do not crowd it.
    """
    ticket = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40))
    known = known.select("lang", "text", ticket.alias("ticket"))
    sizes = tables.stored(known.groupBy("lang").agg(F.approx_count_distinct("ticket").alias("different")), "languages")
    most = min(TRAINING_TEXTS, max(1, ALL_TEXTS // max(1, sizes.count())))
    share = F.when(F.col("different") > 4 * SPARE * most, SPARE * most / F.col("different")).otherwise(1.0)
    limits = sizes.select(F.col("lang").alias("limit_lang"), share.alias("share"))
    near = known.join(limits, F.col("lang") == F.col("limit_lang")).where(F.col("ticket") < F.col("share") * float(1 << 40))
    once = near.dropDuplicates(["lang", "ticket"])
    order = F.row_number().over(Window.partitionBy("lang").orderBy("ticket"))
    return once.withColumn("place", order).where(F.col("place") <= most).select("lang", "text")


def trained(docs: DataFrame) -> Network | None:
    """Network of the labelled rows that are not held out; None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sample = tables.whole(sampled(known), _samples, "lang string, bytes binary").toPandas()  # bounded, see above
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "bytes"])
    languages = sorted(sample["lang"].unique())
    rows = np.concatenate([windows(np.frombuffer(b, np.uint8))[0][:1] for b in sample["bytes"]])
    labels = np.searchsorted(np.array(languages, object), sample["lang"].to_numpy(object))
    return Network(languages).fit(rows, labels)


class Tables:
    """The trained network with its convolutions as sums of table rows for bytes and pairs of bytes."""

    def __init__(self, network: Network):
        self.weights = network.weights
        self.parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        embed = network.weights["embed"]
        for w in WIDTHS:
            single = [embed @ network.weights[f"conv{w}"][i * EMBEDDED : (i + 1) * EMBEDDED] for i in range(w)]
            at, parts = 0, []
            while at < w:
                if at + 1 < w:
                    pairs = (single[at][:, None] + single[at + 1][None]).reshape(-1, FILTERS)
                    parts.append((at, 2, np.ascontiguousarray(pairs)))
                    at += 2
                else:
                    parts.append((at, 1, np.ascontiguousarray(single[at])))
                    at += 1
            self.parts[w] = parts

    def logits(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.intp) * 256 + rows[:, 1:]
        rows = rows.astype(np.intp)
        pooled = []
        for w, parts in self.parts.items():
            positions, values = LENGTH - w + 1, None
            for at, size, table in parts:
                found = table.take((pairs if size == 2 else rows)[:, at : at + positions], axis=0)
                values = found if values is None else np.add(values, found, out=values)
            while (n := values.shape[1]) > 1:  # halves are compared, which is faster than along an axis
                half = np.maximum(values[:, : n // 2], values[:, n // 2 : n // 2 * 2])
                if n % 2:
                    np.maximum(half[:, :1], values[:, -1:], out=half[:, :1])
                values = half
            pooled.append(np.maximum(values[:, 0] + self.weights[f"bias{w}"], 0))
        return np.concatenate(pooled, 1) @ self.weights["out"] + self.weights["out_bias"]


_LOADED: dict[str, Tables] = {}


def _predicted(shared, model: str):
    """Score the texts of a batch, AT_ONCE windows after the other; a text may span several passes."""

    def one(batch: pa.RecordBatch):
        if model not in _LOADED:
            _LOADED.clear()
            _LOADED[model] = Tables(shared.value)
        net, languages = _LOADED[model], shared.value.languages
        data, offsets = wd.buffers(batch["text"])
        sums = np.zeros((batch.num_rows, len(languages)))
        lengths = np.diff(offsets)
        for first, stop in wd.slices(offsets):
            counts = np.maximum(1, -(-lengths[first:stop] // LENGTH))
            owner = np.repeat(np.arange(first, stop), counts)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = offsets[owner] + place * LENGTH
            size = np.minimum(offsets[owner + 1] - start, LENGTH)
            for i in range(0, len(owner), AT_ONCE):
                at = start[i : i + AT_ONCE, None] + np.arange(LENGTH)
                inside = at < (start + size)[i : i + AT_ONCE, None]
                rows = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(data) else np.zeros(at.shape, np.uint8)
                np.add.at(sums, owner[i : i + AT_ONCE], net.logits(rows) * size[i : i + AT_ONCE, None])
        chance = softmax(sums / np.maximum(lengths, 1)[:, None])
        best = chance.argmax(1)
        letters = batch["letters"].to_numpy(zero_copy_only=False).astype(bool)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["held_out"],
                pa.array([languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], pa.string()),
                pa.array(np.where(letters, chance[np.arange(len(best)), best], 0.0)),
            ],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    return one


def predicted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), letters.alias("letters"))
    network = trained(docs)
    if network is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double"
    return tables.whole(rows, _predicted(shared, uuid.uuid4().hex), schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return predicted(tables.read(spark, folder, "documents", "doc_id", "text", "lang"))
