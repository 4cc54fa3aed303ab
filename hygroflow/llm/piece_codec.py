"""Encoding and decoding with a piece vocabulary, through a table of prefixes.

The vocabulary merges neighbours whose concatenation is a piece, best score
first, leftmost first among equal scores.  Such an encoding is right exactly
when every two neighbouring tokens are: no merge ever crosses a border that the
pair alone would keep.  Hence every prefix of a text has one last token: the
piece that ends there and is compatible with the last token of what stands
before it.  One pass of an automaton over the text meets all candidates, the
table keeps the last token of each prefix, and the ids are recovered backwards
from the end - linear in the text, whatever its length.

White space is the sign ``SPACE``, one is put before every text.  No piece holds
``SPACE`` behind another character (checked when the vocabulary is read; if one
did, texts would not be cut), so a border lies before every run of it, and each
distinct stretch between borders is worked out once per worker and remembered.
What is remembered is bounded by entries of at most ``SHORT`` characters.
Characters without a piece become one id per byte of their UTF-8 form.

Defined cases: a null or empty text has the end id alone and decodes to the
empty text; null identifiers and repeated rows are rows of their own; an empty
table gives no rows.  All stages stream: a batch holds whole texts, output
batches end at ``BATCH_IDS`` ids or one text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, whole

MODEL = "piece_bpe_32k.model"
#: The sign that stands for a space, and what an unknown id decodes to.
SPACE, UNKNOWN = "▁", " ⁇ "
#: Longest stretch that is remembered, and how many; how many pairs are remembered.
SHORT, STRETCHES, PAIRS = 64, 400_000, 1_000_000
BATCH_IDS = 1 << 20

_WORKERS: dict[str, PieceCodec] = {}


class _Remembered(dict):
    """Results of a function; all are forgotten beyond a limit."""

    def __init__(self, look_up, limit: int):
        self.look_up, self.limit = look_up, limit

    def __missing__(self, key):
        found = self.look_up(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = found
        return found


class PieceCodec:
    """Ids of texts and texts of ids for one vocabulary file."""

    def __init__(self, file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes_of = {i: int(self.pieces[i][1:-1], 16) for i in range(size) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.bytes_of.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        special = self.silent | self.bytes_of.keys() | {self.unknown}
        if len(self.id_of_byte) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("the vocabulary needs byte pieces and no unused ones")
        self.id_of = {self.pieces[i]: i for i in range(size) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.compatible = _Remembered(lambda pair: self._merged(pair[0] + pair[1]) == list(pair), PAIRS)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if self._merged(p) == [p]:  # other pieces never come out of merging
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        used = set().union(*self.id_of)
        alone = "".join(c for c in "\t\n\x0b\x0c\r" if c not in used)  # in no piece, so a border on both sides
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of)
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|[{alone or SPACE}]" if cut else "(?s).+")
        self.short = _Remembered(self._stretch_ids, STRETCHES)
        #: What decoding prints for each id; byte pieces are handled apart.
        self.shown = [
            "" if i in self.silent else UNKNOWN if i == self.unknown else p.replace(SPACE, " ")
            for i, p in enumerate(self.pieces)
        ]
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.bytes_of)] = True

    def _merged(self, text: str) -> list[str]:
        """Merging by definition; only for pairs of pieces, which are short."""
        parts = list(text)
        while len(parts) > 1:
            found = [(self.score[s], -k) for k in range(len(parts) - 1) if (s := parts[k] + parts[k + 1]) in self.score]
            if not found:
                break
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def last_tokens(self, text: str) -> list[str]:
        """The last token of every prefix; that of the empty prefix is empty."""
        last = [""] * (len(text) + 1)
        compatible = self.compatible
        for at, (token, length) in self.automaton.iter(text):
            if last[at + 1]:
                continue
            start = at + 1 - length
            if not start:
                last[at + 1] = token
                continue
            before = last[start]
            if not before:  # a character in no piece
                before = last[start] = text[start - 1]
            if compatible[before, token]:
                last[at + 1] = token
        return last

    def _stretch_ids(self, text: str) -> bytes:
        last, at, ids, id_of = self.last_tokens(text), len(text), array("i"), self.id_of
        while at:
            token = last[at] or text[at - 1]
            if token in id_of:
                ids.append(id_of[token])
            else:
                ids.extend([self.id_of_byte[b] for b in reversed(token.encode())])
            at -= len(token)
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, the end id last."""
        parts = self.stretch.findall(SPACE + text.replace(" ", SPACE)) if text else []
        short, long = self.short, self._stretch_ids
        joined = b"".join([short[p] if len(p) <= SHORT else long(p) for p in parts])
        return np.append(np.frombuffer(joined, np.intc), np.int32(self.end))

    def _from_bytes(self, data: bytes) -> str:
        """Characters of byte pieces; every byte of an incomplete one counts as unreadable."""
        try:
            return data.decode()
        except UnicodeDecodeError:
            pass
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids.  The space that encoding puts before the text goes again."""
        ids = np.asarray(ids, np.int64)
        listed = ids.tolist()
        shown = list(map(self.shown.__getitem__, listed))
        first = next((k for k, i in enumerate(listed) if i not in self.silent), len(listed))
        if first < len(listed) and self.pieces[listed[first]] in self.id_of and shown[first].startswith(" "):
            shown[first] = shown[first][1:]
        at = np.flatnonzero(self.is_byte[ids])
        if len(at):
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                data = bytes([self.bytes_of[i] for i in ids[run].tolist()])
                for k in run.tolist():
                    shown[k] = ""
                shown[run[0]] = self._from_bytes(data)
        return "".join(shown)


def codec(file: str) -> PieceCodec:
    if file not in _WORKERS:
        _WORKERS[file] = PieceCodec(file)
    return _WORKERS[file]


def _encode(file: str):
    def run(batch: pa.RecordBatch):
        encode, at, ids, n = codec(file).encode, 0, [], 0

        def emit(stop: int) -> pa.RecordBatch:
            offsets = np.cumsum([0] + [len(i) for i in ids], dtype=np.int32)
            values = pa.array(np.concatenate(ids).astype(np.int32))
            arrays = [batch["doc_id"].slice(at, stop - at), pa.ListArray.from_arrays(pa.array(offsets), values)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids"])

        for k, text in enumerate(batch["text"]):
            found = encode(text.as_py() or "")
            if ids and n + len(found) > BATCH_IDS:
                yield emit(k)
                at, ids, n = k, [], 0
            ids.append(found)
            n += len(found)
        yield emit(batch.num_rows)

    return run


def _decode(file: str):
    def run(batch: pa.RecordBatch):
        decode, lists = codec(file).decode, batch["ids"]
        texts = [decode(x.values.to_numpy()) if x.is_valid else "" for x in lists]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """``docs`` (doc_id, text): doc_id and ids, the end id last."""
    kept = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return whole(kept, _encode(file), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, file: str) -> DataFrame:
    """Rows (doc_id, ids): the same with the text of the ids; null ids count as none."""
    return whole(rows.select("doc_id", "ids"), _decode(file), "doc_id long, ids array<int>, text string")


def model_file(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    file = model_file()
    rows = decoded(encoded(read(spark, folder, "documents", "doc_id", "text"), file), file)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
