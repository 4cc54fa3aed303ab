"""Packing of token sequences with balanced cost.

Texts are tokenised where they are read, whole, one id appended at the end of
each document.  Full-length pieces are sequences by themselves.  What is left of
the documents is packed in buffers of ``BUFFER`` documents of one input
partition: descending by length, each goes to the open sequence with the lowest
estimated cost (linear in its tokens plus, as attention stays inside a document,
quadratic in each piece) that has room.  The number of sequences is what the
tokens fill, so a piece that fits nowhere is cut over the sequences with most
room, and what remains at the end of a buffer becomes sequences of a power of
two: nothing is padded.  No shuffle and no global state are needed; a lost task
runs again with the same result, because sequence numbers come from the
partition's number.

The tokenizer's own splitting never crosses white space, so each distinct piece
costs once per worker and its ids are joined as bytes.

Defined cases: null and empty texts have the end id alone; repeated rows and
null identifiers are packed as documents of their own; a document of any length
is cut; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from hygroflow.llm.tables import kept_by_worker, read

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Documents whose rests are packed together.
BUFFER = 4096
#: Cost of a token, and of a pair of tokens of one piece.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
#: Distinct pieces that a worker remembers.
REMEMBERED = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

#: Characters whose case, composition and class are the same in every Unicode
#: version: ASCII without the control characters, letters of Latin-1, dashes and quotes.
_PLAIN = "\t-\r -~À-ÖØ-öø-ÿ\u2010-\u2027"
_ODD = re.compile(f"[^{_PLAIN}]|<\\|")
_PLAIN_ASCII = bytes([*range(9, 14), *range(32, 127)])
_CHUNK = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: The tokenizer's own splitting rule, written for plain characters in lower case.
#: Letters stand first, as most pieces are words; no other branch can start with one.
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary uses for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class _Remembered(dict):
    """Ids of pieces; unknown ones are looked up, all are forgotten beyond a limit."""

    def __init__(self, look_up):
        self.look_up = look_up

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = self.look_up(piece)
        return found


def _odd(text: str) -> bool:
    """Does the text hold a character that is not plain, or what may be a special token?"""
    if text.isascii():
        return "<|" in text or bool(text.encode().translate(None, _PLAIN_ASCII))
    return _ODD.search(text) is not None


class WordIds:
    """Ids of texts as bytes, four per id, in little-endian order.

    A text of plain characters is split here and each distinct piece is given to
    the tokenizer's model.  Any other text is cut at ASCII white space, and each
    distinct chunk is given to the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(file)
        letters, model = _byte_letters(), whole.model

        def of_piece(piece: str) -> bytes:
            # visible ASCII characters are their own letters
            word = piece if piece.isascii() else "".join([letters[b] for b in piece.encode()])
            ids = [t.id for t in model.tokenize(word)]
            return struct.pack(f"<{len(ids)}I", *ids)

        def of_chunk(chunk: str) -> bytes:
            ids = whole.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)

        self.pieces, self.chunks = _Remembered(of_piece), _Remembered(of_chunk)

    def __call__(self, text: str) -> bytes:
        if _odd(text):
            return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))


def word_ids(file: str) -> WordIds:
    return kept_by_worker(file, lambda: WordIds(file))


def placed(lengths: list[int], room: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Place documents (their lengths) into sequences of ``room`` tokens.

    Returns pieces (document, start, length, sequence) and the sequences'
    lengths: all ``room`` but for the last ones, which are powers of two.
    """
    total = sum(lengths)
    sizes = [room] * (total // room)
    rest = total % room
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    left, pieces = list(sizes), []
    open_now = [(0.0, q) for q in range(len(sizes))]  # a heap by cost
    heapq.heapify(open_now)

    def put(doc: int, start: int, length: int, q: int, cost: float) -> None:
        pieces.append((doc, start, length, q))
        left[q] -= length
        if left[q]:
            heapq.heappush(open_now, (cost + LINEAR * length + QUADRATIC * length * length, q))

    for doc in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        passed, found = [], False
        while open_now:
            cost, q = heapq.heappop(open_now)
            if left[q] >= lengths[doc]:
                found = True
                break
            passed.append((cost, q))
        for entry in passed:
            heapq.heappush(open_now, entry)
        if found:
            put(doc, 0, lengths[doc], q, cost)
            continue
        start = 0
        while start < lengths[doc]:
            cost, q = max(open_now, key=lambda e: (left[e[1]], -e[0]))
            open_now.remove((cost, q))
            heapq.heapify(open_now)
            length = min(left[q], lengths[doc] - start)
            put(doc, start, length, q, cost)
            start += length
    return pieces, sizes


def _packer(file: str, room: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        ids_of, sequence = word_ids(file), TaskContext.get().partitionId() << 36
        rests: list[tuple[int | None, int, bytes]] = []  # document, ids before the rest, the rest

        def packed(sequence: int):
            pieces, sizes = placed([len(r[2]) // 4 for r in rests], room)
            used, rows = [0] * len(sizes), []
            for d, start, length, q in pieces:
                doc, before, ids = rests[d]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                rows.append((doc, before + start, length, crc, before + len(ids) // 4, sequence + q, used[q]))
                used[q] += length
            return rows, len(sizes)

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = ids_of(text.as_py() or "") + end
                tokens = len(ids) // 4
                full = tokens // room * room
                for start in range(0, full, room):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + room)])
                    rows.append((doc, start, room, crc, tokens, sequence, 0))
                    sequence += 1
                if full < tokens:
                    rests.append((doc, full, ids[4 * full :]))
                if len(rests) >= BUFFER:
                    more, n = packed(sequence)
                    rows += more
                    sequence, rests[:] = sequence + n, []
            if rows:
                yield _batch(rows)
        if rests:
            yield _batch(packed(sequence)[0])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def packed(docs: DataFrame, file: str, room: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text): one row per piece."""
    kept = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return kept.mapInArrow(_packer(file, room, end_id), SCHEMA)


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed(read(spark, folder, "documents", "doc_id", "text"), tokenizer_file())
