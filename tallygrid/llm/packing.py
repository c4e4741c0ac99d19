"""Packing of whole documents into token sequences along a space-filling curve.

A document's token ids, closed by ``end_id``, are hashed to a signed, normalised vector of ``BUCKETS`` entries and projected to ``DIMS``
numbers. Their place on a Hilbert curve is the document's key: documents with similar words get near keys. The documents are range-sorted
by key and laid end to end, so neighbours on the curve share sequences. A sequence holds ``size`` tokens; a document that does not fit
is cut and goes on in the next. What is left at the end of a range is cut into sequences whose lengths are powers of two, which take
no padding.

Keys decide the order only. Equal keys are dealt by id, so a group of copies never meets in one range. Defined results: a null or empty
text is ``end_id`` alone; every id lies in exactly one piece; repeated rows are packed each; a null id is packed like any other;
an empty table gives no piece. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallygrid.llm.textkit import byte_strings, mix, stored
from tallygrid.llm.tokens import Ids, tokenizer, whole_tokens

BUCKETS = 256
DIMS = 4
BITS = 12

_encoders: dict[str, Ids] = {}


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below ``2 ** bits``, one row each (Skilling's transform)."""
    x = [c.astype(np.int64) for c in points.T]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> level) & 1)
    return key


def hashed_tokens(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of every token id below ``size``."""
    h = mix(np.arange(1, size + 1, dtype=np.uint64))
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def curve_keys(ids: list[np.ndarray], bucket: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given by their token ids."""
    directions = np.random.default_rng(7).standard_normal((BUCKETS, DIMS))
    counts = np.zeros((len(ids), BUCKETS))
    for row, own in zip(counts, ids):
        row += np.bincount(bucket[own], sign[own], BUCKETS)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    places = 1 / (1 + np.exp(-1.7 * counts @ directions))
    return hilbert_keys(np.minimum((places * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, ids) of every document; ids as little-endian bytes of 2 or 4 by the size of the vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Ids(path, whole.value)
        encoder = _encoders[path]
        bucket, sign = hashed_tokens(max(end_id + 1, encoder.tokenizer.get_vocab_size()))
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [b + end for b in encoder.of(byte_strings(batch.column(1)))]
            for lo in range(0, len(ids), 512):
                part = ids[lo : lo + 512]
                keys = curve_keys([np.frombuffer(b, encoder.dtype) for b in part], bucket, sign)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), pa.array(keys), pa.array(part, pa.binary())], ["id", "key", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key long, ids binary")


class Layout:
    """Lays documents end to end and cuts them into sequences of ``size``."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.open, self.filled = size, first, [], 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.size - self.filled]
            self.open.append((doc, start, part, len(ids)))
            start += len(part)
            self.filled += len(part)
            if self.filled == self.size:
                yield from self.close(self.size)

    def close(self, length: int) -> Iterator[tuple]:
        """Number the first ``length`` open tokens as a sequence."""
        offset, rest = 0, []
        for doc, start, ids, total in self.open:
            part = ids[: max(0, length - offset)]
            if len(part):
                yield doc, start, part, total, self.next, offset
            if len(part) < len(ids):
                rest.append((doc, start + len(part), ids[len(part) :], total))
            offset += len(part)
        self.open, self.filled, self.next = rest, self.filled - length, self.next + 1

    def finish(self) -> Iterator[tuple]:
        while self.filled:
            yield from self.close(1 << (self.filled.bit_length() - 1))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: id, start, length, ids (little-endian 32-bit), tokens of the document, sequence, offset in it."""
    wide = np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Layout(size, TaskContext.get().partitionId() << 40)
        def record(pieces: list[tuple], ids: pa.Array) -> pa.RecordBatch:
            doc, start, part, total, sequence, offset = zip(*pieces) if pieces else [()] * 6
            columns = [
                ids.take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array([len(p) for p in part], pa.int64()), pa.array([p.astype("<u4").tobytes() for p in part], pa.binary()),
                pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        held = None
        for batch in batches:
            own = batch.column(0)
            held = own if held is None else pa.concat_arrays([held, own])
            base = len(held) - len(own)
            pieces = []
            for i, b in enumerate(batch.column(2).to_pylist()):
                pieces.extend(layout.add(base + i, np.frombuffer(b, wide)))
            yield record(pieces, held)
            kept = sorted({p[0] for p in layout.open})
            number = {doc: i for i, doc in enumerate(kept)}
            held = held.take(pa.array(kept, pa.int64()))
            layout.open = [(number[p[0]], *p[1:]) for p in layout.open]
        if held is not None:
            yield record(list(layout.finish()), held)

    ids = stored(encoded(docs, path, end_id, id_col, text_col), "packing-ids")
    ranged = ids.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "ids")
    out = ranged.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
