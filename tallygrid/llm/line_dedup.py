"""Exact removal of lines that many documents share, with two Bloom filters in front of the shuffle.

A line's key is the line without white space at its ends and with A-Z lower-cased. A key of at least ``min_chars`` code points
that at least ``min_docs`` documents hold loses its lines everywhere except in the document with the largest id that holds it.

1. Each task hashes its lines and writes every hash once, with a mark if two of its documents hold it.
2. Hash ranges are streamed through two filters, once-seen and twice-seen. A hash that is marked, or already in the first, enters
   the second. Only the second is kept, folded until all ranges together fit ``FILTER_BYTES``; a denser filter lets more lines
   through to the exact step and changes no result.
3. The documents are read again; lines that the broadcast filter suspects are counted exactly by their text, and the documents
   that lose lines get them by a join on the id. No line text that occurs once is shuffled, but for filter errors.

Defined results: a null or empty text is one empty line; lines shorter than ``min_chars`` always stay; a key that repeats within a
document counts once for it; rows with one id are one document for the count, and lose the same keys; a null id counts as no
document and is smaller than any other; an empty table gives an empty result. Other columns are kept and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import byte_strings, free_name, mix, stored

#: Bytes of the broadcast filter, at most.
FILTER_BYTES = 32 << 20
SEGMENT_ROWS = 1 << 20
BITS_PER_ROW = 16
PROBES = 3


def key_of(line: bytes) -> bytes:
    return line.strip().lower()


def is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def keys_of(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in map(key_of, text.split(b"\n")) if is_long(k, min_chars)}


def positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Probe positions in a filter of ``bits`` (a power of two); halving ``bits`` folds them."""
    other = mix(hashes) | np.uint64(1)
    return [((hashes + np.uint64(i) * other) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _hashes(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.zeros(0, np.uint64)]
        for batch in batches:
            found = [xxhash.xxh64_intdigest(k) for text in byte_strings(batch.column(0)) for k in keys_of(text, min_chars)]
            parts.append(np.array(found, np.uint64))
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        for i in range(0, len(values), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(values[part].view(np.int64)), pa.array(counts[part] > 1)], ["hash", "again"])

    return docs.select(text_col).mapInArrow(run, "hash long, again boolean")


def _twice_filters(hashes: DataFrame, segment_bits: int, bits: int) -> DataFrame:
    """(segment, packed twice-seen bits) of each hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, once, twice = None, None, None
        for batch in batches:
            segments, values, again = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for segment in np.unique(segments):
                if segment != current:
                    if current is not None:
                        yield _packed(current, twice)
                    current, once, twice = segment, np.zeros(bits, bool), np.zeros(bits, bool)
                own = segments == segment
                own_values, first, counts = np.unique(values[own].view(np.uint64), return_index=True, return_counts=True)
                at = positions(own_values, bits)
                marked = np.isin(own_values, values[own][again[own]].view(np.uint64))
                seen = np.logical_and.reduce([once[p] for p in at]) | (counts > 1) | marked
                for p in at:
                    twice[p[seen]] = True
                    once[p] = True
        if current is not None:
            yield _packed(current, twice)

    segment = F.shiftrightunsigned("hash", 64 - segment_bits) if segment_bits else F.lit(0).cast("long")
    dealt = hashes.select(segment.alias("segment"), "hash", "again").repartition(max(2, 1 << segment_bits), "segment")
    return dealt.sortWithinPartitions("segment").mapInArrow(run, "segment long, bits binary")


def _packed(segment, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(segment)], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])


def _fold(filters: DataFrame, times: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded = []
            for packed in batch.column(1).to_pylist():
                bits = np.frombuffer(packed, np.uint8)
                for _ in range(times):
                    bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
                folded.append(bits.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folded, pa.binary())], ["segment", "bits"])

    return filters.mapInArrow(run, filters.schema)


class Suspects:
    """The twice-seen filter of all hash ranges."""

    def __init__(self, segment_bits: int, bits: int, filters: dict[int, bytes]):
        self.segment_bits, self.bits = segment_bits, bits
        self.packed = np.zeros((1 << segment_bits, bits // 8), np.uint8)
        for segment, packed in filters.items():
            self.packed[segment] = np.frombuffer(packed, np.uint8)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        segment = (hashes >> np.uint64(64 - self.segment_bits)).astype(np.int64) if self.segment_bits else np.zeros(len(hashes), np.int64)
        hit = np.ones(len(hashes), bool)
        for p in positions(hashes, self.bits):
            hit &= (self.packed[segment, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return hit


def suspects(docs: DataFrame, text_col: str, min_chars: int, filter_bytes: int = FILTER_BYTES) -> Suspects:
    hashes = stored(_hashes(docs, text_col, min_chars), "line-hashes")
    rows = hashes.count()
    segment_bits = max(0, (rows // SEGMENT_ROWS).bit_length())
    bits = 1 << max(10, (BITS_PER_ROW * rows >> segment_bits).bit_length())
    filters = stored(_twice_filters(hashes, segment_bits, bits), "line-filters")
    folds = 0
    while (bits >> folds) > 64 and (bits >> folds << segment_bits) // 8 > filter_bytes:
        folds += 1
    return Suspects(segment_bits, bits >> folds, {r.segment: bytes(r.bits) for r in _fold(filters, folds).toLocalIterator()})


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """(id, key) of every line that goes; keys are UTF-8 bytes."""
    filters = docs.sparkSession.sparkContext.broadcast(suspects(docs, text_col, min_chars))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, text in enumerate(byte_strings(batch.column(1))):
                own = keys_of(text, min_chars)
                rows.extend([i] * len(own))
                keys.extend(own)
            hit = np.flatnonzero(filters.value.test(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)))
            ids = batch.column(0).take(pa.array(np.array(rows, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([keys[i] for i in hit.tolist()], pa.binary())], ["id", "key"])

    found = stored(docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, key binary"), "line-suspects")
    holders = found.groupBy("key", "id").agg(F.count(F.lit(1)).alias("rows"))
    shared = holders.groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    shared = stored(shared.select(F.col("key").alias("shared_key"), "keeper"), "line-shared")
    return found.join(shared, F.col("key") == F.col("shared_key")).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "key")


def _with_lost(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """The documents and, as last column, the keys each loses."""
    lost = free_name(docs, "lost_keys")
    ids = free_name(docs, "lost_id")
    losses = shared_lines(docs, id_col, text_col, min_docs, min_chars).groupBy(F.col("id").alias(ids)).agg(F.collect_set("key").alias(lost))
    return docs.join(losses.hint("shuffle_hash"), docs[id_col].eqNullSafe(losses[ids]), "left").select(*[docs[c] for c in docs.columns], lost)


def _kept(text: bytes, lost: list[bytes]) -> tuple[list[bytes], int]:
    lines = text.split(b"\n")
    gone = set(lost)
    left = [line for line in lines if key_of(line) not in gone]
    return left, len(lines)


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with shared lines taken out; all columns stay."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                old if not lost else b"\n".join(_kept(old.encode(), lost)[0]).decode()
                for old, lost in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            ]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_lost(docs, id_col, text_col, min_docs, min_chars).mapInArrow(run, docs.schema)


def line_report(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lines before, lines dropped, and the SHA-256 of the text that stays."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, digests = [], [], []
            for text, lost in zip(byte_strings(batch.column(1)), batch.column(2).to_pylist()):
                left, n = _kept(text, lost or [])
                n_lines.append(n)
                n_dropped.append(n - len(left))
                digests.append(hashlib.sha256(b"\n".join(left)).hexdigest())
            columns = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_lines", "n_dropped", "kept_sha256"])

    joined = _with_lost(docs.select(id_col, text_col), id_col, text_col, min_docs, min_chars)
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string")
