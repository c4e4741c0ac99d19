"""Benchmark decontamination: a broadcast set of the test items' word n-grams, scanned over training texts.

Words are the runs of characters outside ASCII punctuation, space and control characters, with A-Z lower-cased. Every
``n`` consecutive words of an item form a window; an item with fewer words, but not none, is one window. A word of a
document is hit where it lies inside an occurrence of a window. Rolling hashes propose occurrences; each is confirmed
on the words themselves.

Defined results: null or empty texts have no words and no hits; an item without words has no window; items that repeat count
once per item_id; an item_id that is null hits words but is not listed. With no items, nothing is hit. Columns beside the
named ones are ignored by ``matches`` and kept by ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import byte_strings, chunks, starts_of

#: Bytes of item text that one broadcast set is built from. More items are dealt over several sets, scanned one after another.
ITEM_BYTES = 16 << 20

NON_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in NON_WORD else c for c in range(256))
BASE = 0x9E3779B97F4A7C15
SIEVE_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of a group of items: vocabulary, hash sieve, and window -> items by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.of_length: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                key = np.array(ids[i : i + size], np.int32).tobytes()
                owners = self.of_length.setdefault(size, {}).setdefault(key, set())
                if item is not None:
                    owners.add(item)
        self.codes = np.random.default_rng(0).integers(1, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64)
        self.sieves = {}
        for size, known in self.of_length.items():
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            ids = np.frombuffer(b"".join(known), np.int32).reshape(-1, size)
            sieve[self._slots(ids.T)] = True
            self.sieves[size] = sieve

    def _slots(self, columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            h *= np.uint64(BASE)
            h += self.codes[column]
        return h >> np.uint64(64 - SIEVE_BITS)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(start, length, items) of each window found; id 0 marks words of no item and borders of documents."""
        known = ids > 0
        for size, sieve in self.sieves.items():
            if len(ids) < size:
                continue
            inside = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(inside[size:] - inside[:-size] == size)
            at = at[sieve[self._slots([ids[at + j] for j in range(size)])]] if len(at) else at
            exact = self.of_length[size]
            for i in at.tolist():
                owners = exact.get(ids[i : i + size].tobytes())
                if owners is not None:
                    yield i, size, owners

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, which of them are hit, items that occur."""
        get = self.vocabulary.get
        for lo, hi in chunks(texts):
            ids, lengths = [], []
            for text in texts[lo:hi]:
                words = words_of(text)
                ids.extend([get(w, 0) for w in words])
                ids.append(0)
                lengths.append(len(words) + 1)
            flat = np.array(ids, np.int32)
            begin = starts_of(np.array(lengths))
            hit = np.zeros(len(flat), bool)
            found: dict[int, set[str]] = {}
            for i, size, owners in self.occurrences(flat):
                hit[i : i + size] = True
                found.setdefault(int(np.searchsorted(begin, i, "right")) - 1, set()).update(owners)
            for k in range(hi - lo):
                yield lengths[k] - 1, hit[begin[k] : begin[k + 1] - 1], found.get(k, set())


def windows(items: DataFrame, n: int, item_col: str, text_col: str, item_bytes: int = ITEM_BYTES) -> list:
    """Broadcast window sets, each built from a bounded part of the items."""
    spark = items.sparkSession
    items = items.select(F.col(item_col).cast("string").alias("item"), F.encode(text_col, "UTF-8").alias("text"))
    total = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    parts = -(-total // item_bytes)
    sets = []
    for part in range(parts):
        rows = items.where(F.pmod(F.hash("item", "text"), F.lit(parts)) == part).collect()
        sets.append(spark.sparkContext.broadcast(Windows([(r.item, bytes(r.text or b"")) for r in rows], n)))
    return sets


def _scan(texts: list[bytes], sets: list) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    if not sets:
        return ((len(w), np.zeros(len(w), bool), set()) for w in map(words_of, texts))
    merged = sets[0].value.scan(texts)
    for more in sets[1:]:
        merged = ((n, a | b, x | y) for (n, a, x), (_, b, y) in zip(merged, more.value.scan(texts)))
    return merged


def matches(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: number of words, words hit, spans of hit words (start, end), items that occur."""
    sets = windows(items, n, item_col, item_text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_hit, spans, found = [], [], [], []
            for count, hit, owners in _scan(byte_strings(batch.column(1)), sets):
                n_words.append(count)
                n_hit.append(int(hit.sum()))
                spans.append(_spans(hit) if n_hit[-1] else [])
                found.append(sorted(owners))
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, spans_type), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_hit", "spans", "items"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _cut(text: bytes, hit: np.ndarray) -> str:
    """The text without its hit words; what separates words stays."""
    folded = np.frombuffer(text.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], folded.view(np.int8), [0]])))
    kept, last = [], 0
    for a, b in zip(edges[::2][hit], edges[1::2][hit]):
        kept.append(text[last:a])
        last = b
    return b"".join([*kept, text[last:]]).decode()


def remove(docs: DataFrame, items: DataFrame, n: int = 10, how: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents without those that hold a window (``how="documents"``), or all with the hit words cut out (``"spans"``)."""
    if how not in ("documents", "spans"):
        raise ValueError("how is 'documents' or 'spans'")
    sets = windows(items, n, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_strings(batch.column(at))
            hits = [hit for _, hit, _ in _scan(texts, sets)]
            if how == "documents":
                yield batch.filter(pa.array([not h.any() for h in hits], pa.bool_()))
            else:
                olds = batch.column(at).to_pylist()
                cut = [_cut(t, h) if h.any() else old for t, h, old in zip(texts, hits, olds)]
                yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
