"""Exact removal of long passages that an earlier document holds too: winnowed anchors as seeds, extended both ways.

A passage counts if ``length`` consecutive words or more also stand in a document with a smaller id. Words are runs of bytes other
than ASCII white space, unchanged.

1. *Anchors.* Of every ``length`` words, the least hash among their runs of ``SEED`` words is an anchor, so any two equal windows
   of ``length`` words hold equal anchors at equal places. With an anchor goes a hash of all words that a window through it can reach.
2. *Seeds.* Anchors that documents with different ids hold, found by partial aggregates of the least and the largest id.
3. *Extension.* Where an earlier document has the seed with the same words all around, every window through it repeats. Of each such
   class only the documents with the least id are left; if the seed has several classes, the windows through it are followed word by word on both
   sides of the seed: each is known by 128 bits of hash, and repeats where an earlier document holds it. A group of n documents thus
   costs n rows a window, never pairs.
4. *Maximal repeats.* What repeats in a document is put together to spans, which are cut out.

Defined results: null or empty texts have no words; shorter texts than ``length`` words lose none; a repeat within one document is no
repeat, nor is one between rows with equal ids; a null id neither loses words nor makes others lose theirs; ids may be of any sortable
type; an empty table gives an empty result. Other columns are kept by ``remove_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import WordHashes, byte_strings, chunks, free_name, mix, starts_of, stored

LENGTH = 50
#: Words of a seed; the rest of ``length`` is the stretch from which the least is taken.
SEED = 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SALT = np.uint64(0x5851F42D4C957F2D)


class RollingHashes:
    """Hashes of runs of words, from prefix sums of word hashes times powers of an odd base."""

    def __init__(self, words: np.ndarray, base: int):
        size = len(words)
        self.up = _powers(base, size)
        self.down = _powers(pow(base, -1, 1 << 64), size)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    known = _known_powers.get(base, np.ones(1, np.uint64))
    while len(known) < size:
        known = np.concatenate([known, known * np.uint64(pow(base, len(known), 1 << 64))])
    _known_powers[base] = known
    return known[:size]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


class Passages:
    """The words of some texts, end to end, with hashes of their runs."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.begin = starts_of(self.counts)
        flat = hashes.of([w for own in words for w in own])
        self.first = RollingHashes(flat, BASES[0])
        self.second = RollingHashes(mix(flat ^ SALT), BASES[1])
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)

    def anchors(self, length: int, seed: int) -> np.ndarray:
        """Places of the words at which anchors begin, and their hashes."""
        size = len(self.text_of)
        if size < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(size - seed + 1)
        h = self.first.of(at, at + seed)
        stretch = length - seed + 1
        whole = self.text_of[: size - length + 1] == self.text_of[length - 1 :]
        least = np.where(whole, _sliding(h, stretch, np.minimum), np.uint64(0))
        edge = np.zeros(stretch - 1, np.uint64)
        highest = _sliding(np.concatenate([edge, least, edge]), stretch, np.maximum)
        chosen = np.flatnonzero(highest == h)
        return chosen, h[chosen]

    def reach(self, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """First word, and the word after the last, of all windows through an anchor."""
        own = self.text_of[at]
        return np.maximum(self.begin[own], at - (length - seed)), np.minimum(self.begin[own + 1], at + length)


def _row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """One number for all rows with this id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _anchors(docs: DataFrame, kind: str, length: int, seed: int) -> DataFrame:
    """(seed, around, id, doc, at) of every anchor: hash of its words, of all within reach, id and key of its row, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = byte_strings(batch.column(2))
            for lo, hi in chunks(texts):
                own = Passages(texts[lo:hi], hashes)
                at, h = own.anchors(length, seed)
                around = own.second.of(*own.reach(at, length, seed))
                row = own.text_of[at]
                place = pa.array(row + lo)
                columns = [pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), batch.column(0).take(place), batch.column(1).take(place), pa.array((at - own.begin[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["seed", "around", "id", "doc", "at"])

    return docs.mapInArrow(run, f"seed long, around long, id {kind}, doc long, at int")


def _windows(docs: DataFrame, kind: str, length: int, seed: int) -> DataFrame:
    """(k1, k2, id, doc, start) of the windows through the anchors that column 3 of ``docs`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = byte_strings(batch.column(2))
            for lo, hi in chunks(texts):
                own = Passages(texts[lo:hi], hashes)
                starts = []
                for i, places in enumerate(batch.column(3).slice(lo, hi - lo)):
                    at = own.begin[i] + np.unique(places.values.to_numpy())
                    low, high = own.reach(at, length, seed)
                    many = high - low - length + 1
                    starts.append(np.unique(np.repeat(low, many) + np.arange(many.sum()) - np.repeat(starts_of(many)[:-1], many)))
                start = np.concatenate(starts)
                row = own.text_of[start]
                place = pa.array(row + lo)
                keys = [pa.array(h.of(start, start + length).view(np.int64)) for h in (own.first, own.second)]
                columns = [*keys, batch.column(0).take(place), batch.column(1).take(place), pa.array((start - own.begin[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "id", "doc", "start"])

    return docs.mapInArrow(run, f"k1 long, k2 long, id {kind}, doc long, start int")


def repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, seeds, starts) of each row, known by its key, that holds repeats: anchors whose whole reach repeats, and windows that do."""
    seed = min(SEED, length)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _row_key(docs, id_col, text_col).alias("doc"), F.col(text_col).alias("text")).where("id is not null")
    anchors = stored(_anchors(rows, kind, length, seed), "anchors")
    ends = anchors.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("around").alias("a0"), F.max("around").alias("a1"))
    seeds = ends.where("low < high").select("seed", (F.col("a0") < F.col("a1")).alias("several"))
    shared = stored(anchors.join(seeds, "seed"), "seeds")
    first = shared.groupBy("seed", "around").agg(F.min("id").alias("first"))
    placed = stored(shared.join(first, ["seed", "around"]).where("id > first or several").select("id", "doc", "at", (F.col("id") > F.col("first")).alias("whole")), "placed")
    open_ = placed.where("not whole").groupBy(F.col("doc").alias("open")).agg(F.collect_set("at").alias("places"))
    windows = rows.join(open_.hint("shuffle_hash"), F.col("doc") == F.col("open")).select("id", "doc", "text", "places")
    windows = stored(_windows(windows, kind, length, seed), "windows")
    least = windows.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("k1", "k2", "first")
    later = windows.join(least, ["k1", "k2"]).where("id > first").select("doc", F.lit(None).cast("int").alias("at"), "start")
    found = placed.where("whole").select("doc", "at", F.lit(None).cast("int").alias("start")).union(later)
    return found.groupBy("doc").agg(F.collect_set("at").alias("seeds"), F.collect_set("start").alias("starts"))


def spans(n_words: int, seeds: np.ndarray, starts: np.ndarray, length: int, seed: int) -> list[tuple[int, int]]:
    """Maximal stretches of repeated words."""
    low = np.concatenate([np.maximum(0, seeds - (length - seed)), starts])
    high = np.concatenate([np.minimum(n_words, seeds + length), starts + length])
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, high, -1)
    covered = np.concatenate([[0], np.cumsum(edges[:-1]) > 0, [0]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(covered))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their text as kept words joined by one space, and two columns more: ``n_words`` (before) and ``repeats`` (spans cut out).

    A null text stays null. Where a name is taken, underscores are added to the new one.
    """
    found = repeats(docs, length, id_col, text_col)
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), _row_key(docs, id_col, text_col)))
    joined = keyed.join(found.hint("shuffle_hash"), keyed[key] == found["doc"], "left").select(*[keyed[c] for c in docs.columns], "seeds", "starts")
    names = [*docs.columns, free_name(docs, "n_words"), free_name(docs, "repeats")]
    at, seed = docs.columns.index(text_col), min(SEED, length)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts, cut = [], [], []
            for text, seeds, starts in zip(batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                own = spans(len(words), *(x.values.to_numpy().astype(np.int64) for x in (seeds, starts)), length, seed) if seeds.is_valid else []
                cut.append([{"start": a, "end": b} for a, b in own])
                edges = [0, *(x for span in own for x in span), len(words)]
                left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                kept.append(b" ".join(left).decode() if text.is_valid else None)
            columns = batch.columns[:-2]
            columns[at] = pa.array(kept, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(cut, span_type)], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{fields}, `{names[-2]}` long, `{names[-1]}` array<struct<start:int,end:int>>")
