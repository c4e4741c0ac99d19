"""Small helpers shared by the text operators: words, hashes, Arrow batches, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

MAX_CACHED_WORDS = 400_000
CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``, or in the warehouse folder where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which ends its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_strings(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text has a range of its own."""
    return ranges(map(len, texts), limit)


def ranges(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``limit`` at most; a larger item has a range of its own."""
    start = total = end = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
        end = i + 1
    if start < end:
        yield start, end


class WordHashes(dict):
    """64-bit hashes of words, remembered within a task up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def plain(words: list[bytes]) -> np.ndarray:
        """The same hashes, none of them remembered."""
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash, elementwise."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets at which consecutive runs of these lengths begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows with one value in the first column, as tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
