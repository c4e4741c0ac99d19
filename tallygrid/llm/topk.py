"""Exact top-k inner products by MaxScore, blocks of queries against shards of vectors.

Components are scaled and rounded down to whole numbers, so scores are exact. A query's terms are its dimensions. Within a shard a term's
contribution is counted from its smallest possible value, which makes it non-negative and bounds it by weight x spread. With a
threshold, the score of the k-th best row known so far, the terms with the smallest bounds are non-essential as long as their bounds
together stay below what is needed: a row that wins must get the rest from the essential terms. At least one of them then gives its
share, so their postings, sorted by value, are traversed only down to that share. The rows found are taken by falling partial scores;
non-essential terms are probed, largest bound first, for rows that are still competitive, and the threshold rises as rows are scored in
full. The first shard is searched before the others and gives each query a threshold for all of them. Shards give k rows each, which
are merged by rank.

Defined results: vectors that are null or hold a null or non-finite component, and rows without an id, take no part; every other row
does, also where ids repeat: each is a query, if asked for, and a candidate of every other one. A missing component of a shorter
vector is 0. Rows with components too large for sums of 64 bits are scored in unbounded whole numbers; a scaled component that passes
the doubles is held to the largest of them, and a score that passes a long is given as the limit of long, ranked by its full value.
Ties go to the smaller id; a query with fewer than k candidates gets all; an empty table gives no rows. Ids may be of any ordered type.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallygrid.llm.textkit import stored

SHARD_ROWS = 8192
QUERY_ROWS = 32768
STEP = 8
BLOCK = 256
LONG = 1 << 63
WIDE = 276  # bytes that hold any sum of products of doubles

Hit = tuple[int, int]


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, odd)


def _rows(blobs: list[bytes], width: int) -> np.ndarray:
    """Whole numbers as doubles; rows are cut or filled with zeros to the width."""
    size = 8 * width
    return np.frombuffer(b"".join(b[:size].ljust(size, b"\0") for b in blobs), "<f8").reshape(len(blobs), width)


def _unbounded(row: np.ndarray) -> list[int]:
    return [int(x) for x in row]


class Shard:
    """Vectors in the order of their ids, with postings of each dimension sorted by value; very large vectors apart."""

    def __init__(self, ids: list, rows: np.ndarray, blobs: list[bytes]):
        self.width = max(map(len, blobs)) // 8
        self.limit = isqrt((1 << 61) // max(1, self.width))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids, self.rows = [ids[i] for i in order], rows[order]
        self.vectors = _rows([blobs[i] for i in order], self.width)
        large = (np.abs(self.vectors) > self.limit).any(1)
        self.large, self.small = np.flatnonzero(large), np.flatnonzero(~large)
        self.values = np.ascontiguousarray(self.vectors[self.small].astype(np.int64).T)
        self.order = np.argsort(self.values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, 1)
        self.doubles, self.widest = self.values.astype(float), int(np.abs(self.values).max(initial=0))
        self.low, self.high = (self.sorted[:, 0], self.sorted[:, -1]) if len(self.small) else (None, None)
        self.probes = self.candidates = 0

    def best(self, row: int, blob: bytes, k: int, threshold: int | None = None) -> list[Hit]:
        """(score, place) of rows that reach the threshold, the best k of them; the query's own row is left out."""
        query = _rows([blob], self.width)[0]
        if (np.abs(query) > self.limit).any():
            hits = self._slow(query, np.arange(len(self.ids)), row)
        else:
            hits = self._slow(query, self.large, row) if len(self.large) else []
            if len(self.small):
                hits += self._max_score(query.astype(np.int64), row, k, threshold)
        return sorted(hits, key=lambda h: (-h[0], h[1]))[:k]

    def _slow(self, query: np.ndarray, places: np.ndarray, row: int) -> list[Hit]:
        weights = _unbounded(query)
        return [(sum(a * b for a, b in zip(weights, _unbounded(self.vectors[i]))), int(i)) for i in places if self.rows[i] != row]

    def _postings(self, term: int, weight: int, share: int) -> np.ndarray:
        """Rows to which a term gives its share or more."""
        if weight > 0:
            return self.order[term, np.searchsorted(self.sorted[term], self.low[term] + share // weight, "left") :]
        return self.order[term, : np.searchsorted(self.sorted[term], self.high[term] - share // -weight, "right")]

    def _max_score(self, weights: np.ndarray, row: int, k: int, threshold: int | None) -> list[Hit]:
        others = self.rows[self.small] != row
        # Doubles multiply faster and are exact as long as no sum passes 53 bits.
        exact = self.width * self.widest * int(np.abs(weights).max(initial=0)) < 1 << 53
        numbers, factors = (self.doubles, weights.astype(float)) if exact else (self.values, weights)
        n = int(others.sum())
        base = int(np.where(weights >= 0, weights * self.low, weights * self.high).sum())
        bounds = np.abs(weights) * (self.high - self.low)
        terms = np.argsort(bounds, kind="stable")
        below = np.concatenate([[0], np.cumsum(bounds[terms])])  # most that the first terms can give together
        top: list[Hit] = []

        def given(some: np.ndarray, places: np.ndarray) -> np.ndarray:
            """What some terms give to rows; for many rows a product with whole postings is cheaper than picking."""
            if 16 * len(places) > len(others):
                return (factors[some] @ numbers[some])[places].astype(np.int64)
            return (factors[some] @ numbers[some[:, None], places]).astype(np.int64)

        def scored(places: np.ndarray, scores: np.ndarray) -> None:
            nonlocal top, threshold
            top = sorted([*top, *zip(scores.tolist(), places.tolist())], key=lambda h: (-h[0], h[1]))[:k]
            if len(top) == k:
                threshold = top[-1][0] if threshold is None else max(threshold, top[-1][0])

        if threshold is None and n > 4 * k and len(terms):
            lead = int(terms[-1])
            ends = self.order[lead][::-1] if weights[lead] > 0 else self.order[lead]
            ends = ends[: 4 * k + 1]
            ends = ends[others[ends]]
            threshold = int(np.sort(factors @ numbers[:, ends])[-k])
        need = None if threshold is None else threshold - base
        cut = 0 if need is None or need <= 0 else int(np.searchsorted(below, need, "left")) - 1
        if cut == len(terms) and need is not None and need > 0:
            return []
        essential, optional = terms[cut:], terms[:cut][::-1]
        left = 0 if need is None else need - int(below[cut])
        total = int(bounds[essential].sum())
        if left <= 0 or total == 0:
            wanted = others
        else:
            lists = [self._postings(t, int(weights[t]), left * int(bounds[t]) // total) for t in essential.tolist()]
            if 2 * max(map(len, lists)) > len(others):
                wanted = others  # one list holds most rows already, so all are read at once
            else:
                wanted = np.zeros(len(others), bool)
                wanted[np.concatenate(lists)] = True
                wanted &= others
        places = np.flatnonzero(wanted)
        self.candidates += len(places)
        known = given(essential, places)
        after = [int(below[cut])]
        rest = np.where(weights[optional] >= 0, weights[optional] * self.low[optional], weights[optional] * self.high[optional])
        floors = [int(rest.sum())]
        for t, floor in zip(optional.tolist(), rest.tolist()):
            after.append(after[-1] - int(bounds[t]))
            floors.append(floors[-1] - floor)
        if threshold is not None:
            open_rows = known + floors[0] + after[0] >= threshold
            places, known = places[open_rows], known[open_rows]
        rank, at, size = np.argsort(-known, kind="stable"), 0, BLOCK
        while at < len(rank):
            own = rank[at : at + size]
            block, partial = places[own], known[own]
            at, size = at + size, len(rank)
            if threshold is not None and int(partial[0]) + floors[0] + after[0] < threshold:
                break
            for done in range(0, len(optional), STEP):
                if threshold is not None:
                    alive = partial + floors[done] + after[done] >= threshold
                    block, partial = block[alive], partial[alive]
                probe = optional[done : done + STEP]
                self.probes += len(block) * len(probe)
                partial = partial + given(probe, block)
            if threshold is not None:
                block, partial = block[partial >= threshold], partial[partial >= threshold]
            scored(self.small[block], partial)
        return top


def _beyond(score: int) -> bytes | None:
    """Order of scores that a long cannot hold."""
    return None if -LONG < score < LONG - 1 else (score + (1 << (8 * WIDE - 1))).to_bytes(WIDE, "big")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, kind, rows) of consecutive rows that share both."""
    for batch in batches:
        if batch.num_rows:
            cell, kind = (batch.column(i).to_numpy() for i in (0, 1))
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(cell)]
            for a, b in zip(edges, edges[1:]):
                yield int(cell[a]), int(kind[a]), batch.slice(a, b - a)


def _searched(rows: DataFrame, asked: DataFrame, shards: int, wanted: list[int], asking: int, k: int) -> DataFrame:
    """(ask, query_id, vec_id, score, beyond): the best rows of each wanted shard for each of ``asked`` (row, id, v, threshold)."""
    blocks = max(1, -(-asking // QUERY_ROWS))
    id_type = rows.schema["id"].dataType
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    held = rows.withColumn("shard", shard).where(F.col("shard").between(wanted[0], wanted[-1]))
    held = held.select("row", "id", "v", F.lit(None).cast("long").alias("threshold"), "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("kind"))
    asked = asked.select("row", "id", "v", "threshold", F.explode(F.sequence(F.lit(wanted[0]), F.lit(wanted[-1]))).alias("shard"), F.pmod(F.hash("row"), F.lit(blocks)).alias("block"), F.lit(1).alias("kind"))
    cells = held.union(asked).select((F.col("shard").cast("long") * blocks + F.col("block")).alias("cell"), "kind", "row", "id", "v", "threshold")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, held = None, None, []
        for cell, kind, part in _pieces(batches):
            if cell != at:
                at, shard, held = cell, None, []
            if kind == 0:
                held.append(part)
                continue
            if shard is None and held:
                whole = pa.Table.from_batches(held)
                shard, held = Shard(whole.column(3).to_pylist(), whole.column(2).to_numpy(), whole.column(4).to_pylist()), []
            if shard is None:
                continue
            found = [[], [], [], [], []]
            for row, own, blob, threshold in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5))):
                for score, place in shard.best(row, blob, k, threshold):
                    for column, value in zip(found, (row, own, shard.ids[place], max(-LONG, min(LONG - 1, score)), _beyond(score))):
                        column.append(value)
            kinds = (pa.int64(), part.column(3).type, part.column(3).type, pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], ["ask", "query_id", "vec_id", "score", "beyond"])

    kind = id_type.simpleString()
    dealt = cells.repartition(max(2, len(wanted) * blocks), "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, f"ask long, query_id {kind}, vec_id {kind}, score long, beyond binary")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``is_query`` holds."""
    valid = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    valid = valid.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector_col).cast("array<double>").alias("v"))
    kind, largest = valid.schema["id"].dataType.simpleString(), np.finfo(float).max

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                blobs = [np.clip(np.floor(np.array(v, "<f8") * scale), -largest, largest).tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["id", "asks", "v"])

    numbered = valid.mapInArrow(packed, f"id {kind}, asks boolean, v binary").withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered, "vectors")
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    shards = max(1, -(-total // SHARD_ROWS))
    asked = rows.where("asks").select("row", "id", "v", F.lit(None).cast("long").alias("threshold"))
    found = _searched(rows, asked, shards, [0], asking, k)
    if shards > 1:
        found = stored(found, "first-shard")
        full = found.groupBy("ask").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        # Scores held to the limits of long are no thresholds.
        full = full.where(F.col("least").between(1 - LONG, LONG - 2)).select(F.col("ask").alias("row"), "least")
        asked = asked.join(full, "row", "left").select("row", "id", "v", F.col("least").alias("threshold"))
        found = found.union(_searched(rows, asked, shards, list(range(1, shards)), asking, k))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
