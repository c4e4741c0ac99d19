"""Exact nearest neighbours in a metric space, without scoring all pairs.

Train rows belong to the cell of their nearest pivot, a row drawn by hash. Of a cell the count and the least and largest distance to its
pivot are known. By the triangle inequality these bound a query's distance to every row of the cell from below, and so does the
border between the cell and the query's own one. A query first searches the cell of its nearest pivot. The k-th distance found there
then says which other cells can hold a neighbour, and only these are visited; inside a cell only the rows are scored whose distance to
the pivot differs from the query's by no more. A query that finds fewer than k rows (its own fold may fill the cell) goes on to the next
cells, four times as many in each round, until it has k or has seen all. Bounds carry a margin for rounding, and equal distances pass,
so results and ties are those of a full search.

Where the bounds leave most cells, as in many dimensions, and the metric is Euclidean, blocks of queries meet blocks of train rows instead: a query is
sent once for each block, not for each cell. Euclidean distances are first taken as matrix products in single precision; what lies within their
rounding error of the k best is computed anew by the metric's own sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.operators.windows import nearest_rank
from tallygrid.session import stored

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]

MAX_PIVOTS = 2048
PIVOT_BYTES = 8 << 20
SCORES = 500_000
PARTS = 16
WIDEN = 4
#: Above this share of the cells, blocks are cheaper than visits: sending a query takes as long as some thousand products.
MOST = 0.25
BLOCK_NUMBERS = 1 << 22
CHUNK, ASKED, LANES = 4096, 512, 64


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


class Pivots:
    """Pivot points, and of the rows nearest to each: how many, and how near and far they lie."""

    def __init__(self, points: np.ndarray, metric: Metric, straight: bool = False):
        self.points, self.metric, self.straight = points, metric, straight
        self.count = np.zeros(len(points), np.int64)
        self.near, self.far = np.full(len(points), np.inf), np.zeros(len(points))

    def __getstate__(self) -> dict:
        return {key: value for key, value in self.__dict__.items() if key != "gaps"}

    @cached_property
    def gaps(self) -> np.ndarray:
        return self.metric(self.points, self.points)

    def _pieces(self, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        step = max(1, SCORES // len(self.points))
        for at in range(0, len(vectors), step):
            piece = slice(at, min(at + step, len(vectors)))
            yield piece, self.metric(vectors[piece], self.points)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row, and its distance to the pivot."""
        cell, away = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        for piece, d in self._pieces(vectors):
            cell[piece] = d.argmin(1)
            away[piece] = d.min(1)
        return cell, away

    def hold(self, cell: int, count: int, near: float, far: float) -> None:
        self.count[cell], self.near[cell], self.far[cell] = count, near, far

    def least(self, d: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance to any row of each cell, from the distances to the pivots."""
        home = d.argmin(1)
        own = np.take_along_axis(d, home[:, None], 1)
        low = np.maximum(np.maximum(d - self.far, self.near - d), (d - own) / 2)
        if self.straight:
            # Rows of a cell lie beyond the plane between its pivot and the query's.
            gap, square = self.gaps[home], d * d
            over = square - own * own - 1e-12 * (square + self.far * self.far)
            low = np.maximum(low, np.divide(over, 2 * gap, out=np.zeros_like(d), where=gap > 0))
        return low - 1e-9 * (d + self.far)

    def visits(self, queries: np.ndarray, bound: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, cell, distance to the pivot) of the cells to search.

        Cells count from the nearest pivot on: ``first`` to ``last`` for a query without a bound, else all from ``first`` on that
        may hold a row within the bound.
        """
        found = []
        for piece, d in self._pieces(queries):
            own = bound[piece, None]
            if first == 0 and last >= len(self.points):
                wanted = np.ones(d.shape, bool)
            else:
                rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
                wanted = (rank >= first) & ((rank < last) | np.isfinite(own))
            wanted &= (self.least(d) <= own) & (self.count > 0)
            row, cell = np.nonzero(wanted)
            found.append((row + piece.start, cell, d[row, cell]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def drawn(train: DataFrame, cells: int, dims: int, metric: Metric, straight: bool) -> Pivots:
    """Up to ``cells`` different train rows, by hash of the id: at most ``MAX_PIVOTS``, and ``PIVOT_BYTES`` of numbers."""
    cells = max(1, min(cells, MAX_PIVOTS, PIVOT_BYTES // (8 * max(1, dims))))
    if cells == 1:
        return Pivots(np.zeros((1, dims)), metric, straight)
    rows = train.select("v", F.xxhash64(F.lit("pivot"), "id").alias("h")).orderBy("h").limit(cells).collect()
    return Pivots(np.unique(np.array([r["v"] for r in rows], float), axis=0), metric, straight)


def _enough(train: DataFrame, k: int) -> DataFrame:
    """Of equal vectors, the rows that can be among k neighbours.

    A query leaves out at most one value of ``ex``. With k rows of each value kept, the first 2k by id hold k of the others.
    """
    if "ex" in train.columns:
        train = nearest_rank(train.withColumn("__k", F.struct("v", "ex")), "__k", "id", "id", k).drop("rank", "__k")
    return nearest_rank(train, "v", "id", "id", 2 * k).drop("rank")


def _listed(numbers: Sequence[int], at: str) -> Column:
    return F.get(F.expr("array(" + ", ".join(str(int(n)) for n in numbers) + ")"), F.col(at))


class Products:
    """Train rows of a cell in chunks by their distance to the pivot, as matrices whose product with a query ranks its squared distances."""

    def __init__(self, rows: np.ndarray, away: np.ndarray, ex: np.ndarray | None, queries: np.ndarray):
        self.rows, self.centre = rows, rows.mean(0)
        moved = rows - self.centre
        norms = (moved * moved).sum(1)
        self.longest, self.largest = math.sqrt(norms.max()), math.sqrt((rows * rows).sum(1).max())
        # Single precision where it holds the squares and a far row does not make its error large for all others.
        usual, asked = math.sqrt(np.median(norms)), np.abs(queries).max()
        self.kind = np.float32 if 1e-15 < self.longest < min(1e15, 100 * usual) and asked < 1e15 else np.float64
        by_away = np.argsort(away, kind="stable")
        self.chunks = []
        for at in range(0, len(rows), CHUNK):
            own = by_away[at : at + CHUNK]
            span = away[own[0]], away[own[-1]]
            if ex is not None:
                own = own[np.argsort(ex[own], kind="stable")]
            # Lanes are filled up with rows that are infinitely far.
            t = np.zeros((-(-len(own) // LANES) * LANES, rows.shape[1] + 1), self.kind)
            t[:, -1] = np.inf
            t[: len(own), :-1], t[: len(own), -1] = -2 * moved[own], norms[own]
            self.chunks.append((own, span, t, None if ex is None else ex[own]))

    def candidates(self, queries: np.ndarray, bound: np.ndarray, asks: np.ndarray, reach: np.ndarray, ex: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all pairs that can be among the query's k nearest within its bound; few others."""
        moved = queries - self.centre
        norms = (moved * moved).sum(1)
        q = np.concatenate([moved, np.ones((len(moved), 1))], 1).astype(self.kind)
        size = np.sqrt(norms) + self.longest
        error = (moved.shape[1] + 8) * float(np.finfo(self.kind).eps) * size * size + 1e-12 * (np.sqrt((queries * queries).sum(1)) + self.largest) ** 2
        cap = bound * bound - norms
        best = np.full((len(q), k), np.inf)
        found = []
        low, high = (asks - reach).min(), (asks + reach).max()
        for own, (near, far), t, values in self.chunks:
            if far < low or near > high:
                continue
            scores = q @ t.T
            if values is not None:
                for i, (lo, hi) in enumerate(zip(np.searchsorted(values, ex, "left").tolist(), np.searchsorted(values, ex, "right").tolist())):
                    if lo < hi:
                        scores[i, lo:hi] = np.inf
            lanes = scores.reshape(len(q), LANES, -1)
            least = lanes.min(1)
            # The k-th of the lanes' least scores bounds the k-th score.
            best = np.partition(np.concatenate([best, least], 1), k - 1, axis=1)[:, :k]
            limit = np.minimum(best.max(1), cap) + 2 * error
            row, lane = np.nonzero((least <= limit[:, None]) & np.isfinite(least))
            picked = lanes[row, :, lane]
            at, place = np.nonzero((picked <= limit[row, None]) & np.isfinite(picked))
            found.append((row[at], own[place * lanes.shape[2] + lane[at]], picked[at, place]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, col, score = (np.concatenate(part) for part in zip(*found))
        kept = score <= (np.minimum(best.max(1), cap) + 2 * error)[row]
        return row[kept], col[kept]


def _pair_distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distance of each row of ``q`` to the same row of ``t``: sums over dimensions in the order in which ``nearest.euclidean`` has them."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = q[:, j] - t[:, j]
        total += gap * gap
    return np.sqrt(total)


def _scored(k: int, metric: Metric, straight: bool, carry: Sequence[str], exclude: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    names = ["qid", "tid", "d", *carry]

    def by_products(qp: pd.DataFrame, tp: pd.DataFrame, tv: np.ndarray, qv: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asks, bound, away = qp["away"].to_numpy(), qp["bound"].to_numpy(), tp["away"].to_numpy()
        reach = bound + 1e-9 * (bound + asks + away.max())
        codes = qx = None
        if exclude:
            codes, kinds = pd.factorize(tp["ex"], sort=False)
            qx = pd.Index(kinds).get_indexer(qp["ex"])
            qx[qx < 0] = -2
        products = Products(tv, away, codes, qv)
        for at in range(0, len(qv), ASKED):
            piece = slice(at, at + ASKED)
            row, col = products.candidates(qv[piece], bound[piece], asks[piece], reach[piece], None if qx is None else qx[piece], k)
            d = np.concatenate([np.zeros(0), *(_pair_distances(qv[row[p : p + 50_000] + at], tv[col[p : p + 50_000]]) for p in range(0, len(row), 50_000))])
            inside = d <= bound[row + at]
            yield row[inside] + at, col[inside], d[inside]

    def by_metric(qp: pd.DataFrame, tp: pd.DataFrame, tv: np.ndarray, qv: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        by_away = np.argsort(tp["away"].to_numpy(), kind="stable")
        away, asks, bound = tp["away"].to_numpy()[by_away], qp["away"].to_numpy(), qp["bound"].to_numpy()
        reach = bound + 1e-9 * (bound + asks + away[-1])
        step = max(1, SCORES // len(tv))
        for at in range(0, len(qv), step):
            piece = slice(at, at + step)
            lo = np.searchsorted(away, (asks[piece] - reach[piece]).min(), "left")
            hi = np.searchsorted(away, (asks[piece] + reach[piece]).max(), "right")
            if lo >= hi:
                continue
            near = np.sort(by_away[lo:hi])
            d = metric(qv[piece], tv[near])
            d[d > bound[piece, None]] = np.inf
            if exclude:
                d[qp["ex"].to_numpy()[piece, None] == tp["ex"].to_numpy()[None, near]] = np.inf
            edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(near) else np.inf
            row, col = np.nonzero((d <= edge) & np.isfinite(d))
            yield row + at, near[col], d[row, col]

    def best(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        if qp.empty or tp.empty:
            return pd.DataFrame(columns=names)
        qp = qp.sort_values("away", kind="stable").reset_index(drop=True)
        tp = tp.sort_values("id", kind="stable").reset_index(drop=True)
        tv, qv = matrix(tp["v"]), matrix(qp["v"])
        parts = []
        way = by_products if straight and max(np.abs(tv).max(initial=0), np.abs(qv).max(initial=0)) < 1e100 and tv.shape[1] else by_metric
        for row, col, d in way(qp, tp, tv, qv):
            order = np.lexsort((col, d, row))
            row, col, d = row[order], col[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, "left")
            row, col, d = row[place < k], col[place < k], d[place < k]
            picked = tp.iloc[col]
            frame = {"qid": qp["id"].to_numpy()[row], "tid": picked["id"].to_numpy(), "d": d}
            parts.append(pd.DataFrame(frame | {c: picked[c].to_numpy() for c in carry}))
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    return best


def _round(train: DataFrame, asks: DataFrame, pivots: Pivots, first: int, last: int, k: int, carry: Sequence[str], train_rows: int, query_rows: int, out: str) -> DataFrame | None:
    """Rows found in the cells of this round, at most k for each query and part of a cell; None where blocks of all rows are cheaper."""
    names = [*asks.columns, "cell", "away"]

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cells, n = np.unique(pivots.visits(matrix(f["v"]), f["bound"].to_numpy(), first, last)[1], return_counts=True)
                yield pd.DataFrame({"cell": cells, "n": n})

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                row, cell, away = pivots.visits(matrix(f["v"]), f["bound"].to_numpy(), first, last)
                for at in range(0, len(row), 50_000):
                    piece = slice(at, at + 50_000)
                    yield f.iloc[row[piece]].assign(cell=cell[piece], away=away[piece])[names]

    asked = np.zeros(len(pivots.points), np.int64)
    if len(asked) == 1:
        asked[0] = asks.count()
    else:
        for cell, n in asks.select("v", "bound").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
            asked[cell] = n
        if first == 1 and pivots.straight and asked.sum() > MOST * len(asked) * asks.count():
            return None
    parts, copies = -(-pivots.count // train_rows), -(-asked // query_rows)
    groups = int((parts * copies).sum())
    tasks = max(1, min(groups, max(int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 32)))

    def every(numbers: Sequence[int]) -> Column:
        return F.explode(F.filter(F.sequence(F.lit(0), _listed(numbers, "cell")), lambda i: i < _listed(numbers, "cell")))

    def share(numbers: Sequence[int]) -> Column:
        return F.pmod(F.xxhash64("id"), _listed(np.maximum(numbers, 1), "cell")).cast("int")

    kinds = ", ".join(f"{c} {kind}" for c, kind in asks.dtypes) + ", cell int, away double"
    left = asks.mapInPandas(sent, kinds).withColumn("part", every(parts)).withColumn("copy", share(copies))
    right = train.withColumn("part", share(parts)).withColumn("copy", every(copies))
    keys = ["cell", "part", "copy"]
    left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right).applyInPandas(_scored(k, pivots.metric, pivots.straight, carry, "ex" in asks.columns), out)


def pivot_search(
    train: DataFrame, query: DataFrame, k: int, metric: Metric, metric_space: bool, straight: bool, carry: Sequence[str], train_rows: int, query_rows: int
) -> DataFrame:
    """(qid, rank, tid, d, carried columns) from (id, v, carried columns, ex) and (id, v, ex); ``ex`` may be absent.

    Vectors that are null or hold a null or non-finite number take no part. Without ``metric_space`` there is one cell, and all
    pairs are scored.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    train, query = (df.filter(F.col("v").isNotNull() & ~F.exists("v", odd)) for df in (train, query))
    kinds = dict(train.dtypes)
    out = f"qid {dict(query.dtypes)['id']}, tid {kinds['id']}, d double" + "".join(f", {c} {kinds[c]}" for c in carry)
    kept = stored(_enough(train, k), "neighbour-rows")
    rows, dims = kept.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not rows:
        return nearest_rank(train.sparkSession.createDataFrame([], out), "qid", "d", "tid", k)
    pivots = drawn(kept, math.ceil(rows / train_rows) if metric_space else 1, dims, metric, straight)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cell, away = pivots.place(matrix(f["v"]))
                yield f.assign(cell=cell, away=away)

    if len(pivots.points) == 1:
        cells = kept.withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
        pivots.hold(0, rows, 0.0, math.inf)
    else:
        cells = stored(kept.mapInPandas(placed, ", ".join(f"{c} {kind}" for c, kind in kept.dtypes) + ", cell int, away double"), "neighbour-cells")
        for row in cells.groupBy("cell").agg(F.count(F.lit(1)), F.min("away"), F.max("away")).collect():
            pivots.hold(*row)
    asks = query.withColumn("bound", F.lit(float("inf")))
    found, first, last, total = [], 0, 1, len(pivots.points)
    while True:
        part = _round(cells, asks, pivots, first, last, k, carry, PARTS * train_rows, query_rows, out)
        if part is None:
            whole = Pivots(np.zeros((1, dims)), metric, straight)
            whole.hold(0, rows, 0.0, math.inf)
            block = max(train_rows, BLOCK_NUMBERS // dims)
            part = _round(kept.withColumns({"cell": F.lit(0), "away": F.lit(0.0)}), asks, whole, 0, 1, k, carry, block, block, out)
            return nearest_rank(part, "qid", "d", "tid", k)
        if last >= total and not found:
            return nearest_rank(part, "qid", "d", "tid", k)
        found.append(stored(part, "neighbours"))
        asks = asks.filter(F.col("bound") == F.lit(float("inf")))
        if last >= total or asks.isEmpty():
            return nearest_rank(reduce(DataFrame.unionByName, found), "qid", "d", "tid", k)
        best = nearest_rank(reduce(DataFrame.unionByName, found).select("qid", "tid", "d"), "qid", "d", "tid", k)
        full = best.groupBy("qid").agg(F.max("d").alias("edge"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        asks = asks.join(full, F.col("id") == F.col("qid"), "left").withColumn("bound", F.coalesce("edge", "bound")).select(*asks.columns)
        asks = stored(asks, "asking")
        first, last = last, min(total, last * WIDEN)


__all__ = ["MAX_PIVOTS", "Pivots", "matrix", "pivot_search"]
