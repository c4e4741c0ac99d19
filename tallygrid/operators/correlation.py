"""Correlation: Pearson with interval, Spearman, partial, and the permutation test."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.distributions import Z975, t_two_sided
from tallygrid.operators.gram import complete_rows, moments, solve
from tallygrid.operators.ordered import average_ranks, row_numbers
from tallygrid.session import stored


def pearson_ci(df: DataFrame, x: str, y: str) -> DataFrame:
    """r, its Fisher-z 95 % interval and n; NULL when a column is constant."""
    both = complete_rows(df, [x, y])
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    one = both.agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.covar_pop(a, b).alias("c"),
        F.stddev_pop(a).alias("sx"),
        F.stddev_pop(b).alias("sy"),
    )
    raw = F.col("c") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0))
    r = one.select("n", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)).alias("clipped"), raw.alias("raw"))
    r = r.select("n", F.when(F.col("raw").isNotNull(), F.col("clipped")).alias("r"))
    half = F.when(F.col("n") > 3, F.lit(Z975) / F.sqrt(F.col("n") - 3))
    z = F.atanh("r")
    return r.select("n", "r", F.tanh(z - half).alias("ci_low"), F.tanh(z + half).alias("ci_high"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks with its t-based p-value.

    Pairs are counted first, ranks found per distinct value, and both joined; no
    window spans the whole table.
    """
    pairs = complete_rows(df, [x, y]).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w"))
    clean = complete_rows(df, [x, y])
    rx = average_ranks(clean.select(F.col(x).alias("x")), "x", "rx").select("x", "rx")
    ry = average_ranks(clean.select(F.col(y).alias("y")), "y", "ry").select("y", "ry")
    ranked = pairs.join(rx, "x").join(ry, "y")
    # Mean rank is (n+1)/2 for both, whatever the ties.
    n = pairs.agg(F.sum("w").alias("n"))
    d = ranked.withColumn("mid", (n.scalar() + 1) / F.lit(2.0))
    u, v, w = F.col("rx") - F.col("mid"), F.col("ry") - F.col("mid"), F.col("w")
    row = d.agg(F.sum(w).alias("n"), F.sum(w * u * v).alias("uv"), F.sum(w * u * u).alias("uu"), F.sum(w * v * v).alias("vv")).first()
    n, r, p = row["n"] or 0, None, None
    if n >= 2 and row["uu"] > 0 and row["vv"] > 0:
        r = max(-1.0, min(1.0, row["uv"] / math.sqrt(row["uu"] * row["vv"])))
        if n > 2:
            p = 0.0 if abs(r) == 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
    return df.sparkSession.createDataFrame([(int(n), r, p)], "n bigint, rho double, p double")


def partial_corr(df: DataFrame, y: str, x: str, controls: Sequence[str]) -> DataFrame:
    """Correlation of y and x after removing the controls from both; one pass.

    The residual cross-products are the Schur complement of the controls' block.
    """
    m = moments(df, [y, x, *controls])
    rest = m.cross[:2, :2]
    if controls:
        b = m.cross[:2, 2:]
        rest = rest - b @ solve(m.cross[2:, 2:], b.T)
    r = p = None
    if rest[0, 0] > 0 and rest[1, 1] > 0:
        r = float(rest[0, 1] / math.sqrt(rest[0, 0] * rest[1, 1]))
        # Two residual vectors of length n, correlated as plain samples.
        if m.n > 2:
            p = t_two_sided(r * math.sqrt((m.n - 2) / max(1 - r * r, 1e-300)), m.n - 2)
    return df.sparkSession.createDataFrame([(m.n, r, p)], "n bigint, r double, p double")


#: Pairs that a task makes, about.
PAIRED_ROWS = 1_000_000_000
#: Places of a tile, and of a row that carries a piece of it.
TILE = 1 << 22
PIECE = 1 << 16
#: Pairs that are worked on at a time, so that they stay in the processor's cache.
AT_ONCE = 1 << 15
#: Modulus of the arithmetic in a permutation's rounds; products of two remainders fit a long.
PRIME = (1 << 31) - 1
ROUNDS = 6


def _scrambled(v: Column, key: Column, let: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """A number below ``PRIME`` that depends on both in no simple way."""
    return let((v + key) % PRIME, lambda t: let((t * t + key * 48271 + v) % PRIME, lambda u: (u * u + 69621) % PRIME))


def _inline(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def permuted(df: DataFrame, pos: str, replicate: str, n: int, seed: int, out: str) -> DataFrame:
    """Add the place of ``pos`` in a permutation of 0 … n-1 that ``replicate`` and ``seed`` choose, by arithmetic alone.

    A place is written with two digits, of base a and b: b = ⌈√n⌉, and a the least with a·b ≥ n. Rounds add a scrambled digit to the
    other one in turn, which can be undone, so no two places meet. The few that leave the range are permuted until they return.
    """
    b = math.isqrt(n - 1) + 1 if n > 1 else 1
    a = -(-n // b)

    def keys(r: int | Column) -> Column:
        return (F.col(replicate).cast("long") * 1_000_003 + seed % PRIME + r * 7_368_787) % PRIME

    def once(left: Column, right: Column, let, r: int = 0) -> Column:
        if r == ROUNDS:
            return left * b + right
        if r % 2:
            return let((right + _scrambled(left, keys(r), let)) % b, lambda new: once(left, new, let, r + 1))
        return let((left + _scrambled(right, keys(r), let)) % a, lambda new: once(new, right, let, r + 1))

    steps = []

    def column(value: Column, then: Callable[[Column], Column]) -> Column:
        """Each step is a column of its own, so that it is computed once."""
        nonlocal df
        steps.append(f"__step{len(steps)}")
        df = df.withColumn(steps[-1], value)
        return then(F.col(steps[-1]))

    high = lambda p: ((p - p % b) / b).cast("long")
    place = F.col(pos).cast("long")
    moved = once(high(place), place % b, column)
    df = df.withColumn(out, moved)
    if a * b > n:
        # So many times that a place is still outside with a probability below 1e-18.
        times = math.ceil(math.log(1e-18) / math.log(1 - n / (a * b)))

        def walked(state: Column, i: Column) -> Column:
            left, right, r = state["left"], state["right"], i % ROUNDS
            done = state["done"] | ((r == 0) & (left * b + right < n))
            odd = r % 2 == 1
            mixed = _scrambled(F.when(odd, left).otherwise(right), keys(r), _inline)
            new_left = F.when(done | odd, left).otherwise((left + mixed) % a)
            new_right = F.when(done | ~odd, right).otherwise((right + mixed) % b)
            return F.struct(new_left.alias("left"), new_right.alias("right"), done.alias("done"))

        start = F.struct(high(F.col(out)).alias("left"), (F.col(out) % b).alias("right"), F.lit(False).alias("done"))
        lost = F.raise_error(F.lit("a place did not return")).cast("long")
        back = F.aggregate(F.sequence(F.lit(0), F.lit(times * ROUNDS - 1)), start, walked, lambda s: s["left"] * b + s["right"])
        df = df.withColumn(out, F.when(F.col(out) < n, F.col(out)).otherwise(_inline(back, lambda p: F.when(p < n, p).otherwise(lost))))
    # A column that is never null: a filter for nulls would be pushed below the steps and repeat them in one expression.
    return df.withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("long"))).drop(*steps)


class Grid:
    """Places 0 … n-1 as rows of a grid: ``a`` rows of ``b`` places, of which the last row may lack some. Tables of a permutation's rounds."""

    def __init__(self, n: int, seed: int):
        self.n, self.seed = n, seed
        self.b = math.isqrt(n - 1) + 1 if n > 1 else 1
        self.a = -(-n // self.b)

    def rounds(self, replicate: int) -> list[np.ndarray]:
        """What each round adds to a digit, by the other digit (see ``permuted``).

        Digits are not reduced between rounds but grow by one base each time; the tables repeat as often as that asks for.
        """
        tables = []
        for r in range(ROUNDS):
            own, other = (self.a, self.b) if r % 2 else (self.b, self.a)
            key = (replicate * 1_000_003 + self.seed % PRIME + r * 7_368_787) % PRIME
            v = np.arange(own, dtype=np.int64)
            t = (v + key) % PRIME
            u = (t * t + key * 48271 + v) % PRIME
            tables.append(np.tile((u * u + 69621) % PRIME % other, (r + 3) // 2))
        return tables

    def returned(self, tables: list[np.ndarray]) -> np.ndarray:
        """Where the places from n to the end of the last row lead, after as many permutations as bring them below n.

        Those that come round to themselves without (no place below n leads there) stay.
        """
        at = np.arange(self.n, self.a * self.b)
        out = np.arange(len(at))
        where = at.copy()
        while len(out):
            left, right = np.divmod(where[out], self.b)
            for r, table in enumerate(tables):
                if r % 2:
                    right = (right + table[left]) % self.b
                else:
                    left = (left + table[right]) % self.a
            where[out] = left * self.b + right
            out = out[(where[out] >= self.n) & (where[out] != at[out])]
        return where

    def sums(self, replicates: Sequence[int], x: np.ndarray, x_row: int, y: np.ndarray, y_row: int) -> np.ndarray:
        """Sum over places of x · y at the permuted place, for each replicate; of those in the rows of x that go to the rows of y.

        ``x`` and ``y`` are whole rows from ``x_row`` and ``y_row`` on, with zeros where there is no place.
        """
        a, b, n = self.a, self.b, self.n
        x_rows, y_rows = len(x) // b, len(y) // b
        # After the rows of y follow one of zeros, for places of other rows, and the last row of the grid, if it is another.
        held = np.concatenate([y, np.zeros(2 * b)])
        home = np.full(a, y_rows * b)
        home[y_row : y_row + y_rows] = np.arange(y_rows) * b
        if y_row + y_rows < a:
            home[a - 1] = (y_rows + 1) * b
        tail = slice(home[a - 1] + n - (a - 1) * b, home[a - 1] + b)
        starts, ends = np.tile(home, 4), np.tile(np.arange(b), 4)
        step = max(1, AT_ONCE // b)
        rows, columns = np.arange(x_row, x_row + x_rows)[:, None], np.arange(b)[None, :]
        left, right, added = (np.empty((step, b), np.int64) for _ in range(3))
        met = np.empty((step, b))
        out = np.zeros(len(replicates))
        for i, replicate in enumerate(replicates):
            tables = self.rounds(replicate)
            to = self.returned(tables)
            inside = (to >= y_row * b) & (to < (y_row + y_rows) * b)
            held[tail] = np.where(inside, y[np.where(inside, to - y_row * b, 0)], 0.0)
            total = 0.0
            for at in range(0, x_rows, step):
                m = min(step, x_rows - at)
                l, r, t, v = left[:m], right[:m], added[:m], met[:m]
                np.add(rows[at : at + m], tables[0], out=l)
                np.take(tables[1], l, out=r, mode="clip")
                r += columns
                for number in range(2, ROUNDS):
                    moved, by = (r, l) if number % 2 else (l, r)
                    np.take(tables[number], by, out=t, mode="clip")
                    moved += t
                np.take(starts, l, out=t, mode="clip")
                np.take(ends, r, out=l, mode="clip")
                t += l
                np.take(held, t, out=v, mode="clip")
                total += float(x[at * b : (at + m) * b] @ v.ravel())
            out[i] = total
        return out


def permuted_sums(placed: DataFrame, n: int, B: int, seed: int, tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """(b, s) from (pos, x, y): the sum of x · y at the permuted place for each of B replicates.

    A task holds some replicates, a tile of x and a tile of y. The arithmetic is that of ``permuted``, with the rounds of a replicate in tables
    of about √n numbers. Pieces of x and y travel as bytes, not row by row.
    """
    spark = placed.sparkSession
    grid = Grid(n, seed)
    piece_rows = max(1, piece // grid.b)
    size = piece_rows * grid.b
    per_tile = max(1, tile // size)
    tiles = -(-(-(-n // size)) // per_tile)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        at = rows.column("pos").to_numpy() - key[0].as_py() * size
        parts = []
        for name in ("x", "y"):
            values = np.zeros(size)
            values[at] = rows.column(name).to_numpy()
            parts.append(values.tobytes())
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "x": pa.array([parts[0]], pa.binary()), "y": pa.array([parts[1]], pa.binary())})

    pieces = placed.withColumn("piece", F.floor(F.col("pos") / F.lit(size))).groupBy("piece").applyInArrow(pack, "piece long, x binary, y binary")
    pieces = stored(pieces, "places").withColumn("own", F.floor(F.col("piece") / F.lit(per_tile)))
    groups = max(1, min(B, max(4 * spark.sparkContext.defaultParallelism, min(n, tile) * B // PAIRED_ROWS)))
    numbered = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    sides = [
        pieces.select(F.lit(side).alias("side"), "piece", F.col(side).alias("v"), F.col("own").alias(own), numbered(tiles).alias(other)).select("side", "piece", "v", "i", "j")
        for side, own, other in (("x", "i", "j"), ("y", "j", "i"))
    ]
    sent = sides[0].unionByName(sides[1]).withColumn("g", numbered(groups))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        g = key[0].as_py()
        held = {}
        for side, number, data in zip(*(rows.column(c).to_pylist() for c in ("side", "piece", "v"))):
            held.setdefault(side, []).append((number, data))
        x, y = (np.concatenate([np.frombuffer(data) for _, data in sorted(held[side])]) for side in ("x", "y"))
        first = [min(held[side])[0] * piece_rows for side in ("x", "y")]
        # The last piece is filled up to whole pieces; the grid ends before.
        x, y = (v[: (grid.a - row) * grid.b] for v, row in zip((x, y), first))
        replicates = range(g, B, groups)
        return pa.table({"b": pa.array(list(replicates), pa.int64()), "s": pa.array(grid.sums(replicates, x, first[0], y, first[1]))})

    keys = ["g", "i", "j"]
    cells = sent.repartition(groups * tiles * tiles, *keys).groupBy(*keys).applyInArrow(run, "b long, s double")
    return cells.groupBy("b").agg(F.sum("s").alias("s"))


def permutation_corr_test(df: DataFrame, x: str, y: str, row_id: str, B: int = 10_000, seed: int = 123) -> DataFrame:
    """Two-sided permutation p-value of Pearson's r: (1 + #{|r*| ≥ |r|}) / (B + 1).

    Rows are numbered along ``row_id`` once. In each of B replicates the row at place i meets the y at place π(i), where π is a keyed
    bijection that is computed and not sorted (see ``permuted``). At every size the pairs are met and summed inside tasks that hold
    a tile of each side (see ``permuted_sums``); pairs are never rows.
    """
    both = complete_rows(df, [x, y]).select(
        F.col(row_id).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    m = moments(both, ["x", "y"])
    scale = math.sqrt(m.cross[0, 0] * m.cross[1, 1])
    schema = "n bigint, r double, B int, p double"
    spark = df.sparkSession
    if m.n < 2 or scale == 0:
        return spark.createDataFrame([(m.n, None, B, None)], schema)
    r = float(m.cross[0, 1] / scale)
    limit = abs(m.cross[0, 1]) * (1 - 1e-12)
    centred = both.select("id", (F.col("x") - float(m.mean[0])).alias("x"), (F.col("y") - float(m.mean[1])).alias("y"))
    placed = row_numbers(centred, "id", "pos").select((F.col("pos") - 1).alias("pos"), "x", "y")
    hits = permuted_sums(placed, m.n, B, seed).filter(F.abs("s") >= limit).count()
    return spark.createDataFrame([(m.n, r, B, (1 + hits) / (B + 1))], schema)
