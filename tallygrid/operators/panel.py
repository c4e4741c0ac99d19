"""Two-way fixed effects for (entity, period) panels, balanced or not.

Entity effects are swept out by means. Period effects solve the equations that remain, by conjugate gradients whose only operator
is a pass of grouped sums over the cells: there is no matrix of periods. After that a single aggregate per entity gives slope,
errors and effects: rows are never joined back to their means, and a hot entity combines map-side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions.distributions import t_quantile, t_two_sided
from tallygrid.operators.gram import complete_rows
from tallygrid.session import stored


@dataclass(frozen=True)
class PanelFit:
    beta: float
    se: float
    n: int
    n_entities: int
    n_periods: int
    r2_within: float
    periods: list
    period_effects: np.ndarray
    entities: DataFrame
    entity: str


#: Relative size of the residual at which the iterations end, and the most iterations.
TOLERANCE = 1e-13
MAX_STEPS = 2000


def _grouped_operator(vectors: DataFrame, t: int) -> Callable[[np.ndarray], np.ndarray]:
    """v -> n_t v_t - sum over entities of n_et * (mean of v over the entity's rows), for columns v of period values.

    One pass over a row per entity, each as long as the entity has periods; a task returns one number per period and column.
    """

    def apply(v: np.ndarray) -> np.ndarray:
        k = v.shape[1]

        def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((t, k))
            for part in batches:
                sizes = part["t"].map(len).to_numpy()
                if not len(sizes):
                    continue
                at, n = (np.concatenate(part[c].to_list()) for c in ("t", "n"))
                n = n.astype(float)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total = np.bincount(owner, n)
                for c in range(k):
                    mean = np.bincount(owner, n * v[at, c]) / total
                    out[:, c] += np.bincount(at, n * (v[at, c] - mean[owner]), t)
            pos, col = np.nonzero(out)
            yield pd.DataFrame({"pos": pos, "col": col, "v": out[pos, col]})

        result = np.zeros((t, k))
        for r in vectors.mapInPandas(add_up, "pos bigint, col bigint, v double").groupBy("pos", "col").agg(F.sum("v").alias("v")).collect():
            result[r["pos"], r["col"]] = r["v"]
        return result

    return apply


def _conjugate_gradients(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Solve apply(x) = b for each column of b, scaled by the diagonal, all columns in one pass per step.

    The matrix is singular (constants over connected entities); b lies in its range, and so do all iterates.
    """
    x, r = np.zeros_like(b), b.copy()
    scale = np.sqrt((b * b / diagonal[:, None]).sum(0))
    z = r / diagonal[:, None]
    p, rz = z.copy(), (r * z).sum(0)
    for _ in range(MAX_STEPS):
        open_ = np.sqrt(np.maximum(rz, 0)) > TOLERANCE * scale
        if not open_.any():
            return x
        ap = apply(p)
        curve = (p * ap).sum(0)
        open_ &= curve > 0
        step = np.where(open_, rz / np.where(open_, curve, 1), 0)
        x, r = x + step * p, r - step * ap
        z = r / diagonal[:, None]
        new = (r * z).sum(0)
        p = np.where(open_, z + np.where(open_, new / np.where(rz > 0, rz, 1), 0) * p, 0)
        rz = np.where(open_, new, 0)
    raise ArithmeticError(f"period effects did not settle in {MAX_STEPS} steps")


def fit_panel(df: DataFrame, y: str, x: str, entity: str, period: str, factor: float = 1.0) -> PanelFit:
    """Period effects by conjugate gradients over grouped sums; any number of periods, balanced or not.

    The driver holds a few numbers per period. Cells of (entity, period) are counted once and stored for the iterations.
    """
    d = complete_rows(df, [x, y]).dropna(subset=[entity, period])
    per = d.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"))
    found = sorted(per.collect(), key=lambda r: r[0])
    if not found:
        raise ValueError("no complete rows")
    spark, periods, t = df.sparkSession, [r[0] for r in found], len(found)
    total = sum(r["n"] for r in found)
    centre = {c: sum(r[c] for r in found) / total for c in ("x", "y")}
    kind = d.schema[period].dataType.simpleString()

    def with_periods(**values: Sequence) -> DataFrame:
        """The rows with further columns of their period, by a join with a table of one row per period."""
        names = list(values)
        kinds = ", ".join(f"{n} {'int' if n == '__t' else 'double'}" for n in names)
        table = spark.createDataFrame(list(zip(periods, *(list(values[n]) for n in names))), f"__p {kind}, {kinds}")
        here = (F.col(x) - F.lit(centre["x"])).alias("__x"), (F.col(y) - F.lit(centre["y"])).alias("__y")
        return d.select(entity, F.col(period).alias("__p"), *here).join(table, "__p").drop("__p")

    cells = with_periods(__t=range(t)).groupBy(entity, "__t").agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"))
    vectors = cells.groupBy(entity).agg(F.collect_list(F.struct("__t", "n", "sx", "sy")).alias("c"))
    part = lambda c: F.aggregate(f"c.{c}", F.lit(0.0), lambda a, v: a + v)
    sums = F.struct(part("sx").alias("x"), part("sy").alias("y"), F.aggregate("c.n", F.lit(0).cast("long"), lambda a, v: a + v).alias("n"))
    vectors = stored(vectors.select(F.col("c.__t").alias("t"), F.col("c.n").alias("n"), F.col("c.sx").alias("sx"), F.col("c.sy").alias("sy"), sums.alias("s")), "panel-cells")
    dx, dy = np.zeros(t), np.zeros(t)
    if t > 1:
        own = vectors.select(F.inline(F.arrays_zip("t", "n", "sx", "sy")), "s").groupBy("t").agg(
            F.sum("n").alias("n"), *[F.sum(F.col(f"s{c}") - F.col("n") * F.col(f"s.{c}") / F.col("s.n")).alias(c) for c in ("x", "y")]
        )
        b, diagonal = np.zeros((t, 2)), np.ones(t)
        for r in own.collect():
            b[r["t"]], diagonal[r["t"]] = (r["x"], r["y"]), r["n"]
        # The first period is the base.
        solved = _conjugate_gradients(_grouped_operator(vectors.select("t", "n"), t), b, diagonal)
        dx, dy = (solved - solved[0]).T
    rows = with_periods(__dx=dx.tolist(), __dy=dy.tolist())
    gx, gy = F.col("__x") - F.col("__dx"), F.col("__y") - F.col("__dy")
    cov = {
        "xx": (gx, gx), "xy": (gx, gy), "wxx": (F.col("__x"), F.col("__x")),
        "wxy": (F.col("__x"), F.col("__y")), "wyy": (F.col("__y"), F.col("__y")),
    }
    per_entity = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(gx).alias("gx"),
        F.avg(gy).alias("gy"),
        *[(F.covar_pop(p, q) * F.count(F.lit(1))).alias(k) for k, (p, q) in cov.items()],
    )
    s = per_entity.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("e"), *[F.sum(k).alias(k) for k in cov],
        F.sum(F.col("xy") * F.col("xy")).alias("aa"), F.sum(F.col("xy") * F.col("xx")).alias("ab"),
        F.sum(F.col("xx") * F.col("xx")).alias("bb"),
    ).first()
    if not s["n"] or s["xx"] <= 1e-12 * max(s["wxx"], 1e-300):
        raise ValueError(f"{x} does not vary within entities and periods")
    beta = s["xy"] / s["xx"]
    # Cluster scores Σ x̃e = xy − β·xx per entity; their squares expand into three sums.
    meat = max(s["aa"] - 2 * beta * s["ab"] + beta * beta * s["bb"], 0.0)
    se = math.sqrt(factor * meat) / s["xx"]
    r2 = 1 - (s["wyy"] - 2 * beta * s["wxy"] + beta**2 * s["wxx"]) / s["wyy"] if s["wyy"] > 0 else math.nan
    effects = dy - beta * dx
    level = effects.mean()
    alpha = F.col("gy") - F.lit(beta) * F.col("gx") + F.lit(float(level + centre["y"] - beta * centre["x"]))
    entities = per_entity.select(entity, F.col("n").cast("bigint").alias("n"), alias_effect(alpha))
    return PanelFit(beta, se, s["n"], s["e"], t, r2, periods, effects - level, entities, entity)


def alias_effect(c: Column) -> Column:
    return c.alias("effect")


def panel_fe(df: DataFrame, y: str, x: str, entity: str, period: str, factor: float = 1.0) -> DataFrame:
    """Slope with entity-clustered error, interval, p and within R².

    ``factor`` scales the clustered variance for a small-sample correction; 1 is none.
    """
    f = fit_panel(df, y, x, entity, period, factor)
    dof = f.n - f.n_entities - f.n_periods
    t = f.beta / f.se if f.se > 0 else math.nan
    half = t_quantile(0.975, dof) * f.se if dof > 0 else math.nan
    row = (f.beta, f.se, f.beta - half, f.beta + half, t_two_sided(t, dof), f.r2_within, f.n, f.n_entities, f.n_periods)
    schema = "beta double, se double, ci_low double, ci_high double, p double, r2_within double, n bigint, n_entities bigint, n_periods bigint"
    return df.sparkSession.createDataFrame([row], schema)


def fixed_effects(df: DataFrame, y: str, x: str, entity: str, period: str, highlight: Sequence = ()) -> DataFrame:
    """Effect of each entity (period effects average to zero), sorted, with a highlight mark."""
    out = fit_panel(df, y, x, entity, period).entities
    return out.withColumn("highlight", F.col(entity).isin(list(highlight))).orderBy("effect", entity)
