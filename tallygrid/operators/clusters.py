"""K-means for several numbers of clusters in shared passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, by the hash of their id, from which the first centres come. All rows take part in the passes.
START_ROWS = 2000
RESTARTS = 5


def first_centres(sample: np.ndarray, k: int, seed: int, steps: int = 20) -> np.ndarray:
    """At most ``k`` centres of a sample, fewer if it has fewer distinct rows: the cheapest of some seeded starts."""
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(RESTARTS):
        centres = sample[[rng.integers(len(sample))]]
        gap = ((sample - centres[0]) ** 2).sum(1)
        while len(centres) < k and gap.sum() > 0:
            centres = np.vstack([centres, sample[rng.choice(len(sample), p=gap / gap.sum())]])
            gap = np.minimum(gap, ((sample - centres[-1]) ** 2).sum(1))
        for _ in range(steps):
            near = ((sample[:, None] - centres) ** 2).sum(2).argmin(1)
            centres = np.array([sample[near == j].mean(0) if (near == j).any() else c for j, c in enumerate(centres)])
        found.append((((sample[:, None] - centres) ** 2).sum(2).min(1).sum(), centres))
    return min(found, key=lambda f: f[0])[1]


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


class Centres:
    """Centres of several models over the same columns."""

    def __init__(self, models: Mapping[int, np.ndarray], cols: Sequence[str]) -> None:
        self.models, self.cols = dict(models), list(cols)

    def nearest(self, k: int) -> Column:
        """Number of the nearest centre of model ``k``, the first on a tie."""
        return F.expr(self._nearest(k))

    def _nearest(self, k: int) -> str:
        """As text, since a pass builds hundreds of expressions."""
        ranked = []
        for j, centre in enumerate(self.models[k]):
            gaps = [f"({_name(c)} - double('{float(v)!r}'))" for c, v in zip(self.cols, centre)]
            ranked.append(f"struct({' + '.join(f'{g} * {g}' for g in gaps)} AS d, {j} AS j)")
        return f"{f'least({", ".join(ranked)})' if len(ranked) > 1 else ranked[0]}.j"

    def sums(self, x: DataFrame) -> dict[int, np.ndarray]:
        """Per model, a row for each cluster: rows, sums of the columns, sum of squares. One scan for all models."""
        each = ", ".join(f"struct({k} AS k, {self._nearest(k)} AS cluster)" for k in self.models)
        rows = x.selectExpr(*map(_name, self.cols), f"{self._square()} AS __q", f"inline(array({each}))")
        out = {k: np.zeros((len(c), len(self.cols) + 2)) for k, c in self.models.items()}
        for k, cluster, *values in rows.groupBy("k", "cluster").agg(F.count(F.lit(1)), *[F.sum(_name(c)) for c in self.cols], F.sum("__q")).collect():
            out[k][cluster] = values
        return out

    def _square(self) -> str:
        return " + ".join(f"{_name(c)} * {_name(c)}" for c in self.cols)

    def silhouettes(self, x: DataFrame) -> dict[int, float]:
        """Mean silhouette of each model with at least two clusters that hold rows, over squared distances. One scan for all models.

        The mean squared distance to a cluster needs its sums only; a row alone in its cluster counts 0.
        """
        sums = {k: s for k, s in self.sums(x).items() if (s[:, 0] > 0).sum() > 1}
        if not sums:
            return {}
        each = []
        for k, own in sums.items():
            n = np.maximum(own[:, :1], 1)
            gaps = []
            for held, mean in zip(own[:, 0], own[:, 1:] / n):
                dot = " + ".join(f"{_name(c)} * double('{2 * float(v)!r}')" for c, v in zip(self.cols, mean))
                gaps.append(f"greatest({self._square()} + double('{float(mean[-1])!r}') - ({dot}), double('0'))" if held else "double(NULL)")
            rest = ", ".join(f"double('{float(m)!r}')" for m in n[:, 0] / np.maximum(n[:, 0] - 1, 1))
            alone = ", ".join("true" if m == 1 else "false" for m in own[:, 0])
            each.append(f"struct({k} AS k, {self._nearest(k)} AS own, array({', '.join(gaps)}) AS gaps, array({rest}) AS rest, array({alone}) AS alone)")
        rows = x.selectExpr(f"inline(array({', '.join(each)}))")
        other = F.array_min(F.concat(F.slice("gaps", F.lit(1), F.col("own")), F.slice("gaps", F.col("own") + 2, F.size("gaps"))))
        rows = rows.select("k", (F.get("gaps", F.col("own")) * F.get("rest", F.col("own"))).alias("a"), other.alias("b"), F.get("alone", F.col("own")).alias("alone"))
        most = F.greatest("a", "b")
        score = F.when(F.col("alone") | (most == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / most)
        found = {r["k"]: r["s"] for r in rows.groupBy("k").agg(F.avg(score).alias("s")).collect()}
        return {k: found[k] for k in sums}


def fit_centres(x: DataFrame, cols: Sequence[str], row_id: str, ks: Sequence[int], seed: int = 42, max_iter: int = 20, tol: float = 1e-4) -> Centres:
    """Lloyd's steps for all ``ks`` together, a scan each, until no centre moves by more than ``tol``; a cluster without rows keeps its centre."""
    sample = x.orderBy(F.xxhash64(row_id, F.lit(seed)), row_id).limit(START_ROWS).select(*cols).collect()
    sample = np.array([list(r) for r in sample], float)
    now = Centres({k: first_centres(sample, k, seed + k) for k in ks}, cols)
    for _ in range(max_iter):
        sums = now.sums(x)
        moved = {k: np.where(s[:, :1] > 0, s[:, 1:-1] / np.maximum(s[:, :1], 1), now.models[k]) for k, s in sums.items()}
        far = max(np.sqrt(((moved[k] - c) ** 2).sum(1)).max() for k, c in now.models.items())
        now = Centres(moved, cols)
        if far <= tol:
            break
    return now
