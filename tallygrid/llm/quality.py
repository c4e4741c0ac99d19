"""A quality classifier that is a sum of lookup tables: a generalised additive model with pairwise interactions.

Each text becomes a short row of numbers. Cyclic boosting goes round the features, fits a shallow tree to the current gradient on one
binned feature at a time and adds it to that feature's table; pairs with the most left to explain get two-dimensional tables in
the same way. A score is the sigmoid of a constant plus one table entry per feature and pair.

The tables are fitted on a bounded sample of the labelled rows, ``max_train`` of them, taken by the order of a hash of the id; the
bound is a parameter. Scoring covers every row in one scan and sees nothing but the text.

Defined results: null and empty texts are scored like a text without words; labels that are null are not learnt from; rows of
``labels`` with one id and both labels count as two examples; without any label the score is 0.5, with one class only that
class's smoothed share. Other columns are ignored by ``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import byte_strings

#: Labelled rows that the tables are fitted on, at most.
MAX_TRAIN = 20_000
MAX_BINS = 48
PAIR_BINS = 12
ROUNDS = 150
PAIR_ROUNDS = 40
PAIRS = 8
RATE = 0.1
RIDGE = 2.0
TREE_LEAVES = 4

_CLASSES = np.zeros(256, np.int64)
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[32, *range(9, 14)]] = 4
_CLASSES[[ord(c) for c in ".,;:'\"-()?"]] = 5
_CLASSES[[ord(c) for c in "!"]] = 6
_CLASSES[[ord(c) for c in "|<>{}[]\\/=_"]] = 7
_CLASSES[[ord(c) for c in "#$%&*+@^`~"]] = 8
_CLASSES[128:] = 9

FEATURES = [
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digits", "space", "marks", "shouts", "brackets", "symbols", "non_ascii",
    "entropy", "word_length", "distinct_words", "short_words", "shouted_words", "marked_words", "top_word", "line_length", "repeated_lines",
]


def features_of(text: bytes) -> list[float]:
    size, words, lines = max(1, len(text)), text.split(), text.split(b"\n")
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASSES, by_byte, 10)[1:] / size
    p = by_byte[by_byte > 0] / size
    n = max(1, len(words))
    counts = Counter(words)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), *share, float(-(p * np.log(p)).sum()), sum(map(len, words)) / n,
        len(counts) / n, sum(c for w, c in counts.items() if len(w) <= 3) / n, sum(c for w, c in counts.items() if len(w) > 2 and w.isupper()) / n,
        sum(c for w, c in counts.items() if not (48 <= w[-1] <= 57 or 65 <= w[-1] <= 90 or w[-1] >= 97)) / n, max(counts.values(), default=0) / n,
        len(text) / len(lines), 1 - len(set(lines)) / len(lines),
    ]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between distinct values, at even shares of the rows."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin for a tree with at most ``TREE_LEAVES`` leaves, split where the gain is largest."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    leaves = [(0, len(g))]
    while len(leaves) < TREE_LEAVES:
        best = (1e-9, None, None)
        for a, b in leaves:
            if b - a > 1:
                at = np.arange(a + 1, b)
                won = gain(a, at) + gain(at, b) - gain(a, b)
                if (top := won.argmax()) is not None and won[top] > best[0]:
                    best = (won[top], (a, b), int(at[top]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid: its gain and the leaf value of each cell."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        low = c[:-1, :-1]
        left, top, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, left - low, top - low, all_ - left - top + low]

    sums = list(zip(parts(cg), parts(ch)))
    gains = sum(a * a / (b + RIDGE) for a, b in sums)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    values = [a[i, j] / (b[i, j] + RIDGE) for a, b in sums]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gains[i, j]), out


@dataclass
class Model:
    constant: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.constant)
        for k, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, values in self.pairs:
            total += values[np.searchsorted(self.pair_cuts[i], x[:, i], "right"), np.searchsorted(self.pair_cuts[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the log loss: single features first, then the pairs that explain most of what is left."""
    positive = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(positive / (1 - positive))))
    if len(np.unique(y)) < 2:
        return model
    total = np.full(len(y), model.constant)
    model.cuts = [_cuts(c, MAX_BINS) for c in x.T]
    bins = [np.searchsorted(c, v, "right") for c, v in zip(model.cuts, x.T)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(own, g, size), np.bincount(own, h, size))
            model.tables[k] += step
            total += step[own]
    model.pair_cuts = [_cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(c, v, "right") for c, v in zip(model.pair_cuts, x.T)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        return tuple(np.bincount(cell, v, sizes[i] * sizes[j]).reshape(shape) for v in (g, h))

    g, h = slopes()
    open_ = [(i, j) for i in range(len(bins)) for j in range(i) if sizes[i] > 1 and sizes[j] > 1]
    ranked = sorted(open_, key=lambda ij: (-_quadrants(*grids(*ij, g, h))[0], ij))[:PAIRS]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model.pairs:
            step = RATE * _quadrants(*grids(i, j, *slopes()))[1]
            values += step
            total += step[coarse[i], coarse[j]]
    return model


def held_out(id_col: Column, parts: int = 5) -> Column:
    return F.crc32(id_col.cast("string")) % parts == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the first ``max_train`` labelled rows, by a hash of the id, that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    rows = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_train).collect()
    wanted: dict = {}
    for r in rows:
        wanted.setdefault(r.id, []).append(r.label)
    share = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [share.value.get(i, ()) for i in batch.column(0).to_pylist()]
            picked = [i for i, labels in enumerate(own) if labels]
            x = matrix(byte_strings(batch.column(1).take(pa.array(picked, pa.int64()))))
            times = [k for k, i in enumerate(picked) for _ in own[i]]
            found = [v for i in picked for v in own[i]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(x[times].tolist(), pa.list_(pa.float64()))], ["y", "x"])

    seen = docs.select(id_col, text_col).mapInArrow(run, "y int, x array<double>").toPandas()
    if not len(seen):
        return Model()
    x, y = np.stack(seen["x"].to_numpy()), seen["y"].to_numpy(np.float64)
    order = np.lexsort(x.T)
    return fit(x[order], y[order])


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: whether its label was held out, its score, and the class at ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, max_train))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(matrix(byte_strings(batch.column(1))))
            columns = [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "held_out", "score", "predicted"])

    picked = docs.select(id_col, text_col, F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labelled: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that score ``threshold`` or more; ``labelled`` holds the texts that the labels speak of."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, labels, id_col, text_col, label_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(matrix(byte_strings(batch.column(at)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
