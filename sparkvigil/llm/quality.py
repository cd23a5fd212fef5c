"""Text quality: a generalised additive model with pairwise interactions, boosted in cycles."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import slices, unused
from .learning import SAMPLE, held_out, labelled_sample

FEATURES = ("words", "word_length", "upper", "symbols", "digits", "distinct", "stutter", "marked_ends", "repeated_lines", "line_length", "top_word", "bare_symbols", "repeated_pairs", "exclaims", "long_words", "length_spread", "capital_starts")
BINS, GRID = 32, 8


def features(text: str) -> list[float]:
    """What the model sees of a whole text; all zero without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.lower() for w in words]
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(lower)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ascii_ = points[points < 128]
    upper = np.count_nonzero((ascii_ >= 65) & (ascii_ <= 90))
    digits = np.count_nonzero((ascii_ >= 48) & (ascii_ <= 57))
    letters = np.count_nonzero(((ascii_ | 32) >= 97) & ((ascii_ | 32) <= 122))
    blank = np.count_nonzero((ascii_ == 32) | ((ascii_ >= 9) & (ascii_ <= 13)))
    size = len(points)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    ends = Counter(w[-1] for w in words)
    bare = sum(c for w, c in counts.items() if not any(map(str.isalnum, w)))
    return [
        float(np.log1p(n)), lengths.mean(), upper / size, (len(ascii_) - letters - digits - blank) / size, digits / size,
        len(counts) / n, sum(map(str.__eq__, lower, lower[1:])) / n, sum(c for e, c in ends.items() if not e.isalnum() and e not in ".,;:?") / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), max(counts.values()) / n, bare / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, text.count("!") / n, np.count_nonzero(lengths > 12) / n, lengths.std(),
        sum(w[0].isupper() for w in words) / n,
    ]


@dataclass
class AdditiveModel:
    """score = sigmoid(intercept + sum of tables[f][bin of f] + sum of pair tables[bin of f][bin of g])."""

    edges: list[np.ndarray]
    grid: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, edges in enumerate(self.edges):
            total += self.tables[f][np.searchsorted(edges, x[:, f], "right")]
        coarse = {f: np.searchsorted(self.grid[f], x[:, f], "right") for f in {f for pair in self.pairs for f in pair}}
        for (f, g), cells in self.pairs.items():
            total += cells[coarse[f], coarse[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.empty(0)


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _step(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values, for each bin, of the best tree of up to two cuts over binned gradients."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    out = np.full(len(g), cg[-1] / (ch[-1] + ridge))
    if len(g) < 2:
        return out

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, -1
        g0, h0 = (cg[lo - 1], ch[lo - 1]) if lo else (0.0, 0.0)
        gl, hl = cg[lo : hi - 1] - g0, ch[lo : hi - 1] - h0
        gt, ht = cg[hi - 1] - g0, ch[hi - 1] - h0
        gains = _gain(gl, hl, ridge) + _gain(gt - gl, ht - hl, ridge) - gt * gt / (ht + ridge)
        k = int(np.argmax(gains))
        return float(gains[k]), lo + k + 1

    _, first = cut(0, len(g))
    parts = [(0, first), (first, len(g))]
    gains = [cut(*p) for p in parts]
    best = int(gains[1][0] > gains[0][0])
    if gains[best][0] > 0:
        lo, hi = parts[best]
        parts[best : best + 1] = [(lo, gains[best][1]), (gains[best][1], hi)]
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and the leaf values of the best tree that cuts both axes of a grid once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, (1, 1)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gs, hs = _four(cg, i, j), _four(ch, i, j)
            gain = float(_gain(gs, hs, ridge).sum())
            if gain > best:
                best, at = gain, (i, j)
    i, j = at
    gs, hs = _four(cg, i, j), _four(ch, i, j)
    value = gs / (hs + ridge)
    out = np.empty(g.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = value
    return best - float(cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def _four(c: np.ndarray, i: int, j: int) -> np.ndarray:
    a, b, d = c[i - 1, j - 1], c[i - 1, -1], c[-1, j - 1]
    return np.array([a, b - a, d - a, c[-1, -1] - b - d + a])


def fit(x: np.ndarray, y: np.ndarray, cycles: int = 150, pair_cycles: int = 50, pairs: int = 6, rate: float = 0.1, ridge: float = 5.0) -> AdditiveModel:
    """Boosts one shallow tree a feature in turn, then, with those fixed, one a pair of the most interacting features.

    One class alone, or no rows, gives a constant. Rows are taken in the order given; no randomness.
    """
    n, width = x.shape
    rest = (y.sum() + 1) / (n + 2)
    model = AdditiveModel([_edges(x[:, f], BINS) for f in range(width)], [_edges(x[:, f], GRID) for f in range(width)], float(np.log(rest / (1 - rest))), [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(width)]
    logit = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(cycles):
        for f in range(width):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * _step(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size), ridge)
            model.tables[f] += step
            logit += step[bins[f]]
    shape = [len(e) + 1 for e in model.grid]
    coarse = [np.searchsorted(model.grid[f], x[:, f], "right") for f in range(width)]

    def summed(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[f] * shape[k] + coarse[k], v, shape[f] * shape[k]).reshape(shape[f], shape[k])

    g, h = slopes()
    ranked = sorted(((-_quadrants(summed(f, k, g), summed(f, k, h), ridge)[0], f, k) for f, k in combinations(range(width), 2) if min(shape[f], shape[k]) > 1))
    for _, f, k in ranked[:pairs]:
        model.pairs[f, k] = np.zeros((shape[f], shape[k]))
    for _ in range(pair_cycles):
        for (f, k), cells in model.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(summed(f, k, g), summed(f, k, h), ridge)[1]
            cells += step
            logit += step[coarse[f], coarse[k]]
    return model


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = SAMPLE) -> AdditiveModel:
    """Fits on at most ``limit`` labelled documents; only their features come to the driver."""

    def each(frames):
        for pdf in frames:
            x = _matrix(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], **{f"f{i}": x[:, i] for i in range(x.shape[1])}})

    names = [f"f{i}" for i in range(len(FEATURES))]
    found = labelled_sample(docs, labels, column, limit).mapInPandas(each, "doc_id bigint, y int, " + ", ".join(f"{c} double" for c in names))
    rows = found.dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id", ignore_index=True)
    return fit(rows[names].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 of each whole text; null texts count as empty."""
    at = docs.columns.index("text")

    def each(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_matrix(texts)))], names=[*batch.schema.names, column])

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = scored(ids, train(docs, labels)).drop("text")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    (named,) = unused(docs.columns, "_score")
    return scored(docs, train(docs, labels), named).where(F.col(named) >= threshold).drop(named)
