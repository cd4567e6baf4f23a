"""Learned quality rules: gradient-boosted trees over document statistics with monotone constraints.

The trees are grown on the driver from a bounded sample of labelled rows,
reduced to their statistics by Spark, and flattened into node arrays. Scoring
is a vectorised walk of those arrays inside Arrow batches of the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import bounded_sample, per_text
from plumewalk.llm.statistics import FEATURES, describe

#: More of these never makes a text better: -1; the other features are free.
MONOTONE = {"symbols_per_word": -1, "duplicate_line_share": -1, "repeated_word_share": -1, "top_word_share": -1, "upper_share": -1, "exclamations_per_word": -1, "symbol_word_share": -1, "pipes_per_word": -1}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Forest:
    """Node arrays of all trees: an inner node sends x <= threshold left; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _best_split(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, signs: np.ndarray, bounds: tuple[float, float], l2: float, least: float):
    """(gain, feature, cut, left weight, right weight) of the best split that keeps the signs, or None."""
    total_g, total_h = g.sum(), h.sum()
    best = None
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        gl = np.cumsum(np.bincount(bins[:, f], g, len(edges) + 1))[:-1]
        hl = np.cumsum(np.bincount(bins[:, f], h, len(edges) + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        wl, wr = np.clip(-gl / (hl + l2), *bounds), np.clip(-gr / (hr + l2), *bounds)
        gain = -(gl * wl + (hl + l2) * wl**2 / 2) - (gr * wr + (hr + l2) * wr**2 / 2)
        gain[(hl < least) | (hr < least) | (signs[f] * (wr - wl) < 0)] = -np.inf
        k = int(gain.argmax())
        if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), f, k, float(wl[k]), float(wr[k]))
    return best


def boost(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 2.0, bins: int = 64) -> Forest:
    """Logistic gradient boosting on binned features. A split against a feature's sign is never taken, and the
    weights of both sides stay on their side of the middle further down, so the sum is monotone. Without both
    classes, or without rows, the forest is the prior alone."""
    p = (y.sum() + 1.0) / (len(y) + 2.0)
    bias = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(w: float) -> int:
        at = len(value)
        feature.append(0)
        threshold.append(0.0)
        left.append(at)
        right.append(at)
        value.append(rate * w)
        return at

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        cuts = [e[e < c.max()] for e, c in zip(cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), bias)
        for _ in range(trees):
            q = 1.0 / (1.0 + np.exp(-margin))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)

            def grow(rows: np.ndarray, level: int, bounds: tuple[float, float], w: float, g=g, h=h) -> int:
                stay = -(g[rows].sum() * w + (h[rows].sum() + l2) * w * w / 2)
                best = _best_split(binned[rows], cuts, g[rows], h[rows], signs, bounds, l2, least) if level < depth else None
                at = leaf(w)
                if best is None or best[0] <= stay + 1e-9:
                    margin[rows] += rate * w
                    return at
                _, f, k, wl, wr = best
                goes_left = binned[rows, f] <= k
                middle = (wl + wr) / 2
                low, high = ((bounds[0], middle), (middle, bounds[1])) if signs[f] > 0 else ((middle, bounds[1]), (bounds[0], middle)) if signs[f] < 0 else (bounds, bounds)
                feature[at], threshold[at] = f, float(cuts[f][k])
                left[at] = grow(rows[goes_left], level + 1, low, wl)
                right[at] = grow(rows[~goes_left], level + 1, high, wr)
                return at

            everything = np.arange(len(y))
            roots.append(grow(everything, 0, (-np.inf, np.inf), float(-g.sum() / (h.sum() + l2))))
    return Forest(*(np.array(a, dtype=t) for a, t in ((feature, np.int64), (threshold, np.float64), (left, np.int64), (right, np.int64), (value, np.float64), (roots, np.int64))), depth, bias)


def labelled_features(docs: DataFrame, labelled: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``most`` labelled rows. The sample of (id, label) pairs is bounded and so is broadcast."""
    chosen = bounded_sample(labelled.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label")), most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        return lambda texts: {"x": [describe(t)[1].tolist() for t in texts]}

    found = per_text(rows, make, "x array<double>", ("doc_id", "label")).select("label", "x").collect()
    return np.array([r["x"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found])


def fit_rules(docs: DataFrame, labelled: DataFrame, most: int = 20_000) -> Forest:
    """Trees for ``labelled`` (doc_id, label 0/1), from at most ``most`` of its rows."""
    x, y = labelled_features(docs, labelled, most)
    return boost(x, y, np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def apply_rules(docs: DataFrame, forest: Forest, least_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """(doc_id, the base statistics, base_failed, score, kept) for every row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeated`` per cent of them in repeated five-word windows. Other
    rows are kept if the trees give 0.5 or more. Null and empty texts have zero
    statistics and fail the base rule; repeated rows get equal results.
    Columns other than doc_id and text are not read.
    """

    def make():
        def kernel(texts):
            described = [describe(t) for t in texts]
            out = {n: [b[n] for b, _ in described] for n in BASE}
            out["score"] = forest.probability(np.stack([x for _, x in described])).tolist()
            return out

        return kernel

    scored = per_text(docs, make, ", ".join(f"{n} long" for n in BASE) + ", score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return scored.select("doc_id", *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= 0.5)).alias("kept"))
