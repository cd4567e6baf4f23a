"""Quality from trusted positives and unlabelled text: non-negative positive-unlabelled learning.

No negative label is used. A first classifier of trusted against unlabelled
rows gives scores from which the share of positives among the unlabelled is
estimated; a small network then minimises the non-negative unbiased risk under
that prior. Both are fitted on bounded samples of feature vectors; scoring
covers the whole table in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import bounded_sample, per_text
from plumewalk.llm.statistics import FEATURES, describe


@dataclass(frozen=True)
class Network:
    """One hidden layer over standardised features; ``prior`` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -40, 40)))


def _train(z: np.ndarray, slope, hidden: int = 24, steps: int = 600, rate: float = 0.02, decay: float = 2e-3, seed: int = 7) -> tuple:
    """Adam on full batches; ``slope`` gives the derivative of the risk by the outputs."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = params
        a = np.tanh(z @ w1 + b1)
        d = slope(a @ w2 + b2[0])
        da = np.outer(d, w2) * (1 - a * a)
        grads = [z.T @ da + decay * w1, da.sum(0), a.T @ d + decay * w2, np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """Share of positives among the unlabelled, from scores of both (higher: more like the positives).

    Above any threshold the unlabelled hold at least prior * (positives above
    it), so the smallest ratio of the two tails, with a margin for the noise of
    thin tails, estimates the prior.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 0.99, 99))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    margin = np.sqrt(np.log(4 / confidence) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    k = int(np.argmin((u + margin) / np.maximum(p, 1e-9)))
    return float(np.clip(u[k] / max(p[k], 1e-9), 0.02, 0.98))


def fit_network(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    """The network for features of trusted positives and of unlabelled rows. Without positives every score is the prior 0.5 or near it."""
    width = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-9
    z = np.clip((both - mean) / scale, -6, 6)
    n_p, n_u = len(positive), len(unlabelled)
    is_p = np.arange(len(z)) < n_p

    def against(out: np.ndarray) -> np.ndarray:  # balanced logistic loss
        return np.where(is_p, (_sigmoid(out) - 1) / n_p, _sigmoid(out) / n_u)

    half = np.arange(len(z)) % 2 == 0  # scores of rows that the classifier has not seen
    outs = np.empty(len(z))
    for part in (half, ~half):
        n1, n2 = max(1, int((is_p & part).sum())), max(1, int((~is_p & part).sum()))
        fitted = _train(z[part], lambda out, q=is_p[part], n1=n1, n2=n2: np.where(q, (_sigmoid(out) - 1) / n1, _sigmoid(out) / n2), steps=200)
        outs[~part] = np.tanh(z[~part] @ fitted[0] + fitted[1]) @ fitted[2] + fitted[3]
    prior = estimate_prior(outs[is_p], outs[~is_p])

    def slope(out: np.ndarray) -> np.ndarray:
        s = _sigmoid(out)
        ds = s * (1 - s)
        # sigmoid loss: as positive 1 - s, as negative s
        negative = s[~is_p].mean() - prior * s[is_p].mean()
        d = np.where(is_p, -prior * ds / n_p, 0.0)
        if negative >= 0:
            return d + np.where(is_p, -prior * ds / n_p, ds / n_u)
        return -np.where(is_p, -prior * ds / n_p, ds / n_u)  # only lift the negative part back to zero

    w1, b1, w2, b2 = _train(z, slope)
    return Network(mean, scale, w1, b1, w2, b2, prior)


def features_of(docs: DataFrame) -> np.ndarray:
    """Feature vectors of a bounded sample."""

    def make():
        return lambda texts: {"x": [describe(t)[1].tolist() for t in texts]}

    found = per_text(docs, make, "x array<double>").select("x").collect()
    return np.array([r["x"] for r in found]).reshape(-1, len(FEATURES))


def fit_quality(docs: DataFrame, trusted: DataFrame, unlabelled: DataFrame, most: int = 12_000) -> Network:
    """A network from at most ``most`` trusted ids and ``most`` unlabelled ids of ``docs`` (one column doc_id each).

    The id samples are bounded and so are broadcast; features are computed where the texts lie.
    """
    chosen = [F.broadcast(bounded_sample(ids.where("doc_id is not null").select("doc_id").distinct(), most)) for ids in (trusted, unlabelled)]
    return fit_network(*[features_of(docs.select("doc_id", "text").join(c, "doc_id", "left_semi")) for c in chosen])


def score_quality(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) for every row; null and empty texts are scored by their zero features, repeated rows alike."""

    def make():
        return lambda texts: {"score": network.score(np.stack([describe(t)[1] for t in texts])).tolist()}

    return per_text(docs, make, "score double")
