"""Validation plans: every function labels rows with a fold and a role, nothing is copied out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.operators.ordered import with_position
from plumewalk.operators.quantile import quantiles
from plumewalk.operators.series import group_bounds


def frequency_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based equal-frequency bin, right-closed; equal edges are merged."""
    edges = quantiles(df, [], value, [i / bins for i in range(bins + 1)]).scalar()
    below = F.size(F.filter(F.array_distinct(F.col("_edges")), lambda e: e < F.col(value)))
    return df.withColumn("_edges", edges).withColumn(name, F.greatest(below - 1, F.lit(0))).drop("_edges")


def subject_holdout(df: DataFrame, subject: str = "subject_id", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``role``: max(1, int(share * subjects)) whole subjects, drawn by a seeded hash, are 'holdout'."""
    subjects = df.select(subject).distinct()
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(subject).cast("string")))
    n = subjects.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share + 1e-9))).scalar()
    ranked = with_position(subjects.withColumn("_h", draw), [], ["_h", subject], "_rank")
    held = ranked.select(subject, F.when(F.col("_rank") < n, "holdout").otherwise("development").alias("role"))
    return df.join(held, subject)


def group_folds(df: DataFrame, subject: str = "subject_id", k: int = 4) -> DataFrame:
    """Adds ``fold``: whole subjects, dealt largest first in turns that reverse direction.

    The row counts per subject are ranked on Spark; folds differ by no more
    than the largest subject.
    """
    sizes = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col("_n"))
    ranked = with_position(sizes, [], ["_neg", subject], "_rank")
    turn, seat = F.floor(F.col("_rank") / k), F.col("_rank") % k
    fold = F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    return df.join(ranked.select(subject, fold.alias("fold")), subject)


def spatial_blocks(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", k: int = 3) -> DataFrame:
    """Adds ``block``: k strips of equal count along the longer side of each subject's extent."""
    wide = df.groupBy(*keys).agg((F.max(x) - F.min(x) >= F.max(y) - F.min(y)).alias("_wide"))
    along = df.join(wide, list(keys)).withColumn("_a", F.when(F.col("_wide"), F.col(x)).otherwise(F.col(y)))
    cuts = quantiles(along, keys, "_a", [i / k for i in range(1, k)], name="_cuts")
    block = F.size(F.filter("_cuts", lambda c: c < F.col("_a")))
    return along.join(cuts, list(keys)).withColumn("block", block).drop("_wide", "_a", "_cuts")


def position_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 3) -> DataFrame:
    """Adds ``block`` = position mod k, for rows without coordinates."""
    return with_position(df, keys, order, "_pos").withColumn("block", (F.col("_pos") % k).cast("int")).drop("_pos")


def _sized(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return group_bounds(with_position(df, keys, order, "pos"), keys, {"n": F.count(F.lit(1))})


def temporal_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], test_size: float = 0.2, gap: int = 0) -> DataFrame:
    """Adds ``role``: 'train' before int(n * (1 - test_size)), 'test' after it and the gap; gap rows get null."""
    cut = F.floor(F.col("n") * F.lit(1 - test_size) + 1e-9)
    role = F.when(F.col("pos") < cut, "train").when(F.col("pos") >= cut + gap, "test")
    return _sized(df, keys, order).withColumn("role", role).drop("n")


def _fold_rows(sized: DataFrame, spans: list[tuple[int, Column, Column, Column, Column]]) -> DataFrame:
    """One row per (row, fold) it takes part in, from (fold, train from, train to, test from, test to)."""
    pos = F.col("pos")
    cells = []
    for fold, t0, t1, e0, e1 in spans:
        role = F.when((pos >= t0) & (pos < t1), "train").when((pos >= e0) & (pos < e1), "test")
        cells.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    return sized.select("*", F.inline(F.array(*cells))).where("role is not null")


def _walk_spans(k: int, gap: int, max_train: int | None):
    n, m = F.col("n"), F.floor(F.col("n") / (k + 1))
    spans = []
    for i in range(k):
        start = n - (k - i) * m
        stop = start - gap
        low = F.greatest(F.lit(0), stop - max_train) if max_train else F.lit(0)
        spans.append((i, low, stop, start, start + m))
    return spans


def walk_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 5, gap: int = 0, max_train: int | None = None) -> DataFrame:
    """Expanding windows: rows with fold and role ('train' / 'test')."""
    return _fold_rows(_sized(df, keys, order), _walk_spans(k, gap, max_train)).drop("n")


def blocked_folds(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int = 5, total: int | None = None) -> DataFrame:
    """Blocks of N // (2k) rows: fold i trains on all blocks to i and tests block i + 1.

    ``total`` is N when the folds are laid over a part of it. Series with fewer
    than k + 1 blocks use the walk-forward plan.
    """
    size = F.greatest(F.floor((F.lit(total) if total else F.col("n")) / (2 * k)), F.lit(1))
    sized = _sized(df, keys, order).withColumn("_b", size)
    enough = F.floor(F.col("n") / F.col("_b")) >= k + 1
    b, n = F.col("_b"), F.col("n")
    spans = []
    for (i, low, stop, start, end) in _walk_spans(k, 0, None):
        pick = lambda blocked, walk: F.when(enough, blocked).otherwise(walk)
        spans.append(
            (i, low, pick((i + 1) * b, stop), pick((i + 1) * b, start), pick(F.least((i + 2) * b, n), end))
        )
    return _fold_rows(sized, spans).drop("n", "_b")


def forecast_holdout(df: DataFrame, keys: Sequence[str], order: Sequence[str], horizon: int) -> DataFrame:
    """Adds ``role``: the last ``horizon`` rows are 'test', those before 'train'; all rows of a series
    that would keep less than 70 % for training are 'short', so that nothing goes unseen."""
    sized = _sized(df, keys, order)
    short = (F.col("n") - horizon) < 0.7 * F.col("n")
    return sized.withColumn("role", F.when(short, "short").when(F.col("pos") >= F.col("n") - horizon, "test").otherwise("train")).drop("n")
