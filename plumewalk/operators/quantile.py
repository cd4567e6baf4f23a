"""Exact quantiles and ranks that never put a whole column into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.operators.ordered import group_sizes, prefix_sums
from plumewalk.session import group_limit


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """Distinct finite values with their count; copies collapse before any shuffle of rows."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    kept = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return kept.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Sequence[float],
    limit: int | None = None,
    name: str = "q",
) -> DataFrame:
    """Linear-interpolated quantiles per key as an array column, in the order of ``probs``.

    While the distinct values of a key fit one task the built-in ``percentile``
    runs on the counted values. Beyond that the order statistics are found by
    running counts over range-partitioned chunks.
    """
    counted = value_counts(df, keys, value)
    limit = group_limit(df.sparkSession, limit)
    largest, _ = group_sizes(counted, keys)
    if largest <= limit:
        return counted.groupBy(*keys).agg(
            F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_n")).alias(name)
        )
    running = prefix_sums(counted, keys, ["_v"], {"_cum": F.col("_n")}, limit)
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    placed = running.join(totals, list(keys)) if keys else running.withColumn("_total", totals.scalar())
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.min(F.when(F.col("_cum") > rank, F.col("_v"))).alias(f"_{side}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_fr{i}"))
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        F.array(
            *[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_fr{i}") for i in range(len(probs))]
        ).alias(name),
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", limit: int | None = None
) -> DataFrame:
    """One row per (key, distinct value): average rank of its ties and the tie count ``ties``."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    running = prefix_sums(counted, keys, [value], {"_cum": F.col("ties")}, limit)
    return running.withColumn(name, F.col("_cum") - (F.col("ties") - 1) / F.lit(2.0)).drop("_cum")
