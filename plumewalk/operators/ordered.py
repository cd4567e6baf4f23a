"""Ordered-series primitives that hold when one key owns a third of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Each
function here first measures the largest group with one map-side-combined
count. Up to the limit the plain window is the best plan and is used. Beyond
it the table is range-partitioned on (key, order), so that a key spans many
balanced chunks; chunk totals (one row per chunk and key) carry the running
state from chunk to chunk and only chunk-sized windows are evaluated.

``keys`` + ``order`` must be unique together and the keys must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plumewalk.session import durable, group_limit

Keys = Sequence[str]

#: More chunks than this cost more in shuffle bookkeeping than their sorts would in spills.
MOST_CHUNKS = 20_000


_measured: dict[tuple[str, int], tuple[DataFrame, tuple[int, int]]] = {}


def group_sizes(df: DataFrame, keys: Keys) -> tuple[int, int]:
    """(rows of the largest group, all rows); one partial aggregation, two numbers back.

    The answer for a plan is remembered, since several steps of one query ask
    the same question. It only picks between two plans with equal results.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n"))
    at = (df.sparkSession.sparkContext.applicationId, sizes.semanticHash())
    seen = _measured.get(at)
    if seen is not None and seen[0].sameSemantics(sizes):
        return seen[1]
    row = sizes.first()
    if len(_measured) >= 256:
        _measured.pop(next(iter(_measured)))
    _measured[at] = (sizes, (int(row[0] or 0), int(row[1] or 0)))
    return _measured[at][1]


def range_chunks(df: DataFrame, keys: Keys, order: Sequence[str], total: int, limit: int) -> DataFrame:
    """Adds ``_chunk``: ordered, balanced pieces of the (key, order) sequence, about ``limit`` of ``total`` rows each.

    The bounds come from a sample, so the result is written down once; both the
    chunk totals and the rows must see the same pieces.
    """
    ranged = df.repartitionByRange(min(math.ceil(total / limit), MOST_CHUNKS), *keys, *order)
    return durable(ranged.withColumn("_chunk", F.spark_partition_id()))


def prefix_sums(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    sums: dict[str, Column],
    limit: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sums`` within ``keys`` in ``order``; a null adds nothing.

    A caller that knows a bound on all rows gives it as ``at_most``; below the
    limit it spares the count.
    """
    limit = group_limit(df.sparkSession, limit)
    largest, total = (at_most, at_most) if at_most is not None and at_most <= limit else group_sizes(df, keys)
    if largest <= limit:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(n) for n, c in sums.items()])

    staged = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_v_{n}") for n, c in sums.items()])
    chunked = range_chunks(staged, keys, order, total, limit)
    totals = chunked.groupBy("_chunk", *keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_chunk", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy("_chunk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = chunked.join(offsets, ["_chunk", *keys])
    return joined.select(
        *df.columns, *[(F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in sums]
    )


def with_position(
    df: DataFrame, keys: Keys, order: Sequence[str], name: str = "pos", limit: int | None = None, at_most: int | None = None
) -> DataFrame:
    """0-based position of each row within its key."""
    out = prefix_sums(df, keys, order, {name: F.lit(1).cast("long")}, limit, at_most)
    return out.withColumn(name, F.col(name) - 1)


Finish = Callable[[DataFrame], DataFrame]


def sliding(
    df: DataFrame,
    keys: Keys,
    order: Sequence[str],
    before: int = 0,
    after: int = 0,
    limit: int | None = None,
) -> tuple[DataFrame, WindowSpec, Finish]:
    """Rows prepared for bounded ROWS frames reaching at most ``before`` / ``after`` rows.

    Returns (rows, window, finish). Put window functions over ``window`` on
    ``rows``, then call ``finish``. A key beyond the limit is cut into blocks of
    consecutive positions and only the rows next to a cut are copied to the
    neighbouring block, so no task ever sees a whole hot series.
    """
    limit = max(group_limit(df.sparkSession, limit), before, after)
    largest, _ = group_sizes(df, keys)
    if largest <= limit:
        return df, Window.partitionBy(*keys).orderBy(*order), lambda d: d

    placed = with_position(df, keys, order, "_pos", limit)
    block = F.floor(F.col("_pos") / F.lit(limit))
    no_copy = F.lit(None).cast("long")
    copies = F.array(
        block,
        F.when(F.col("_pos") >= (block + 1) * limit - before, block + 1).otherwise(no_copy),
        F.when((F.col("_pos") < block * limit + after) & (block > 0), block - 1).otherwise(no_copy),
    )
    spread = placed.withColumn("_block", F.explode(F.array_compact(copies)))

    def finish(d: DataFrame) -> DataFrame:
        own = F.floor(F.col("_pos") / F.lit(limit)) == F.col("_block")
        return d.where(own).drop("_pos", "_block")

    return spread, Window.partitionBy(*keys, "_block").orderBy("_pos"), finish


def fill_gaps(
    df: DataFrame, keys: Keys, order: Sequence[str], columns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Forward fill, then backward fill of ``columns`` in order within each key."""
    limit = group_limit(df.sparkSession, limit)
    largest, total = group_sizes(df, keys)
    if largest <= limit:
        base = Window.partitionBy(*keys).orderBy(*order)
        back = base.rowsBetween(Window.unboundedPreceding, 0)
        ahead = base.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns(
            {c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead)) for c in columns}
        )

    chunked = range_chunks(df, keys, order, total, limit)
    at = F.struct(*order)
    edges = chunked.groupBy("_chunk", *keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_l_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_f_{c}") for c in columns],
    )
    w = Window.partitionBy(*keys).orderBy("_chunk")
    carried = edges.select(
        "_chunk",
        *keys,
        *[F.last(f"_l_{c}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_p_{c}") for c in columns],
        *[F.first(f"_f_{c}", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias(f"_n_{c}") for c in columns],
    )
    inside = Window.partitionBy("_chunk", *keys).orderBy(*order)
    joined = chunked.join(carried, ["_chunk", *keys])
    filled = {
        c: F.coalesce(
            F.last(c, True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
            F.col(f"_p_{c}"),
            F.first(c, True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
            F.col(f"_n_{c}"),
        )
        for c in columns
    }
    return joined.withColumns(filled).select(*df.columns)
