"""Distance and pair joins on a grid of cells.

A plain ``distance <= r`` join plans as a nested loop. Here both sides get grid
cells, the join is an equi-join on the cell and the exact distance stays as the
residual predicate. Features are put on a level of a power-of-two grid that
fits their own extent, so a long street or a large park covers a handful of
cells. Cells that hold more sites than one task may take are salted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.functions.geo import euclid
from plumewalk.operators.nearest import nearest  # noqa: F401  (callers find all joins here)
from plumewalk.operators.ordered import group_sizes, with_position
from plumewalk.session import block_partitions, durable, group_limit

CELL = ["_lv", "_cx", "_cy"]


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def cell_join(
    sites: DataFrame, features: DataFrame, reach: float, points: bool = False, limit: int | None = None, met: Column | None = None
) -> DataFrame:
    """Pairs whose feature box, grown by ``reach``, meets the cell of the site.

    ``sites`` has planar px, py; ``features`` has fx, fy when ``points`` else
    minx, miny, maxx, maxy. Each (site, feature) pair comes out at most once.
    The caller applies the exact distance to the result. With ``met`` the
    sites come out, as often as they went in, that have a feature for which it
    holds; a site's search ends at the first one.

    Features are copied to every cell in reach, which Spark's size estimate
    does not see, so the join is by sorting and never by a broadcast.
    """
    limit = group_limit(sites.sparkSession, limit)
    reach_c = F.lit(float(reach))
    if points:
        levels = [0]
        placed = features.withColumn("_lv", F.lit(0))
        box = {"minx": F.col("fx"), "maxx": F.col("fx"), "miny": F.col("fy"), "maxy": F.col("fy")}
    else:
        extent = F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))
        steps = F.ceil(F.log2(F.greatest(extent / reach_c, F.lit(1.0))))
        placed = features.withColumn("_lv", steps.cast("int"))
        # One number per power of two of the map extent: a few dozen at the very most.
        levels = sorted(r[0] for r in placed.select("_lv").distinct().collect())
        box = {c: F.col(c) for c in ("minx", "maxx", "miny", "maxy")}
    size = reach_c * F.pow(F.lit(2.0), F.col("_lv"))

    def cover(low: str, high: str) -> Column:
        return F.explode(F.sequence(_cell(box[low] - reach_c, size), _cell(box[high] + reach_c, size)))

    celled = placed.withColumn("_cx", cover("minx", "maxx")).withColumn("_cy", cover("miny", "maxy"))
    if len(levels) == 1:
        homes = sites.withColumn("_lv", F.lit(levels[0]))
    else:
        homes = sites.withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
    homes = homes.withColumn("_cx", _cell(F.col("px"), size)).withColumn("_cy", _cell(F.col("py"), size))

    def boxed(near: DataFrame, far: DataFrame, keys: list[str]) -> DataFrame:
        hit = F.col("px").between(box["minx"] - reach_c, box["maxx"] + reach_c)
        hit &= F.col("py").between(box["miny"] - reach_c, box["maxy"] + reach_c)
        if met is None:
            return near.join(far.hint("merge"), keys).where(hit).drop(*keys)
        far = far.withColumnsRenamed({k: f"{k}_f" for k in keys})
        for k in keys:
            hit &= F.col(k) == F.col(f"{k}_f")
        return near.join(far.hint("merge"), hit & met, "left_semi").drop(*keys)

    largest, _ = group_sizes(homes, CELL)
    if largest <= limit:
        return boxed(homes, celled, CELL)
    # At most total/limit cells can be hot, so this table is small by construction.
    hot = (
        homes.groupBy(*CELL)
        .count()
        .where(F.col("count") > limit)
        .select(*CELL, F.ceil(F.col("count") / F.lit(limit)).alias("_salts"))
    )
    split = homes.join(F.broadcast(hot), CELL, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*sites.columns), F.coalesce("_salts", F.lit(1)))
    )
    spread = celled.join(F.broadcast(hot), CELL, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1))
    )
    return boxed(split.drop("_salts"), spread.drop("_salts"), [*CELL, "_salt"])


def within(sites: DataFrame, features: DataFrame, reach: float, limit: int | None = None) -> DataFrame:
    """Site x point-feature pairs with ``dist`` <= reach (inclusive)."""
    pairs = cell_join(sites, features, reach, points=True, limit=limit)
    return pairs.withColumn("dist", euclid("px", "py", "fx", "fy")).where(F.col("dist") <= float(reach))


def beyond_all(sites: DataFrame, features: DataFrame, reach: float, site_id: str) -> DataFrame:
    """Sites with no point feature closer than ``reach`` (strictly closer disqualifies)."""
    spots, known = sites.select("px", "py").distinct(), features.select("fx", "fy").distinct()
    taken = cell_join(spots, known, reach, points=True, met=euclid("px", "py", "fx", "fy") < float(reach))
    return sites.join(taken, ["px", "py"], "left_anti")


TILE_ROWS = 1024
#: Groups of tiles that all points make at least, and rows of a group at most: a group travels to each group that it meets.
TILE_GROUPS, GROUP_ROWS = 256, 1 << 18
PairKernel = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], bool], pd.DataFrame]


def pair_tiles(left: DataFrame, right: DataFrame, cell: Sequence[str], left_id: Sequence[str], right_id: Sequence[str], width: int, group: int = 4) -> DataFrame:
    """Left tiles next to right tiles of the same ``cell``, with the work of a crowded cell spread over tasks.

    A cell with more than ``group`` tiles on a side is a grid of groups of
    tiles: a left tile is copied to each group of right tiles and the other way
    round, and a pair meets under its cell and both groups, so no task gets
    more than a few tiles of each side of one cell. Both inputs are read twice
    and should be written down. Cells are listed only where they are crowded.
    """
    spark = left.sparkSession
    numbers = [d.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias(n)) for d, n in ((left, "_na"), (right, "_nb"))]
    crowded = durable(numbers[0].join(numbers[1], list(cell)).where("_na > 1 or _nb > 1"))
    listed = crowded.count()
    keys = list(cell)
    if listed:
        crowded = F.broadcast(crowded) if listed <= 100_000 else crowded
        one = lambda n: F.coalesce(n, F.lit(1))
        at = lambda ids, n: F.pmod(F.xxhash64(*ids), one(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), one(F.col(n)) - 1))
        left = left.join(crowded, keys, "left").withColumn("_ga", at(left_id, F.col("_na"))).withColumn("_gb", every("_nb")).drop("_na", "_nb")
        right = right.join(crowded, keys, "left").withColumn("_gb", at(right_id, F.col("_nb"))).withColumn("_ga", every("_na")).drop("_na", "_nb")
        keys += ["_ga", "_gb"]
        width = max(width, 3 * spark.sparkContext.defaultParallelism)
    return left.repartition(width, *keys).join(right.repartition(width, *keys), keys).drop("_ga", "_gb")


def tile_pairs(
    points: DataFrame,
    reach: float,
    point_id: str,
    attrs: Sequence[str],
    kernel: PairKernel,
    schema: str,
    tile_rows: int = TILE_ROWS,
    limit: int | None = None,
    with_id: bool = True,
) -> DataFrame:
    """Run ``kernel`` on every pair of neighbouring tiles, each unordered pair once.

    Points are cut into tiles of at most ``tile_rows`` rows within cells of
    at least side ``reach``; the tile pairs of a crowded cell are spread over tasks. Only tiles travel,
    never pairs of rows: the kernel gets two blocks of column arrays (and
    whether they are the same block) and returns partial sums. Blocks further
    apart than ``reach`` along an axis are left out. Groups of tiles grow with
    the points, so that a tile is copied about as often however many there are.
    Without ``with_id`` a kernel does not get ``point_id``.
    """
    box, farthest = points.agg(F.max("px") - F.min("px"), F.max("py") - F.min("py"), F.count("px")).first(), float(reach)
    if box[2]:
        # Sparse points get wider cells, so that a tile is worth its overhead.
        reach = max(float(reach), math.sqrt(box[0] * box[1] * (tile_rows / 2) / box[2]))
    celled = points.select(
        point_id, "px", "py", *[a for a in attrs if a not in ("px", "py", point_id)]
    ).withColumns({"_cx": F.floor(F.col("px") / reach).cast("long"), "_cy": F.floor(F.col("py") / reach).cast("long")})
    # Tiles are strips of their cell, so that many tiles of neighbouring cells are out of reach.
    placed = with_position(celled, ["_cx", "_cy"], ["px", "py", point_id], "_pos", limit, at_most=box[2])
    names = list(dict.fromkeys([point_id, "px", "py", *attrs]))
    if not with_id:
        names.remove(point_id)
    tiles = (
        placed.withColumn("_part", F.floor(F.col("_pos") / tile_rows).cast("long"))
        .groupBy("_cx", "_cy", "_part")
        .agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_rows"))
        .select("_cx", "_cy", "_part", *[F.col(f"_rows.{n}").alias(n) for n in names])
    )
    tiles = durable(tiles)
    left = tiles.select("_cx", "_cy", F.struct("_cx", "_cy", "_part").alias("ka"), *[F.col(n).alias(f"a_{n}") for n in names])
    # A tile goes to its own cell and the four before it; the four after it send theirs.
    before = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (0, -1), (-1, -1), (-1, 0), (-1, 1))])
    right = tiles.withColumn("_d", F.explode(before)).select(
        (F.col("_cx") + F.col("_d.x")).alias("_cx"),
        (F.col("_cy") + F.col("_d.y")).alias("_cy"),
        F.struct("_cx", "_cy", "_part").alias("kb"),
        *[F.col(n).alias(f"b_{n}") for n in names],
    )
    width = block_partitions(points.sparkSession, box[2])
    group = min(max(4, box[2] // (TILE_GROUPS * tile_rows)), max(4, GROUP_ROWS // tile_rows))
    pairs = pair_tiles(left, right, ["_cx", "_cy"], ["ka"], ["kb"], width, group).where(F.col("ka") <= F.col("kb"))
    pairs = pairs.withColumn("same", F.col("ka") == F.col("kb")).drop("_cx", "_cy", "ka", "kb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                a = {n: np.asarray(row[f"a_{n}"]) for n in names}
                b = {n: np.asarray(row[f"b_{n}"]) for n in names}
                if any(max(a[c].min() - b[c].max(), b[c].min() - a[c].max()) > farthest * (1 + 1e-9) for c in ("px", "py")):
                    continue
                yield kernel(a, b, bool(row["same"]))

    return pairs.mapInPandas(run, schema)
