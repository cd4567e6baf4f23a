"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to blocks, and every block keeps one list for each dimension:
its rows ordered by that component. A query reads the lists from the end that
helps it (the largest components where its own is positive, the smallest where
it is negative), a few more places each round, and scores every row that it
sees for the first time. What no list has shown yet cannot score more than the
components at the reading places allow; as soon as this bound is below the
query's kth best score, the rest of the block is not read. A task carries the
best rows of its queries from block to block, so later blocks stop earlier, and
the few rows that each task leaves are ranked at the end.

Queries are a stated set; blocks of them meet blocks of vectors, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumewalk.session import block_partitions

#: Rows of a block of vectors and, about, of a block of queries.
BLOCK = 4096
#: Places of each list that the first round reads; every further round doubles them.
FIRST = 32
_LAST = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), for vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above infinity
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def blocks(vectors: DataFrame) -> DataFrame:
    """(dims, ids, known, rows, lists): at most ``BLOCK`` vectors of one length, and their order in each dimension, falling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[pa.RecordBatch]] = {}

        def block(dims: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).combine_chunks()
            ids, v = own.column("vec_id").combine_chunks(), matrix(own.column("v").combine_chunks())
            lists = np.argsort(~v, axis=0, kind="stable").T.astype(np.uint16)
            fields = [[dims], [ids.fill_null(_LAST).to_numpy().tobytes()], [ids.is_valid().to_numpy(zero_copy_only=False).tobytes()], [v.tobytes()], [np.ascontiguousarray(lists).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(fields[0], pa.int32()), *[pa.array(f, pa.binary()) for f in fields[1:]]], ["dims", "ids", "known", "rows", "lists"])

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dims))
                for lo in range(0, own.num_rows, BLOCK):
                    kept.setdefault(dims, []).append(own.slice(lo, BLOCK))
                    if sum(b.num_rows for b in kept[dims]) >= BLOCK:
                        rows = pa.Table.from_batches(kept.pop(dims)).combine_chunks()
                        yield block(dims, rows.slice(0, BLOCK).to_batches())
                        if rows.num_rows > BLOCK:
                            kept[dims] = rows.slice(BLOCK).to_batches()
        for dims, parts in kept.items():
            yield block(dims, parts)

    return vectors.mapInArrow(run, "dims int, ids binary, known binary, rows binary, lists binary")


def product(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; those beyond 64 bits are held at its ends."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    most = np.abs(rows.astype(np.float64)).max() * np.abs(query.astype(np.float64)).max() * rows.shape[1]
    if most < 2.0**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return rows @ query
    exact = rows.astype(object) @ query.astype(object)
    return np.array([max(-_LAST - 1, min(_LAST, int(x))) for x in exact], np.int64)


class Best:
    """The k best (score, falling; id, rising) rows that a query has met."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.known, self.own = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray, own: np.ndarray) -> None:
        if len(self.score) == self.k:
            near = score >= self.score[-1]
            score, ids, known, own = score[near], ids[near], known[near], own[near]
        if not len(score):
            return
        score, ids, known, own = (np.concatenate(x) for x in zip((self.score, self.id, self.known, self.own), (score, ids, known, own), strict=True))
        best = np.lexsort((~own, ids, ~known, ~score))[: self.k]  # ~ turns the order of whole numbers round, without overflow
        self.score, self.id, self.known, self.own = score[best], ids[best], known[best], own[best]

    def floor(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None


def read_lists(query: np.ndarray, query_id: int, v: np.ndarray, lists: np.ndarray, ids: np.ndarray, known: np.ndarray, best: Best) -> int:
    """The threshold algorithm on one block; adds to ``best`` and returns how many rows were scored."""
    n = len(ids)
    up, down = np.nonzero(query > 0)[0], np.nonzero(query < 0)[0]
    weights = [int(q) for q in np.concatenate([query[up], query[down]])]
    dims = np.concatenate([up, down])
    seen, lo, places, scored = np.zeros(n, bool), 0, FIRST, 0
    while lo < n:
        # the components at the reading places: what the unseen rows have at most in each dimension
        at = np.concatenate([lists[up, lo], lists[down, n - 1 - lo]]).astype(np.int64)
        floor = best.floor()
        if floor is not None and sum(w * c for w, c in zip(weights, v[at, dims].tolist(), strict=True)) < floor:
            break
        hi = min(n, lo + places)
        new = np.zeros(n, bool)
        new[lists[up, lo:hi].ravel()] = True
        new[lists[down, n - hi : n - lo].ravel()] = True
        if not len(dims):
            new[:] = True  # a query of zeros scores zero everywhere and has no list to read
            hi = n
        rows = np.nonzero(new & ~seen)[0]
        seen |= new
        scored += len(rows)
        own = known[rows] & (ids[rows] == query_id)
        if own.any():
            own[own] = (v[rows[own]] == query).all(axis=1)
        best.add(product(v[rows], query), ids[rows], known[rows], own)
        lo, places = hi, 2 * places
    return scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the highest integer inner product with each row of ``queries``.

    Components count as floor(scale * x), x as double. Both tables have vec_id
    and embedding; other columns are not read. Ties go to the smaller vec_id,
    null ones last. A query does not meet its own row: of the rows with its id
    and vector one is left out. Rows that repeat a query are answered each.
    Vectors that are null or hold a null or non-finite component take no part;
    vectors of different lengths do not meet; a vector of length 0 scores 0. A
    query gets fewer rows where there are fewer; empty tables give no rows.
    Scores beyond 64 bits are held at the ends of a long.
    """
    spark = vectors.sparkSession
    asked = whole_vectors(queries, scale).where("vec_id is not null").groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    n_queries = asked.count()
    shares = max(1, -(-n_queries // BLOCK))
    tasks = block_partitions(spark, n_queries, 64)
    # a query block meets all vector blocks, in as many shares as there are tasks
    dealt = asked.withColumn("share", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shares)).cast("int"))
    asked_blocks = dealt.groupBy("share", F.size("v").alias("dims")).agg(F.collect_list(F.struct("vec_id", "times", "v")).alias("asked"))
    asked_blocks = asked_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    found = blocks(whole_vectors(vectors, scale)).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(tasks)).cast("int"))
    found = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    met = found.repartition(max(tasks, shares), "share", "part").join(asked_blocks.hint("merge"), ["share", "part", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked, best = None, [], []

        def left() -> Iterator[pa.RecordBatch]:
            for (query_id, times, v), b in zip(asked, best, strict=True):
                n = len(b.id)
                if n:
                    ids = pa.array(b.id, mask=~b.known)
                    fixed = [pa.array([query_id] * n, pa.int64()), pa.array([times] * n, pa.int64()), pa.array([v.tolist()] * n, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*fixed, ids, pa.array(b.score), pa.array(b.own)], ["query_id", "times", "v", "vec_id", "score", "own"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in ("share", "part", "dims"))
                if key != held:
                    yield from left()
                    rows = batch.column("asked")[i].values
                    vs = matrix(rows.field("v"))
                    held, asked = key, list(zip(rows.field("vec_id").to_pylist(), rows.field("times").to_pylist(), vs, strict=True))
                    best = [Best(k + 1) for _ in asked]  # one more, as a query's own row may be among them
                ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                known = np.frombuffer(batch.column("known")[i].as_py(), bool)
                v = np.frombuffer(batch.column("rows")[i].as_py(), np.int64).reshape(len(ids), -1)
                lists = np.frombuffer(batch.column("lists")[i].as_py(), np.uint16).reshape(-1, len(ids))
                for (query_id, _, query), b in zip(asked, best, strict=True):
                    read_lists(query, query_id, v, lists, ids, known, b)
        yield from left()

    partial = met.mapInArrow(run, "query_id long, times long, v array<long>, vec_id long, score long, own boolean")
    order = [F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("own")]
    few = partial.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "v").orderBy(*order))).where(F.col("_nth") <= k + 1)
    skipped = F.min(F.when(F.col("own"), F.col("_nth"))).over(Window.partitionBy("query_id", "v"))
    kept = few.withColumn("_own", skipped).where("_own is null or _nth <> _own")
    ranked = kept.withColumn("rank", (F.col("_nth") - F.when(F.col("_own") < F.col("_nth"), 1).otherwise(0)).cast("int")).where(F.col("rank") <= k)
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
