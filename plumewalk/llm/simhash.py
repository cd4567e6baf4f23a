"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

A fingerprint is cut into five blocks. Two fingerprints that differ in at most
two bits agree on at least three blocks, so each triple of blocks (38 bits or
more) is a join key and no close pair is missed. Keys that few fingerprints
share are verified pair by pair inside one bounded array. A key shared by many
(a large group of near copies) is solved without pairs: two of its members
are within two bits exactly if their one-bit balls over the bits outside the
key meet, so members are grouped by ball point and linked in a star.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import per_text, settled
from plumewalk.llm.components import components

#: Inclusive bit ranges of the five blocks.
BLOCKS = ((0, 12), (13, 25), (26, 38), (39, 51), (52, 63))
MOST_DIFFERING = 2


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def block_masks() -> list[tuple[int, list[int]]]:
    """(mask of three blocks, single-bit values outside it), as signed longs."""
    out = []
    for chosen in combinations(BLOCKS, len(BLOCKS) - MOST_DIFFERING):
        bits = {b for lo, hi in chosen for b in range(lo, hi + 1)}
        out.append((_signed(sum(1 << b for b in bits)), [_signed(1 << b) for b in range(64) if b not in bits]))
    return out


def fingerprint_words(words: list[bytes], width: int, chunk: int = 1 << 16) -> int:
    """The fingerprint of a word list, as a signed long: a bit is set if over half the shingle hashes have it."""
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) <= width:
        spans = [(0, len(joined))]
    else:
        spans = list(zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True))
    hash64 = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(spans), chunk):
        hashes = np.array([hash64(joined[s:e], 42) for s, e in spans[lo : lo + chunk]], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(``carry``, fp long) for every row. Null and empty texts have no word and get zero."""

    def make():
        def kernel(texts):
            # bytes.lower and bytes.split know ASCII only: A-Z, and the six white space characters
            return {"fp": [fingerprint_words((t or "").encode().lower().split(), width) for t in texts]}

        return kernel

    return per_text(docs, make, "fp long", carry)


def hamming_links(points: DataFrame, dense: int = 64) -> DataFrame:
    """Links (a, b), a < b, whose closure joins all pairs of distinct ``fp`` within two bits.

    Keys with up to ``dense`` members give every verified pair; larger keys
    give the stars of their ball points (all of whose members are within two
    bits of each other), which connect the same fingerprints.
    """
    masks = block_masks()
    keys = points.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, (m, _) in enumerate(masks)])).alias("k")
    ).select("fp", "k.way", "k.key")
    sizes = keys.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settled(keys.join(sizes, ["way", "key"]))

    groups = shared.where(F.col("n") <= dense).groupBy("way", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    close = F.flatten(
        F.transform(
            "fps",
            lambda a: F.transform(
                F.filter("fps", lambda b: (b > a) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_DIFFERING)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    sparse = groups.select(F.explode(close).alias("l")).select("l.a", "l.b")

    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in free]) for _, free in masks])
    balls = shared.where(F.col("n") > dense).select("way", "key", "fp", F.explode(F.element_at(flips, F.col("way") + 1)).alias("flip"))
    stars = balls.groupBy("way", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return sparse.union(star).distinct()


def row_key(docs: DataFrame) -> Column:
    """A hash of id and text: with the id it names a row, but for rows that repeat both."""
    return F.xxhash64(docs["doc_id"], docs["text"].cast("string"))


def components_of(points: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, root, component_id) of ``points`` (fp, first_id) over ``links`` of fp; every point has a root of its own or a shared one."""
    found = components(links)
    rooted = settled(points.select("fp", "first_id").join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return settled(rooted.join(named, "root").select("fp", "root", "component_id"))


def grouped(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row of ``docs``; rows of one group share ``root``."""
    prints = settled(fingerprints(docs.select("doc_id", "text", row_key(docs).alias("row_key")), width, ("doc_id", "row_key")))
    points = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return prints.join(components_of(points, hamming_links(points.select("fp"))), "fp")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id that is reachable over links of at
    most two differing bits. Equal fingerprints, and so copies, become one
    point before any join. Null or empty texts share fingerprint zero and are
    linked like any other. Repeated rows stay repeated; a null doc_id never
    becomes a component's id unless all of its ids are null. Columns other
    than doc_id and text are not read; an empty table gives an empty result.
    """
    return grouped(docs, width).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, found: DataFrame | None = None) -> DataFrame:
    """One row of ``docs`` for each group, with the columns of ``docs``: the row of its smallest doc_id, null last.

    Rows that share an id but not a text are told apart: of several such rows
    of one group the one with the smallest ``row_key`` stays, and rows of
    different groups all stay. Of rows that repeat id and text the one with the
    smallest hash of all columns stays. ``found`` (doc_id, row_key, root) are
    the groups, if not those of ``near_duplicates``.
    """
    found = grouped(docs, width) if found is None else found
    rows = found.groupBy("root", "doc_id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "n")).alias("r"))
    chosen = settled(first.select(F.col("r.doc_id").alias("_keep_id"), F.col("r.row_key").alias("_keep_key"), F.col("r.n").alias("_rows")))
    same = docs["doc_id"].eqNullSafe(chosen["_keep_id"]) & (row_key(docs) == chosen["_keep_key"])
    kept = docs.join(chosen.where("_rows = 1"), same, "left_semi")
    if chosen.where("_rows > 1").isEmpty():
        return kept
    repeated = docs.join(chosen.where("_rows > 1"), same, "left_semi")
    whole = repeated.select(F.struct(*[repeated[c] for c in repeated.columns]).alias("_row"))
    once = whole.groupBy(F.col("_row.doc_id").alias("_id"), F.xxhash64("_row.doc_id", F.col("_row.text").cast("string")).alias("_key")).agg(F.min_by("_row", F.xxhash64(F.col("_row"))).alias("_row"))
    return kept.unionByName(once.select("_row.*"))
