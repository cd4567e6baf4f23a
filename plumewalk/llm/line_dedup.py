"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Two lines are linked if their edit distance is at most ``EDITS``. A line is
cut into EDITS + 1 segments, so an edited copy leaves one segment untouched.
The segments of every line, keyed by line length and place, form the index.
A line probes the index of each length it may have come from with its
substrings at those few starts which an alignment of so many edits allows.
Candidates are verified by a banded bit-parallel distance, written as a fold
over the characters.

Lines under a crowded key are cut finer: among 5, 9 or 17 segments two at most
are open, and all others have to agree in one key. Templates and copies that
were changed in different places part there. What stays crowded in the finest
cut are close neighbours; where classes are wanted and not all links, they are
linked to one pivot of the key first, and only lines that this leaves in
different classes are paired. In the finer cuts a line's character counts
travel with its keys, and lines whose counts differ too much are not paired.

Lines are handled by the 64-bit hash of their text, together with their
length in every key; texts are fetched for candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import settled
from plumewalk.llm.components import components
from plumewalk.session import block_partitions

EDITS = 2
BAND = 2 * EDITS + 1
#: From this length on lines are judged by edits in the queries: each segment of the shortest ones has five characters, and two edits are an eighth of them. Shorter ones are judged by equality.
LEAST_EDITED = 16
#: Segments of each cut: the first serves all lines, a later one those that share a crowded key of the cut before.
CUTS = (EDITS + 1, 5, 9, 17)
#: Index rows from which a key of each cut is crowded: about where a line's pairs under it outnumber the line's keys in the next cut.
DENSE = (12, 48, 192, 192)


def lines_of(docs: DataFrame, least_chars: int, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, row_key, line_no, line) for lines of at least ``least_chars`` characters, and non-blank ones of ``exact_chars``; ``row_key`` is a hash of id and text."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row_key"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    wanted = F.length("line") >= least_chars
    return rows.where(wanted if exact_chars is None else wanted | ((F.length("line") >= exact_chars) & F.col("line").rlike(r"\S")))


def open_segments(parts: int) -> list[tuple[int, int, int, int]]:
    """(i, j, longer, shift): what a line may share with an indexed one that is ``longer`` characters shorter.

    Each edit touches one of the indexed line's segments, so all but two, i
    and j, occur in the other line: those before i in place, those after j
    moved by ``longer``, those between moved by ``shift``, where i takes one
    edit and j the other. Both edits in one segment is the case of two
    adjacent ones. The patterns of equal place (the index itself) come first.
    """
    found = [
        (i, j, longer, shift)
        for i in range(parts)
        for j in range(i + 1, parts)
        for longer in range(EDITS + 1)
        for shift in (range(longer - 1, 2) if j > i + 1 else (0,))
    ]
    return sorted(found, key=lambda c: (_kind(c[2], c[3]), c))


def _kind(longer: int, shift: int) -> int:
    """0: the line's own place in the index, 1: another place at the same length, 2: a shorter line's."""
    return 2 if longer else int(shift != 0)


def _key(parts: int, i: Column, j: Column, longer: Column, shift: Column, given: Sequence[bool] = (True, True, True)) -> Column:
    """Hash of the shared segments of ``line`` (``_n`` characters); ``given`` says which of the three runs of segments there are."""
    n = F.col("_n") - longer
    end = lambda p: F.floor(n * p / parts).cast("int")
    runs = [(F.lit(0), F.lit(0), i), (shift, i + 1, j), (longer, j + 1, F.lit(parts))]
    texts = [F.substring(F.col("line"), end(lo) + moved + 1, end(hi) - end(lo)) for (moved, lo, hi), there in zip(runs, given, strict=True) if there]
    return F.when(n >= 0, F.xxhash64(n, i, j, *texts))


def first_keys(lines: DataFrame) -> DataFrame:
    """(key, id, kind) of the first cut, once for each distinct line; the rows of kind 0 are the index.

    The keys of a line are one row of whole numbers, of which a task keeps one
    for each line: a line that occurs everywhere is a few rows from there on.
    They are written once for the count, the pairs and the crowded lines.
    """
    parts = CUTS[0]
    cases = open_segments(parts)
    n_own, n_same = (sum(_kind(longer, shift) < k for _, _, longer, shift in cases) for k in (1, 2))
    sized = lines.select("id", "line", F.length("line").alias("_n"))
    keys = [_key(parts, *map(F.lit, c), given=(c[0] > 0, c[1] > c[0] + 1, c[1] < parts - 1)).alias(f"_k{x}") for x, c in enumerate(cases)]
    names = [f"_k{x}" for x in range(len(cases))]
    once = settled(sized.select("id", *keys).groupBy("id").agg(*[F.min(c).alias(c) for c in names]))
    asked = once.select("id", F.posexplode(F.array(*names)).alias("nth", "key")).where("key is not null")
    kind = F.when(F.col("nth") < n_own, 0).when(F.col("nth") < n_same, 1).otherwise(2)
    return asked.select("key", "id", kind.alias("kind"))


def finer_keys(lines: DataFrame, parts: int) -> DataFrame:
    """``first_keys`` for ``parts`` segments and distinct lines, with the signature of each line."""
    signed = lines.select("id", "line", signature(bag(characters(F.col("line")))).alias("sig"))
    rows = signed.select("id", "line", "sig", F.length("line").alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(parts - 2))).alias("_i"))
    rows = rows.select("*", F.explode(F.sequence(F.col("_i") + 1, F.lit(parts - 1))).alias("_j"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(EDITS))).alias("_longer"))
    shifts = F.when(F.col("_j") == F.col("_i") + 1, F.array(F.lit(0))).otherwise(F.sequence(F.col("_longer") - 1, F.lit(1)))
    rows = rows.select("*", F.explode(shifts).alias("_shift"))
    key = _key(parts, F.col("_i"), F.col("_j"), F.col("_longer"), F.col("_shift"))
    kind = F.when(F.col("_longer") > 0, 2).when(F.col("_shift") != 0, 1).otherwise(0)
    return settled(rows.select(key.alias("key"), "id", kind.alias("kind"), "sig").where("key is not null"))


def characters(text: Column) -> Column:
    """The code points of a text."""
    return F.transform(F.split(text, ""), F.ascii)


def bag(chars: Column, classes: int = 16) -> Column:
    """How many characters of a text fall into each class of code points."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.size(F.filter(chars, lambda c: c % classes == k)))


def bags_allow(a: Column, b: Column) -> Column:
    """False if the bags of two texts alone show more than EDITS edits: an edit adds one character at most and takes one at most."""
    gap = F.zip_with(a, b, lambda x, y: x - y)
    over = lambda sign: F.aggregate(gap, F.lit(0), lambda acc, x: acc + F.greatest(sign * x, F.lit(0))) <= EDITS
    return over(1) & over(-1)


def signature(counts: Column) -> Column:
    """A ``bag`` as one number: four bits for each of the 16 classes, the count modulo 16."""
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR((x % 16).cast("long")))


def signatures_allow(a: Column, b: Column) -> Column:
    """``bags_allow`` for signatures: never False where the bags allow a pair."""
    gaps = [F.pmod(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)), F.lit(16)) for k in range(16)]
    more, less = ([F.when(g < 8, g).otherwise(0) for g in gaps], [F.when(g < 8, 0).otherwise(16 - g) for g in gaps])
    return (reduce(lambda x, y: x + y, more) <= EDITS) & (reduce(lambda x, y: x + y, less) <= EDITS)


def within_edits(a: Column, b: Column) -> Column:
    """True if two texts, given as ``characters`` in columns of their own, are within EDITS edits: banded bit-parallel distance.

    The band holds the cells next to the diagonal as bits: vertical and
    horizontal differences of +1 and -1 move from column to column by a few
    operations on whole numbers. Past the limit the fold does no more work.
    """
    long_first = F.size(a) >= F.size(b)
    p, t = F.when(long_first, a).otherwise(b), F.when(long_first, b).otherwise(a)
    m, n = F.size(p), F.size(t)
    full = (1 << BAND) - 1

    def flip(x: Column) -> Column:
        return x.bitwiseXOR(F.lit(full))

    def half(x: Column) -> Column:
        return F.shiftright(x, 1)

    def step(acc: Column, j: Column) -> Column:  # j from 0: the column of shorter[j]
        vp, vn, score = acc["vp"], acc["vn"], acc["score"]
        c = F.get(t, j)
        eq = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(p, j - EDITS + r) == c, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(BAND)])
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), score.alias("score"), acc["at"].alias("at"))

    def settle(mid: Column, j: Column) -> Column:
        d0, vp, vn = mid["d0"], mid["vp"], mid["vn"]
        hp, hn = vn.bitwiseOR(flip(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
        diagonal = j < m - EDITS
        down = F.when(d0.bitwiseAND(F.lit(1 << (BAND - 1))) == 0, 1).otherwise(0)
        across = F.when(hp.bitwiseAND(mid["at"]) != 0, 1).when(hn.bitwiseAND(mid["at"]) != 0, -1).otherwise(0)
        return F.struct(
            hn.bitwiseOR(flip(half(d0).bitwiseOR(hp))).alias("vp"),
            half(d0).bitwiseAND(hp).alias("vn"),
            (mid["score"] + F.when(diagonal, down).otherwise(across)).alias("score"),
            F.when(diagonal, mid["at"]).otherwise(half(mid["at"])).alias("at"),
        )

    start = F.struct(F.lit(full ^ ((1 << EDITS) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(EDITS).alias("score"), F.lit(1 << (BAND - 2)).alias("at"))
    # the score can only fall while the band's last row is left, by one in each of at most 2 * EDITS columns
    hopeless = lambda acc: acc["score"] > 3 * EDITS
    folded = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        start,
        lambda acc, j: F.when(hopeless(acc), acc).otherwise(F.element_at(F.transform(F.array(step(acc, j)), lambda mid: settle(mid, j)), 1)),
        lambda acc: acc["score"] <= EDITS,
    )
    return F.when(m - n > EDITS, F.lit(False)).when(m <= EDITS, F.lit(True)).otherwise(folded)


def _pairs(asked: DataFrame, own: DataFrame, apart: str = "true") -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of probes and index rows under equal keys; equal lengths pair in one direction.

    Where the rows have signatures, a pair whose signatures show too many edits is never made.
    """
    own = own.withColumnsRenamed({"id": "other", "sig": "other_sig"})
    found = asked.join(own, "key").where(f"id <> other and (kind = 2 or id > other) and {apart}")
    if "sig" in asked.columns:
        found = found.where(signatures_allow(F.col("sig"), F.col("other_sig")))
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _fetch(lines: DataFrame, ids: DataFrame, small: int = 500_000) -> DataFrame:
    """(id, line) of the wanted ids, once each; the ids are sent to the lines while their number is small, else both are joined by shuffle."""
    wanted = settled(ids.select("id").distinct())
    few = wanted.count() <= small
    return settled(lines.select("id", "line").join(F.broadcast(wanted) if few else wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")))


def _verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidate pairs that are within EDITS edits; ``texts`` holds (id, line) of all of them."""
    found = settled(found)
    texts = settled(texts.select("id", characters(F.col("line")).alias("chars")).select("id", "chars", bag(F.col("chars")).alias("bag")))
    left, right = (texts.select(F.col("id").alias(c), F.col("chars").alias(f"_{c}"), F.col("bag").alias(f"_bag_{c}")) for c in ("a", "b"))
    both = found.repartition(block_partitions(found.sparkSession, found.count(), 500)).join(left, "a").join(right, "b")
    near = F.when(bags_allow(F.col("_bag_a"), F.col("_bag_b")), within_edits(F.col("_a"), F.col("_b"))).otherwise(F.lit(False))
    return settled(both.where(near).select("a", "b"))


def _classed(asked: DataFrame, own: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the same classes as all links of ``found`` and of the crowded rows do.

    Every line is held against the least line of each of its keys. Pairs are
    made only where that leaves a key with lines of several classes, and one
    side of each is a line outside the class of the key's pivot.
    """
    pivots = settled(own.groupBy("key").agg(F.min("id").alias("pivot")))
    star = asked.join(pivots, "key").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
    links = _verified(found.union(star).distinct(), texts)
    classes = settled(components(links))
    roots = lambda rows, c: rows.join(classes.withColumnRenamed("node", c), c, "left").withColumn("root", F.coalesce("root", c))
    mains = roots(pivots, "pivot").select("key", F.col("root").alias("main"))
    asked, own = (roots(rows, "id").join(mains, "key").withColumn("outside", F.col("root") != F.col("main")).drop("main") for rows in (asked, own))
    asked, own = settled(asked), settled(own.withColumnRenamed("root", "other_root").withColumnRenamed("outside", "other_outside"))
    rest = _pairs(asked.where("outside"), own, "root <> other_root").union(_pairs(asked.where("not outside"), own.where("other_outside"), "root <> other_root"))
    return settled(links.union(_verified(rest.distinct(), texts)))


def edit_links(lines: DataFrame, dense: int | None = None, spanning: bool = False) -> DataFrame:
    """Links (a, b) of distinct lines (id, line, repeats allowed) within EDITS edits.

    Lines of keys with more than ``dense`` index rows (unset: ``DENSE`` of the
    cut) are joined by the keys of the next cut instead. ``spanning`` leaves
    out links inside a class that other links hold together, where a key of
    the last cut is crowded. The lines themselves are read for the first keys
    and for one fetch of the texts that are wanted later.
    """
    found, members, texts, crowd = [], None, None, None
    for parts, most in zip(CUTS, DENSE, strict=True):
        asked = first_keys(lines) if members is None else finer_keys(texts.join(members, "id", "left_semi"), parts)
        own = asked.where("kind = 0").drop("kind")
        last = parts == CUTS[-1]
        several = 0
        if spanning or not last:
            crowded = settled(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (dense or most)).select("key"))
            several = crowded.count()
        if not several:
            found.append(settled(_pairs(asked, own)))
        else:
            known = F.broadcast(crowded) if several <= 200_000 else crowded
            found.append(settled(_pairs(asked.join(known, "key", "left_anti"), own.join(known, "key", "left_anti"))))
            members = settled(asked.join(known, "key", "left_semi").select("id").distinct())
        if texts is None:
            ends = found[0].select(F.explode(F.array("a", "b")).alias("id"))
            texts = _fetch(lines, ends.union(members) if several else ends)
        if last and several:
            crowd = tuple(settled(rows.join(known, "key", "left_semi")) for rows in (asked, own))
        if not several:
            break
    pairs = reduce(DataFrame.union, found).distinct()
    return _verified(pairs, texts) if crowd is None else _classed(*crowd, pairs, texts)


def repeated_lines(docs: DataFrame, least_chars: int = 32, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, row_key, removed): for each row that repeats lines of earlier ones, the numbers of those lines, from 0.

    Lines that are equal or linked, directly or over others, form a class. The
    class keeps its first line by (doc_id, null last; row_key; line number);
    every other occurrence is to be removed. Lines of fewer than
    ``least_chars`` characters are linked to equal lines only, from
    ``exact_chars`` on, and never where that is None; blank ones among them are
    never removed. Rows that repeat both doc_id and text count as one document.
    """
    lines = lines_of(docs, least_chars, exact_chars).withColumn("id", F.xxhash64("line"))
    links = edit_links(lines.where(F.length("line") >= least_chars).select("id", "line"), spanning=True)
    classes = components(links)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key", "line_no")
    places = lines.select("id", place.alias("place"))
    counted = places.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    linked = counted.join(classes, counted["id"] == classes["node"], "left").where("n > 1 or root is not null")
    members = settled(linked.select("id", "first", F.coalesce("root", "id").alias("root")))
    kept = members.groupBy("root").agg(F.min("first").alias("keep"))
    keepers = settled(members.join(kept, "root").select("id", "keep"))
    extra = places.join(keepers, "id").where("place <> keep")
    return extra.groupBy(F.col("place.doc_id").alias("doc_id"), F.col("place.row_key").alias("row_key")).agg(F.array_sort(F.collect_set("place.line_no")).alias("removed"))


def line_report(docs: DataFrame, least_chars: int = 32, exact_chars: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every row of ``docs``; null texts have no line, the empty text one."""
    found = settled(repeated_lines(docs, least_chars, exact_chars))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row_key"), F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("n_lines"))
    joined = rows.join(found.withColumnRenamed("doc_id", "_id"), (rows["row_key"] == found["row_key"]) & rows["doc_id"].eqNullSafe(F.col("_id")), "left")
    return joined.select(rows["doc_id"], F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = 32, exact_chars: int | None = None) -> DataFrame:
    """``docs`` with repeated lines cut from ``text`` and ``n_chars`` (where there is such a column) counted anew.

    No row goes; a text of which nothing is left becomes empty. Other texts are unchanged.
    """
    found = settled(repeated_lines(docs, least_chars, exact_chars)).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_row_key"), F.col("removed").alias("_removed"))
    inside = dict(zip(docs.columns, (f"_c{i}" for i in range(len(docs.columns))), strict=True))
    plain = docs.toDF(*inside.values())  # so that no name of a column meets one of the report's
    doc_id, own = F.col(inside["doc_id"]), F.col(inside["text"])
    joined = plain.join(found, (F.xxhash64(doc_id, own.cast("string")) == F.col("_row_key")) & doc_id.eqNullSafe(F.col("_id")), "left")
    left = F.filter(F.split(own.cast("string"), "\n", -1), lambda x, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull(), own).otherwise(F.array_join(left, "\n"))
    columns = {"text": text}
    if "n_chars" in inside:
        columns["n_chars"] = F.when(F.col("_removed").isNull(), F.col(inside["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[columns.get(c, F.col(n)).alias(c) for c, n in inside.items()])
