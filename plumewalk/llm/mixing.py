"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source gets a token target. Among all document rates between 0 and
``most_copies`` that meet it, the mix takes those closest to one copy each in
Kullback-Leibler divergence. Their convex dual has one multiplier per source:
the rate of a document of n words is min(most_copies, exp(multiplier * n /
mean n)). A rate depends on (source, n) only, so the rows are reduced once to a
histogram of these cells; the Newton rounds for all sources at once, and the
rounding, work on cells, and the documents are read again only to be given
their copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumewalk.llm.common import WORD
from plumewalk.operators.ordered import with_position
from plumewalk.session import durable, written


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each text; null and empty texts have none."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds ``src`` (position by code point, null last) and ``weight`` (the given ones, repeating)."""
    keyed = sources.select("*", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"))
    placed = with_position(keyed, [], ["_none", "_name"], "src").drop("_none", "_name")
    return placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float, most_copies: int) -> DataFrame:
    """Adds ``target``: ``share`` of all words by weight, at most ``most_copies`` times a source's words.

    What a full source cannot take goes to the others by weight until none is
    above its limit. The level (words per unit of weight) only rises, so a
    source once full stays full; each round is one aggregation to three numbers.
    """
    cap = F.col("source_size") * most_copies
    total = share * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        full = cap < F.col("weight") * level
        row = sources.agg(F.sum(F.when(full, cap)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        risen = (total - float(row["full"] or 0)) / row["open"]
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level))


def _rate(multiplier: Column, x: Column, most_copies: int) -> Column:
    """exp(multiplier * x), at most ``most_copies``; the exponent is cut first, so nothing overflows."""
    return F.exp(F.least(multiplier * x, F.log(F.lit(float(most_copies)))))


def multipliers(cells: DataFrame, sources: DataFrame, most_copies: int, tolerance: float = 1e-6) -> DataFrame:
    """``sources`` with ``multiplier``: the root of each source's dual gradient, words taken minus target.

    Newton steps from zero, kept inside a bracket that each round narrows;
    a step that leaves it, or a flat gradient, is replaced by bisection (by
    doubling while a side is open). A source at its limit gets infinity
    (``most_copies`` of everything), a source without words zero. All sources
    move in the same round: one join of cells with sources, one aggregation
    that is pre-aggregated map-side. Ends when every source is within
    ``tolerance`` of its target or its bracket has no number left.
    """
    cap = (F.col("source_size") * most_copies).cast("double")
    free = (F.col("source_size") > 0) & (F.col("target") < cap)
    state = written(
        sources.withColumns(
            {
                "multiplier": F.when(F.col("target") >= cap, F.lit(float("inf"))).otherwise(0.0),
                "mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-300)),
                "lo": F.lit(float("-inf")),
                "hi": F.lit(float("inf")),
                "open": free,
            }
        ).withColumn("multiplier", F.when(F.col("source_size") > 0, F.col("multiplier")).otherwise(0.0))
    )
    while not state.where("open").isEmpty():
        x = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), x, most_copies)
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most_copies, words * x).otherwise(0.0)
        sums = cells.join(state.where("open").select("src", "multiplier", "mean"), "src").groupBy("src").agg(F.sum(words).alias("_words"), F.sum(slope).alias("_slope"))
        gap, m = F.col("_words") - F.col("target"), F.col("multiplier")
        met = F.abs(gap) <= tolerance * F.col("target")
        lo, hi = F.when(gap < 0, m).otherwise(F.col("lo")), F.when(gap > 0, m).otherwise(F.col("hi"))
        inf = float("inf")
        middle = F.when(lo == -inf, F.least(2 * hi, hi - 1)).when(hi == inf, F.greatest(2 * lo, lo + 1)).otherwise((lo + hi) / 2)
        newton = m - gap / F.when(F.col("_slope") > 0, F.col("_slope"))
        inside = newton.isNotNull() & (newton > lo) & (newton < hi) & (F.abs(newton - m) <= 1 + F.abs(m))
        step = F.when(inside, newton).otherwise(middle)
        open_ = F.col("open")
        stuck = (step == m) | (step <= lo) | (step >= hi)
        state = written(
            state.join(sums, "src", "left").select(
                "src", "source", "source_size", "docs", "weight", "target", "mean",
                F.when(open_, lo).otherwise(F.col("lo")).alias("lo"),
                F.when(open_, hi).otherwise(F.col("hi")).alias("hi"),
                F.when(open_ & ~met & ~stuck, step).otherwise(m).alias("multiplier"),
                (open_ & ~met & ~stuck).alias("open"),
            )
        )
    return state.drop("lo", "hi", "open")


def round_cells(cells: DataFrame, sources: DataFrame, most_copies: int, tolerance: float = 1e-4) -> DataFrame:
    """Cells (src, size, n) with ``copies``: whole copies per cell whose words come as near to each target as copies allow.

    Expected copies are rounded along the sizes of a source, so that what one
    cell is rounded up the next ones are rounded down, and sizes next to each
    other keep their rates together. What a source then lacks, or has too much,
    is moved by all its cells at once: from the largest size that fits, the
    running sum says how many copies each cell gives. A cell that would pass
    the target is moved only if nothing fits and the gap becomes smaller by it.
    Each round at least halves what fits or narrows a gap by a whole copy, so a
    few rounds end it; a source stops when its gap is within ``tolerance`` or
    no single copy narrows it.
    """
    rate = F.when(F.col("multiplier") == float("inf"), F.lit(float(most_copies))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), most_copies))
    expected = F.least(F.col("n") * rate, (F.col("n") * most_copies).cast("double"))
    along = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.join(sources.select("src", "multiplier", "mean"), "src").select("src", "size", "n", expected.alias("expected")).withColumn("_up_to", F.sum("expected").over(along))
    rounded = F.floor(F.col("_up_to") + 0.5) - F.floor(F.col("_up_to") - F.col("expected") + 0.5)
    out = written(summed.select("src", "size", "n", "expected", F.greatest(F.lit(0).cast("long"), F.least(rounded.cast("long"), F.col("n") * most_copies)).alias("copies")))
    falling = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    while True:
        taken = out.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
        gaps = taken.join(sources.select("src", "target"), "src").select("src", (F.col("target") - F.col("_taken")).alias("gap"), "target").where(F.abs("gap") > tolerance * F.col("target"))
        room = F.when(F.col("gap") > 0, F.col("n") * most_copies - F.col("copies")).otherwise(F.col("copies"))
        able = out.where("size > 0").join(gaps, "src").withColumn("room", room).where("room > 0").withColumn("fits", F.col("size") <= F.abs("gap"))
        before = F.coalesce(F.sum(F.when(F.col("fits"), F.col("room") * F.col("size"))).over(falling), F.lit(0))
        some = F.max("fits").over(Window.partitionBy("src"))
        least = F.min(F.when(~F.col("fits"), F.col("size"))).over(Window.partitionBy("src"))
        fitting = F.least(F.col("room"), F.floor((F.abs("gap") - before) / F.col("size")).cast("long"))
        passing = (F.col("size") == least) & (F.col("size") < 2 * F.abs("gap"))
        k = F.when(some, F.when(F.col("fits"), F.greatest(fitting, F.lit(0).cast("long"))).otherwise(0)).when(passing, 1).otherwise(0)
        moves = able.select("src", "size", (k * F.signum("gap").cast("long")).alias("change")).where("change <> 0")
        moved = written(out.join(moves, ["src", "size"], "left").select("src", "size", "n", "expected", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"), F.col("change").isNotNull().alias("_moved")))
        if moved.where("_moved").isEmpty():
            return out
        out = moved.drop("_moved")


def mix(docs: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, most_copies: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source_rate) for every row of ``docs``.

    Sources in code point order, null last (null is a source of its own), weigh
    ``weights``, repeating, and share ``share`` times all words; see ``targets``.
    ``copies`` is how often the mix takes a document (0 to ``most_copies``),
    ``taken`` its words with repeats, ``source_rate`` the taken words of its
    source over its words (null for a source without words). Documents without
    words take part with zero words. Reruns agree: every draw is a hash of
    doc_id, so repeated rows may differ in copies but their multiset does not.
    Other columns are not read; an empty table gives an empty result.

    Copies of a cell are dealt by rank of a hash. A large cell (a hot group of
    equal sizes) is first cut into about sqrt(rows) / 4 sub-cells by the same
    hash, whose shares follow from their running counts, so no task sorts a
    whole cell.
    """
    rows = durable(sized(docs))
    hist = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    plain = durable(hist)
    totals = plain.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    sources = durable(targets(durable(cyclic_weights(totals, weights)), share, most_copies))
    same = plain["source"].eqNullSafe(sources["source"])
    cells = durable(plain.join(sources.select("src", "source"), same).select("src", "size", "n"))
    solved = multipliers(cells, sources, most_copies)
    dealt = round_cells(cells, solved, most_copies)

    taken = dealt.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("source_taken"))
    about = solved.join(taken, "src").select("src", F.col("source").alias("_source"), "source_size", "target", "source_taken")
    named = durable(dealt.select("src", F.col("size").alias("_size"), "n", F.col("copies").alias("_copies")).join(about, "src"))
    placed = rows.join(named, rows["source"].eqNullSafe(named["_source"]) & (rows["size"] == named["_size"]))
    parts = F.greatest(F.ceil(F.sqrt("n") / 4), F.lit(1))
    placed = placed.select("doc_id", "size", "src", "n", "_copies", "source_size", "target", "source_taken", F.pmod(F.xxhash64("doc_id"), parts).alias("part"))

    parts_n = placed.groupBy("src", "size", "part", "n", "_copies").agg(F.count(F.lit(1)).alias("rows"))
    up_to = F.sum("rows").over(Window.partitionBy("src", "size").orderBy("part"))
    whole = F.floor(F.col("_copies") / F.col("n")).cast("long")
    more = F.col("_copies") - whole * F.col("n")
    share_to = lambda c: F.floor(more * c / F.col("n"))
    shares = parts_n.withColumn("_up_to", up_to).select("src", "size", "part", whole.alias("_whole"), (share_to(F.col("_up_to")) - share_to(F.col("_up_to") - F.col("rows"))).alias("_more"))
    shares = durable(shares)

    ranked = placed.repartition("src", "size", "part").withColumn("_rank", F.row_number().over(Window.partitionBy("src", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")))
    out = ranked.join(shares, ["src", "size", "part"])
    copies = (F.col("_whole") + (F.col("_rank") <= F.col("_more")).cast("long")).cast("long")
    return out.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"),
        F.when(F.col("source_size") > 0, F.col("source_taken") / F.col("source_size")).alias("source_rate"),
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as rows: each document of ``docs`` as often as its ``copies``, columns of ``docs`` kept.

    Rows that repeat a doc_id share that id's copies, the smallest given to any of them.
    """
    counts = mixed.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.min("copies").cast("int").alias("_mix_copies")).where("_mix_copies > 0")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    joined = plain.join(counts, plain[names[docs.columns.index("doc_id")]].eqNullSafe(counts["_mix_id"]))
    return joined.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*names).toDF(*docs.columns)
