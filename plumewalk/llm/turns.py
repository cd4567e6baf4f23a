"""Conversation structure repair by generalised LR parsing with weighted edits.

The legal role sequences are a grammar: an optional system turn, then pairs of
user and assistant, or nothing. Its LR automaton drives a graph-structured
stack: nodes (state, node below) are shared, every row moves each stack top on
by keeping, reroling or deleting it, inserted turns move a top without a row,
and tops that become equal are merged by the smallest (cost, audit), the audit
being the initials of the edits in order. (Two audits of equal cost at the same
top never begin one another, as each row adds one letter other than I, so the
smaller one stays smaller whatever follows.) The grammar is left-recursive, so
there are few distinct stacks, and a run of rows amounts to a small table: for
each top before it the tops after it, with cost and audit.

So a conversation of any length is cut into chunks, whose tables are made
independently and joined in order. Only two things pass through one task per
conversation, both as a stream: the tables, and the repaired text on its way
into a SHA-256, which has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import settled
from plumewalk.operators.ordered import with_position

#: Rules of the role grammar: s system, u user, a assistant; C is a conversation, P its pairs.
RULES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a chunk.
CHUNK = 4096
BLANKS = " \t\n\x0b\x0c\r"

Item = tuple[int, int]
#: The cheapest way to each stack top.
Tops = dict[int, tuple[int, str]]


def _closed(items: set[Item]) -> frozenset[Item]:
    todo = list(items)
    while todo:
        rule, dot = todo.pop()
        right = RULES[rule][1]
        for k, (left, _) in enumerate(RULES):
            if dot < len(right) and right[dot] == left and (k, 0) not in items:
                items.add((k, 0))
                todo.append((k, 0))
    return frozenset(items)


class Stacks:
    """The stacks that the grammar's LR automaton can reach, as shared nodes numbered in order of discovery."""

    def __init__(self) -> None:
        start = _closed({(k, 0) for k, (left, _) in enumerate(RULES) if left == "C"})
        self.nodes: list[tuple[frozenset[Item], int | None]] = [(start, None)]
        self.moves: dict[tuple[int, str], int] = {}
        at = 0
        while at < len(self.nodes):
            for symbol in "sua":
                top = self._shifted(at, symbol)
                if top is not None:
                    self.moves[at, symbol] = top
            at += 1
        self.accepting = {k for k, (state, _) in enumerate(self.nodes) if any(RULES[r][0] == "C" and d == len(RULES[r][1]) for r, d in state)}
        #: Tops between two rows; the other nodes are reduced at once.
        self.tops = sorted({0, *self.moves.values()})
        #: The role that an inserted or reroled turn can take at each top.
        self.taken = {k: [(symbol, self.moves[k, symbol]) for symbol in "ua" if (k, symbol) in self.moves] for k in range(len(self.nodes))}

    def _pushed(self, below: int, symbol: str) -> int | None:
        moved = {(r, d + 1) for r, d in self.nodes[below][0] if d < len(RULES[r][1]) and RULES[r][1][d] == symbol}
        if not moved:
            return None
        node = (_closed(moved), below)
        if node not in self.nodes:
            self.nodes.append(node)
        return self.nodes.index(node)

    def _shifted(self, top: int, symbol: str) -> int | None:
        """The top after a shift and the reductions that follow: a state whose only item is complete is reduced at once."""
        top = self._pushed(top, symbol)
        while top is not None and len(self.nodes[top][0]) == 1:
            (rule, dot), left = next(iter(self.nodes[top][0])), None
            left, right = RULES[rule]
            if dot < len(right) or left == "C":
                break
            for _ in right:
                top = self.nodes[top][1]
            top = self._pushed(top, left)
        return top

    def filled(self, tops: Tops) -> Tops:
        """Tops that are reached by inserting turns, too; every insert costs, so this ends."""
        out, todo = dict(tops), list(tops)
        while todo:
            top = todo.pop()
            cost, audit = out[top]
            for _, to in self.taken[top]:
                way = (cost + INSERT, audit + "I")
                if to not in out or way < out[to]:
                    out[to] = way
                    todo.append(to)
        return out

    def after(self, tops: Tops, code: str) -> Tops:
        """Tops after a row: its role's initial, in upper case if the text is truncated; 0 to 3 if it must go."""
        out: Tops = {}

        def reach(to: int, way: tuple[int, str]) -> None:
            if to not in out or way < out[to]:
                out[to] = way

        initial, extra = code.lower(), TRUNCATED * code.isupper()
        for top, (cost, audit) in self.filled(tops).items():
            reach(top, (cost + DELETE, audit + "D"))
            if code.isdigit():
                continue
            if (top, initial) in self.moves:
                reach(self.moves[top, initial], (cost + extra, audit + "K"))
            for _, to in self.taken[top]:
                reach(to, (cost + REROLE + extra, audit + "R"))
        return out

    def run(self, tops: Tops, codes: str) -> Tops:
        for code in codes:
            tops = self.after(tops, code)
        return tops

    def ended(self, tops: Tops) -> tuple[int, str]:
        """The cheapest way to a whole conversation."""
        return min(way for top, way in self.filled(tops).items() if top in self.accepting)


@cache
def stacks() -> Stacks:
    return Stacks()


@lru_cache(maxsize=50_000)
def _table_of_short(start: int, codes: str) -> tuple[tuple[int, int, str], ...]:
    return tuple((to, cost, audit) for to, (cost, audit) in stacks().run({start: (0, "")}, codes).items())


def chunk_table(start: int, codes: str) -> tuple[tuple[int, int, str], ...]:
    """(top after, cost, audit) of a chunk from one top before it; short chunks are often alike and remembered."""
    return _table_of_short(start, codes) if len(codes) <= 64 else _table_of_short.__wrapped__(start, codes)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the seeded damage; null values count as one space in the seed, role and text."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    plain = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), draw.alias("_draw")).where("_draw <> 0")
    text = F.when(F.col("_draw") == 1, "").when(F.col("_draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv_id", "turn", F.when(F.col("_draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _named(rows: DataFrame) -> DataFrame:
    """Adds ``_k``, a text that stands for conv_id and is never null."""
    return rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))


def faults(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(_k, turn, pos, role, text, fault, code) of ``rows`` (conv_id, turn, role, text, copy).

    ``pos`` counts a conversation's rows by turn (null first), then role, text
    and copy. ``fault`` is the first of blank, duplicate and truncated, or
    null. The first row of a (role, text) comes from one aggregation, so a text
    that half of all rows repeat is no hot group.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    plain = _named(rows).select("_k", "turn", role.alias("role"), text.alias("text"), "copy", F.md5(text.cast("binary")).alias("_h"))
    placed = settled(with_position(plain, ["_k"], ["turn", "role", "text", "copy"], "pos", limit))
    repeated = placed.groupBy("_k", "role", "_h").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    blank = end == ""
    fault = F.when(blank, "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    at = F.when(initial.isin("s", "u", "a"), F.instr(F.lit("sua"), initial)).otherwise(4)
    code = F.when(F.col("fault").isNull(), F.substring(F.lit("suax"), at, F.lit(1))).when(F.col("fault") == "truncated", F.substring(F.lit("SUAX"), at, F.lit(1))).otherwise((at - 1).cast("string"))
    return placed.join(repeated, ["_k", "role", "_h"], "left").withColumn("fault", fault).select("_k", "turn", "pos", "role", "text", "fault", code.alias("code"))


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


def cheapest_edits(rows: DataFrame) -> DataFrame:
    """(_k, cost, audit, illegal) of each conversation of ``rows`` (_k, pos, code)."""
    part = F.floor(F.col("pos") / CHUNK).cast("long")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    chunks = rows.groupBy("_k", part.alias("part")).agg(joined.alias("codes"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            ways, initials = [], []
            for n, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts = [0] if n == 0 else stacks().tops
                ways.append([{"start": s, "top": to, "cost": cost, "audit": audit} for s in starts for to, cost, audit in chunk_table(s, codes)])
                initials.append(codes.translate(str.maketrans("SUAX0123", "suaxsuax")))
            breaks = [_illegal(x) for x in initials]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ways, kind), pa.array(breaks, pa.int64()), pa.array([x[0] for x in initials]), pa.array([x[-1] for x in initials])],
                ["_k", "part", "ways", "illegal", "first", "last"],
            )

    made = chunks.mapInArrow(tables, "_k string, part long, ways array<struct<start int, top int, cost long, audit string>>, illegal long, first string, last string")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tops, shared, illegal, last = None, {}, [], 0, ""

        def done() -> Iterator[pa.RecordBatch]:
            if held is not None:
                cost, audit = stacks().ended(tops)
                yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([cost], pa.int64()), pa.array(["".join([*shared, audit])]), pa.array([illegal], pa.int64())], ["_k", "cost", "audit", "illegal"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["_k"] != held:
                    yield from done()
                    held, tops, shared, illegal, last = row["_k"], {0: (0, "")}, [], 0, ""
                new: Tops = {}
                for way in row["ways"]:
                    if way["start"] in tops:
                        cost, audit = tops[way["start"]]
                        found = (cost + way["cost"], audit + way["audit"])
                        if way["top"] not in new or found < new[way["top"]]:
                            new[way["top"]] = found
                # what all tops have in common is kept once
                audits = [audit for _, audit in new.values()]
                low, high, n = min(audits), max(audits), 0
                while n < min(len(low), len(high)) and low[n] == high[n]:
                    n += 1
                shared.append(low[:n])
                tops = {top: (cost, audit[n:]) for top, (cost, audit) in new.items()}
                illegal += row["illegal"] + (_illegal(last + row["first"]) if last else 0)
                last = row["last"]
        yield from done()

    ordered = made.repartition("_k").sortWithinPartitions("_k", "part")
    return ordered.mapInArrow(join, "_k string, cost long, audit string, illegal long")


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: the rows of one conversation with an audit applied."""
    known, top = stacks(), 0
    for edit in audit:
        if edit in "IR":
            symbol, top = known.taken[top][0]
            yield ROLES[symbol], "" if edit == "I" else next(rows)[1]
        else:
            role, text = next(rows)
            if edit == "K":
                top = known.moves[top, role[0]]
                yield role, text


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(_k, repaired_sha256): SHA-256 of ``role:text`` lines joined by newlines, of ``rows`` (_k, pos, role, text) with ``audits`` (_k, audit) applied.

    The audit goes ahead of its conversation's rows in one sorted stream; no more than a batch of texts is held.
    """
    first = audits.select("_k", F.lit(-1).cast("long").alias("pos"), F.col("audit").alias("role"), F.lit("").alias("text"))
    stream = rows.select("_k", "pos", "role", "text").unionByName(first).repartition("_k").sortWithinPartitions("_k", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple[str, int, str, str]]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("_k", "pos", "role", "text")), strict=True)

        feed = flat()
        item = next(feed, None)
        while item is not None:
            key, audit, digest, begun = item[0], item[2], hashlib.sha256(), False
            following = None

            def own() -> Iterator[tuple[str, str]]:
                nonlocal following
                for row in feed:
                    if row[0] != key:  # noqa: B023
                        following = row
                        return
                    yield row[2], row[3]

            rest = own()
            for role, text in repaired_rows(audit, rest):
                digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
            for _ in rest:
                raise ValueError("an audit does not fit its rows")
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["_k", "repaired_sha256"])
            item = following

    return stream.mapInArrow(run, "_k string, repaired_sha256 string")


def repair(rows: DataFrame, every: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, copy), and for each conv_id of ``every`` that has none.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    and repaired_sha256. Keeping a row is free, reroling costs 3, deleting 4,
    inserting an empty turn 3, and a truncated row that stays 3. Blank and
    duplicate rows must go. The cheapest edits to a legal role sequence are
    taken, among those the ones whose initials are first in ASCII order.

    Null turns come first, equal turns in the order of role, text and copy; a
    null role or text is one space, a null conv_id a conversation of its own. A
    role counts by its first letter; one without a letter can't be kept. Gaps
    that pass 64 bits are null. A conversation without rows has zeros, an empty
    audit and the digest of nothing. Other columns are not read; empty tables
    give no rows.
    """
    found = settled(faults(rows, limit))
    edits = settled(cheapest_edits(found))
    digests = repaired_digests(found, edits)
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    faulty = found.groupBy("_k").agg(count("blank"), count("duplicate"), count("truncated"))
    turns = found.where("turn is not null").groupBy("_k", "turn").agg(F.lit(1).alias("_one")).groupBy("_k").agg(F.min("turn").alias("_lo"), F.max("turn").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    gaps = turns.select("_k", F.expr("try_cast(cast(_hi as decimal(20,0)) - cast(_lo as decimal(20,0)) + 1 - _n as bigint)").alias("gaps"), F.lit(True).alias("_turns"))
    ids = _named(rows.select("conv_id") if every is None else every.select("conv_id")).groupBy("_k").agg(F.first("conv_id").alias("conv_id"))
    out = ids.join(faulty, "_k", "left").join(gaps, "_k", "left").join(edits, "_k", "left").join(digests, "_k", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", F.when(F.col("_turns"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"), *map(number, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
