"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with k = m // piece - 1 edits. It is cut
into k + 1 pieces: an occurrence with at most k edits leaves one piece
untouched, so exact piece hits find every candidate place, and Myers'
bit-parallel distance verifies the place. Pieces of a bounded block of items
form one multi-pattern automaton; a larger benchmark takes one pass for each
block, so the automaton a task holds never grows with the benchmark.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import kept_rows, per_text

RUN = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    """Lower-case runs of letters and digits, each between single blanks; blank at both ends unless there is none."""
    words = RUN.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def cut(item: str, piece: int) -> list[tuple[int, str]]:
    """(offset, text) of the k + 1 near-equal pieces of an item."""
    n = max(1, len(item) // piece)
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_match(pattern: str, window: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best occurrence of a pattern in a window with at most ``most`` edits: Myers' bit vectors in one long integer."""
    at = window.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    if not most:
        return None
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(window, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        ph = (ph << 1) & full  # the text before the occurrence costs nothing
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j)
    return best


class Matcher:
    """Items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], piece: int, memory: int = 20_000):
        self.ids: dict[str, list[int]] = {}
        for item_id, text in items:
            if text:
                self.ids.setdefault(text, []).append(item_id)
        self.texts = list(self.ids)
        self.pieces = [cut(t, piece) for t in self.texts]
        self.known: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.memory = memory
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, parts in enumerate(self.pieces):
            for offset, part in parts:
                places.setdefault(part, []).append((k, offset))
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        if places:
            self.automaton.make_automaton()

    def _verify(self, k: int, window: str) -> tuple[int, int] | None:
        """Copied passages meet the same windows again and again, so some answers are kept."""
        key = (k, window)
        if key not in self.known:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[key] = best_match(self.texts[k], window, len(self.pieces[k]) - 1)
        return self.known[key]

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normal form) of the best occurrence of each item."""
        hits: dict[int, set[int]] = {}
        if self.texts and text:
            for end, (n, where) in self.automaton.iter(text):
                for k, offset in where:
                    hits.setdefault(k, set()).add(end + 1 - n - offset)
        found = []
        for k, starts in hits.items():
            slack, m, best, done = len(self.pieces[k]) - 1, len(self.texts[k]), None, None
            for s in sorted(starts):
                if done is not None and s <= done:
                    continue  # another piece of a place that a window has covered
                lo, hi = max(0, s - slack), s + m + 2 * slack
                done = s + slack if slack else None
                got = self._verify(k, text[lo:hi])
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
                if best and not best[0]:
                    break
            if best:
                found += [(i, *best) for i in self.ids[self.texts[k]]]
        return found


def item_blocks(benchmark: DataFrame, most_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``most_chars`` characters, each a bounded read of the driver."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-int(total) // most_chars)
    return [[(r["item_id"], normal(r["text"])) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()] for b in range(blocks)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, piece: int = 16, most_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, end): each pair of a document and an item that occurs in it.

    Texts are compared in their normal form: lower case, runs of letters and
    digits between single blanks. An item of m such characters may have
    m // ``piece`` - 1 edits (insertions, deletions, replacements; none below
    2 * ``piece`` characters); ``distance`` is the least, ``end`` its first end
    in the document's normal form. Items without letters or digits, null texts
    and null item ids match nothing. Equal items are all reported; repeated
    documents give repeated rows; an empty side gives an empty result. Only
    doc_id, item_id and the two texts are read.
    """
    blocks = item_blocks(benchmark, most_chars)

    def one(items: list[tuple[int, str]]) -> DataFrame:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())]))

        def make():
            matcher = Matcher(items, piece)

            def kernel(texts):
                found = [[dict(zip(("item_id", "distance", "end"), x, strict=True)) for x in matcher.search(normal(t))] for t in texts]
                return {"found": pa.array(found, kind)}

            return kernel

        rows = per_text(docs, make, "found array<struct<item_id: long, distance: int, end: int>>")
        return rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.item_id", "f.distance", "f.end")

    if not blocks:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("distance"), F.lit(0).alias("end")).where("false")
    return reduce(DataFrame.union, map(one, blocks))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, piece: int = 16, most_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item (see ``find_leaks``); judged row by row, without a join."""

    def clean(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def make():
            matcher = Matcher(items, piece)
            return lambda texts: [not matcher.search(normal(t)) for t in texts]

        return kept_rows(rows, make)

    return reduce(clean, item_blocks(benchmark, most_chars), docs)
