"""Phrase collocations from truncated suffix subtrees, one for each group of word prefixes.

The corpus is never indexed as a whole. Word prefixes are partitioned first:
a prefix with more places than the memory budget of a group is taken apart by
its next word, again and again down to the full depth, and the prefixes that
remain are packed, in order, into groups of about one budget each. A suffix is
the run of words from a place to the end of its piece, cut at ``DEPTH`` words.
Every suffix goes to the group that owns its prefix, equal ones as one leaf
with a count, and each group builds its subtree on its own: sorted leaves, in
which a node is a run of equal beginnings and its count the sum of its leaves.

Only phrases of at least ``least`` places are kept, so a suffix ends before a
word that is rarer (it can be in no such phrase). The test for that is a
bitmap of fixed size over word hashes: a false hit costs time, never a count.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumewalk.llm.common import settled
from plumewalk.session import durable

#: Words of the longest phrase.
DEPTH = 5
#: Suffixes of a group, unless that made more than ``MOST_GROUPS`` groups: then the budget grows with the corpus.
BUDGET = 2_000_000
MOST_GROUPS = 50_000
#: Bits of the bitmap of frequent words (4 MB).
BITS = 1 << 25
#: Places that a task turns into leaves at a time.
FLUSH = 2_000_000

#: Characters that end a piece, all read as a full stop, which therefore no word holds.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_STOP = bytes.maketrans(_ENDS, b"." * len(_ENDS))


def tokens_of(text: str | None, chunk: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, and b"." between pieces, in parts of about ``chunk`` bytes cut at a blank."""
    raw = (text or "").encode().lower().translate(_STOP)
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + chunk) if len(raw) - lo > chunk else -1
        hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].replace(b".", b" . ").split()
        lo = hi


def _key(lang: str, words: Iterable[bytes]) -> bytes:
    """A prefix as bytes: every word ends with a tab, so all suffixes of a prefix are neighbours in byte order."""
    return b"\t".join([lang.encode().hex().encode(), *words, b""])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame, least: int, most: int = 400_000) -> DataFrame:
    """(lang, word, c): words of at least ``least`` places, and under the empty word the places of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def tables() -> Iterator[pa.RecordBatch]:
            for lang, own in seen.items():
                own[b""] = sum(own.values())
                names = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), names, pa.array(list(own.values()), pa.int64())], ["lang", "word", "c"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = seen.setdefault(lang, Counter())
                for words in tokens_of(text):
                    own.update(words)
                own.pop(b".", None)
                if sum(map(len, seen.values())) >= most:
                    yield from tables()
        yield from tables()

    counted = _texts(docs).mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    return counted.where((F.col("c") >= least) | (F.col("word") == ""))


def frequent_bitmap(words: DataFrame) -> np.ndarray:
    """``BITS`` bits, as bytes: one is set for the hash of every frequent word; the driver gets 4 MB at most."""
    bit = F.pmod(F.xxhash64(F.concat("lang", F.lit("\t"), "word")), F.lit(BITS)) + 1
    parts = words.where("word <> ''").select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in parts.toLocalIterator():
        own = np.frombuffer(row["bits"], np.uint8)
        out[(row["part"] - 1) * len(own) : row["part"] * len(own)] = own
    return out


class _Numbers(dict):
    """Numbers of words in order of appearance; -1 for the end of a piece and for words that are not frequent."""

    def __init__(self, lang: str, frequent: np.ndarray):
        self.prefix, self.frequent, self.names = lang.encode() + b"\t", frequent, []
        self[b"."] = -1

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.prefix + word, 42) & (BITS - 1)
        known = self.frequent[h >> 3] >> (h & 7) & 1
        self[word] = n = len(self.names) if known else -1
        if known:
            self.names.append(word)
        return n


def windows(ids: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Rows of ``depth`` word numbers from each of the ``places`` on, -1 from the end of the piece on; places without a second word are left out.

    ``ids`` ends with ``depth`` times -1.
    """
    places = places[(ids[places] >= 0) & (ids[places + 1] >= 0)]
    out = np.empty((depth, len(places)), np.int32)
    out[0], out[1] = ids[places], ids[places + 1]
    for d in range(2, depth):
        out[d] = np.where(out[d - 1] >= 0, ids[places + d], -1)
    return out.T


def sorted_leaves(rows: np.ndarray, times: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and the sums of their ``times``.

    As many columns as fit are packed into one number; its rank then stands for them, and the next columns are packed behind it.
    """
    if not len(rows):
        return rows, times
    bits, room = max(1, (words + 1).bit_length()), 63
    key = np.zeros(len(rows), np.int64)
    for d in range(rows.shape[1]):
        if room < bits:
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) != 0
            key[order] = np.cumsum(new) - 1
            room = 63 - int(len(rows)).bit_length()
        key = key << bits | (rows[:, d].astype(np.int64) + 1)
        room -= bits
    order = np.argsort(key)
    starts = np.nonzero(np.diff(key[order], prepend=-1))[0]
    return rows[order[starts]], np.add.reduceat(times[order], starts)


def _trees(docs: DataFrame, frequent: np.ndarray, make, schema: str, depth: int, only: dict[str, set[bytes]] | None = None) -> DataFrame:
    """What ``make`` (lang, names, rows, times) yields for the sorted leaves of each language in bounded parts of the corpus; of suffixes that begin with the words ``only``, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        parts: dict[str, list[np.ndarray]] = {}
        places = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in parts.items():
                ids, names = np.concatenate([*own, np.full(depth, -1, np.int32)]), numbers[lang].names
                wanted = np.append(np.ones(len(names), bool) if only is None else np.fromiter((w in only[lang] for w in names), bool, len(names)), False)
                every = np.nonzero(wanted[ids])[0]
                for lo in range(0, len(every), FLUSH):
                    rows = windows(ids, every[lo : lo + FLUSH], depth)
                    rows, times = sorted_leaves(rows, np.ones(len(rows), np.int64), len(names))
                    if len(rows):
                        yield from make(lang, names, rows, times)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if only is not None and lang not in only:
                    continue
                number = numbers.get(lang) or numbers.setdefault(lang, _Numbers(lang, frequent))
                own = parts.setdefault(lang, [])
                for words in tokens_of(text):
                    own.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    places += len(words)
                own.append(np.array([-1], np.int32))
                if places >= FLUSH:
                    yield from flush()
                    numbers.clear()
                    parts.clear()
                    places = 0
        yield from flush()

    return _texts(docs).mapInArrow(run, schema)


def _squeezed(raw: bytes) -> bytes:
    """A text or array in compressed form, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _whole(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _narrow(values: np.ndarray) -> bytes:
    """Non-negative whole numbers in as few bytes each as they need, the first byte saying how many; compressed."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if values.max() <= np.iinfo(k).max)
    return _squeezed(bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes())


def _wide(packed: bytes) -> np.ndarray:
    raw = _whole(packed)
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[raw[0]], offset=1).astype(np.int64)


def _runs(rows: np.ndarray, times: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(first leaf, count) of every node of ``depth`` words in sorted leaves."""
    whole = np.nonzero(rows[:, depth - 1] >= 0)[0]
    if not len(whole):
        return whole, whole
    own = rows[whole, :depth]
    starts = np.concatenate([[0], 1 + np.nonzero((own[1:] != own[:-1]).any(axis=1))[0]])
    return whole[starts], np.add.reduceat(times[whole], starts)


def _extended(docs: DataFrame, frequent: np.ndarray, heavy: set[bytes], first_words: dict[str, set[bytes]], depth: int) -> DataFrame:
    """(key, lang, phrase, c): the prefixes of ``depth`` words that go on from heavy ones, counted in all texts."""

    def make(lang, names, rows, times):
        out = []
        first, counts = _runs(rows, times, depth)
        for at, c in zip(first.tolist(), counts.tolist(), strict=True):
            words = [names[w] for w in rows[at, :depth]]
            if _key(lang, words[:-1]) in heavy:
                out.append((_key(lang, words).decode(), lang, b" ".join(words).decode(), c))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], ["key", "lang", "phrase", "c"])

    pieces = _trees(docs, frequent, make, "key string, lang string, phrase string, c long", depth, first_words)
    return pieces.groupBy("key", "lang", "phrase").agg(F.sum("c").alias("c"))


def partition_prefixes(docs: DataFrame, words: DataFrame, frequent: np.ndarray, budget: int, depth: int) -> tuple[list[bytes], set[bytes], DataFrame]:
    """(first prefix of each group, heavy prefixes, counts of the heavy ones as (lang, phrase, depth, c)).

    A heavy prefix has more than ``budget`` places, so a level has at most
    places / budget of them; groups are at most twice that and one for each
    range of prefixes. Both lists are bounded and are all that tasks are sent.
    """
    key = F.concat(F.lower(F.hex("lang")), F.lit("\t"), "word", F.lit("\t"))
    level = words.where("word <> ''").select(key.alias("key"), "lang", F.col("word").alias("phrase"), "c")
    light, heavy, counts = [], set(), []
    total = int(level.agg(F.sum("c")).first()[0] or 0)
    budget = max(budget, total // MOST_GROUPS)
    for d in range(1, depth + 1):
        last = d == depth
        light.append(level if last else level.where(F.col("c") <= budget))
        if d > 1:
            counts.append(level.where(F.col("c") > budget).select("lang", "phrase", F.lit(d).alias("depth"), "c"))
        if last:
            break
        found = level.where(F.col("c") > budget).select("key", "lang", "phrase").collect()
        if not found:
            break
        heavy.update(r["key"].encode() for r in found)
        first_words: dict[str, set[bytes]] = {}
        for r in found:
            first_words.setdefault(r["lang"], set()).add(r["phrase"].split(" ")[0].encode())
        level = durable(_extended(docs, frequent, {r["key"].encode() for r in found}, first_words, d + 1))
    prefixes = light[0]
    for more in light[1:]:
        prefixes = prefixes.unionByName(more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = budget
        for batch in batches:
            firsts = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if filled + c > budget:
                    firsts.append(k)
                    filled = 0
                filled += c
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.string())], ["first"])

    ranges = 1 + total // (8 * budget)
    ordered = prefixes.select("key", "c").repartitionByRange(ranges, "key").sortWithinPartitions("key")
    bounds = sorted(r["first"].encode() for r in ordered.mapInArrow(cut, "first string").collect())
    every = counts[0] if counts else None
    for more in counts[1:]:
        every = every.unionByName(more)
    return bounds, heavy, every


def subtree_counts(docs: DataFrame, frequent: np.ndarray, bounds: Sequence[bytes], heavy: set[bytes], least: int, depth: int) -> DataFrame:
    """(lang, phrase, depth, c): nodes of 2 to ``depth`` words with ``least`` places or more, except the heavy ones, from the subtrees of all groups."""

    def group_of(lang: str, names: Sequence[bytes], rows: np.ndarray) -> np.ndarray:
        """The group of each row: that of its shortest prefix which is not heavy."""
        out, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for d in range(1, depth + 1):
            own = rows[todo, :d]
            starts = np.concatenate([[0], 1 + np.nonzero((own[1:] != own[:-1]).any(axis=1))[0]])
            ends, more = np.append(starts[1:], len(todo)), []
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                key = _key(lang, [names[w] for w in own[lo] if w >= 0])
                if d < depth and key in heavy and own[lo, -1] >= 0:
                    more.append(todo[lo:hi])
                else:
                    out[todo[lo:hi]] = max(0, bisect_right(bounds, key) - 1)
            if not more:
                break
            todo = np.concatenate(more)
        return out

    def make(lang, names, rows, times):
        groups = group_of(lang, names, rows)
        order = np.argsort(groups, kind="stable")
        starts = np.nonzero(np.diff(groups[order], prepend=-1))[0]
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            own = rows[order[lo:hi]]
            used = np.nonzero(np.bincount((own + 1).ravel(), minlength=len(names) + 1)[1:])[0]
            local = np.zeros(len(names) + 1, np.int64)
            local[used] = np.arange(1, len(used) + 1)  # 0 stays for the end of a piece, which indexes the last place
            words = _squeezed(b"\t".join([names[w] for w in used]))
            # by columns: neighbouring leaves share their first words, which compresses well
            packed = _narrow(local[own].T.ravel()), _narrow(times[order[lo:hi]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([groups[order[lo]]], pa.int32()), pa.array([lang]), pa.array([words], pa.binary()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())],
                ["grp", "lang", "words", "rows", "times"],
            )

    def build(pieces: pa.Table) -> pa.Table:
        found: list[tuple[str, str, int, int]] = []
        numbers: dict[str, dict[str, int]] = {}
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i in range(pieces.num_rows):
            lang, words, raw, times = (pieces.column(c)[i].as_py() for c in ("lang", "words", "rows", "times"))
            number = numbers.setdefault(lang, {})
            words = _whole(words).decode().split("\t")
            place = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            place = np.concatenate([[-1], place]).astype(np.int32)
            parts.setdefault(lang, []).append((place[_wide(raw).reshape(depth, -1).T], _wide(times)))
        for lang, own in parts.items():
            names = list(numbers[lang])
            rows, times = sorted_leaves(np.concatenate([r for r, _ in own]), np.concatenate([t for _, t in own]), len(names))
            for d in range(2, depth + 1):
                first, counts = _runs(rows, times, d)
                for at, c in zip(first[counts >= least].tolist(), counts[counts >= least].tolist(), strict=True):
                    words = [names[w] for w in rows[at, :d]]
                    if not heavy or _key(lang, [w.encode() for w in words]) not in heavy:
                        found.append((lang, " ".join(words), d, c))
        columns = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table([pa.array(list(x), k) for x, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "depth", "c"])

    leaves = _trees(docs, frequent, make, "grp int, lang string, words binary, rows binary, times binary", depth)
    return leaves.groupBy("grp").applyInArrow(build, "lang string, phrase string, depth int, c long")


def phrase_counts(docs: DataFrame, least: int = 100, depth: int = DEPTH, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, depth, c) of all phrases of 1 to ``depth`` words with ``least`` (2 or more) places, and each language's number of words under the empty phrase of depth 0."""
    words = durable(count_words(docs, least))
    frequent = frequent_bitmap(words)
    bounds, heavy, known = partition_prefixes(docs, words, frequent, budget, depth)
    counts = words.select("lang", F.col("word").alias("phrase"), F.when(F.col("word") == "", 0).otherwise(1).alias("depth"), "c")
    if bounds:
        # a heavy prefix of the full depth is a leaf: it has a group, which counts it
        counts = counts.unionByName(subtree_counts(docs, frequent, bounds, heavy, least, depth))
        if known is not None:
            counts = counts.unionByName(known.where(F.col("depth") < depth))
    return settled(counts)


def collocations(docs: DataFrame, least: int = 100, best: int = 2000, absorbed: int = 100, depth: int = DEPTH, budget: int = BUDGET, scale: int = 1000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language by the score of their weakest cut.

    Texts are read whole, A-Z in lower case, null texts as empty and null
    languages as ``und``; pieces end at ``.,;:!?`` and line breaks, words at
    blanks and tabs. A phrase has 2 to ``depth`` words and a >= ``least``
    places within pieces, overlaps included. Its cut after k words scores
    floor(scale * a * n / (l * r)), in whole numbers of up to 38 digits; the
    lowest cut counts, the smallest k among equals. A phrase that lies in a
    longer one with at least ``absorbed`` percent of its places is left out
    (if any longer one is such, one with a single word more is). Ranks go by
    score and a, falling, then phrase in byte order, so there are no ties.

    Repeated rows count each time; other columns are not read; an empty table,
    and texts without a frequent phrase, give no rows.
    """
    counts = phrase_counts(docs, least, depth, budget)
    known = counts.where(F.col("depth").between(1, depth - 1)).select("lang", "phrase", "c")
    sizes = counts.where("depth = 0").select("lang", F.col("c").alias("n"))
    named = sizes.count()
    long_ones = counts.where("depth >= 2").select("lang", "phrase", "depth", F.col("c").alias("a"))

    cuts = long_ones.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    left, right = known.toDF("lang", "first", "l"), known.toDF("lang", "rest", "r")
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(F.broadcast(sizes) if named <= 10_000 else sizes, "lang")
    number = "cast({} as decimal(17,0))".format
    score = F.expr(f"({number('a')} * {number('n')} * cast({scale} as decimal(4,0))) div ({number('l')} * {number('r')})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.expr("array(substring(phrase, length(substring_index(phrase, ' ', 1)) + 2), substring_index(phrase, ' ', depth - 1))")
    longer = long_ones.where("depth >= 3").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longest")).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    left_over = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < absorbed * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left_over.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # a language may own nearly all phrases: only the best of each share of them meet in one task
    shares = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
    few = rows.withColumn("_nth", F.row_number().over(share)).where(F.col("_nth") <= best).drop("_nth")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
