"""Language-model scoring with a weighted backoff automaton.

The model has three levels. A state stands for a training word; its arcs are
all pairs that it starts. Its failure arc leads to the root, whose arcs are
all training words. The root's failure arc leads to a spelling automaton over
characters, whose states are the character n-grams of the training words and
whose failure arcs drop the first character. Every level is smoothed by
absolute discounting, and what it takes from its arcs is the weight of the
failure arc, so the weights of all words that may follow a state sum to one
(spelling includes an end mark). One traversal from left to right carries the
state and adds up log weights.

All levels grow with the corpus and stay Spark tables: nothing is left out for
being rare, so a text's weight does not depend on a threshold. Texts are read
into slices: the tokens as numbers into the slice's own list of words. A slice
asks each part of the lexicon for its words and each part of the pair table for
its pairs. Both are sorted lists, so what goes through a shuffle is a few bytes
for each distinct word or pair of a slice, and an answer needs no keys. As every
token is followed by one token, the counts of a state's pairs sum to the state's
own count, and the failure weight is ``discount * pairs / count``.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewalk.llm.common import slices as cuts
from plumewalk.session import durable, shared_folder

#: Marks inside the spelling automaton: before the first and after the last character of a word.
FIRST, LAST = "\x02", "\x03"
#: The token after the last word of a text; a word never holds a blank.
STOP, END = " ", b" "
#: Root weights travel as whole numbers of this part of a base-10 log, 6e-8.
ROOT_UNITS = 1 << 24
#: Discount of the spelling counts.
SPELLING = 0.7


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case, as bytes: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from -1 on in as few bytes each as they need, byte by byte, compressed; floats as they are."""
    if values.dtype.kind != "f":
        values = values.astype(np.int64)
        values += 1
        values = values.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(k).max))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    head = bytes([values.itemsize, values.dtype.kind == "f"]) + len(planes).to_bytes(8, "little")
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    size, planes = packed[0], pa.decompress(packed[10:], decompressed_size=int.from_bytes(packed[2:10], "little"), codec="zstd", asbytes=True)
    raw = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1)
    if packed[1]:
        return raw.view(np.float64)
    values = raw.view(f"u{size}").astype(np.int64)
    values -= 1
    return values


def pack_words(words: list[bytes]) -> bytes:
    """Words and ends, none of which holds a line feed."""
    whole = b"\n".join(words)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def unpack_words(packed: bytes) -> list[bytes]:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


#: What slices and parts say to each other: ``part`` or ``slice`` is the group that reads the row.
MESSAGE, MESSAGE_ARROW = "part long, slice long, kind string, a binary, b binary, c binary, d binary", pa.schema([("part", pa.int64()), ("slice", pa.int64()), ("kind", pa.string()), *((x, pa.binary()) for x in "abcd")])


def _said(rows: Iterable[tuple]) -> pa.Table:
    return _rows(MESSAGE_ARROW, [(*r, *[None] * (7 - len(r))) for r in rows])


def slices_of(docs: DataFrame, block_chars: int, learn: bool = False) -> DataFrame:
    """(slice, ids, lengths, tokens, words, times): the texts as numbers into the slice's distinct words, the end first and then frequent words.

    To learn from, ``tokens`` are the slice's distinct pairs instead, as steps
    from one (first word, second word) to the next, ``lengths`` their counts,
    and there are no ids. A slice ends with the text that brings it to ``block_chars`` characters; a
    longer text is a slice by itself. The rows must be settled before they are
    used, so that the numbers of the slices hold for all that follows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ["slice", "ids", "lengths", "tokens", "words", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0

        def fresh():
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            number[END]
            return number, [], []

        def flush() -> pa.RecordBatch:
            tokens, words = np.concatenate(found), list(number)
            times = np.bincount(tokens, minlength=len(words))
            order = np.concatenate([[0], 1 + np.argsort(-times[1:], kind="stable")])
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            tokens, lengths = rank[tokens], np.array([len(x) for x in found])
            if learn:
                tokens, lengths = np.unique(_local(tokens, len(words)), return_counts=True)
                tokens = np.diff(tokens, prepend=0)
            row = [first + done, pack(lengths), pack(tokens), pack_words([words[i] for i in order.tolist()]), pack(times[order])]
            listed = pa.concat_arrays(ids)[: 0 if learn else None]
            listed = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
            return pa.RecordBatch.from_arrays([pa.array(row[:1], pa.int64()), listed, *(pa.array([x], pa.binary()) for x in row[1:])], fields)

        (number, found, ids), chars = fresh(), 0
        for batch in batches:
            for k, t in enumerate(batch.column(1).to_pylist()):
                words = words_of(t)
                found.append(np.fromiter(map(number.__getitem__, [*words, END]), np.int32, len(words) + 1))
                ids.append(batch.column(0).slice(k, 1))
                chars += len(t or "")
                if chars >= block_chars:
                    yield flush()
                    (number, found, ids), chars, done = fresh(), 0, done + 1
        if found:
            yield flush()

    out = f"slice long, ids array<{kind}>, lengths binary, tokens binary, words binary, times binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def _local(tokens: np.ndarray, words: int) -> np.ndarray:
    """Each token with the one before it, as one number; every text starts behind an end."""
    local = np.zeros(len(tokens), np.int64)
    np.multiply(tokens[:-1], words, out=local[1:], dtype=np.int64)
    local += tokens
    return local


def _first_ones(ordered: np.ndarray) -> np.ndarray:
    """Which of the sorted numbers differ from the one before."""
    return np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])


def _parts_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))


def _places(part: np.ndarray, parts: int) -> list[np.ndarray]:
    """The positions of the words of each part of the lexicon."""
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def _asked(slices: DataFrame, parts: int) -> DataFrame:
    """The words of each slice and how often it has them, for each part of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, packed, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, c = unpack_words(packed), unpack(times)
                found = ((p, own, "asked", pack_words([words[i] for i in at]), pack(c[at])) for p, at in enumerate(_places(_parts_of(words, parts), parts)) if len(at))
                yield from _said(found).to_batches()

    return slices.select("slice", "words", "times").mapInArrow(run, MESSAGE)


def _grouped(messages: DataFrame, by: str, groups: int, run, schema: str = MESSAGE) -> DataFrame:
    return messages.repartition(max(1, groups), by).groupBy(by).applyInArrow(run, schema)


def _messages(rows: pa.Table) -> Iterator[dict]:
    for batch in rows.to_batches(max_chunksize=64):
        yield from batch.to_pylist()


def lexicon_of(asked: DataFrame, parts: int) -> DataFrame:
    """One message of each part: its words in byte order and their counts. A word's number is its place times ``parts`` plus its part."""

    def merge(rows: pa.Table) -> pa.Table:
        seen: dict[bytes, int] = {}
        for r in _messages(rows):
            for w, c in zip(unpack_words(r["a"]), unpack(r["b"]).tolist(), strict=True):
                seen[w] = seen.get(w, 0) + c
        words = sorted(seen)
        return _said([(r["part"], 0, "lexicon", pack_words(words), pack(np.array([seen[w] for w in words])))])

    return durable(_grouped(asked, "part", parts, merge))


def counted_words(lexicon: DataFrame, parts: int) -> DataFrame:
    """(word, c, number) of a lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, c = unpack_words(r["a"]), unpack(r["b"])
                number = np.arange(len(words)) * parts + r["part"]
                for i in range(0, len(words), 50_000):
                    cut = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(words[cut], pa.binary()).cast(pa.string()), pa.array(c[cut]), pa.array(number[cut])], ["word", "c", "number"])

    return lexicon.mapInArrow(run, "word string, c long, number long")


@dataclass(frozen=True)
class PairCode:
    """A pair of word numbers as its part and one number within the part: hot words spread over all parts, and the code is exact."""

    numbers: int
    parts: int

    @property
    def width(self) -> int:
        return -(-self.numbers // self.parts) or 1

    def of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (first + second) % self.parts, first * self.width + second // self.parts

    def back(self, part: int, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = code // self.width
        return first, code % self.width * self.parts + (part - first) % self.parts


def _slice_pairs(tokens: np.ndarray, number: np.ndarray, code: PairCode) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each token the number of its pair among the slice's distinct pairs; and (part, their numbers, their sorted codes) of the pairs of two known words."""
    local = _local(tokens, len(number))
    order = np.argsort(local)
    local = local[order]
    fresh = _first_ones(local)
    of = np.empty(len(order), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - 1
    del order
    local = local[fresh]
    return of, _coded(local, number, code)


def _coded(local: np.ndarray, number: np.ndarray, code: PairCode) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(part, their places, their sorted codes) of the pairs of two known words."""
    first, second = number[local // len(number)], number[local % len(number)]
    known = np.nonzero((first >= 0) & (second >= 0))[0].astype(np.int32)
    first, second = first[known], second[known]
    part, codes = code.of(first, second)
    part = part.astype(np.int32)
    del first, second
    order = np.lexsort((codes, part)).astype(np.int32)
    known, part, codes = known[order], part[order], codes[order]
    starts = np.nonzero(np.diff(part, prepend=-1))[0].tolist()
    return [(int(part[i]), known[i:j], codes[i:j]) for i, j in zip(starts, [*starts, len(part)][1:], strict=True)]


def pairs_of(slices: DataFrame, asked: DataFrame, lexicon: DataFrame, parts: int, code: PairCode) -> DataFrame:
    """One message of each part of the pair table: sorted codes (as steps) and counts."""

    def number(rows: pa.Table) -> pa.Table:
        rows = list(_messages(rows))
        own = next(r for r in rows if r["kind"] == "lexicon")
        numbers = {w: i * parts + own["part"] for i, w in enumerate(unpack_words(own["a"]))}
        return _said((r["part"], r["slice"], "number", pack(np.array([numbers[w] for w in unpack_words(r["a"])]))) for r in rows if r["kind"] == "asked")

    def count(own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in own.to_pylist():
            local, times = np.cumsum(unpack(r["tokens"])), unpack(r["lengths"])
            numbers, = _answers(unpack(r["part"]), parts, told, "a")
            out += [(p, r["slice"], "pairs", pack(np.diff(codes, prepend=0)), pack(times[at])) for p, at, codes in _coded(local, numbers, code)]
        return _said(out)

    def merge(rows: pa.Table) -> pa.Table:
        found = [(np.cumsum(unpack(r["a"])), unpack(r["b"])) for r in _messages(rows)]
        codes, of = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        times = np.bincount(of, np.concatenate([x for _, x in found])).astype(np.int64)
        return _said([(rows.column("part")[0].as_py(), 0, "pairs", pack(np.diff(codes, prepend=0)), pack(times))])

    numbers = _grouped(asked.union(lexicon), "part", parts, number)
    own = _with_parts(slices.select("slice", "lengths", "tokens", "words"), parts).groupBy("slice").cogroup(numbers.groupBy("slice")).applyInArrow(count, MESSAGE)
    return durable(_grouped(own, "part", code.parts, merge))


def _with_parts(slices: DataFrame, parts: int) -> DataFrame:
    """The last column, the words, as the part of each: all that a slice needs to put answers in place."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [pack(_parts_of(unpack_words(w), parts)) for w in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(part, pa.binary())], [*batch.schema.names[:-1], "part"])

    return slices.mapInArrow(run, f"{kept}, part binary")


def _answers(part: np.ndarray, parts: int, told: pa.Table, columns: str) -> list[np.ndarray]:
    """What the parts of the lexicon told a slice, in the order of its words."""
    at, words = _places(part, parts), part
    out: list = [None] * len(columns)
    for r in _messages(told):
        for k, name in enumerate(columns):
            values = unpack(r[name])
            if out[k] is None:
                out[k] = np.zeros(len(words), values.dtype)
            out[k][at[r["part"]]] = values
    return out


def count_spellings(words: DataFrame, order: int, most: int = 400_000) -> DataFrame:
    """(gram, c): character n-grams of 1 to ``order`` characters over the distinct words, each word between its marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(seen: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["gram", "c"])

        seen: dict[str, int] = {}
        for batch in batches:
            for w in batch.column(0).to_pylist():
                s = FIRST + w + LAST
                for end in range(2, len(s) + 1):
                    for start in range(max(0, end - order), end):
                        g = s[start:end]
                        seen[g] = seen.get(g, 0) + 1
                if len(seen) >= most:
                    yield table(seen)
                    seen = {}
        yield table(seen)

    return words.select("word").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _split(grams: Iterable[tuple[str, float | None, float | None]]) -> tuple[dict, dict]:
    """Arcs by state and label, and failure weights by state, as base-10 logs, of rows (gram, arc, fail)."""
    arcs: dict[str, dict[str, float]] = {"": {}}
    fail: dict[str, float] = {}
    for g, arc, down in grams:
        if arc is not None:
            arcs.setdefault(g[:-1], {})[g[-1]] = arc
        if down is not None:
            fail[g] = down
    return arcs, fail


@dataclass
class Automaton:
    """What is learnt: a few numbers, and the levels as tables.

    ``grams`` is (gram, arc, fail): the log weight of the gram's last character
    after the others, and the failure weight of the gram as a state.
    ``lexicon`` and ``pairs`` have one row for each of their parts. A task has no tables but sets ``spelling`` to the grams of
    its block. The dictionaries read a whole table into memory; they are for
    looking at small models.
    """

    tokens: int
    vocabulary: int
    discount: float
    order: int
    unseen: float
    grams: DataFrame | None = None
    lexicon: DataFrame | None = None
    parts: int = 1
    pairs: DataFrame | None = None
    code: PairCode = PairCode(1, 1)
    counts: DataFrame | None = None

    @cached_property
    def spelling(self) -> tuple[dict, dict]:
        return _split(tuple(r) for r in self.grams.toLocalIterator())

    @property
    def spell_arcs(self) -> dict[str, dict[str, float]]:
        return self.spelling[0]

    @property
    def spell_fail(self) -> dict[str, float]:
        return self.spelling[1]

    @cached_property
    def pair_arcs(self) -> dict[bytes, dict[bytes, float]]:
        rows = self.counts.collect()
        counts, named = {r["word"]: r["c"] for r in rows}, {r["number"]: r["word"] for r in rows}
        followers: dict[str, dict[str, int]] = {}
        for r in self.pairs.toLocalIterator():
            ends = self.code.back(r["part"], np.cumsum(unpack(bytes(r["a"]))))
            for first, second, c in zip(*(x.tolist() for x in ends), unpack(bytes(r["b"])).tolist(), strict=True):
                followers.setdefault(named[first], {})[named[second]] = c
        out = {}
        for first, found in followers.items():
            fail = self.discount * len(found) / counts[first]
            out[first.encode()] = {w.encode(): log10((c - self.discount) / counts[first] + fail * 10.0 ** self.root(w, counts[w])) for w, c in found.items()}
        return out

    @cached_property
    def pair_fail(self) -> dict[bytes, float]:
        counts = {r["word"].encode(): r["c"] for r in self.counts.toLocalIterator()}
        return {first: log10(self.discount * len(found) / counts[first]) for first, found in self.pair_arcs.items()}

    def spell(self, word: str) -> float:
        """Log weight of spelling a word and its end: one traversal of the character states."""
        total, state = 0.0, FIRST
        arcs, fail, keep = self.spell_arcs, self.spell_fail, self.order - 1
        for c in word + LAST:
            while True:
                own = arcs.get(state)
                if own is not None and c in own:
                    total += own[c]
                    break
                if not state:
                    total += self.unseen  # a character that no training word has
                    break
                total += fail.get(state, 0.0)
                state = state[1:]
            state = (state + c)[-keep:] if keep else ""
        return total

    def root(self, word: str, c: int) -> float:
        """Log weight of a word from the root: its own arc joined with the failure arc and its spelling."""
        if not self.tokens:
            return self.spell(word)
        below = self.discount * (self.vocabulary - 1) / self.tokens
        if word == STOP:
            return log10(max(c, 0.5) / self.tokens)
        spelled = below * 10.0 ** self.spell(word) if below > 0 else 0.0
        return log10(max(c - self.discount, 0.0) / self.tokens + spelled + 1e-300)


def weigh_spellings(counted: DataFrame, order: int) -> tuple[DataFrame, float]:
    """((gram, arc, fail), log weight of an unknown character) by absolute discounting over all n-grams, level by level.

    Every n-gram without its first character is an n-gram too, so one join with the level below finds what an arc adds to.
    """
    base = counted.where(F.length("gram") == 1)
    row = base.agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).first()
    total = (row["c"] or 0) + row["n"] * SPELLING or 1.0
    unseen = log10(SPELLING / total / 0x110000) if row["n"] else log10(1 / 0x110000)
    level = base.select("gram", (F.col("c") / total).alias("p"))
    arcs, states = level, None
    for n in range(2, order + 1):
        own = counted.where(F.length("gram") == n).select("gram", "c", F.substring("gram", 1, n - 1).alias("state"), F.substring("gram", 2, n - 1).alias("lower"))
        share = own.groupBy("state").agg(F.sum("c").alias("whole"), (F.count(F.lit(1)) * SPELLING / F.sum("c")).alias("share"))
        below = level.select(F.col("gram").alias("lower"), F.col("p").alias("below"))
        level = durable(own.join(share, "state").join(below, "lower").select("gram", ((F.col("c") - SPELLING) / F.col("whole") + F.col("share") * F.col("below")).alias("p")))
        arcs = arcs.unionByName(level)
        fail = share.select(F.col("state").alias("gram"), F.log10("share").alias("fail"))
        states = fail if states is None else states.unionByName(fail)
    if states is None:
        return durable(arcs.select("gram", F.log10("p").alias("arc"), F.lit(None).cast("double").alias("fail"))), unseen
    return durable(arcs.select("gram", F.log10("p").alias("arc")).join(states, "gram", "full")), unseen


def fit_automaton(train: DataFrame, order: int = 5, rarest: int | None = None, discount: float = 0.75, block_chars: int = 24_000_000, part_words: int = 500_000, part_pairs: int = 3_000_000) -> tuple[Automaton, DataFrame]:
    """(automaton, counts) learnt from all texts of ``train``; counts is (word, c, number).

    A part of the lexicon reads about ``part_words`` distinct words of slices
    and a part of the pair table at most about ``part_pairs`` pairs of slices.
    ``rarest`` has no effect: it bounded the pairs and n-grams that were kept,
    and all are kept now.
    """
    slices, folder = _table(slices_of(train, block_chars, learn=True))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(unpack(t)), int(unpack(n).sum())) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["words", "tokens"])

    size = slices.select("times", "lengths").mapInArrow(sizes, "words long, tokens long").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    tokens, parts = int(size["tokens"] or 0), max(1, -(-int(size["words"] or 0) // part_words))
    asked = _asked(slices, parts)
    lexicon = lexicon_of(asked, parts)
    counts = counted_words(lexicon, parts)
    row = counts.agg(F.count(F.lit(1)).alias("v"), F.max("number").alias("last")).first()
    code = PairCode(int(row["last"] or 0) + 1, max(1, -(-tokens // part_pairs)))
    pairs = pairs_of(slices, asked, lexicon, parts, code)
    _drop(train.sparkSession, folder)
    grams, unseen = weigh_spellings(durable(count_spellings(counts.where(F.col("word") != STOP), order)), order)
    return Automaton(tokens, int(row["v"]), discount, order, unseen, grams, lexicon, parts, pairs, code, counts), counts


def _table(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and the table's own folder."""
    folder = f"{shared_folder(df.sparkSession)}/slices-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def _drop(spark: SparkSession, folder: str) -> None:
    """Deletes a table of ``_table`` once all that was made of it is settled."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _followers(pairs: DataFrame, code: PairCode, parts: int) -> DataFrame:
    """For each part of the lexicon, how many different tokens follow its words, as far as a part of the pair table knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, n = np.unique(code.back(r["part"], np.cumsum(unpack(r["a"])))[0], return_counts=True)
                part, place = first % parts, first // parts
                found = ((p, 0, "followers", pack(np.diff(place[part == p], prepend=0)), pack(n[part == p])) for p in np.unique(part).tolist())
                yield from _said(found).to_batches()

    return pairs.mapInArrow(run, MESSAGE)


def known_words(asked: DataFrame, automaton: Automaton) -> DataFrame:
    """One message of each part: the distinct words that slices ask for, with their numbers (-1: not learnt), counts and followers, as columns a to d."""
    parts = automaton.parts

    def look(rows: pa.Table) -> pa.Table:
        names, c, n, wanted = [], np.zeros(0, np.int64), [], set()
        for r in _messages(rows):
            if r["kind"] == "lexicon":
                names, c = unpack_words(r["a"]), unpack(r["b"])
            elif r["kind"] == "followers":
                n.append((np.cumsum(unpack(r["a"])), unpack(r["b"])))
            else:
                wanted.update(unpack_words(r["a"]))
        if not wanted:
            return _said([])
        part = rows.column("part")[0].as_py()
        after = np.zeros(len(names) + 1, np.int64)
        for at, more in n:
            after[at] += more
        place, words = {w: i for i, w in enumerate(names)}, sorted(wanted)
        at = np.array([place.get(w, -1) for w in words])
        return _said([(part, 0, "known", pack_words(words), pack(np.where(at >= 0, at * parts + part, -1)), pack(np.append(c, 0)[at]), pack(after[at]))])

    return durable(_grouped(asked.union(automaton.lexicon).union(_followers(automaton.pairs, automaton.code, parts)), "part", parts, look))


def spell_words(known: DataFrame, automaton: Automaton) -> DataFrame:
    """(part, words, number, c, n, root): ``known`` with the root weight of each word, spelt in parts that fetch the arcs of their own n-grams."""
    order, bare = automaton.order, replace(automaton, grams=None, lexicon=None, pairs=None, counts=None)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams: set[str] = set()
                for w in unpack_words(packed):
                    s = FIRST + w.decode() + LAST
                    grams.update(s[i : i + n] for n in range(1, order + 1) for i in range(len(s) - n + 1))
                found = list(grams)
                for i in range(0, len(found), 50_000):
                    cut = found[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(cut), pa.int64()), pa.array(cut, pa.string())], ["part", "gram"])

    arcs = known.select("part", "a").mapInArrow(distinct, "part long, gram string").join(automaton.grams, "gram")

    def weigh(own: pa.Table, grams: pa.Table) -> pa.Table:
        model = replace(bare)
        model.spelling = _split(zip(*(grams.column(c).to_pylist() for c in ("gram", "arc", "fail")), strict=True))
        r = own.to_pylist()[0]
        root = np.array([model.root(w.decode(), c) for w, c in zip(unpack_words(r["a"]), unpack(r["c"]).tolist(), strict=True)])
        root = np.rint(root * -ROOT_UNITS).astype(np.int64)
        return pa.table([own.column(x) for x in ("part", "a", "b", "c", "d")] + [pa.array([pack(root)], pa.binary())], ["part", "words", "number", "c", "n", "root"])

    return known.groupBy("part").cogroup(arcs.groupBy("part")).applyInArrow(weigh, "part long, words binary, number binary, c binary, n binary, root binary")


def _added_up(tokens: np.ndarray, lengths: np.ndarray, of: np.ndarray, seen: np.ndarray, c: np.ndarray, n: np.ndarray, root: np.ndarray, floor: int, discount: float, most: int = 250_000) -> list[np.ndarray]:
    """Known tokens, base score and score of each text of a slice, by texts of together ``most`` tokens (one text at least).

    ``of`` and ``seen`` are the pair of each token and the counts of the pairs; the others are by word.
    """
    whole, base = np.maximum(c, 1.0), np.log10((c + 1) / floor)
    down, straight = discount * n / whole, 10.0**root
    ends = np.cumsum(lengths)
    sums: list[list[np.ndarray]] = [[], [], []]
    for lo, hi in cuts(lengths.tolist(), most):
        begin = int(ends[lo] - lengths[lo])
        cut = slice(begin, int(ends[hi - 1]))
        at = tokens[cut]
        before = np.concatenate([[0], at[:-1]])  # every text starts behind an end
        fail = down[before]
        arc = np.maximum(seen[of[cut]] - discount, 0.0) / whole[before] + fail * straight[at]
        # a word without a state of its own, or a weight too small for a float, is added up in logs
        plain = root[at] + np.log10(fail, where=fail > 0, out=np.zeros(len(at)))
        weight = np.where((fail > 0) & (arc > 0), np.log10(np.maximum(arc, 1e-300)), plain)
        starts = ends[lo:hi] - lengths[lo:hi] - begin
        for total, v in zip(sums, ((c[at] > 0).astype(np.int64), base[at], weight), strict=True):
            total.append(np.add.reduceat(v, starts))
    return [np.concatenate(x) for x in sums]


def score_texts(docs: DataFrame, automaton: Automaton, counts: DataFrame | None = None, block_chars: int = 24_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every whole text of ``docs``.

    Texts are read into slices of about ``block_chars`` characters. A slice
    asks once for each of its distinct words and once for each of its distinct
    pairs, and is then scored in one traversal from left to right. Null and
    empty texts are one end token. Repeated rows get equal results; other
    columns are not read; an empty training corpus leaves spelling alone.
    ``counts`` is not needed any more.
    """
    parts, code = automaton.parts, automaton.code
    slices, _ = _table(slices_of(docs, block_chars))
    asked = _asked(slices, parts)
    known = spell_words(known_words(asked, automaton), automaton)

    def tell(rows: pa.Table, known: pa.Table) -> pa.Table:
        own = known.to_pylist()[0]
        place = {w: i for i, w in enumerate(unpack_words(own["words"]))}
        values = [unpack(own[x]) for x in ("number", "c", "n", "root")]
        found = ((r, np.array([place[w] for w in unpack_words(r["a"])])) for r in _messages(rows))
        return _said([(r["part"], r["slice"], "told", *(pack(v[at]) for v in values)) for r, at in found])

    told = asked.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(tell, MESSAGE)
    told = durable(told.select("slice", "part", "a", "b", "c", "d"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, tokens, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = unpack_words(words)
                pairs = _local(unpack(tokens), len(words))
                pairs.sort()
                steps = np.diff(pairs[_first_ones(pairs)], prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in (steps, _parts_of(words, parts)))], ["slice", "pairs", "part"])

    def request(own: pa.Table, told: pa.Table) -> pa.Table:
        r = own.to_pylist()[0]
        number, = _answers(unpack(r["part"]), parts, told, "a")
        return _said((p, r["slice"], "asked", pack(np.diff(codes, prepend=0))) for p, _, codes in _coded(np.cumsum(unpack(r["pairs"])), number, code))

    local_pairs = slices.select("slice", "tokens", "words").mapInArrow(local, "slice long, pairs binary, part binary")
    requests = local_pairs.groupBy("slice").cogroup(told.select("slice", "part", "a").groupBy("slice")).applyInArrow(request, MESSAGE)

    def find(rows: pa.Table) -> pa.Table:
        rows = sorted(_messages(rows), key=lambda r: r["kind"] != "pairs")
        if not rows or rows[0]["kind"] != "pairs":
            return _said((r["part"], r["slice"], "times", pack(np.zeros(len(unpack(r["a"])), np.int64))) for r in rows)
        codes, times = np.cumsum(unpack(rows[0]["a"])), unpack(rows[0]["b"])
        out = []
        for r in rows[1:]:
            own = np.cumsum(unpack(r["a"]))
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out.append((r["part"], r["slice"], "times", pack(np.where(codes[at] == own, times[at], 0))))
        return _said(out)

    times = _grouped(requests.union(automaton.pairs), "part", code.parts, find).select("slice", "part", F.col("a").alias("e"))
    told = told.unionByName(times, allowMissingColumns=True)
    floor, discount = automaton.tokens + automaton.vocabulary + 1, automaton.discount

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        lengths, part = (unpack(own.column(x)[0].as_py()) for x in ("lengths", "part"))
        at = unpack(own.column("tokens")[0].as_py()).astype(np.int32)
        is_word = told.column("a").is_valid()
        number, c, n, root = _answers(part, parts, told.filter(is_word), "abcd")
        of, found = _slice_pairs(at, number, code)
        seen = np.zeros(int(of.max()) + 1)
        at_part = {p: places for p, places, _ in found}
        for m in _messages(told.filter(pc.invert(is_word))):
            seen[at_part[m["part"]]] = unpack(m["e"])
        sums = _added_up(at, lengths, of, seen, c.astype(float), n, root / -ROOT_UNITS, floor, discount)
        return pa.table([own.column("ids").combine_chunks().flatten(), pa.array(lengths), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
    texts = _with_parts(slices.select("slice", "ids", "lengths", "tokens", "words"), parts)
    return texts.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(score, out)
