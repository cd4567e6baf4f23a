"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two words is the dot product of their gap-weighted character
triples: every triple of characters in order, up to ``SPAN`` apart, weighs
``DECAY`` to the power of its span. Inserted characters and gaps therefore
change a word's image a little, not wholly. The machine is trained on the
image of words under a bounded set of landmark words; since the landmarks'
images are known, its decision for a word is one weight per triple, which
scores all distinct words of many texts with a few array operations. A text is
as toxic as its worst word (multiple-instance reading of the labelled texts),
calibrated to a probability.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import bounded_sample, kept_rows, per_text
from plumewalk.session import durable

SPAN, DECAY = 6, 0.6
#: Distances from the first character of a triple to its second and third.
GAPS = [(a, b) for a, b in combinations(range(1, SPAN), 2)]
#: 64 character codes: 1-26 for a-z, 27 and 28 for the ends of a word, the rest for hashed other letters.
CODES, START, END = 64, 27, 28

CHUNK = re.compile(r"[^\s]+")
LETTERS = re.compile(r"[^\W\d_]+")
SPACED = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[^\w\n]{1,3}[^\W\d_]){2,}(?![^\W\d_])")
#: Figures and signs that stand for letters inside a word; fixed values.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})


def tokens(text: str) -> set[str]:
    """The distinct words of a lower-case text that may hide an insult: letter runs, white-space words with
    signs taken out or read as letters, and letters that are spaced out."""
    words = set(LETTERS.findall(text))
    for w in set(CHUNK.findall(text)) - words:
        core = w.strip(".,;:!?#*%&|\"'()[]$@")
        if len(core) <= 40 and not core.isalpha():
            words.add("".join(LETTERS.findall(core)))
            words.add("".join(LETTERS.findall(core.translate(STANDS_FOR))))
    for run in SPACED.findall(text):
        words.add("".join(LETTERS.findall(run)))
    words.discard("")
    return words


def sentences(text: str | None) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n", (text or "").lower()) if s.strip()]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all words, each between its end marks, and the first position of each word."""
    chars = np.frombuffer("\x01".join(["", *words, ""]).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    own = np.where((chars >= 97) & (chars <= 122), chars - 96, 29 + (chars * 2_654_435_761 % (1 << 32)) % (CODES - 29))
    breaks = np.nonzero(chars == 1)[0]
    out = np.empty(len(chars) + len(breaks), dtype=np.int64)
    at = np.arange(len(chars)) + np.searchsorted(breaks, np.arange(len(chars)), side="left")
    out[at] = own
    out[at[breaks]] = END
    out[at[breaks] + 1] = START
    return out[1:-1], at[breaks[:-1]]  # from the first start mark to the last end mark


class Triples:
    """Gap-weighted triples of words: code, weight and word of each."""

    def __init__(self, words: list[str]):
        codes, starts = _codes(words)
        self.n = len(words)
        owner = np.zeros(len(codes), dtype=np.int64)
        owner[starts[1:]] = 1
        owner = np.cumsum(owner)
        parts = []
        for a, b in GAPS:
            if len(codes) > b:
                same = owner[:-b] == owner[b:]
                triple = (codes[:-b] * CODES + codes[a : len(codes) - b + a]) * CODES + codes[b:]
                parts.append((triple[same], owner[:-b][same], DECAY ** (b + 1)))
        self.parts = parts
        self.norm = np.sqrt(sum((np.bincount(o, minlength=self.n) * w * w for _, o, w in parts), np.zeros(self.n))) + 1e-12

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Normalised image of each word times a table over triples."""
        return sum((np.bincount(o, table[t], self.n) * w for t, o, w in self.parts), np.zeros(self.n)) / self.norm

    def image(self) -> tuple[np.ndarray, np.ndarray]:
        """The triples that occur, sorted, and the normalised images of a few words over them; shape (words, triples)."""
        used = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[t for t, _, _ in self.parts]]))
        out = np.zeros((self.n, len(used)))
        for t, o, w in self.parts:
            np.add.at(out, (o, np.searchsorted(used, t)), w)
        return used, out / self.norm[:, None]


@dataclass(frozen=True)
class Machine:
    """``weights`` per triple and the offset give a word's decision; ``scale`` and ``shift`` turn a text's worst word into a probability."""

    weights: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0

    def decide(self, words: list[str], chunk: int = 20_000) -> np.ndarray:
        found = [Triples(words[i : i + chunk]).dot(self.weights) for i in range(0, len(words), chunk)]
        return np.concatenate([np.zeros(0), *found]) + self.offset


def fit_machine(insults: list[str], insult_weight: np.ndarray, clean: list[str], clean_weight: np.ndarray, landmarks: list[str], cost: float = 3000.0) -> Machine:
    """Squared-hinge support vector machine on Nystroem features of the landmarks, by Newton steps."""
    used, base = Triples(landmarks).image()
    values, vectors = np.linalg.eigh(base @ base.T)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # landmark kernel to the power of -1/2
    triples = Triples(insults + clean)

    def spread(row: np.ndarray) -> np.ndarray:
        table = np.zeros(CODES**3)
        table[used] = row
        return table

    k = np.stack([triples.dot(spread(row)) for row in base], axis=1)
    x = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
    y = np.concatenate([np.ones(len(insults)), -np.ones(len(clean))])
    weight = cost * np.concatenate([insult_weight / insult_weight.sum(), clean_weight / clean_weight.sum()])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-2)
    ridge[-1] = 1e-6
    for _ in range(30):
        short = 1 - y * (x @ w)
        active = short > 0
        grad = ridge * w - x[active].T @ (weight[active] * y[active] * short[active])
        hess = np.diag(ridge) + (x[active] * weight[active, None]).T @ x[active]
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Machine(spread((root @ w[:-1]) @ base), float(w[-1]))


NEVER = Machine(np.zeros(CODES**3), -1.0, 4.0, 0.0)


def sentence_words(labelled: DataFrame) -> DataFrame:
    """(word, toxic_n, clean_n): in how many distinct sentences a word stands. A sentence of any clean text is clean.

    Copies and near copies of a text share their sentences, so that a large
    group of them does not make its ordinary words look telling.
    """

    def split():
        return lambda texts: {"sentences": pa.array([sorted(set(sentences(t))) for t in texts], pa.list_(pa.string()))}

    def cut():
        return lambda texts: {"words": pa.array([sorted(tokens(t)) for t in texts], pa.list_(pa.string()))}

    each = per_text(labelled, split, "sentences array<string>", ("label",)).select("label", F.explode("sentences").alias("text"))
    known = each.groupBy("text").agg(F.min("label").alias("label"))
    rows = per_text(known, cut, "words array<string>", ("label",)).select("label", F.explode("words").alias("word"))
    return rows.groupBy("word").agg(F.sum("label").alias("toxic_n"), F.sum(1 - F.col("label")).alias("clean_n"))


def credited(toxic: DataFrame, suspects: dict[str, int]) -> dict[str, int]:
    """In how many toxic texts each suspect stands that no other suspect there outnumbers four times; one number per suspect."""

    def make():
        def kernel(texts):
            out = []
            for t in texts:
                own = [w for w in tokens((t or "").lower()) if w in suspects]
                most = max((suspects[w] for w in own), default=0)
                out.append(sorted(w for w in own if 4 * suspects[w] >= most))
            return {"words": pa.array(out, pa.list_(pa.string()))}

        return kernel

    rows = per_text(toxic, make, "words array<string>", ("label",)).select(F.explode("words").alias("word"))
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def worst_words(labelled: DataFrame, machine: Machine) -> DataFrame:
    """(label, word, value): the word of each text with the highest decision; texts without words have none."""

    def make():
        def kernel(texts):
            found = _worst(texts, machine)
            return {"word": pa.array([w for w, _ in found], pa.string()), "value": [v for _, v in found]}

        return kernel

    return per_text(labelled, make, "word string, value double", ("label",))


def _worst(texts, machine: Machine) -> list[tuple[str | None, float]]:
    seen: dict[str, int] = {}
    ids = []
    for t in texts:
        own = tokens(t.lower()) if t else ()
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in own), dtype=np.int64, count=len(own)))
    words = list(seen)
    value = machine.decide(words)
    out = []
    for at in ids:
        if not len(at):
            out.append((None, -1.0))
            continue
        v = value[at]
        k = min(np.nonzero(v == v.max())[0], key=lambda j: words[at[j]])
        out.append((words[at[k]], float(v[k])))
    return out


def _calibrate(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of a logistic curve, by Newton steps with a little ridge."""
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - label) + 1e-2 * (w - [4.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 0.1), float(w[1])


def _least_count(counts: DataFrame, share: float = 0.05, wrong: float = 0.05) -> int:
    """The smallest number of toxic sentences from which at most ``wrong`` of the suspects are there by chance.

    A word of n sentences is in toxic ones only, by chance, with the rate of
    toxic word places to the power of n.
    """
    suspect = F.col("clean_n") <= share * F.col("toxic_n")
    rows = counts.groupBy((F.col("toxic_n") + F.col("clean_n")).cast("long").alias("n")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("toxic_n").alias("toxic"), F.sum(suspect.cast("long")).alias("suspects")
    ).where("n > 0").orderBy("n").collect()
    places = sum(r["n"] * r["words"] for r in rows)
    rate = sum(r["toxic"] for r in rows) / places if places else 0.0
    for i, r in enumerate(rows):
        chance = sum(x["words"] * rate ** x["n"] for x in rows[i:])
        if r["n"] >= 2 and chance <= wrong * sum(x["suspects"] for x in rows[i:]):
            return int(r["n"])
    return 1 << 60


def fit_toxicity(docs: DataFrame, labelled: DataFrame, most: int = 20_000, words: int = 6_000, landmarks: int = 240, rounds: int = 2) -> Machine:
    """A machine from ``labelled`` (doc_id, label 0/1), at most ``most`` of its rows; equal texts count once, as toxic if any is.

    The insults to learn from are words that stand in toxic sentences too
    often, and in clean ones too seldom, for chance, and that still explain
    enough toxic texts when a text is credited to its most frequent such words
    (so the ordinary words of copied toxic texts get no credit). The worst
    words of the clean texts under the first machine join the clean words, and
    the machine is trained again; the last one is calibrated on the worst words
    of all sampled texts. The driver sees at most ``words`` words of each kind
    and two numbers for each sampled row. Without toxic or clean rows every
    text scores low.
    """
    chosen = bounded_sample(labelled.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label")), most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = durable(rows.where("text is not null").groupBy("text").agg(F.max("label").alias("label")))
    counts = durable(sentence_words(sample))
    least = _least_count(counts)
    first = counts.where((F.col("toxic_n") >= least) & (F.col("clean_n") <= 0.05 * F.col("toxic_n"))).orderBy(F.desc("toxic_n"), "word").limit(words).collect()
    clean_words = counts.where("clean_n > toxic_n")
    common = clean_words.orderBy(F.desc("clean_n"), "word").limit(words // 2).collect()
    others = clean_words.orderBy(F.xxhash64("word"), "word").limit(words).collect()
    credit = credited(sample.where("label = 1"), {r["word"]: int(r["toxic_n"]) for r in first})
    insults = {r["word"]: float(r["toxic_n"]) for r in first if credit.get(r["word"], 0) >= least}
    if not insults or not common:
        return NEVER
    clean = {r["word"]: float(r["clean_n"]) for r in [*common, *others]}
    half = landmarks // 2

    def trained() -> Machine:
        bad, good = sorted(insults, key=lambda w: (-insults[w], w)), sorted(clean, key=lambda w: (-clean[w], w))
        marks = list(dict.fromkeys(bad[:half] + good[: landmarks - half]))
        return fit_machine(bad, np.sqrt([insults[w] for w in bad]), good, np.sqrt([clean[w] for w in good]), marks)

    machine = trained()
    for _ in range(rounds):
        worst = worst_words(sample.where("label = 0"), machine).where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"))
        for r in worst.orderBy(F.desc("value"), "word").limit(words).collect():
            if r["word"] not in insults:
                clean[r["word"]] = max(clean.get(r["word"], 0.0), float(r["n"]))
        machine = trained()
    found = worst_words(sample, machine).select("label", "value").collect()
    scale, shift = _calibrate(np.array([r["value"] for r in found]), np.array([r["label"] for r in found]))
    return Machine(machine.weights, machine.offset, scale, shift)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score, worst_word) for every whole text of ``docs``.

    Null texts and texts without letters have no word and score as a clean
    one; ties between words go to the smaller word; repeated rows score alike.
    """

    def make():
        def kernel(texts):
            found = _worst(texts, machine)
            value = np.array([v for _, v in found]) * machine.scale + machine.shift
            return {"score": (1 / (1 + np.exp(-np.clip(value, -40, 40)))).tolist(), "worst_word": pa.array([w for w, _ in found], pa.string())}

        return kernel

    return per_text(docs, make, "score double, worst_word string")


def drop_toxic(docs: DataFrame, machine: Machine, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text scores ``limit`` or more; judged row by row, without a join."""

    def make():
        def keep(texts):
            value = np.array([v for _, v in _worst(texts, machine)]) * machine.scale + machine.shift
            return (1 / (1 + np.exp(-np.clip(value, -40, 40))) < limit).tolist()

        return keep

    return kept_rows(docs, make)
