"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language gives every piece of the vocabulary a probability. The
likelihood of a word is the sum over all its segmentations into pieces, which
a forward pass over its characters computes; expectation-maximisation fits the
piece probabilities with the matching backward pass. Words of many texts are
walked through the piece trie together, one array step for all of them.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.common import bounded_sample, per_text

#: Environment variable that names another vocabulary file, and the default file.
VOCABULARY_KEY, VOCABULARY = "PLUMEWALK_PIECES", "/opt/tokenizers/piece_bpe_32k.model"

LETTERS = re.compile(r"[^\W\d_]+")

#: Longer words are cut into parts of this many characters; pieces do not span a cut.
PART = 48


def read_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces with letters of a sentencepiece vocabulary; a leading mark stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or os.environ.get(VOCABULARY_KEY, VOCABULARY))
    found = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({p for p in found if re.fullmatch(r"▁?[^\W\d_]*", p) and p})


class Trie:
    """The pieces as one sorted array of (node, character) codes, walked for many words at once.

    Piece 0 stands for any single character that is no piece itself.
    """

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for k, piece in enumerate(pieces, 1):
            node = 0
            for c in piece:
                node = nodes.setdefault((node, c), len(nodes) + 1)
            ends[node] = k
        codes = np.array([n * 0x110000 + ord(c) for n, c in nodes], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.to = codes[order], np.fromiter(nodes.values(), dtype=np.int64, count=len(nodes))[order]
        self.piece = np.zeros(len(nodes) + 1, dtype=np.int64)
        for node, k in ends.items():
            self.piece[node] = k
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)

    def edges(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, word numbers, piece numbers) of all pieces in all words, by start; a word has one edge at most of a start and length."""
        lengths = np.array([len(w) for w in words])
        chars = np.zeros((len(words), int(lengths.max(initial=0))), dtype=np.int64)
        for n in np.unique(lengths):
            rows = np.nonzero(lengths == n)[0]
            if n:
                chars[rows, :n] = np.frombuffer("".join(words[r] for r in rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n)
        out = []
        for i in range(chars.shape[1]):
            rows = np.nonzero(lengths > i)[0]
            node = np.zeros(len(rows), dtype=np.int64)
            for n in range(1, self.longest + 1):
                inside = lengths[rows] >= i + n
                rows, node = rows[inside], node[inside]
                if not len(rows):
                    break
                code = node * 0x110000 + chars[rows, i + n - 1]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                if n == 1:
                    ids = np.where(hit, self.piece[self.to[at]], 0)
                    out.append((i, 1, rows, ids))
                rows, node = rows[hit], self.to[at[hit]]
                if n > 1:
                    ids = self.piece[node]
                    some = ids > 0
                    if some.any():
                        out.append((i, n, rows[some], ids[some]))
        return out


def forward(n_words: int, width: int, edges: list, log_p: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each prefix; shape (positions, words, languages)."""
    alpha = np.full((width + 1, n_words, log_p.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, n, rows, ids in edges:
        alpha[i + n, rows] = np.logaddexp(alpha[i + n, rows], alpha[i, rows] + log_p[ids])
    return alpha


def word_parts(word: str) -> list[str]:
    marked = "▁" + word
    return [marked[i : i + PART] for i in range(0, len(marked), PART)]


def word_log_probabilities(words: list[str], trie: Trie, log_p: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Log probability of each word under each language; shape (words, languages)."""
    out = np.zeros((len(words), log_p.shape[1]))
    parts, owner = [], []
    for k, w in enumerate(words):
        for p in word_parts(w):
            parts.append(p)
            owner.append(k)
    by_length = sorted(range(len(parts)), key=lambda j: len(parts[j]))
    for lo in range(0, len(parts), chunk):
        some = by_length[lo : lo + chunk]
        text = [parts[j] for j in some]
        lengths = np.array([len(t) for t in text])
        alpha = forward(len(text), int(lengths.max()), trie.edges(text), log_p)
        np.add.at(out, [owner[j] for j in some], alpha[lengths, np.arange(len(text))])
    return out


def expected_counts(words: list[str], weights: np.ndarray, trie: Trie, log_p: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Expected uses of each piece in all segmentations of the words; log_p is one language's column."""
    total = np.zeros(trie.size)
    parts, w = [], []
    for word, weight in zip(words, weights, strict=True):
        for p in word_parts(word):
            parts.append(p)
            w.append(weight)
    by_length = sorted(range(len(parts)), key=lambda j: len(parts[j]))
    for lo in range(0, len(parts), chunk):
        some = by_length[lo : lo + chunk]
        text, weight = [parts[j] for j in some], np.array([w[j] for j in some], dtype=np.float64)
        lengths, every = np.array([len(t) for t in text]), np.arange(len(some))
        edges = trie.edges(text)
        alpha = forward(len(text), int(lengths.max()), edges, log_p[:, None])[:, :, 0]
        beta = np.full_like(alpha, -np.inf)
        beta[lengths, every] = 0.0
        whole = alpha[lengths, every]
        for i, n, rows, ids in reversed(edges):
            beta[i, rows] = np.logaddexp(beta[i, rows], beta[i + n, rows] + log_p[ids])
            share = np.exp(alpha[i, rows] + log_p[ids] + beta[i + n, rows] - whole[rows])
            total += np.bincount(ids, share * weight[rows], trie.size)
    return total


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    log_p: np.ndarray
    log_prior: np.ndarray


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over lower-case letter runs, pre-aggregated in each Arrow slice."""
    rows = docs.select("lang", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in LETTERS.findall((text or "").lower()):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, path: str | None = None, most: int = 20_000, rounds: int = 3, smoothing: float = 0.1) -> LanguageModel:
    """Piece probabilities of every non-null ``lang`` of ``docs`` by EM, from at most ``most`` of its rows.

    The E-step runs on Spark over the word counts of the sample, grouped into
    pieces of a few thousand words; what returns is one number per language
    and piece of the vocabulary, so the driver holds languages x pieces.
    """
    from plumewalk.session import durable

    pieces = read_pieces(path)
    chosen = bounded_sample(docs.where("lang is not null and doc_id is not null").select("doc_id"), most)
    sample = docs.where("lang is not null").select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
    counts = durable(word_counts(sample))
    share = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(share)
    size = len(pieces) + 1
    log_p = np.full((size, max(len(languages), 1)), -np.log(size))
    for _ in range(rounds if languages else 0):
        given = log_p

        def run(batches, given=given):
            trie = Trie(pieces)
            for batch in batches:
                langs, words, n = (np.array(batch.column(i).to_pylist(), dtype=object) for i in range(3))
                for k, lang in enumerate(languages):
                    own = langs == lang
                    if own.any():
                        total = expected_counts(list(words[own]), n[own].astype(float), trie, given[:, k])
                        used = np.nonzero(total)[0]
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(used), pa.int32()), pa.array(used), pa.array(total[used])], ["lang", "piece", "n"])

        found = counts.mapInArrow(run, "lang int, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        table = np.full(log_p.shape, smoothing)
        for r in found:
            table[r["piece"], r["lang"]] += r["n"]
        log_p = np.log(table) - np.log(table.sum(0))
    prior = np.log(np.array([share[x] for x in languages], dtype=float) / max(1, sum(share.values()))) if languages else np.zeros(1)
    return LanguageModel(languages, pieces, log_p, prior)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text of ``docs``.

    The score is the posterior of the predicted language; ties go to the
    smallest name. Null texts, texts without a letter, and all texts under a
    model without languages get ``und`` and 0. Repeated rows get equal results.
    """

    def make():
        trie = Trie(model.pieces)
        names = np.array(model.languages or ["und"], dtype=object)

        def kernel(texts):
            seen: dict[str, int] = {}
            ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in LETTERS.findall((t or "").lower())), dtype=np.int64) for t in texts]
            table = word_log_probabilities(list(seen), trie, model.log_p) if seen else np.zeros((0, 1))
            pred, score = [], []
            for at in ids:
                if not len(at) or not model.languages:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = model.log_prior + table[at].sum(0)
                k = int(total.argmax())
                pred.append(names[k])
                score.append(float(1.0 / np.exp(total - total[k]).sum()))
            return {"lang_pred": pred, "score": score}

        return kernel

    return per_text(docs, make, "lang_pred string, score double")
