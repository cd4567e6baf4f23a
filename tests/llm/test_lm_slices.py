"""The language model over many slices and parts gives what one slice and one part give."""

import numpy as np
from pyspark.sql import functions as F

from plumewalk.llm import lm_score


def test_packed_arrays_return():
    for v in (np.zeros(0, np.int64), np.array([-1, 0, 5]), np.array([1 << 40, 0]), np.array([0.5, -3.0])):
        assert np.array_equal(lm_score.unpack(lm_score.pack(v)), v)
    assert lm_score.unpack_words(lm_score.pack_words(["ñ".encode(), b" "])) == ["ñ".encode(), b" "]


def test_pair_codes_are_exact():
    rng = np.random.default_rng(3)
    for numbers, parts in ((1, 1), (7, 1), (50, 6), (1000, 37), (5, 40)):
        code = lm_score.PairCode(numbers, parts)
        first, second = rng.integers(0, numbers, (2, 500))
        part, codes = code.of(first, second)
        assert len(set(zip(part.tolist(), codes.tolist(), strict=True))) == len(set(zip(first.tolist(), second.tolist(), strict=True)))
        back = code.back(part, codes)
        assert np.array_equal(back[0], first) and np.array_equal(back[1], second)


def test_slices_and_parts_do_not_change_scores(spark):
    rng = np.random.default_rng(5)
    words = ["the", "of", "ñandú", "42", "a.b", *(f"w{i}" for i in range(300))]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=None)) for _ in range(200)]
    texts += [None, "", " \n\t", "the " * 3000, "Never Seen wörds", texts[0], texts[0]]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = docs.where(F.coalesce("doc_id", F.lit(1)) % 3 != 0)
    got = []
    for sizes in ({}, {"block_chars": 500, "part_words": 200, "part_pairs": 150}):
        model, counts = lm_score.fit_automaton(train, **sizes)
        rows = lm_score.score_texts(docs, model, counts, sizes.get("block_chars", 24_000_000)).collect()
        got.append(sorted(((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows), key=str))
    assert model.parts > 3 and model.code.parts > 10
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]]
    assert np.allclose([r[3:] for r in got[0]], [r[3:] for r in got[1]], rtol=1e-9)
