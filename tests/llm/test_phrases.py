"""Phrase collocations against a count of all phrases in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from plumewalk.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, source string, c long, phrase string, grp int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", 1, "p", 2, "k") for i, t, g in rows], SCHEMA)


def all_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, best=2000):
    f, n = all_counts(rows)
    out = {}
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in found.items()):
                continue
            score, _, left, right = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:best], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n[lang], -score)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    vocab = [f"{a}{b}" for a in ("the", "Of", "ñu", "x\x01", "a") for b in ("", "r", "|", "é")]
    odd = [None, "", " \t ", "...", "One", "a" * 3000, "the of\x0bthe of\x0cthe", "tab\tand blank kept"]
    out = [(i, " ".join(rng.choice(vocab) + rng.choice(["", "", "", ".", ", ", "!\n", "\t", "?x"]) for _ in range(rng.randint(1, 60))), rng.choice(["en", "de", None, "und", "a\tb"])) for i in range(300)]
    out += [(1000 + i, "one very common passage of seven words here", "en") for i in range(150)]
    out += [(2000 + i, t, "en") for i, t in enumerate(odd)] + [(3000, "to be " * 4000, "en"), (None, "to be or", None), (5, "to be or", None)]
    return out


@pytest.mark.parametrize("budget", [1_000_000, 40])
def test_counts_match_brute_force(spark, rows, budget):
    got = {(r["lang"], tuple(r["phrase"].split(" ")) if r["phrase"] else ()): r["c"] for r in phrases.phrase_counts(frame(spark, rows), 5, budget=budget).collect()}
    f, n = all_counts(rows)
    want = {(g, p): c for g, own in f.items() for p, c in own.items() if c >= 5} | {(g, ()): c for g, c in n.items()}
    assert got == want and sum(len(p) == 5 for _, p in want) > 3


@pytest.mark.parametrize("least", [5, 100])
def test_ranked_phrases_match_brute_force(spark, rows, least):
    found = phrases.collocations(frame(spark, rows), least, best=50)
    assert found.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    got = {(r["lang"], r["rank"]): tuple(r)[2:] for r in found.collect()}
    assert got == brute(rows, least, 50) and len(got) > (60 if least == 5 else 5)


def test_small_parts_of_the_corpus(spark, rows, monkeypatch):
    """Texts longer than a part, and languages over several parts, in the driver's own process."""
    joined = [w for part in phrases.tokens_of(rows[-3][1], 50) for w in part]
    assert joined == rows[-3][1].encode().split() and len(list(phrases.tokens_of(rows[-3][1], 50))) > 100
    assert [w for part in phrases.tokens_of("A.b ;c", 2) for w in part] == [b"a", b".", b"b", b".", b"c"]


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    big = [("x", "", 0, 10**13), ("x", "a", 1, 10**12), ("x", "b", 1, 10**12 + 7), ("x", "a b", 2, 10**11 + 3)]
    counts = spark.createDataFrame(big, "lang string, phrase string, depth int, c long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *_: counts)
    row = phrases.collocations(frame(spark, [])).first()
    assert row["score"] == 1000 * (10**11 + 3) * 10**13 // (10**12 * (10**12 + 7))


def test_query_on_a_folder(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["lang"], r["rank"]): tuple(r)[2:] for r in queries.op11_phrases(spark, str(tmp_path)).collect()}
    assert got == brute(rows, 100)
    assert phrases.collocations(frame(spark, rows[:0])).count() == 0
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "..", "en")])).count() == 0
