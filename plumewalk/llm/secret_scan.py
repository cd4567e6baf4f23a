"""Secret scan: candidate strings from whole texts, judged by a random forest; DataFrame functions and Spark ML only.

Candidates are long runs of key characters with a digit, and all values that
are assigned to a credential's name, taken with the words around them. The forest learns from labelled findings which of them are real:
it sees a candidate's length, character classes and their transitions, how much
of it a dictionary covers, whether it lies in a path or address, and whether
the word before it names a credential.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumewalk.llm.language_id import read_pieces
from plumewalk.session import durable

#: Characters of context that are kept before and after a candidate, within its line.
BEFORE, AFTER = 40, 20

#: Words that name a credential; fixed values.
CREDENTIAL = "api|apikey|auth|authorization|bearer|credential|key|passphrase|passwd|password|private|pwd|secret|token"

#: A run of at least 16 key characters with a digit among them; '=' belongs to it as padding at its end only.
RUN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9_+/=-]))?"

#: The end of a credential's name: a word of its own, after another sign than a letter, or a capitalised one after a small letter.
NAMED = rf"(?:^|[^A-Za-z]|[a-z](?=[A-Z]))(?i:{CREDENTIAL})s?"

#: What stands between a name and the value that is assigned to it.
ASSIGNS = r"(?::=|=>|[:=])[ \t]{0,8}[\"']?"

#: A value of at least 6 characters that is assigned to a credential's name: up to its closing quote (unless that is more than one word and has a long run inside), or up to a separator.
ASSIGNED = (
    rf"(?<=[ \t\"'=:>])(?=[^\s\"'])(?<={ASSIGNS})(?<={NAMED}[0-9]{{0,3}}[\"']?[ \t]{{0,8}}{ASSIGNS})"
    r"(?:(?<=\")(?![^\"\n]*[A-Za-z0-9_+/-]{16})[^\"\n]{6,}+(?=\")|(?<=')(?![^'\n]*[A-Za-z0-9_+/-]{16})[^'\n]{6,}+(?=')|[^\s\"'`,;&<>()\[\]{}]{6,}+)"
)

CANDIDATE = f"{ASSIGNED}|{RUN}"

FEATURES = ("length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "hex", "dictionary", "slashes", "in_path", "names_credential", "assigned", "quoted", "word_after")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, nth, before, candidate, after): every candidate of every text in order, ``nth`` from 0; null and empty texts have none."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("_text"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("_found")).where(F.size("_found") > 0)
    apart = rows.select("doc_id", "_found", F.split("_text", CANDIDATE, -1).alias("_rest"))  # what lies between the candidates
    each = apart.select("doc_id", "_rest", "_found", F.posexplode("_found").alias("nth", "candidate"))
    near = lambda k: F.coalesce(F.get("_found", k), F.lit(""))  # noqa: E731  # a name may be a candidate itself
    before = F.substring_index(F.right(F.concat(near(F.col("nth") - 1), F.get("_rest", F.col("nth"))), F.lit(BEFORE)), "\n", -1)
    after = F.substring_index(F.left(F.concat(F.get("_rest", F.col("nth") + 1), near(F.col("nth") + 1)), F.lit(AFTER)), "\n", 1)
    return each.select("doc_id", "nth", before.alias("before"), "candidate", after.alias("after"))


def dictionary_grams(path: str | None = None, most: int = 3_000, width: int = 4) -> list[str]:
    """The ``most`` frequent letter groups of a public vocabulary's pieces, by count, then by name."""
    seen: dict[str, int] = {}
    for piece in read_pieces(path):
        word = piece.strip("▁")
        if word.isascii():
            for i in range(len(word) - width + 1):
                seen[word[i : i + width]] = seen.get(word[i : i + width], 0) + 1
    return sorted(seen, key=lambda g: (-seen[g], g))[:most]


def with_features(found: DataFrame, grams: list[str]) -> DataFrame:
    """Candidates with the columns of ``FEATURES``, all doubles."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    listed = ", ".join(f"'{g}'" for g in grams) or "''"
    known = F.expr(f"size(filter(transform(sequence(1, greatest(length(candidate) - 3, 1)), i -> substring(lower(candidate), i, 4)), g -> g in ({listed})))")
    word = F.regexp_extract("before", r"([A-Za-z_]+)[^A-Za-z_]*$", 1)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    columns: dict[str, Column] = {
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "others": share("[^A-Za-z0-9]"),
        "transitions": share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "dictionary": known / n, "slashes": share("/"), "in_path": flag(F.col("before").rlike(r"[A-Za-z0-9:]/+$|https?:|www\.|@\S*$")),
        "names_credential": flag(word.rlike(f"{NAMED}$")), "assigned": flag(F.col("before").rlike("[=:]>?\\s*[\"']?$")), "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "word_after": F.length(F.regexp_extract("after", "^[^A-Za-z]*([A-Za-z]*)", 1)),
    }
    return found.select("*", *[columns[f].cast("double").alias(f) for f in FEATURES])


def rule_labels(features: DataFrame) -> DataFrame:
    """``features`` with a label from rules that stand in for reviewed findings: 1, 0 or null where they don't know.

    Real: a quoted value that is assigned to a credential's name and is mixed
    or hexadecimal. False: figures alone (card and account numbers, counters),
    parts of addresses and paths, and strings that a dictionary covers to a
    third.
    """
    real = (F.col("names_credential") == 1) & (F.col("assigned") == 1) & (F.col("dictionary") < 0.2) & (F.col("digits") < 1)
    false = (F.col("digits") > 0.9) | (F.col("in_path") == 1) | (F.col("dictionary") >= 0.33)
    return features.withColumn("label", F.when(real, 1.0).when(false, 0.0))


def fit_forest(labelled: DataFrame, most: int = 20_000, trees: int = 40, depth: int = 6):
    """A forest from findings with ``FEATURES`` and ``label``, at most ``most`` of each label; None unless both labels occur.

    The sample is that of the lowest hashes, so every run draws the same rows.
    """
    order = F.xxhash64("candidate", "before", "after")
    rows = [labelled.where(F.col("label") == y).select("label", *FEATURES, order.alias("_order")).orderBy("_order", *FEATURES).limit(most) for y in (0.0, 1.0)]
    if any(r.isEmpty() for r in rows):
        return None
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(durable(rows[0].unionByName(rows[1])))
    return RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8).fit(train)


def judge(features: DataFrame, forest) -> DataFrame:
    """(doc_id, nth, candidate, score, predicted) for every candidate. Without a forest nothing is removed: score 1."""
    if forest is None:
        return features.select("doc_id", "nth", "candidate", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    scored = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_x").transform(features.select("doc_id", "nth", "candidate", *FEATURES)))
    score = F.element_at(vector_to_array("probability"), 2)
    return scored.select("doc_id", "nth", "candidate", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Judged candidates of every whole text of ``docs``: (doc_id, nth, candidate, score, predicted).

    ``findings`` are labelled findings to learn from (doc_id, nth, before,
    candidate, after, label); without them, the candidates themselves, labelled
    by ``rule_labels``. One row per candidate; repeated rows of ``docs`` give
    repeated findings; texts without candidates (null and empty ones too) give
    none. Columns other than doc_id and text are not read.
    """
    grams = dictionary_grams(path)
    features = durable(with_features(candidates(docs), grams))
    labelled = rule_labels(features) if findings is None else with_features(findings, grams)
    return judge(features, fit_forest(labelled.where("label is not null")))
