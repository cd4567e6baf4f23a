"""The dealt operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewalk.llm import decontaminate, language_id, line_dedup, lm_score, mixing, phrases, quality_pu, quality_rules, secret_scan, simhash, topk, toxicity, turns
from plumewalk.llm.common import documents, id_remainder, labels


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir), line_dedup.LEAST_EDITED, exact_chars=1)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, learn = documents(spark, sf_dir), id_remainder("doc_id", 3) != 1
    network = quality_pu.fit_quality(docs, labels(spark, sf_dir).where(learn & (F.col("quality") == 1)), docs.where(learn))
    scored = quality_pu.score_quality(docs, network)
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    forest = quality_rules.fit_rules(docs, labels(spark, sf_dir).select("doc_id", F.col("quality").alias("label")))
    return quality_rules.apply_rules(docs, forest)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), id_remainder("doc_id", 5) == 0
    machine = toxicity.fit_toxicity(docs, labels(spark, sf_dir).where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_word")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), id_remainder("doc_id", 7) == 2
    automaton, counts = lm_score.fit_automaton(docs.where(~held_out))
    scored = lm_score.score_texts(docs, automaton, counts)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(automaton.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), id_remainder("doc_id", 5) == 0
    model = language_id.fit_languages(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of each language, from all texts."""
    return phrases.collocations(documents(spark, sf_dir))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every conversation after the seeded damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.repair(turns.damaged(rows), rows)


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of all embeddings for every row whose vec_id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_decontaminate, op3_line_dedup, op4_quality, op5_secrets, op6_simhash, op7_rules, op8_toxicity, op9_lm_score, op10_language, op11_phrases, op12_turns, op13_topk)
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    "op11_phrases": rf"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
        w AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] AS ws FROM p),
        g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM
              (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(ws) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
        n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
        h AS (SELECT f.*, n, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS one, array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS two
              FROM f JOIN n USING (lang), (VALUES (1), (2), (3), (4)) v(j) WHERE j < f.k),
        c AS (SELECT h.lang, h.phrase, h.k, h.a, h.n, l.a AS l, r.a AS r, (1000::HUGEINT * h.a * h.n) // (l.a::HUGEINT * r.a) AS score
              FROM h JOIN f l ON l.lang = h.lang AND l.phrase = h.one JOIN f r ON r.lang = h.lang AND r.phrase = h.two
              QUALIFY row_number() OVER (PARTITION BY h.lang, h.phrase ORDER BY score, h.j) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM c
        WHERE NOT EXISTS (SELECT 1 FROM f q WHERE q.lang = c.lang AND q.k > c.k AND q.a >= c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
        QUALIFY rank <= 2000""",
    "op13_topk": """
        WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)])::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
}
