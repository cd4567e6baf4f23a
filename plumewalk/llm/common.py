"""Pieces that several text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewalk.session import durable

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Kernel = Callable[[Sequence[str | None]], dict[str, Sequence]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_remainder(of: str | Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; a null id counts as the empty text."""
    c = F.col(of) if isinstance(of, str) else of
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def per_text(docs: DataFrame, make: Callable[[], Kernel], schema: str, carry: Sequence[str] = ("doc_id",), most_chars: int = 8_000_000) -> DataFrame:
    """``carry`` of each row and the columns that a kernel computes from its text.

    ``make`` runs once in each task and returns the kernel. The kernel sees
    slices of a batch with at most ``most_chars`` characters (one text at
    least), so memory does not follow the number of rows in an Arrow batch.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("string").alias("_text"))
    out_schema = ", ".join([*(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carry), schema])
    names = [part.split()[0].strip("`") for part in split_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            texts = batch.column(len(carry)).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts], most_chars):
                found = kernel(texts[lo:hi])
                given = [batch.column(i).slice(lo, hi - lo) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*given, *[v if isinstance(v, pa.Array) else pa.array(v) for v in (found[n] for n in names)]], [*carry, *names])

    return kept.mapInArrow(run, out_schema)


def split_schema(schema: str) -> list[str]:
    """The fields of a schema text; commas inside <> belong to a field."""
    return [p.strip() for p in re.split(r",(?![^<]*>)", schema)]


def kept_rows(docs: DataFrame, make: Callable[[], Callable[[Sequence[str | None]], Sequence[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text a kernel keeps; the columns may have any names."""
    inside = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inside).withColumn("text", F.col(inside[docs.columns.index("text")]))

    def judged():
        keep = make()
        return lambda texts: {"_kept": list(keep(texts))}

    return per_text(plain, judged, "_kept boolean", inside).where("_kept").select(*inside).toDF(*docs.columns)


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, the same ones on every run: those whose id hashes lowest."""
    return rows.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(most)


def settled(df: DataFrame) -> DataFrame:
    """``durable`` for rows that are joined with themselves later.

    The rows are written as one struct column: a checkpoint otherwise keeps
    predicates on the columns it was made from, which a self-join can't rename.
    """
    return durable(df.select(F.struct(*df.columns).alias("_row"))).select("_row.*")
