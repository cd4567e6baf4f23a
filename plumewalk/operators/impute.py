"""Imputation of map attributes: low-rank completion and chained regressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumewalk.operators.clean import FOOT_TYPES, coerce_numeric
from plumewalk.operators.model import _square, moments
from plumewalk.session import durable

MAX_LABELS = 1000


def labels_of(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct labels of a category column; refuses a column with too many to be one."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()]
    if len(found) > MAX_LABELS:
        raise ValueError(f"{column} has more than {MAX_LABELS} labels")
    return sorted(found)


def complete_matrix(df: DataFrame, columns: Sequence[str], max_rank: int = 20, max_iters: int = 100, tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """Soft-thresholded low-rank completion of the null cells of numeric ``columns``.

    One iteration is one pass: rows apply the projections found so far to
    their own cells and add to a columns x columns product matrix; only that
    matrix is decomposed on the driver. Every few iterations the rows are
    written down so that a pass never replays more than that many.
    """
    p = len(columns)
    rest = [c for c in df.columns if c not in columns]
    cells = F.array(*[F.col(c).cast("double") for c in columns])
    state = df.select(F.struct(*rest).alias("_rest") if rest else F.lit(0).alias("_rest"), cells.alias("x"), F.transform(cells, lambda v: F.coalesce(v, F.lit(0.0))).alias("z"))
    state = durable(state)

    def advance(batch: pd.DataFrame, ws: list[np.ndarray]):
        x = np.array(batch["x"].tolist(), dtype=float).reshape(-1, p)
        z = np.array(batch["z"].tolist(), dtype=float).reshape(-1, p)
        known, before = ~np.isnan(x), z
        for w in ws:
            before, z = z, np.where(known, x, z @ w)
        return z, before, ~known

    def totals(ws: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros(p * p + 2)
            for batch in batches:
                if len(batch):
                    z, before, missing = advance(batch, ws)
                    acc[: p * p] += (z.T @ z).ravel()
                    acc[-2] += float((((z - before) ** 2) * missing).sum())
                    acc[-1] += float(((before**2) * missing).sum())
            yield pd.DataFrame({"i": np.arange(p * p + 2), "v": acc})

        rows = state.select("x", "z").mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(p * p + 2)  # columns squared numbers
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    ws: list[np.ndarray] = []
    shrink = None
    for it in range(max_iters):
        t = totals(ws)
        if it > 0 and t[-1] > 0 and np.sqrt(t[-2] / t[-1]) < tolerance:
            break
        val, vec = np.linalg.eigh(t[: p * p].reshape(p, p))
        val, vec = np.sqrt(np.maximum(val[::-1], 0.0)), vec[:, ::-1]
        shrink = val[0] / 50 if shrink is None else shrink
        gain = np.divide(np.maximum(val - shrink, 0.0), val, out=np.zeros(p), where=val > 0)
        gain[max_rank:] = 0.0
        ws.append((vec * gain) @ vec.T)
        if len(ws) == every:
            state = durable(_advance_rows(state, advance, list(ws)))
            ws = []
    final = _advance_rows(state, advance, ws) if ws else state
    keep = [F.col(f"_rest.{c}").alias(c) for c in rest]
    return final.select(*keep, *[F.col("z")[i].alias(c) for i, c in enumerate(columns)]).select(*df.columns)


def _advance_rows(state: DataFrame, advance, ws: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z, _, _ = advance(batch, ws)
            yield batch.assign(z=list(z))

    return state.mapInPandas(run, state.schema)


def impute_attributes(df: DataFrame, exclude: Sequence[str], max_rank: int = 20, max_iters: int = 100) -> DataFrame:
    """Numeric and category columns completed together; a category takes the label with the largest score."""
    use = [c for c in df.columns if c not in exclude]
    typed = coerce_numeric(df, [c for c, t in df.dtypes if c in use and (t == "string" or t.startswith("array"))])
    kinds = dict(typed.dtypes)
    cats = [c for c in use if kinds[c] == "string"]
    nums = [c for c in use if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    labels = {c: labels_of(typed, c) for c in cats}
    flags = {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c in cats for v in labels[c]}
    wide = typed.withColumns({c: F.col(c).cast("double") for c in nums} | flags)
    filled = complete_matrix(wide, [*nums, *flags], max_rank, max_iters)
    for c in cats:
        if labels[c]:
            scores = F.array(*[F.col(f"{c}_{v}") for v in labels[c]])
            best = F.array_position(scores, F.array_max(scores)).cast("int")
            filled = filled.withColumn(c, F.element_at(F.array(*map(F.lit, labels[c])), best))
    return filled.drop(*flags)


def chained_regressions(df: DataFrame, columns: Sequence[str], rounds: int = 10, ridge: float = 1e-3, tolerance: float = 1e-3) -> DataFrame:
    """Null cells of numeric ``columns`` by repeated regressions of each column on all others.

    Starts from the column means. Each step is one moment aggregation over the
    rows that have the column and one column expression over the rest.
    """
    start = df.agg(*[F.avg(c).alias(c) for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in columns]).first()
    gaps = sorted((c for c in columns if start[f"_n_{c}"]), key=lambda c: start[f"_n_{c}"])
    state = df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in gaps})
    state = state.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(start[c] or 0.0)) for c in columns})
    p = len(columns) - 1
    for _ in range(rounds if gaps else 0):
        moved = 0.0
        for c in gaps:
            xs = [x for x in columns if x != c]
            m = moments(state.where(~F.col(f"_gap_{c}")), [], xs, c).first()
            if m is None or m["n"] < 2:
                continue
            sxx = _square(m["sxx"], p)
            w = np.linalg.solve(sxx + ridge * np.diag(np.where(np.diag(sxx) > 0, np.diag(sxx), 1.0)), np.asarray(m["sxy"]))
            fit = F.lit(float(m["my"] - w @ np.asarray(m["mx"])))
            for x, b in zip(xs, w):
                fit = fit + F.lit(float(b)) * F.col(x)
            state = state.withColumns({f"_old_{c}": F.col(c), c: F.when(F.col(f"_gap_{c}"), fit).otherwise(F.col(c))})
        state = durable(state)
        shift = state.agg(*[F.max(F.abs(F.col(c) - F.col(f"_old_{c}"))).alias(c) for c in gaps if f"_old_{c}" in state.columns]).first()
        moved = max((v or 0.0) for v in shift) if shift else 0.0
        state = state.drop(*[f"_old_{c}" for c in gaps])
        if moved < tolerance:
            break
    return state.drop(*[f"_gap_{c}" for c in gaps])


def impute_edges(
    edges: DataFrame,
    categories: Sequence[str] = ("highway", "access"),
    flags: Sequence[str] = ("oneway", "reversed"),
    numbers: Sequence[str] = ("length", "lanes", "maxspeed"),
    rounds: int = 10,
) -> DataFrame:
    """Missing street attributes by chained regressions on ordinal codes.

    Numbers are clamped at 0, foot streets lose lanes and maxspeed again, codes
    are rounded, clipped to known labels and decoded; other columns are kept.
    """
    coded = [*categories, *flags]
    kinds = dict(edges.dtypes)
    labels = {c: labels_of(edges, c) for c in coded}
    state = edges
    for c in coded:
        known = F.array(*map(F.lit, labels[c])) if labels[c] else F.array().cast("array<string>")
        code = F.array_position(known, F.col(c).cast("string")) - 1
        state = state.withColumn(f"_c_{c}", F.when(F.col(c).isNotNull(), code).cast("double"))
    work = [*[f"_c_{c}" for c in coded], *numbers]
    state = state.withColumns({c: F.col(c).cast("double") for c in numbers})
    out = chained_regressions(state, work, rounds)
    foot = F.coalesce(F.col("highway").isin(FOOT_TYPES), F.lit(False))
    new = {c: F.greatest(F.col(c), F.lit(0.0)) for c in numbers}
    for c in ("lanes", "maxspeed"):
        if c in new:
            new[c] = F.when(~foot, new[c])
    for c in coded:
        if labels[c]:
            slot = F.least(F.greatest(F.rint(f"_c_{c}"), F.lit(0.0)), F.lit(float(len(labels[c]) - 1))).cast("int") + 1
            new[c] = F.element_at(F.array(*map(F.lit, labels[c])), slot).cast(kinds[c])
    return out.withColumns(new).select(*edges.columns)
