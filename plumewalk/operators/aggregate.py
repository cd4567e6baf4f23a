"""Summaries, correlations, profiles and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumewalk.operators.ordered import sliding, with_position
from plumewalk.operators.quantile import average_ranks, quantiles

DEFAULT_SPEED = 1.4
EDGE_STEP = 5.0


def edge_integrals(
    points: DataFrame,
    edge: str = "edge_id",
    order: Sequence[str] = ("distance_along_edge", "point_id"),
    conc: str = "predicted_co2",
    speed: Column | float = DEFAULT_SPEED,
    step: float = EDGE_STEP,
) -> DataFrame:
    """Per edge: trapezoid of the concentration over walking time in minutes, mean, ends and metadata.

    Null concentrations are left out before neighbours are paired; an edge
    without any is dropped and one with a single value counts one step.
    Multiply ``integral`` by a minute ventilation to get the inhaled exposure.
    """
    minutes = step / (F.lit(speed) if isinstance(speed, (int, float)) else speed) / 60.0
    known = points.where(F.col(conc).isNotNull() & ~F.isnan(conc))
    rows, w, finish = sliding(known.select(edge, *order, conc), [edge], list(order), after=1)
    paired = finish(rows.withColumn("_mid", (F.col(conc) + F.lead(conc, 1).over(w)) / 2))
    sums = paired.groupBy(edge).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg(conc).alias("mean_co2"), F.sum("_mid").alias("_trapezoid"), F.max(conc).alias("_only")
    )
    at = F.struct(*order)
    ends = {"start_x": F.min_by("x", at), "start_y": F.min_by("y", at), "end_x": F.max_by("x", at), "end_y": F.max_by("y", at)}
    if "edge_length" in points.columns:
        ends["edge_length"] = F.coalesce(F.min_by("edge_length", at), F.lit(EDGE_STEP))
    if "highway" in points.columns:
        ends["highway_type"] = F.coalesce(F.min_by("highway", at), F.lit("unknown"))
    meta = points.groupBy(edge).agg(*[c.alias(n) for n, c in ends.items()])
    total = F.when(F.col("n_points") == 1, F.col("_only")).otherwise(F.col("_trapezoid")) * minutes
    return sums.withColumn("integral", total).drop("_trapezoid", "_only").join(meta, edge)


def mean_by_location(df: DataFrame, value: str, locations: Sequence[str], obj: str = "subject_id", location: str = "location") -> DataFrame:
    """One row per object with a mean column per location, and a final row (object null) with the column means."""
    wide = df.groupBy(obj).pivot(location, list(locations)).agg(F.avg(value))
    overall = wide.agg(*[F.avg(c).alias(c) for c in locations]).withColumn(obj, F.lit(None).cast(wide.schema[obj].dataType))
    return wide.unionByName(overall)


def street_type_stats(df: DataFrame, kind: str = "highway", value: str = "predicted_co2") -> DataFrame:
    valid = df.where(F.col(kind).isNotNull() & F.col(value).isNotNull())
    return valid.groupBy(kind).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n")
    ).orderBy(F.desc("mean"), kind)


def surface_summary(df: DataFrame, value: str, sample: bool = False) -> DataFrame:
    """n, valid, share, min, max, mean, std (population, or sample for tables) and median on one row."""
    std = F.stddev_samp(value) if sample else F.stddev_pop(value)
    stats = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("valid"), (F.count(value) / F.count(F.lit(1))).alias("share"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), std.alias("std"),
    )
    return stats.withColumn("median", quantiles(df, [], value, [0.5]).scalar()[0])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, p25, p50, p75, max: one row per column."""
    long = unpivot(df, columns)
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    return stats.join(q, "column").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max"
    )


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def hotspots(df: DataFrame, value: str, prob: float = 0.9) -> DataFrame:
    """Threshold at the quantile, number of rows above it and their share."""
    cut = quantiles(df, [], value, [prob]).scalar()[0]
    marked = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), cut.alias("_cut"))
    above = F.count_if(F.col("_v") > F.col("_cut"))
    return marked.agg(F.max("_cut").alias("threshold"), above.alias("n_hot"), (above / F.count(F.lit(1))).alias("share"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max, the maximum in the last bin; empty bins are absent."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    known = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"), ends.alias("_e"))
    lo, width = F.col("_e.lo"), (F.col("_e.hi") - F.col("_e.lo")) / bins
    k = F.coalesce(F.try_divide(F.col("_v") - lo, width), F.lit(0.0))
    return known.groupBy(F.least(F.floor(k), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def target_statistics(df: DataFrame, target: str, probs: Sequence[float] = (0.01, 0.5, 0.99)) -> DataFrame:
    stats = df.agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"), F.min(target).alias("min"), F.max(target).alias("max"))
    return stats.withColumn("quantiles", quantiles(df, [], target, list(probs)).scalar())


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each column with the target, in one pass."""
    return _long_row(df.agg(*[F.corr(c, target).alias(c) for c in columns]), columns, "column", "corr")


def _long_row(row: DataFrame, columns: Sequence[str], key: str, value: str) -> DataFrame:
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in columns])))


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """All pairs i < j with their correlation, one pass over the rows."""
    data = df.select(*columns)
    if method == "spearman":
        data = data.na.drop()
        for c in columns:
            data = data.join(average_ranks(data.select(c), [], c, f"_r_{c}").drop("ties"), c)
        data = data.select(*[F.col(f"_r_{c}").alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = data.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def validation_report(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per column: nulls, distinct values, constant flag; and the number of repeated key rows."""
    row = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns],
        *[F.count_distinct(c).alias(f"d_{c}") for c in columns],
    )
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("missing"), F.col(f"d_{c}").alias("distinct"), (F.col(f"d_{c}") <= 1).alias("constant"))
        for c in columns
    ]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeats = sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("r")).scalar()
    return row.select(F.inline(F.array(*cells))).withColumn("duplicate_keys", repeats)


def profile(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Describe, missingness and correlation with the target, one row per column."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    gaps = row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing"), (F.col(c) / F.col("_n")).alias("missing_share")) for c in columns]))
    )
    return describe(df, columns).join(gaps, "column").join(target_correlations(df, columns, target), "column")


def parameter_diversity(trials: DataFrame, params: str = "params") -> tuple[DataFrame, DataFrame]:
    """(numeric parameters: mean, std, min, max; text parameters: count per value)."""
    long = trials.select(F.explode(params).alias("param", "value")).withColumn("number", F.col("value").try_cast("double"))
    numeric = long.where("number is not null").groupBy("param").agg(
        F.avg("number").alias("mean"), F.stddev_samp("number").alias("std"), F.min("number").alias("min"), F.max("number").alias("max")
    )
    text = long.where("number is null and value is not null").groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"))
    return numeric, text


def score_summary(trials: DataFrame, score: str) -> DataFrame:
    return trials.agg(
        F.min(score).alias("best"), F.max(score).alias("worst"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(score).alias("n")
    )


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 5) -> DataFrame:
    """The first k rows of each key by a unique order; Spark keeps only k rows per key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_matrix(pairs: DataFrame, a: str, b: str, value: str, labels: Sequence[str]) -> DataFrame:
    """Symmetric matrix of mean values: each pair is counted in both directions."""
    both = pairs.select(F.col(a).alias("row"), F.col(b).alias("col"), value).unionByName(
        pairs.select(F.col(b).alias("row"), F.col(a).alias("col"), value)
    )
    return both.groupBy("row").pivot("col", list(labels)).agg(F.avg(value))


def drop_outlying_pvalues(df: DataFrame, keys: Sequence[str], p: str, threshold: float = 1.5) -> DataFrame:
    """Rows whose -log10 p lies within ``threshold`` scaled MADs of the key's median; MAD 0 keeps all."""
    logged = df.withColumn("_lp", -F.log10(F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(1e-10))))
    med = quantiles(logged, keys, "_lp", [0.5], name="_med")
    dev = logged.join(med, list(keys)).withColumn("_dev", F.abs(F.col("_lp") - F.col("_med")[0]))
    mad = quantiles(dev, keys, "_dev", [0.5], name="_mad")
    scaled = dev.join(mad, list(keys))
    keep = (F.col("_mad")[0] == 0) | (F.try_divide(F.col("_dev"), F.col("_mad")[0] * 1.4826) < threshold)
    return scaled.where(keep).drop("_lp", "_med", "_dev", "_mad")


def walking_speed(df: DataFrame, length_m: float, subject: str = "subject_id", ts: str = "ts", default: float = DEFAULT_SPEED) -> DataFrame:
    """Mean over subjects of route length by duration in seconds; the default where no subject moves."""
    seconds = F.unix_micros(F.max(ts).cast("timestamp")) / 1e6 - F.unix_micros(F.min(ts).cast("timestamp")) / 1e6
    per = df.groupBy(subject).agg(seconds.alias("_s")).where("_s > 0")
    return per.agg(F.coalesce(F.avg(F.lit(float(length_m)) / F.col("_s")), F.lit(default)).alias("speed"))


def trial_states(trials: DataFrame, state: str = "state", value: str = "value", trial: str = "trial") -> DataFrame:
    return trials.groupBy(state).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("best_value"), F.min_by(trial, F.struct(value, trial)).alias("best_trial")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key as an aggregation, so that a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def row_at_middle(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> Column:
    """Struct of ``columns`` at row n // 2 of the whole ordered table, as a scalar to attach to any table."""
    placed = with_position(df.select(*dict.fromkeys([*order, *columns])), [], order, "_pos")
    mid = F.floor(df.agg(F.count(F.lit(1))).scalar() / 2)
    return placed.where(F.col("_pos") == mid).agg(F.first(F.struct(*columns))).scalar()


def match_lung_capacity(people: DataFrame, fvc: DataFrame) -> DataFrame:
    """fvc_predicted per person: same sex, nearest age, then nearest height; the smaller one on ties.

    Ages are matched on the distinct (sex, age) pairs and heights on the
    distinct combinations, so the work does not grow with repeated people.
    """
    table = fvc.select("sex", F.col("age").alias("_a"), F.col("height").alias("_h"), "fvc_predicted")
    known = table.select("sex", "_a").distinct()
    ages = people.select("sex", "age").distinct().join(known, "sex").groupBy("sex", "age").agg(
        F.min_by("_a", F.struct(F.abs(F.col("_a") - F.col("age")), "_a")).alias("_a")
    )
    combos = people.select("sex", "age", "height").distinct().join(ages, ["sex", "age"]).join(table, ["sex", "_a"])
    order = F.struct(F.abs(F.col("_h") - F.col("height")), "_h")
    best = combos.groupBy("sex", "age", "height").agg(F.min_by("fvc_predicted", order).alias("fvc_predicted"))
    return people.join(best, ["sex", "age", "height"], "left")
