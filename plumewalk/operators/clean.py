"""Row and column cleaning: labels, null policies, filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewalk.functions.scalar import location_label, regime
from plumewalk.operators.ordered import fill_gaps, prefix_sums, with_position
from plumewalk.operators.quantile import quantiles

# Street classes walked on foot, node kinds.
FOOT_TYPES = ["footway", "pedestrian", "unclassified", "steps", "corridor", "path"]
# The columns that are zero-filled before incomplete rows are dropped.
ZERO_FILLED = [
    "average_nearby_num_lanes_50",
    "average_nearby_maxspeed_50",
    "average_nearby_streets_len_50",
    "average_building_height_100",
    "average_building_height_200",
]

# Stored weather names and their English form.
WEATHER_NAMES = {
    "T": "temperature",
    "RH": "humidity",
    "P": "pressure",
    "velocita_vento_massimo": "wind_speed_max",
    "velocita_vento_medio": "wind_speed_mean",
    "direzzione_vento_massimo": "wind_direction_max",
    "direzzione_vento_medio": "wind_direction_mean",
    "radiazione_globale_medio": "solar_radiation",
    "precipitazione_valore_cumulato": "precipitation",
}


def label_route(df: DataFrame, keys: Sequence[str], order: Sequence[str], signal: str = "signal") -> DataFrame:
    """Adds location_code (the running sum of the signal, cut to a whole number), location and regime."""
    out = prefix_sums(df, keys, order, {"location_code": F.col(signal).cast("double")})
    out = out.withColumn("location_code", F.col("location_code").cast("long"))
    out = out.withColumn("location", location_label("location_code"))
    return out.withColumn("regime", regime("location"))


def trim_target(df: DataFrame, target: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with the target between two exact quantiles, both ends kept."""
    q = quantiles(df, [], target, [low, high]).scalar()
    return df.where((F.col(target) >= q[0]) & (F.col(target) <= q[1]))


def street_views(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    foot = F.col("highway").isin(FOOT_TYPES)
    return {
        "foot": edges.where(foot),
        "cars": edges.where(~foot),
        "residential": edges.where("highway = 'residential'"),
        "service": edges.where("highway = 'service'"),
        "crossings": nodes.where("highway = 'crossing'"),
        "signals": nodes.where("highway = 'traffic_signals'"),
    }


def clean_edges(edges: DataFrame) -> DataFrame:
    """Numeric lanes, speed and direction flags; a one-way street without lanes has one; 0 lanes is unknown."""
    oneway = F.coalesce(F.col("oneway").cast("int"), F.lit(0))
    lanes = F.coalesce(F.col("lanes").try_cast("double"), F.lit(0.0))
    lanes = F.when((oneway == 1), 1.0).otherwise(lanes)
    return edges.withColumns(
        {
            "lanes": F.when(lanes != 0, lanes),
            "maxspeed": F.col("maxspeed").try_cast("double"),
            "oneway": oneway,
            "reversed": F.coalesce(F.col("reversed").cast("int"), F.lit(0)),
        }
    )


def building_levels(df: DataFrame, levels: str = "levels", level: str = "level") -> DataFrame:
    """One numeric ``levels``: ground floor 0, basement entries unknown, ``level`` as a stand-in."""
    main = F.when(F.lower(F.trim(levels)) == "piano terra", "0").otherwise(F.col(levels)).try_cast("double")
    spare = F.when(F.trim(level) != "-1", F.col(level)).try_cast("double")
    return df.withColumn(levels, F.coalesce(main, spare)).drop(level)


def english_weather(df: DataFrame, names: Mapping[str, str] = WEATHER_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def null_rule(name: str, variant: str = "street") -> float | str:
    """Fill for a feature column by its name, the first rule that matches; a median_or_x rule asks for the median."""
    rules: list[tuple[tuple[str, ...], float | str]] = [
        (("distance", "close2"), 200.0),
        (("num_", "count"), 0.0),
        (("proportion_", "average_"), "median_or_0.3"),
    ]
    if variant == "street":
        rules.append((("sum_", "len"), 0.0))
    for marks, fill in rules:
        if any(m in name.lower() for m in marks):
            return fill
    return "median_or_0" if variant == "street" else 0.0


def fill_by_name(df: DataFrame, columns: Sequence[str], variant: str = "street") -> DataFrame:
    """Null policy driven by column names; all medians come from one pass over the unpivoted columns."""
    fixed: dict[str, float] = {}
    asked: dict[str, float] = {}
    for c in columns:
        rule = null_rule(c, variant)
        if isinstance(rule, str):
            asked[c] = float(rule.rsplit("_", 1)[1])
        else:
            fixed[c] = rule
    if asked:
        long = df.select(F.explode(F.create_map(*[x for c in asked for x in (F.lit(c), F.col(c).cast("double"))])).alias("c", "v"))
        # One row per feature column: as small as the schema.
        medians = {r["c"]: r["q"][0] for r in quantiles(long, ["c"], "v", [0.5]).collect()}
        fixed.update({c: medians.get(c) if medians.get(c) is not None else asked[c] for c in asked})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fixed[c])) for c in columns})


def combine_subjects(parts: Sequence[DataFrame], drop: Sequence[str] = ("PM25",)) -> DataFrame:
    """All subject tables in one, zero-filled where agreed, rows with other nulls left out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.drop(*drop)
    zero = [c for c in ZERO_FILLED if c in out.columns]
    return out.fillna(0.0, subset=zero).na.drop() if zero else out.na.drop()


def prepare_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], target: str, columns: Sequence[str]) -> DataFrame:
    """Rows with a target, gaps filled forward then backward, what is still null dropped."""
    return fill_gaps(df.where(F.col(target).isNotNull()), keys, order, columns).na.drop(subset=list(columns))


def spaced_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k equally spaced rows per key: positions floor(i*(n-1)/(k-1)); all rows when the key has fewer."""
    placed = with_position(df, keys, order, "_pos")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    joined = placed.join(sizes, list(keys))
    # Row p is hit by i = ceil(p*(k-1)/(n-1)) if floor(i*(n-1)/(k-1)) falls back on p.
    step = (F.col("_n") - 1) / F.lit(max(k - 1, 1))
    first = F.ceil(F.col("_pos") / F.when(step > 0, step).otherwise(1.0) - 1e-9)
    hit = (F.floor(first * step + 1e-9) == F.col("_pos")) & (first < k)
    return joined.where((F.col("_n") <= k) | hit).drop("_pos", "_n")


def reject_models(preds: DataFrame, model: str = "subject_id", pred: str = "pred", low: float = -100.0, high: float = 50000.0) -> DataFrame:
    """Every prediction of a model whose mean prediction is out of range becomes null."""
    means = preds.groupBy(model).agg(F.avg(pred).alias("_mean"))
    joined = preds.join(means, model)
    bad = (F.col("_mean") < low) | (F.col("_mean") > high)
    return joined.withColumn(pred, F.when(~F.coalesce(bad, F.lit(False)), F.col(pred))).drop("_mean")


def drop_invalid_geometry(df: DataFrame, column: str = "rings", least_points: int = 1) -> DataFrame:
    return df.where(F.col(column).isNotNull() & F.exists(column, lambda r: F.size(r) >= least_points))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns of which more than half of the rows parse become double; a list cell gives its first element."""
    flat = df
    for c in columns:
        if isinstance(df.schema[c].dataType, T.ArrayType):
            flat = flat.withColumn(c, F.try_element_at(F.col(c), F.lit(1)))
    counts = flat.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c).try_cast("double")).alias(f"n_{c}") for c in columns]
    ).first()
    numeric = {c: F.col(c).try_cast("double") for c in columns if counts[f"n_{c}"] * 2 > counts["rows"]}
    return flat.withColumns(numeric) if numeric else flat


def pick_rows(df: DataFrame, subject=None, regime_name: str = "all") -> DataFrame:
    if regime_name not in ("all", "static", "dynamic"):
        raise ValueError(f"unknown regime {regime_name!r}")
    out = df if subject is None else df.where(F.col("subject_id") == subject)
    return out if regime_name == "all" else out.where(F.col("regime") == regime_name)


def inside_box(west: float, south: float, east: float, north: float, x: str = "x", y: str = "y") -> Column:
    return F.col(x).between(west, east) & F.col(y).between(south, north)
