"""Readers: every file set becomes one table in one job, with the schema fixed up front."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumewalk.functions.scalar import plain_name, sensor_codes_to_null

# The measured variables, in reading order.
VARIABLES = ["CO2", "P", "PM1", "PM10", "PM25", "RH", "T", "VOC"]

WEATHER_RAW = "`Id Sensore` long, `Data-Ora` timestamp_ntz, value double"
PREDICTION_FIELDS = {
    "edge_id": "string", "point_id": "string", "distance_along_edge": "double", "edge_length": "double",
    "highway": "string", "x": "double", "y": "double", "predicted_co2": "double", "point_type": "string",
}


def read_series(spark: SparkSession, folder: str, variables: Sequence[str] = tuple(VARIABLES)) -> DataFrame:
    """Long sensor table (subject_id, variable, t, value, signal) from ``S{id}_{var}_TableResampled.parquet``.

    The three columns of a file are taken by position; ``t`` is seconds of the
    day. A variable without any file is left out.
    """
    parts = []
    for var in variables:
        try:
            raw = spark.read.parquet(f"{folder}/S*_{var}_TableResampled.parquet")
        except AnalysisException:
            continue
        value, ts, signal = raw.columns[:3]
        sid = F.regexp_extract(F.col("_metadata.file_path"), r"/S(\d+)_[^/]*_TableResampled", 1).try_cast("int")
        clock = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        parts.append(
            raw.select(
                sid.alias("subject_id"), F.lit(var).alias("variable"), clock.cast("int").alias("t"),
                F.col(value).cast("double").alias("value"), F.col(signal).cast("double").alias("signal"),
            )
        )
    if not parts:
        raise FileNotFoundError(f"no sensor file under {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_sensor_names(spark: SparkSession, folder: str) -> DataFrame:
    """(Id_Sensore, Nome_Sensore) from lines 12-18 of every .txt file; line 12 is the header."""
    files = spark.read.text(f"{folder}/*.txt", wholetext=True)
    lines = files.select(
        F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")
    ).where(F.col("pos").between(11, 17))
    header = lines.where("pos = 11").select("file", F.split("line", ",").alias("head"))
    cells = lines.where("pos > 11 and length(trim(line)) > 0").select("file", F.split("line", ",").alias("cells"))

    def cell(name: str):
        return F.trim(F.element_at("cells", F.array_position(F.transform("head", F.trim), name).cast("int")))

    return (
        cells.join(header, "file")
        .select(cell("Id_Sensore").cast("long").alias("Id_Sensore"), cell("Nome_Sensore").alias("Nome_Sensore"))
        .distinct()
    )


def read_weather(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """Long weather table (ts, sensor, value) from the station CSVs, codes cleaned, sensors named.

    The value column of a file differs by sensor, so its header is the unit
    part of the sensor name; it is read from the file rather than inferred.
    """
    rows = spark.read.text(f"{folder}/*.csv").select(F.input_file_name().alias("file"), F.col("value").alias("line"))
    cells = rows.select("file", F.split("line", ",").alias("c"))
    head = cells.where(F.array_contains("c", "Data-Ora"))

    def spot(name: str):
        return F.array_position("c", name).cast("int")

    head = head.select(
        "file",
        spot("Id Sensore").alias("pid"),
        spot("Data-Ora").alias("pts"),
        F.filter("c", lambda h: ~h.isin("Id Sensore", "Data-Ora"))[0].alias("unit"),
    )
    data = cells.where(~F.array_contains("c", "Data-Ora")).join(head, "file")
    sid = F.element_at("c", F.col("pid")).try_cast("long")
    pv = 6 - F.col("pid") - F.col("pts")
    long = data.select(
        F.element_at("c", F.col("pts")).try_cast("timestamp_ntz").alias("ts"),
        sid.alias("Id_Sensore"),
        F.trim("unit").alias("unit"),
        sensor_codes_to_null(F.element_at("c", pv).try_cast("double")).alias("value"),
    )
    return long.join(names, "Id_Sensore").select(
        "ts", plain_name(F.concat_ws(" ", F.trim("Nome_Sensore"), "unit")).alias("sensor"), "value"
    )


def weather_wide(long: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """All sensors side by side by time; a time one sensor lacks stays, with a null. Readings that repeat a time and sensor are averaged."""
    return long.groupBy("ts").pivot("sensor", list(sensors)).agg(F.avg("value"))


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks (file, pos, name, description, geom_type, pts) of many KMZ files in one job."""
    schema = (
        "file string, pos int, name string, description string, geom_type string, "
        "pts array<struct<x:double,y:double>>"
    )

    def text(node, tag: str) -> str | None:
        found = next((e for e in node.iter() if e.tag.endswith(tag)), None)
        return None if found is None or found.text is None else found.text.strip()

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("doc.kml"))
                marks = [e for e in root.iter() if e.tag.endswith("Placemark")]
                for pos, mark in enumerate(marks):
                    coords = [c.split(",") for c in (text(mark, "coordinates") or "").split()]
                    pts = [{"x": float(c[0]), "y": float(c[1])} for c in coords]
                    kind = "line" if len(pts) > 1 else "point"
                    rows.append((file, pos, text(mark, "name"), text(mark, "description"), kind, pts))
            yield pd.DataFrame(rows, columns=["file", "pos", "name", "description", "geom_type", "pts"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(unpack, schema)


def route_parts(route: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line rows, point rows) of a route."""
    return route.where("geom_type = 'line'"), route.where("geom_type = 'point'")


def tag_filter(features: DataFrame, tags: Mapping[str, object], column: str = "tags") -> DataFrame:
    """Features for which any key of ``tags`` matches: True = present, a text = equal, a list = one of."""
    match = F.lit(False)
    for key, want in tags.items():
        have = F.try_element_at(F.col(column), F.lit(key))
        if want is True:
            match = match | have.isNotNull()
        else:
            match = match | F.coalesce(have.isin(want if isinstance(want, list) else [want]), F.lit(False))
    return features.where(match)


class Layers:
    """Feature tables by source: a name goes to its registered table, a tag dict filters the base table."""

    def __init__(self, base: DataFrame, named: Mapping[str, DataFrame] | None = None):
        self.base, self.named, self._seen = base, dict(named or {}), {}

    def get(self, source) -> DataFrame:
        from plumewalk.operators.enrich import layer_key

        if isinstance(source, str):
            if source not in self.named:
                raise KeyError(source)
            return self.named[source]
        if not isinstance(source, Mapping):
            raise TypeError(f"a source is a name or a tag filter, not {type(source).__name__}")
        key = layer_key(source)
        if key not in self._seen:
            self._seen[key] = tag_filter(self.base, source)
        return self._seen[key]


def modelling_table(df: DataFrame, drop: Sequence[str] = ("PM1", "PM10", "VOC")) -> DataFrame:
    """The double and long columns except ``drop``, rows with any null left out."""
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.LongType)) and f.name not in drop]
    return df.select(*keep).na.drop()


#: Exclusions of the time-series variant of the modelling table.
SERIES_DROP = ("PM1", "PM10", "VOC", "P", "RH", "T")


def read_predictions(spark: SparkSession, candidates: Sequence[str]) -> DataFrame:
    """The first candidate that exists: its edge rows, or its grid rows with an id of their own.

    A missing edge id is rebuilt from ``u_v_key_i`` point ids with the full ``u_v_key``.
    """
    for path in candidates:
        try:
            df = spark.read.option("header", True).csv(path)
        except AnalysisException:
            continue
        df = df.select(*[F.col(c).try_cast(PREDICTION_FIELDS.get(c, "string")).alias(c) for c in df.columns])
        if "point_type" in df.columns:
            rows = df.where("point_type = 'edge'")
            if "edge_id" not in df.columns:
                rows = rows.withColumn("edge_id", F.regexp_extract("point_id", r"^(.*)_\d+$", 1))
            return rows
        if {"predicted_co2", "x", "y"} <= set(df.columns):
            return df.withColumns(
                {
                    "edge_id": F.concat_ws("_", "x", "y"),
                    "point_type": F.lit("grid"),
                    "distance_along_edge": F.lit(0.0),
                }
            )
    raise FileNotFoundError(f"none of {list(candidates)}")


def grid_predictions(df: DataFrame) -> DataFrame:
    """x, y and predicted_co2 required; nulls dropped; x, y renamed to lng, lat."""
    missing = {"x", "y", "predicted_co2"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return df.na.drop(subset=["x", "y", "predicted_co2"]).withColumnsRenamed({"x": "lng", "y": "lat"})


def read_fvc(spark: SparkSession, path: str) -> DataFrame:
    """Lung-capacity lookup; heights given in metres become centimetres."""
    schema = "age int, height double, sex string, ethnic int, fvc_predicted double"
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumn("height", F.when(F.col("height") < 3, F.col("height") * 100).otherwise(F.col("height")))


def read_network(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Street nodes and edges from parquet tables of those names."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
