import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from plumewalk.operators.clean import label_route
from plumewalk.sources import readers as rd
from plumewalk.sources import sinks as sk


def test_series_files_become_one_table(spark, tmp_path):
    t0 = dt.datetime(2022, 11, 11, 9, 0, 1)
    for sid, var in ((1, "CO2"), (2, "CO2"), (1, "T")):
        rows = [(400.0 + i, t0 + dt.timedelta(seconds=i), 10000.0 if i == 1 else 0.0) for i in range(3)]
        spark.createDataFrame(rows, f"{var}x double, when timestamp_ntz, S double").coalesce(1).write.parquet(str(tmp_path / f"S{sid}_{var}_TableResampled.parquet"))
    long = rd.read_series(spark, str(tmp_path))
    assert long.count() == 9 and {r[0] for r in long.select("variable").distinct().collect()} == {"CO2", "T"}
    assert sorted(r[0] for r in long.where("subject_id = 1 and variable = 'CO2'").select("t").collect()) == [32401, 32402, 32403]
    lab = label_route(long.where("variable = 'CO2'"), ["subject_id"], ["t"]).orderBy("subject_id", "t").collect()
    assert [r["location"] for r in lab[:3]] == ["A", "AB", "AB"] and [r["regime"] for r in lab[:3]] == ["static", "dynamic", "dynamic"]
    with pytest.raises(FileNotFoundError):
        rd.read_series(spark, str(tmp_path / "none"))


def test_weather_folder(spark, tmp_path):
    head = "\n".join(f"note {i}" for i in range(11))
    (tmp_path / "legend.txt").write_text(head + "\nId_Sensore,Nome_Sensore\n10, Temperatura \n20,Velocità Vento\n")
    (tmp_path / "a.csv").write_text("Id Sensore,Data-Ora,Medio\n10,2022-11-11 09:00:00,12.5\n10,2022-11-11 09:10:00,-999\n")
    (tmp_path / "b.csv").write_text("Id Sensore,Data-Ora,Medio\n20,2022-11-11 09:10:00,777\n20,2022-11-11 09:20:00,3\n")
    names = rd.read_sensor_names(spark, str(tmp_path))
    assert {(r[0], r[1]) for r in names.collect()} == {(10, "Temperatura"), (20, "Velocità Vento")}
    wide = rd.weather_wide(rd.read_weather(spark, str(tmp_path), names), ["temperatura_medio", "velocita_vento_medio"])
    got = {r["ts"].strftime("%H:%M"): (r[1], r[2]) for r in wide.collect()}
    assert got == {"09:00": (12.5, None), "09:10": (None, 0.0), "09:20": (None, 3.0)}


def test_kmz(spark, tmp_path):
    kml = (
        '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
        "<Placemark><name>loop</name><LineString><coordinates>9.0,45.0,0 9.1,45.1,0 9.0,45.0,0</coordinates></LineString></Placemark>"
        "<Placemark><name>A start</name><Point><coordinates>9.0,45.0,0</coordinates></Point></Placemark></Document></kml>"
    )
    for n in ("r1", "r2"):
        with zipfile.ZipFile(tmp_path / f"{n}.kmz", "w") as z:
            z.writestr("doc.kml", kml)
    routes = rd.read_routes(spark, str(tmp_path / "*.kmz"))
    lines, points = rd.route_parts(routes)
    assert lines.count() == 2 and points.count() == 2
    assert points.first()["name"] == "A start" and len(lines.first()["pts"]) == 3


def test_layers(spark):
    base = spark.createDataFrame([(1, {"shop": "kiosk"}), (2, {"natural": "tree"}), (3, {"waterway": "river"})], "fid int, tags map<string,string>")
    layers = rd.Layers(base, {"nodes": base.limit(1)})
    assert {r["fid"] for r in layers.get({"natural": ["tree", "wood"], "waterway": True}).collect()} == {2, 3}
    assert layers.get({"shop": True}) is layers.get({"shop": True})
    with pytest.raises(KeyError):
        layers.get("nope")
    with pytest.raises(TypeError):
        layers.get(3)


def test_predictions(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("x,y,predicted_co2,point_type,point_id\n1,2,400,edge,5_6_0_3\n1,2,,node,node_5\n")
    rows = rd.read_predictions(spark, [str(tmp_path / "none.csv"), str(p)]).collect()
    assert [(r["edge_id"], r["predicted_co2"]) for r in rows] == [("5_6_0", 400.0)]
    g = tmp_path / "g.csv"
    g.write_text("x,y,predicted_co2\n1,2,400\n")
    assert rd.read_predictions(spark, [str(g)]).first()["point_type"] == "grid"
    assert rd.grid_predictions(rd.read_predictions(spark, [str(g)])).columns[:2] == ["lng", "lat"]
    with pytest.raises(ValueError):
        rd.grid_predictions(spark.range(1))


def test_fvc_height_in_metres(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("age,height,sex,ethnic,fvc_predicted\n20,1.75,M,1,4.5\n20,180,M,1,4.7\n")
    assert sorted(r["height"] for r in rd.read_fvc(spark, str(p)).collect()) == [175.0, 180.0]


def test_sinks(spark, tmp_path):
    df = spark.range(2500).select((F.col("id") % 2).alias("subject_id"), F.lit("1s").alias("variant"), "id")
    sk.write_subjects(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("subject_id = 1").count() == 1250
    sk.write_chunks(df.coalesce(1), str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 3
    sk.parquet_to_csv(spark, str(tmp_path / "s"), str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).count() == 2500
    sk.write_trials({"train": df.limit(3)}, df.limit(1), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t" / "summary")).count() == 1


def test_chunks_are_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(2000, numPartitions=1).select((F.col("id") % 200).alias("subject_id"), F.col("id").alias("v"))
    sk.write_chunks(rows, f"{tmp_path}/chunks", 10)
    files = sorted(tmp_path.glob("chunks/part-*.csv"), key=lambda f: (f.name.split("-")[1], f.name))
    assert len({f.name.split("-")[1] for f in files}) > 4
    held = [[int(line.split(",")[1]) for line in f.read_text().split()[1:]] for f in files]
    assert max(map(len, held)) <= 10 and sum(held, []) == list(range(2000))


def test_many_subjects_are_written_by_many_tasks(spark, tmp_path, few_rows):
    """A task for a few folders each; a small subject is one file, a large one (here over 5 rows) several; no row is lost."""
    rows = [(i % 60, i, float(i)) for i in range(240)] + [(99, i, 0.5) for i in range(400)] + [(None, i, 1.0) for i in range(3)]
    sk.write_subjects(spark.createDataFrame(rows, "subject_id long, ts long, co2 double"), str(tmp_path / "s"))
    files = {p.name: [f.name for f in p.glob("part-*.parquet")] for p in (tmp_path / "s").glob("subject_id=*")}
    assert len(files) == 62 and all(len(f) == 1 for name, f in files.items() if name != "subject_id=99")
    assert len(files["subject_id=99"]) > 4
    assert len({f.split("-")[1] for own in files.values() for f in own}) > 4
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select("subject_id", "ts", "co2").collect())) == sorted(f"Row(subject_id={s}, ts={t}, co2={c})" for s, t, c in rows)
