"""Readers and writers on small files; streaming forms as streams."""

import datetime as dt
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.sources import readers, writers
from heatloom.streaming import windows


def put(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def square(x, y, size):
    return [[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]


def test_features(spark, tmp_path):
    shape = lambda kind, c, **p: {"type": "Feature", "geometry": None if kind is None else {"type": kind, "coordinates": c}, "properties": p}
    doc = {"features": [
        shape("Polygon", [square(0, 0, 2)], top="12.5", ground="2.5", surface="asphalt"), shape("MultiPolygon", [[square(5, 5, 1)], [square(8, 8, 1), square(8.2, 8.2, 0.1)]], top=9, ground=9, landuse="grass"),
        shape("Point", [1.0, 1.0], top="x"), shape(None, None), shape("Polygon", [square(-9, -9, 1)], top="3", ground="1", natural="water", landuse="grass"),
    ]}
    f = readers.features(spark, put(tmp_path / "f.json", doc))
    assert f.count() == 4
    assert [tuple(r.e) for r in f.select(readers.envelope(F.col("coordinates")).alias("e")).collect()][:2] == [(0, 0, 2, 2), (5, 5, 9, 9)]
    assert readers.clip(f, 2, 2, 5, 5).count() == 2
    tall, skipped = readers.buildings(f, "top", "ground")
    assert sorted(r.height for r in tall.collect()) == [2.0, 10.0] and skipped.first().skipped == 2
    assert {len(r.edges) for r in tall.collect()} == {5}
    classes = spark.createDataFrame([("natural", "water", 9, 1), ("landuse", "grass", 4, 2)], "tag string, value string, class int, priority int")
    got = readers.classified(f, ["natural", "landuse", "surface"], classes)
    assert sorted(got.select(F.col("class")).toPandas()["class"]) == [0, 0, 4, 9]
    assert readers.classified(f, ["natural", "landuse"], classes, None).count() == 2


def test_streets(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": 13794345654, "lat": 1.0, "lon": 2.0}, {"type": "way", "id": 7, "nodes": [13794345654, 2, 3], "tags": {"highway": "steps", "name": "A"}}, {"type": "way", "id": 8, "nodes": [3]}, {"type": "way", "id": 9, "nodes": [3, 2]}]}
    nodes, ways = readers.streets(spark, put(tmp_path / "s.json", doc))
    assert nodes.collect() == [(13794345654, 2.0, 1.0)] and {r.way: len(r.tags) for r in ways.collect()} == {7: 2, 9: 0}
    assert [tuple(r) for r in readers.steps(ways).where("way = 7").orderBy("seq").collect()] == [(7, 0, 13794345654), (7, 1, 2), (7, 2, 3)]
    assert {r.node: r.names for r in readers.names_at_nodes(ways).collect()}[3] == ["A"]


def test_sensor_csv(spark, tmp_path):
    path = put(tmp_path / "c.csv", "device_id;received_at;latlong;airtemperature;relativehumidity\na;2024-01-01T00:30:00+00:00;-37.8,144.9;21.5;100\nb;2024-07-01T00:30:00+00:00;;50.1;nan\nc;never;1,2;3;4\nd;2024-01-01T00:30:00+00:00;x;-5;\n")
    got = {r.device_id: r for r in readers.sensor_rows(spark, path).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].local == dt.datetime(2024, 1, 1, 11, 30) and got["b"].local == dt.datetime(2024, 7, 1, 10, 30)
    assert (got["a"].lat, got["a"].lon, got["a"].airtemperature, got["a"].relativehumidity) == (-37.8, 144.9, 21.5, 100.0)
    assert (got["b"].airtemperature, got["b"].relativehumidity, got["d"].airtemperature, got["d"].lat) == (None, None, -5.0, None)


def test_light_and_station_csv(spark, tmp_path):
    path = put(tmp_path / "l.csv", "boardid,timestamp,light_avg,latitude,longitude\n1,2015-01-01 10:00:00,80.5,-37,144\n2,2015-01-01 10:00:00,,-37,144\n,2015-01-01 10:00:00,3,1,1\n")
    assert [(r.board, r.light) for r in readers.light_rows(spark, path).collect()] == [(1, 80.5)]
    path = put(tmp_path / "i.csv", 'DATE,TMP,DEW\n2024-01-01T00:00:00,"+0200,1","+0100,1"\n2024-01-01T00:30:00,"+0300,1","+9999,9"\n2024-01-01T01:00:00,"+0250,2","+0100,1"\n')
    got = {r.hh: r for r in readers.station_hours(spark, path).collect()}
    assert (got[dt.datetime(2024, 1, 1, 11)].ta, got[dt.datetime(2024, 1, 1, 11)].n) == (25.0, 2) and 50 < got[dt.datetime(2024, 1, 1, 11)].rh < 55
    assert got[dt.datetime(2024, 1, 1, 12)].ta is None


def test_payloads_and_catalogues(spark, tmp_path):
    doc = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-02T00:00"], "temperature_2m": [1.5, None, 3.0], "short": [1.0]}}
    with gzip.open(tmp_path / "p.json.gz", "wt") as f:
        json.dump(doc, f)
    rows = readers.payload_rows(spark, str(tmp_path / "p.json.gz"), ["temperature_2m", "short", "missing"])
    assert [(r.temperature_2m, r.short, r.missing) for r in rows.orderBy("time").collect()] == [(1.5, 1.0, None), (None, None, None), (3.0, None, None)]
    assert [(r.slot, r.temperature_2m) for r in readers.clock_rows(rows).orderBy("slot").collect()] == [(0, 1.5), (60, None)]
    for i, m in enumerate(({"date": "d", "slots": [780]}, {"date": "e", "step_min": 30, "slots": [780, 810]}, {"date": "f", "slots": [0]})):
        put(tmp_path / f"manifest{i}.json", m)
    assert sorted((r.date, r.step) for r in readers.shade_sets(spark, str(tmp_path / "manifest*.json")).collect()) == [("d", 60), ("e", 30)]
    table = {"classes": {"mall": {"mon": [9.0, 17.5], "tue": None}}}
    got = {r.dow: (r.opens, r.closes) for r in readers.hours_table(spark, put(tmp_path / "h.json", table)).collect()}
    assert len(got) == 7 and got[0] == (9.0, 17.5) and got[1] == (None, None)


def test_changes_of_the_clock(spark):
    at = [dt.datetime(2024, 4, 7, 2, 30), dt.datetime(2024, 10, 6, 2, 30), dt.datetime(2024, 4, 7, 12), dt.datetime(2024, 10, 6, 4)]
    df = spark.createDataFrame([(x,) for x in at], "local timestamp_ntz")
    got = {r.local for r in readers.local_to_utc(df, "local", "Australia/Melbourne").collect()}
    assert got == {at[2], at[3]}  # repeated in April, left out in October


def test_raster_round_trip_and_manifest(spark, tmp_path):
    grid = np.arange(600.0).reshape(300, 2)
    np.save(tmp_path / "g.npy", grid)
    cells = readers.raster_cells(spark, str(tmp_path / "g.npy")).drop("file").withColumn("slot", F.lit(780))
    assert {(r.row, r.col): r.h for r in cells.collect()} == {(i, j): grid[i, j] for i in range(300) for j in range(2)}
    writers.shade_set(cells, str(tmp_path / "set"), "2024-01-26", 30, {"maker": "x"})
    assert [(r.date, r.step, r.slots) for r in readers.shade_sets(spark, str(tmp_path / "set/manifest")).collect()] == [("2024-01-26", 30, [780])]
    assert spark.read.parquet(str(tmp_path / "set/cells")).count() == 600


def test_fit_scores_and_lines(spark, tmp_path):
    shapes = spark.createDataFrame([(s, h, h / 10, 1.25) for s in ("DJF", "JJA") for h in range(24)], "season string, hr int, shape double, level double")
    writers.fit(shapes, str(tmp_path / "fit"))
    back = readers.bias_table(spark, str(tmp_path / "fit"))
    assert sorted(map(tuple, back.select("season", "hr", "shape", "level").collect())) == sorted(map(tuple, shapes.collect()))
    with pytest.raises(Exception, match="not a fit"):
        readers.bias_table(spark, str(tmp_path / "fit"), "another").collect()
    writers.scores(shapes.limit(3), str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).count() == 3
    points = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((144.9, -37.8), (145.0, -37.9))])
    line = json.loads(spark.range(1).select(writers.line_feature(points, id=F.col("id")).alias("j")).first().j)
    assert line == {"type": "Feature", "properties": {"id": 0}, "geometry": {"type": "LineString", "coordinates": [[144.9, -37.8], [145.0, -37.9]]}}


START = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, schema, name="in", files=3):
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / name)
    for i in range(files):
        df.where(F.col("n") % files == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), df


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def test_windows_as_streams(spark, tmp_path):
    rows = [(i, START + dt.timedelta(minutes=7 * i), i % 4, "ab"[i % 2], float(i)) for i in range(60)]
    s, df = stream_of(spark, tmp_path, rows, "n int, ts timestamp, user_id int, event_type string, value double")
    got = drained(windows.window_mean(s), "means", "complete").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, windows.window_mean(df).collect())) and len(got) > 5
    got = drained(windows.dedupe_latest(s.drop("event_type")), "latest", "complete").collect()
    want = {}
    for n, ts, user, _, v in rows:
        k = (user, ts.replace(minute=0))
        want[k] = max(want.get(k, (ts, n, v)), (ts, n, v))
    assert {(r.user_id, r.start): (r.ts, r.n, r.value) for r in got} == want
    firsts = drained(windows.dedupe_first(s, "user_id", "30 days"), "firsts", "append")
    assert firsts.count() == 4


def test_interval_join_as_a_stream(spark, tmp_path):
    a, da = stream_of(spark, tmp_path, [(i, START + dt.timedelta(minutes=20 * i), 1, float(i)) for i in range(12)], "n int, ts timestamp, device int, value double", "a")
    b, db = stream_of(spark, tmp_path, [(i, START + dt.timedelta(minutes=60 * i), 1, 100.0 + i) for i in range(4)], "n int, ts timestamp, device int, value double", "b")
    got = drained(windows.lagged_pairs(a, b), "pairs", "append").collect()
    assert sorted((r.obs, r.mod) for r in got) == [(float(i), 100.0 + i // 3) for i in range(12)]


def test_march_as_a_stream(spark, tmp_path):
    rows = [(i // 8, START + dt.timedelta(hours=i // 2), "ab"[i % 2], 100.0 + i, 290.0) for i in range(24)]
    s, _ = stream_of(spark, tmp_path, rows, "n int, ts timestamp, site string, q double, air double")
    step = lambda t, q, air: t + 0.01 * (q - 5 * (t - air))
    got = drained(windows.march_stream(s, step), "march", "append").collect()
    t = {"a": 293.15, "b": 293.15}
    want = []
    # batches come in the order of the files' names, times within a site are in order over all of them
    for n, ts, site, q, air in rows:
        want.append((site, ts, t[site]))
        t[site] = step(t[site], q, air)
    assert len(got) == len(want)
    assert {(r.site, r.ts) for r in got} == {w[:2] for w in want}


def test_slots_leave_through_a_sink(spark, tmp_path):
    s, df = stream_of(spark, tmp_path, [(i, START, i) for i in range(9)], "n int, ts timestamp, slot int")
    q = windows.emit_slots(s, lambda batch, _: batch.write.mode("append").partitionBy("slot").parquet(str(tmp_path / "out")), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    live = spark.createDataFrame([(0, 1.0), (30, 2.0), (60, 3.0)], "slot int, value double")
    assert [r.value for r in windows.fresh(live, spark.createDataFrame([(45,)], "minute int")).collect()] == [3.0]
