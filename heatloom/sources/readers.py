"""Readers: map features, street data, sensor and station series, weather payloads, rasters, catalogues.

All but rasters and single JSON documents are split by Spark's own sources. Bad values become null, never an error;
what a reader drops is said in its docstring."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import comfort
from heatloom.operators.joins import ring_edges

#: Rows of a raster that one row of the reader's output comes from.
SLAB = 256
RINGS, PARTS, LINE = "array<array<array<double>>>", "array<array<array<array<double>>>>", "array<array<double>>"


def number(text: Column) -> Column:
    """A finite number, or null."""
    n = F.trim(text).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def features(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON collections: kind, coordinates (JSON text) and properties (a map of texts). Features without
    geometry are dropped. Collections are one document, so each file is one task's; convert large ones to Parquet once."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")).where("kind IS NOT NULL AND coordinates IS NOT NULL")


def envelope(coordinates: Column) -> Column:
    """Bounds (x1, y1, x2, y2) of coordinates of any depth."""
    pairs = F.regexp_extract_all(coordinates, F.lit(r"\[\s*(-?[0-9.eE+-]+)\s*,\s*-?[0-9.eE+-]+"), 1)
    ys = F.regexp_extract_all(coordinates, F.lit(r"\[\s*-?[0-9.eE+-]+\s*,\s*(-?[0-9.eE+-]+)"), 1)
    x, y = F.transform(pairs, lambda v: v.try_cast("double")), F.transform(ys, lambda v: v.try_cast("double"))
    return F.struct(F.array_min(x).alias("x1"), F.array_min(y).alias("y1"), F.array_max(x).alias("x2"), F.array_max(y).alias("y2"))


def clip(df: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Features whose bounds touch a box, its edges included."""
    e = envelope(F.col("coordinates"))
    return df.where((e["x1"] <= x2) & (e["x2"] >= x1) & (e["y1"] <= y2) & (e["y2"] >= y1))


def polygon_edges(kind: Column, coordinates: Column) -> Column:
    """Edges of all rings of a polygon or of several; null for other kinds."""
    rings = F.when(kind == "Polygon", F.from_json(coordinates, RINGS)).when(kind == "MultiPolygon", F.flatten(F.from_json(coordinates, PARTS)))
    return F.flatten(F.transform(rings, lambda ring: ring_edges(F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))))))


def buildings(df: DataFrame, top: str, ground: str) -> tuple[DataFrame, DataFrame]:
    """Polygons with their height (top less ground), and one row with the number skipped: no polygon, or no height above 0."""
    height = number(F.element_at("properties", top)) - number(F.element_at("properties", ground))
    p = df.select(polygon_edges(F.col("kind"), F.col("coordinates")).alias("edges"), height.alias("height"))
    good = (F.size("edges") > 0) & (F.col("height") > 0)
    return p.where(good), p.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("skipped"))


def classified(df: DataFrame, keys: list[str], classes: DataFrame, default: int | None = 0) -> DataFrame:
    """Features with the class (tag, value -> class, priority) of the first of the keys that they have; those of no class take
    the default, or go where it is None. `classes` is a small table that is broadcast."""
    first = F.coalesce(*[F.when(F.element_at("properties", k).isNotNull(), F.struct(F.lit(k).alias("tag"), F.element_at("properties", k).alias("value"))) for k in keys])
    j = df.withColumn("t", first).withColumn("tag", F.col("t.tag")).withColumn("value", F.col("t.value")).drop("t").join(F.broadcast(classes), ["tag", "value"], "inner" if default is None else "left")
    return j if default is None else j.withColumn("class", F.coalesce("class", F.lit(default)))


def streets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lon, lat) and ways (way, tags, nodes) of street data in JSON."""
    schema = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    nodes = e.where("type = 'node'").select(F.col("id").alias("node"), "lon", "lat")
    ways = e.where("type = 'way' AND size(nodes) > 1").select(F.col("id").alias("way"), F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("tags"), "nodes")
    return nodes, ways


def steps(ways: DataFrame) -> DataFrame:
    """way, seq, node of ways."""
    return ways.select("way", F.posexplode("nodes").alias("seq", "node"))


def names_at_nodes(ways: DataFrame) -> DataFrame:
    """The names of the ways at each node."""
    return ways.select(F.explode("nodes").alias("node"), F.coalesce(F.element_at("tags", "name"), F.element_at("tags", "highway")).alias("name")).where("name IS NOT NULL").groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("names"))


#: Valid ranges of readings; the bounds are valid. Fixed values.
RANGES = {"airtemperature": (-5.0, 50.0), "relativehumidity": (1.0, 100.0), "averagewindspeed": (0.0, 40.0)}


def sensor_rows(spark: SparkSession, path: str, zone: str = "Australia/Melbourne", ranges: dict | None = None) -> DataFrame:
    """Readings from CSV with semicolons: device_id, received_at (UTC text), latlong and numbers. Adds ts (UTC), local, lat, lon;
    numbers outside their range, or that are none, are null; rows without a time are dropped."""
    c = spark.read.option("header", True).option("sep", ";").csv(path)
    ts = F.coalesce(*[F.try_to_timestamp("received_at", F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss")])
    place = F.split("latlong", ",")
    out = c.withColumn("ts", ts).where("ts IS NOT NULL").withColumns({"lat": number(F.get(place, F.lit(0))), "lon": number(F.get(place, F.lit(1))), "local": F.from_utc_timestamp("ts", zone).cast("timestamp_ntz")})
    for name, (low, high) in (ranges or RANGES).items():
        if name in c.columns:
            v = number(F.col(name))
            out = out.withColumn(name, F.when(v.between(low, high), v))
    return out


def light_rows(spark: SparkSession, path: str) -> DataFrame:
    """Light readings: board, ts, light, lat, lon; rows without one of board, time or light are dropped."""
    c = spark.read.option("header", True).csv(path)
    return c.select(F.col("boardid").try_cast("int").alias("board"), F.try_to_timestamp("timestamp").alias("ts"), number(F.col("light_avg")).alias("light"), number(F.col("latitude")).alias("lat"), number(F.col("longitude")).alias("lon")).dropna(subset=["board", "ts", "light"])


#: Quality codes of station values that count. Fixed values.
GOOD = ("0", "1", "4", "5", "9")


def station_hours(spark: SparkSession, path: str, zone: str = "Australia/Melbourne") -> DataFrame:
    """Hourly means of station reports: TMP and DEW as "value,quality" in tenths of a degree (9999: none), DATE in UTC.
    Adds humidity from the dew point, 0 to 100; values of other quality are null."""
    c = spark.read.option("header", True).csv(path)

    def value(name):
        v = number(F.get(F.split(name, ","), F.lit(0)))
        return F.when((F.abs(v) != 9999) & F.trim(F.get(F.split(name, ","), F.lit(1))).isin(*GOOD), v / 10)

    rows = c.select(F.from_utc_timestamp(F.try_to_timestamp("DATE"), zone).cast("timestamp_ntz").alias("local"), value("TMP").alias("ta"), value("DEW").alias("dew")).where("local IS NOT NULL")
    rows = rows.withColumn("rh", comfort.clamp(100 * comfort.sat_vapour_bolton(F.col("dew")) / comfort.sat_vapour_bolton(F.col("ta")), 0.0, 100.0))
    return rows.groupBy(F.date_trunc("hour", "local").cast("timestamp_ntz").alias("hh")).agg(F.avg("ta").alias("ta"), F.avg("rh").alias("rh"), F.count("ta").alias("n"))


def payload_rows(spark: SparkSession, path: str, variables: list[str], block: str = "hourly") -> DataFrame:
    """Rows of weather payloads (JSON, plain or gz) whose block holds parallel arrays: file, time and the variables; one that is
    missing is null, arrays of other lengths are filled up."""
    arrays = ",".join(f"{v}:array<double>" for v in variables)
    d = spark.read.schema(f"{block} struct<time:array<string>,{arrays}>").option("multiLine", True).json(path)
    known = [F.coalesce(F.col(f"{block}.{v}"), F.array().cast("array<double>")).alias(v) for v in variables]
    d = d.select(F.input_file_name().alias("file"), F.coalesce(F.col(f"{block}.time"), F.array().cast("array<string>")).alias("time"), *known)
    z = d.select("file", F.explode(F.arrays_zip("time", *variables)).alias("z"))
    return z.select("file", F.col("z.time").alias("time"), *[F.col(f"z.{v}").alias(v) for v in variables])


def clock_rows(rows: DataFrame, minutes: int = 60) -> DataFrame:
    """payload_rows of the first day only, with slot: the minute of the day that the text of the time names."""
    day = F.min(F.substring("time", 1, 10)).over(Window.partitionBy("file"))
    slot = F.substring("time", 12, 2).try_cast("int") * 60 + F.substring("time", 15, 2).try_cast("int")
    return rows.withColumn("day", day).where(F.substring("time", 1, 10) == F.col("day")).withColumn("slot", slot).where((F.col("slot") % minutes == 0) & F.col("slot").isNotNull()).drop("day")


def local_to_utc(df: DataFrame, local: str, zone: str) -> DataFrame:
    """df with utc for a local time; times that a change of the clock leaves out or repeats are dropped."""
    at = F.to_utc_timestamp(F.col(local).cast("timestamp"), zone)
    back = F.from_utc_timestamp(at, zone)
    hour = F.expr("INTERVAL '1' HOUR")
    twice = (F.from_utc_timestamp(at + hour, zone) == back) | (F.from_utc_timestamp(at - hour, zone) == back)
    return df.withColumn("utc", at).where((back == F.col(local).cast("timestamp")) & ~twice)


def raster_cells(spark: SparkSession, path: str, value: str = "h") -> DataFrame:
    """file, row, col, value of .npy rasters. A file is one task's, its cells leave it in slabs of rows."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                for a in range(0, grid.shape[0], SLAB):
                    part = grid[a : a + SLAB]
                    row, col = np.indices(part.shape).reshape(2, -1)
                    yield pd.DataFrame({"file": name, "row": (row + a).astype(np.int32), "col": col.astype(np.int32), value: part.reshape(-1).astype(float)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, f"file string, row int, col int, {value} double")


def shade_sets(spark: SparkSession, path: str, probe: int = 780) -> DataFrame:
    """Catalogue of shade sets from their manifests: file, date, step (60 where none is named); sets without the probe slot are left out."""
    m = spark.read.schema("date string, step_min int, slots array<int>").option("multiLine", True).json(path)
    return m.where(F.array_contains("slots", probe)).select(F.input_file_name().alias("file"), "date", F.coalesce("step_min", F.lit(60)).alias("step"), "slots")


def bias_table(spark: SparkSession, path: str, kind: str = "diurnal_shape") -> DataFrame:
    """season, hr, shape, level of a fit; a document of another kind is an error."""
    d = spark.read.schema("kind string, level double, seasons map<string,array<double>>").option("multiLine", True).json(path)
    checked = F.when(F.col("kind") == kind, F.col("level")).otherwise(F.raise_error(F.concat(F.lit("not a fit of the kind wanted: "), F.coalesce("kind", F.lit("none")))))
    return d.select(checked.alias("level"), F.explode("seasons").alias("season", "shape")).select("season", "level", F.posexplode("shape").alias("hr", "shape"))


def hours_table(spark: SparkSession, path: str) -> DataFrame:
    """class, dow (Monday: 0), opens, closes (decimal hours) of opening tables; a day without a span has nulls: closed."""
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    d = spark.read.schema("classes map<string,map<string,array<double>>>").option("multiLine", True).json(path)
    e = d.select(F.explode("classes").alias("class", "days")).select("class", "days", F.posexplode(F.array(*map(F.lit, days))).alias("dow", "day"))
    span = F.element_at("days", F.col("day"))
    return e.select("class", "dow", F.get(span, F.lit(0)).alias("opens"), F.get(span, F.lit(1)).alias("closes"))
