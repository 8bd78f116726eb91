"""The tables that the queries read, under the names of the domain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL (DuckDB) of the same readings, hourly means, model series, legs and options.
READINGS = "r AS (SELECT event_id, user_id AS device, event_type AS site, ts, date_trunc('hour', ts) AS hh, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, CASE WHEN value BETWEEN 1 AND 400 THEN value END AS value FROM events)"
HOURLY = READINGS + ", h AS (SELECT device, hh, avg(value) AS value, count(value) AS n FROM r GROUP BY device, hh HAVING count(value) > 0)"
PAIRED = HOURLY + ", m AS (SELECT hh, avg(value) AS value FROM h GROUP BY hh), p AS (SELECT h.device, h.hh, hour(h.hh) AS hr, ['DJF', 'MAM', 'JJA', 'SON'][1 + (day(h.hh) - 1) // 8] AS season, h.value AS obs, m.value AS mod, m.value - h.value AS bias FROM h JOIN m USING (hh))"
LEGS = "l AS (SELECT l_orderkey AS route, l_linenumber AS seq, l_partkey AS part, l_extendedprice AS price, l_quantity * 10 AS len, l_discount * 10 AS shade, l_extendedprice / l_quantity / 50 AS utci, l_returnflag = 'R' AS indoor, l_tax AS tax, l_partkey % 7 = 0 AS conveying FROM lineitem)"
OPTIONS = "o AS (SELECT l_orderkey AS route, o_custkey AS od, sum(l_quantity) AS minutes, sum(l_quantity * (100 - round(l_discount * 100))) / 100 AS load FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts, about.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, by: str) -> DataFrame:
    """df of so many rows, dealt by a key over as many partitions as keep tasks small: a fixed number of them would grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_A_TASK)), by)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings: values outside the valid range are null."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    return e.select("event_id", F.col("user_id").alias("device"), F.col("event_type").alias("site"), "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hh"), F.get_json_object("props", "$.k").cast("int").alias("k"), F.when(v.between(1, 400), v).alias("value"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("device", "hh").agg(F.avg("value").alias("value"), F.count("value").alias("n")).where("n > 0")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings beside the model series, the mean of all devices. Seasons are eight days long, as the data cover a month."""
    h = hourly(spark, sf_dir)
    m = h.groupBy("hh").agg(F.avg("value").alias("mod"))
    season = F.get(F.array(*map(F.lit, ("DJF", "MAM", "JJA", "SON"))), F.floor((F.dayofmonth("hh") - 1) / 8).cast("int"))
    return h.join(m, "hh").select("device", "hh", F.hour("hh").alias("hr"), season.alias("season"), F.col("value").alias("obs"), "mod", (F.col("mod") - F.col("value")).alias("bias"))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of routes: the parts of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 10).alias("len"), (F.col("l_discount") * 10).alias("shade"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 50).alias("utci"), (F.col("l_returnflag") == "R").alias("indoor"), F.col("l_tax").alias("tax"), (F.col("l_partkey") % 7 == 0).alias("conveying"),
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route options of an origin and destination: the orders of a customer. load is exact to the hundredth."""
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("od"))
    load = F.sum(F.col("l_quantity") * (100 - F.round(F.col("l_discount") * 100))) / 100
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_orderkey").alias("route"), "od").agg(F.sum("l_quantity").alias("minutes"), load.alias("load"))
