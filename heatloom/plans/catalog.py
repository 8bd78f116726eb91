"""All queries of the library and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatloom.functions import comfort
from heatloom.operators import joins
from heatloom.plans import checks, city, physics, routes, sensors, spaces, texts
from heatloom.plans.shared import PRELUDE, SHARED
from heatloom.plans.tables import table
from heatloom.streaming import windows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What the shared texts leave open, for each engine.
SPARK = {"first": "0", "json": "get_json_object", "half_even": "bround", "epoch_hh": "unix_seconds(CAST(hh AS TIMESTAMP))", "digest": "sha2(text, 256)"}
DUCK = {"first": "1", "json": "json_extract_string", "half_even": "round_even", "epoch_hh": "epoch(hh)", "digest": "sha256(text)"}


def names_in(sql: str) -> set[str]:
    return set(re.findall(r"[A-Za-z_]+", sql))


def with_prelude(sql: str, engine: dict[str, str]) -> str:
    """sql behind the views of PRELUDE that it uses, in their order."""
    used: list[str] = []
    text = sql
    for name in reversed(PRELUDE):
        if name in names_in(text):
            used.append(name)
            text += " " + PRELUDE[name]
    whole = ("WITH " + ", ".join(f"{n} AS ({PRELUDE[n]})" for n in reversed(used)) + " " if used else "") + sql
    for name, own in engine.items():
        whole = whole.replace("{" + name + "}", own)
    return whole if engine is SPARK else whole.replace("explode(sequence(0, 23))", "unnest(range(0, 24))")


def shared_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = with_prelude(SHARED[name], SPARK)
        for t in names_in(sql).intersection(TABLES):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    return run


def readings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")


def points(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"))


def join_asof_backward(spark, sf_dir):
    all_ = readings(spark, sf_dir)
    left = all_.where("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = all_.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_backward(left, right, "user_id", "ts", "value").select("event_id", F.round("value", 4).alias("value"))


def join_radius_bucket(spark, sf_dir):
    p = points(spark, sf_dir)
    return joins.within_radius(p, p, 2.0).where("id < id2").select("id", "id2", F.round("d", 4).alias("d"))


def join_nn_snap(spark, sf_dir):
    p = points(spark, sf_dir)
    return joins.nearest_within(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), 3.0).select("id", "id2", F.round("d", 4).alias("d"))


def join_asof_nearest(spark, sf_dir):
    all_ = readings(spark, sf_dir)
    left = all_.where("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = all_.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_nearest(left, right, "user_id", "ts", "value").select("event_id", F.round("value", 4).alias("value"))


def scan_arrays_explode(spark, sf_dir):
    """Mean of each component over all vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("pos").agg(F.count("x").alias("n"), F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))


def phys_air_and_sky(spark, sf_dir):
    """value / 10 as air temperature, k as humidity and cloud, value / 40 as wind."""
    ta, k = F.col("value") / 10, F.regexp_extract("props", "(-?[0-9]+)", 1).cast("double")
    e = comfort.vapour(ta, k)
    out = {"e": e, "sky": comfort.sky_emissivity(ta, e, k / 100), "wind": comfort.wind_low(F.col("value") / 40), "h": comfort.convection(comfort.wind_low(F.col("value") / 40)), "rh": comfort.humidity_after(ta, k, F.lit(1.5)), "strain": comfort.stress(ta)}
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", *(F.round(c, 4).alias(n) for n, c in out.items()))


def phys_sun(spark, sf_dir):
    """k as the sun's elevation and as cloud cover."""
    k = F.regexp_extract("props", "(-?[0-9]+)", 1).cast("double")
    out = {"uv": comfort.uv_under_cloud(comfort.uv_clear(k), k), "ghi": comfort.ghi_clear(k)}
    return table(spark, sf_dir, "events").select("event_id", *(F.round(c, 3).alias(n) for n, c in out.items()))


def phys_ts_march(spark, sf_dir):
    """Surface temperature at the end of each device's day: one fold over at most 24 hourly means."""
    hourly = table(spark, sf_dir, "events").where("value BETWEEN 1 AND 400").groupBy(F.col("user_id").alias("device"), F.date_trunc("hour", "ts").alias("hh")).agg(F.avg("value").alias("v"))
    day = hourly.groupBy("device", F.to_date("hh").alias("day")).agg(F.array_sort(F.collect_list(F.struct("hh", F.col("v").alias("absorbed"), (F.col("v") / 20 + 283.15).alias("air")))).alias("s"))
    return day.select("device", "day", F.round(comfort.march(F.col("s"), F.lit(293.15)), 3).alias("ts"))


def stream_window_mean(spark, sf_dir):
    """The streaming plan on the table read as a batch; tests run it as a stream."""
    out = windows.window_mean(readings(spark, sf_dir))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("value", 4).alias("value"), "n")


POINTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings)"
PLANS = {
    "join_asof_backward": (join_asof_backward, "WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY user_id, ts) SELECT l.event_id, round(r.value, 4) AS value FROM (SELECT * FROM events WHERE event_id % 2 = 0) l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "join_radius_bucket": (join_radius_bucket, f"WITH {POINTS} SELECT a.id, b.id AS id2, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 4) AS d FROM p a JOIN p b ON a.id < b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.0"),
    "join_nn_snap": (join_nn_snap, f"WITH {POINTS}, c AS (SELECT a.id, b.id AS id2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0) SELECT id, id2, round(d, 4) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, id2) AS rn FROM c WHERE d <= 3.0) WHERE rn = 1"),
    "join_asof_nearest": (join_asof_nearest, "WITH r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY user_id, ts), c AS (SELECT l.event_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS rn FROM events l LEFT JOIN r ON l.user_id = r.user_id WHERE l.event_id % 2 = 0) SELECT event_id, round(value, 4) AS value FROM c WHERE rn = 1"),
    "scan_arrays_explode": (scan_arrays_explode, "SELECT pos::INTEGER AS pos, count(x) AS n, round(avg(x::DOUBLE), 4) AS mean FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos"),
    "phys_air_and_sky": (phys_air_and_sky, "WITH b AS (SELECT event_id, value / 10e0 AS ta, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS k, greatest(0.5e0, value / 40e0 * ln(1.1e0 / 0.03e0) / ln(10e0 / 0.03e0)) AS u FROM events WHERE value IS NOT NULL), v AS (SELECT *, 6.112e0 * exp(17.62e0 * ta / (243.12e0 + ta)) * greatest(0e0, least(100e0, k)) / 100e0 AS e FROM b), w AS (SELECT *, 46.5e0 * e / (ta + 273.15e0) AS w FROM v), s AS (SELECT *, 1e0 - (1e0 + w) * exp(-sqrt(1.2e0 + 3e0 * w)) AS clear FROM w) SELECT event_id, round(e, 4) AS e, round(clear + (1e0 - clear) * k / 100e0, 4) AS sky, round(u, 4) AS wind, round(2.8e0 + 3e0 * u, 4) AS h, round(greatest(0e0, least(100e0, 100e0 * e / (6.112e0 * exp(17.62e0 * (ta - 1.5e0) / (243.12e0 + ta - 1.5e0))))), 4) AS rh, round(greatest(0e0, ta - 26e0, 9e0 - ta), 4) AS strain FROM s"),
    "phys_sun": (phys_sun, "WITH b AS (SELECT event_id, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events) SELECT event_id, round(12.5e0 * power(greatest(0e0, sin(radians(k))), 2.42e0) * (1e0 - 0.56e0 * power(greatest(0e0, least(100e0, k)) / 100e0, 3.4e0)), 3) AS uv, round(CASE WHEN k > 0 THEN 1098e0 * sin(radians(k)) * exp(-0.059e0 / sin(radians(k))) ELSE 0e0 END, 3) AS ghi FROM b"),
    "phys_ts_march": (phys_ts_march, "WITH h AS (SELECT user_id AS device, date_trunc('hour', ts) AS hh, avg(value) AS v FROM events WHERE value BETWEEN 1 AND 400 GROUP BY 1, 2), d AS (SELECT device, hh::DATE AS day, list(v ORDER BY hh) AS s FROM h GROUP BY 1, 2) SELECT device, day, round(list_reduce(s, lambda t, v: t + 3600e0 * (v - 0.95e0 * 5.670374419e-8 * power(t, 4e0) - 8e0 * (t - v / 20e0 - 283.15e0)) / (2.5e5 + 3600e0 * (4e0 * 0.95e0 * 5.670374419e-8 * power(t, 3e0) + 8e0)), 293.15e0), 3) AS ts FROM d"),
    "stream_window_mean": (stream_window_mean, "SELECT date_trunc('hour', ts) AS start, event_type, round(avg(value), 4) AS value, count(*) AS n FROM events GROUP BY 1, 2"),
}


ALL = PLANS | physics.PLANS | sensors.PLANS | routes.PLANS | spaces.PLANS | texts.PLANS | city.PLANS | checks.PLANS


def queries() -> dict:
    return {name: shared_query(name) for name in SHARED} | {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_prelude(sql, DUCK) for name, sql in SHARED.items()} | {name: sql for name, (_, sql) in ALL.items() if sql}
