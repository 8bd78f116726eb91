"""Queries that check sources against each other and against theory, label what decided, and snap places."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import comfort, earth
from heatloom.operators import pairs
from heatloom.plans import physics
from heatloom.plans.city import BLOCK, ROW, STREETS, crossings, streets
from heatloom.plans.sensors import PLACE, TRAIN_END
from heatloom.plans.tables import PAIRED, READINGS, paired, readings, table


def radiation(spark, sf_dir):
    """Hourly light of two sources (even and odd devices): ghi, dif, dir (W/m2), with the sun half an hour before the stamp."""
    r = readings(spark, sf_dir).where("value IS NOT NULL")
    source = F.when(F.col("device") % 2 == 0, "sat").otherwise("era").alias("source")
    h = r.groupBy(source, "hh").agg((F.avg("value") * 4).alias("ghi"), (F.avg(F.col("value") * F.col("k")) / 30).alias("dif"))
    mid = F.col("hh").cast("timestamp") - F.expr("INTERVAL '30' MINUTE")
    elev = earth.sun_position(mid, *PLACE)[1]
    return h.withColumn("dir", F.col("ghi") - 0.98 * F.col("dif")).withColumn("elev", elev).withColumn("outside", comfort.extraterrestrial(F.dayofyear(mid), F.col("elev")))


def agg_radiation_checks(spark, sf_dir):
    """For each source: whether beam and diffuse light make up the global; how far the diffuse light is from what the clearness lets expect;
    and its diffuse share in the hours that the source itself calls clear (within a quarter of the clear-sky value)."""
    r = radiation(spark, sf_dir)
    gap = F.col("dir") + F.col("dif") - F.col("ghi")
    one = r.where("elev > 5").groupBy("source").agg(F.lit("consistency").alias("test"), F.count("*").alias("n"), F.avg(gap).alias("a"), F.max(F.abs(gap)).alias("b"), F.lit(None).cast("double").alias("c"))
    k = r.where("elev >= 15 and outside > 0").withColumn("kt", F.least(F.lit(1.2), F.greatest(F.lit(0.0), F.col("ghi") / F.col("outside"))))
    off = F.col("dif") - F.col("ghi") * comfort.diffuse_share(F.col("kt"))
    two = k.groupBy("source").agg(F.lit("clearness").alias("test"), F.count("*").alias("n"), F.avg("kt").alias("a"), F.sqrt(F.avg(off * off)).alias("b"), F.avg(off).alias("c"))
    clear = comfort.ghi_clear(F.col("elev"))
    own = r.where("elev >= 25 and ghi > 0").where(F.abs(F.col("ghi") / clear - 1) <= 0.25)
    three = own.groupBy("source").agg(F.lit("own clear hours").alias("test"), F.count("*").alias("n"), (100 * F.avg(F.col("dif") / F.col("ghi"))).alias("a"), (100 * F.avg(comfort.diffuse_share(clear / F.col("outside")))).alias("b"), F.lit(None).cast("double").alias("c"))
    return one.unionByName(two).unionByName(three)


def agg_staleness(spark, sf_dir):
    """How stale the model series may be: errors of its value now and an hour ago against each device, levels fitted on the first days,
    over all test hours and the warm ones."""
    p = paired(spark, sf_dir)
    ago = p.select("hh", "mod").distinct().select((F.col("hh") + F.expr("INTERVAL '1' HOUR")).alias("hh"), F.col("mod").alias("ago"))
    j = p.join(ago, "hh").select("hh", "obs", F.explode(F.array(F.struct(F.lit(0).alias("lag"), F.col("mod").alias("v")), F.struct(F.lit(1).alias("lag"), F.col("ago").alias("v")))).alias("m")).select("hh", "obs", "m.lag", "m.v")
    train = F.col("hh") < F.lit(f"{TRAIN_END} 00:00:00").cast("timestamp_ntz")
    level = j.where(train).groupBy("lag").agg(F.avg(F.col("v") - F.col("obs")).alias("level"))
    groups = F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("obs") >= 200, "from 200"), F.when(F.col("obs") >= 300, "from 300")), lambda g: g.isNotNull())).alias("hours")
    t = j.where(~train).join(F.broadcast(level), "lag").select("lag", (F.col("v") - F.col("level") - F.col("obs")).alias("e"), groups)  # two rows
    return t.groupBy("hours", "lag").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"))


def phys_uv_source(spark, sf_dir):
    """The UV index of each reading and where it comes from: measured in the current slot, a feed, or the sun's height."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").withColumn("k", k)
    slot = F.hour("ts") * 60 + F.floor(F.minute("ts") / 30) * 30
    feed, sun = F.when(F.col("event_id") % 3 == 0, F.col("k") / 10), F.when(F.col("event_id") % 5 != 0, F.col("k") / 2)
    out = comfort.uv_index_for(slot, F.lit(810), F.when(F.col("event_id") % 2 == 0, F.round(F.col("k") / 9, 2)), F.date_format("ts", "HH:mm"), feed, F.col("k"), sun)
    return e.select("event_id", out["index"].alias("index"), out["source"].alias("source"))


def phys_sky_reason(spark, sf_dir):
    """What decided the state of the sky at each reading."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("k", k)
    rain, sun = F.when(F.col("event_id") % 9 == 0, F.col("k") / 50), F.when(F.col("event_id") % 7 != 0, F.col("k") / 2 - 2)
    args = (F.col("value"), F.col("k"), rain, sun, F.lit(None).cast("double"))
    return e.select("event_id", comfort.sky_condition(*args).alias("sky"), comfort.sky_reason(*args).alias("why"))


def phys_explicit_step(spark, sf_dir):
    """The longest explicit step of surfaces by their heat content, and whether an hour would be stable."""
    p = table(spark, sf_dir, "part")
    heat, t = 1e4 * (1 + F.col("p_partkey") % 30), 280.0 + F.col("p_size")
    dt = comfort.explicit_step(heat, F.lit(0.95), 5.0 + F.col("p_partkey") % 7, t, F.lit(1.5))
    return p.select("p_partkey", dt.alias("dt"), (dt >= 3600).alias("hour_is_stable"))


def phys_ladder(spark, sf_dir):
    """The preferences that each customer's options span."""
    c = table(spark, sf_dir, "customer")
    rungs = comfort.preference_ladder([0.0, 0.03, 0.1, 0.3], F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 3 == 0))
    return c.select("c_custkey", F.posexplode(rungs).alias("rung", "k"))


def graph_snap_main(spark, sf_dir):
    """Places at the nearest crossing of the largest part of the streets while those between columns 14 and 15 are closed."""
    e = streets(spark, sf_dir).withColumn("hours_key", F.when((F.col("b") == F.col("a") + 1) & (F.col("a") % ROW == 14), "mall").otherwise("street"))
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 2100 + 0.25).alias("x"), (k * 53 % 3000 + 0.5).alias("y"))
    closed = spark.createDataFrame([("mall",)], "hours_key string")
    return pairs.snap_to_main(p, crossings(spark, sf_dir), e, closed, 300.0, (0.0, 0.0), 2500.0)


MIDS = physics.PLANS["phys_sun_position"][1].replace("FROM events)", "FROM mids)")
ERBS = "CASE WHEN {k} <= 0.22 THEN 1 - 0.09e0 * {k} WHEN {k} <= 0.8 THEN 0.9511e0 - 0.1604e0 * {k} + 4.388e0 * {k} ** 2 - 16.638e0 * {k} ** 3 + 12.336e0 * {k} ** 4 ELSE 0.165e0 END"
CLEAR = "(1098 * sin(radians(elev)) * exp(-0.059e0 / sin(radians(elev))))"
PLANS = {
    "agg_radiation_checks": (agg_radiation_checks, f"""WITH {READINGS}, h AS (SELECT CASE WHEN device % 2 = 0 THEN 'sat' ELSE 'era' END AS source, hh, avg(value) * 4 AS ghi, avg(value * k) / 30 AS dif FROM r WHERE value IS NOT NULL GROUP BY 1, 2),
mids AS (SELECT DISTINCT epoch_us(hh) AS event_id, hh - INTERVAL 30 MINUTE AS ts FROM h), sun AS ({MIDS}),
x AS (SELECT h.*, ghi - 0.98e0 * dif AS dir, elevation AS elev, greatest(0, 1366.1e0 * (1 + 0.033e0 * cos(2 * pi() * dayofyear(hh - INTERVAL 30 MINUTE) / 365e0)) * sin(radians(elevation))) AS outside FROM h JOIN sun ON event_id = epoch_us(hh)),
k AS (SELECT *, least(1.2, greatest(0, ghi / outside)) AS kt FROM x WHERE elev >= 15 AND outside > 0), d AS (SELECT *, dif - ghi * ({ERBS.format(k='kt')}) AS off FROM k)
SELECT source, 'consistency' AS test, count(*) AS n, avg(dir + dif - ghi) AS a, max(abs(dir + dif - ghi)) AS b, NULL::DOUBLE AS c FROM x WHERE elev > 5 GROUP BY 1
UNION ALL SELECT source, 'clearness', count(*), avg(kt), sqrt(avg(off ** 2)), avg(off) FROM d GROUP BY 1
UNION ALL SELECT source, 'own clear hours', count(*), 100 * avg(dif / ghi), 100 * avg({ERBS.format(k='(' + CLEAR + ' / outside)')}), NULL FROM x WHERE elev >= 25 AND ghi > 0 AND abs(ghi / {CLEAR} - 1) <= 0.25 GROUP BY 1"""),
    "agg_staleness": (agg_staleness, f"""WITH {PAIRED}, m2 AS (SELECT DISTINCT hh, mod FROM p), j AS (SELECT p.hh, p.obs, 0 AS lag, p.mod AS v FROM p JOIN m2 ON m2.hh = p.hh - INTERVAL 1 HOUR UNION ALL SELECT p.hh, p.obs, 1, m2.mod FROM p JOIN m2 ON m2.hh = p.hh - INTERVAL 1 HOUR),
l AS (SELECT lag, avg(v - obs) AS level FROM j WHERE hh < TIMESTAMP '{TRAIN_END}' GROUP BY 1), t AS (SELECT obs, lag, v - level - obs AS e FROM j JOIN l USING (lag) WHERE hh >= TIMESTAMP '{TRAIN_END}'),
g AS (SELECT 'all' AS hours, lag, e FROM t UNION ALL SELECT 'from 200', lag, e FROM t WHERE obs >= 200 UNION ALL SELECT 'from 300', lag, e FROM t WHERE obs >= 300)
SELECT hours, lag, count(*) AS n, sqrt(avg(e ** 2)) AS rmse, avg(abs(e)) AS mae, avg(e) AS bias FROM g GROUP BY 1, 2"""),
    "phys_uv_source": (phys_uv_source, """WITH e AS (SELECT event_id, ts, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS k, hour(ts) * 60 + minute(ts) // 30 * 30 AS slot FROM events), c AS (SELECT *, 1 - 0.56e0 * power(least(100, greatest(0, k)) / 100, 3.4e0) AS under, ' x cloud (' || round_even(k, 0)::INTEGER || '%)' AS label FROM e)
SELECT event_id, CASE WHEN slot = 810 AND event_id % 2 = 0 THEN round(k / 9, 2) WHEN event_id % 3 = 0 THEN round(greatest(0, k / 10 * under), 1) WHEN event_id % 5 <> 0 THEN round(greatest(0, 12.5e0 * power(greatest(0, sin(radians(k / 2))), 2.42e0) * under), 1) END AS index,
 CASE WHEN slot = 810 AND event_id % 2 = 0 THEN 'station measured ' || strftime(ts, '%H:%M') WHEN event_id % 3 = 0 THEN 'feed clear-sky' || label WHEN event_id % 5 <> 0 THEN 'modelled clear-sky at ' || round_even(k / 2, 0)::INTEGER || ' deg elevation' || label ELSE 'no index in the feed and no measurement' END AS source FROM c"""),
    "phys_sky_reason": (phys_sky_reason, """WITH e AS (SELECT event_id, value, CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE value IS NOT NULL), s AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN k / 50 ELSE 0 END AS rain, CASE WHEN event_id % 7 <> 0 THEN k / 2 - 2 END AS el FROM e),
b AS (SELECT *, CASE WHEN el > 0 THEN 1367 * power(0.7e0, power(1 / (sin(radians(el)) + 0.50572e0 * power(el + 6.07995e0, -1.6364e0)), 0.678e0)) * sin(radians(el)) ELSE 0 END AS clear FROM s), x AS (SELECT *, CASE WHEN clear >= 10 THEN greatest(0, value) / clear END AS kb, CASE WHEN k >= 60 THEN 'cloudy' ELSE 'partly_cloudy' END AS by_cloud FROM b)
SELECT event_id, CASE WHEN rain >= 0.5 THEN 'rain' WHEN rain > 0 THEN 'drizzle' WHEN el IS NULL THEN by_cloud WHEN el <= 5 THEN 'night' WHEN kb IS NULL THEN by_cloud WHEN kb >= 0.5 THEN 'sunny' WHEN kb >= 0.15 THEN 'partly_cloudy' ELSE 'cloudy' END AS sky,
 CASE WHEN rain > 0 THEN 'precipitation ' || printf('%.1f', rain + 1e-9) || ' mm' WHEN el IS NULL THEN 'cloud cover ' || round_even(k, 0)::INTEGER || '% (no sun position)' WHEN el <= 5 THEN 'sun ' || printf('%.1f', el) || ' deg -- below 5' WHEN kb IS NULL THEN 'cloud cover ' || round_even(k, 0)::INTEGER || '% (sun too low to read the beam)' ELSE 'beam ' || printf('%.2f', kb) || ' of clear-sky' END AS why FROM x"""),
    "phys_explicit_step": (phys_explicit_step, "WITH d AS (SELECT p_partkey, 2 * 1e4 * (1 + p_partkey % 30) / (5 + p_partkey % 7 + 1.5e0 + 4 * 0.95e0 * 5.670374419e-8 * power(280e0 + p_size, 3)) AS dt FROM part) SELECT p_partkey, dt, dt >= 3600 AS hour_is_stable FROM d"),
    "phys_ladder": (phys_ladder, "WITH f AS (SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN 1.8e0 ELSE 1 END * CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 = 0 THEN 1.8e0 ELSE 1 END, 4) AS f FROM customer) SELECT c_custkey, rung::INTEGER AS rung, round(k * f, 4) AS k FROM f, (VALUES (0, 0e0), (1, 0.03e0), (2, 0.1e0), (3, 0.3e0)) AS l(rung, k)"),
    "graph_snap_main": (graph_snap_main, f"""WITH RECURSIVE {STREETS}, w AS (SELECT a, b FROM u WHERE NOT (abs(a - b) = 1 AND least(a, b) % {ROW} = 14)), t(node, root) USING KEY (node) AS (SELECT a, a FROM s0 UNION SELECT * FROM (SELECT w.b AS node, min(t.root) AS root FROM t JOIN w ON w.a = t.node JOIN recurring.t AS r ON r.node = w.b WHERE t.root < r.root GROUP BY w.b)),
m AS (SELECT node FROM t WHERE root = (SELECT root FROM t GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)), c AS (SELECT node, node % {ROW} * {BLOCK} AS x, node // {ROW} * {BLOCK} AS y FROM m),
p AS (SELECT s_suppkey AS id, s_suppkey * 37 % 2100 + 0.25e0 AS x, s_suppkey * 53 % 3000 + 0.5e0 AS y FROM supplier), n AS (SELECT p.id, c.node, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS d FROM p, c QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.x - c.x) ** 2 + (p.y - c.y) ** 2, c.node) = 1)
SELECT p.*, CASE WHEN d <= 300 THEN node END AS node, CASE WHEN d <= 300 THEN d END AS d, CASE WHEN sqrt(x * x + y * y) <= 2500 THEN sqrt(x * x + y * y) END AS from_origin FROM p JOIN n USING (id)"""),
}
