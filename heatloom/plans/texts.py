"""Queries of tags, levels, opening hours and dates as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import ways
from heatloom.plans.tables import READINGS, readings, table

HOURS = [
    "24/7", "Mo-Su 07:30-15:45", "Fr-Mo 11:15-16:00; Tu-We 08:00-12:30; Th 13:00-20:00", "Tu-Sa 06:45-13:15; Th off", "Mo-Su 19:30-04:15", "We,Sa 08:20-11:40,17:05-18:55", '12:00-15:30 "ring the bell"; Mo closed',
    None, "   ", "dawn-dusk", "Tu-Th 07:00+", "Oct-Dec 08:00-12:00", "Sa 07:00-11:00 || Su 08:00-09:00", "We-Th",
]
#: The same by hand: text, first and last weekday (Monday: 1), first minute and the one after the last. Those from 7 on are unknown.
SPANS = [
    (0, 1, 7, 0, 1440), (1, 1, 7, 450, 945), (2, 5, 7, 675, 960), (2, 1, 1, 675, 960), (2, 2, 3, 480, 750), (2, 4, 4, 780, 1200), (3, 2, 3, 405, 795), (3, 5, 6, 405, 795),
    (4, 1, 7, 1170, 1440), (4, 1, 7, 0, 255), (5, 3, 3, 500, 700), (5, 3, 3, 1025, 1135), (5, 6, 6, 500, 700), (5, 6, 6, 1025, 1135), (6, 2, 7, 720, 930),
]
LEVELS = ["0", "1;2", "-1", "0;-1", "0-2", "1.5", "mezzanine", "", "3;x;-2", None]


def text_open_hours(spark, sf_dir):
    """Whether places are open at the times of the readings."""
    places = spark.createDataFrame([(i, t) for i, t in enumerate(HOURS)], "place int, text string")
    r = readings(spark, sf_dir).withColumn("place", (F.col("event_id") % len(HOURS)).cast("int"))
    out = ways.open_at(F.col("text"), F.weekday("ts"), F.hour("ts") * 60 + F.minute("ts"))
    return r.join(F.broadcast(places), "place").select("event_id", "place", out.alias("open"))


def text_levels(spark, sf_dir):
    """The levels of all ways, from their layer where they have none."""
    return tagged(spark, sf_dir).select("p_partkey", F.array_join(ways.levels(F.col("tags")), ",").alias("levels"))


def tagged(spark, sf_dir):
    """Ways with tags, from the parts."""
    k = F.col("p_partkey")
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))
    tags = {"highway": pick(["footway", "steps", "corridor", "motorway", "primary", "service", None], k), "foot": pick([None, "yes", "no"], k / 7), "access": pick([None, None, "private"], k / 21), "indoor": pick([None, "yes", None, "no"], k / 5), "tunnel": pick([None, "building_passage", None, None, None], k / 3), "level": pick([*LEVELS], k / 2), "layer": pick([None, "1", "-1"], k / 19), "covered": pick([None, "yes", None, "arcade"], k / 11), "bridge": pick([None, None, "yes"], k / 13), "step_count": pick([None, "12", "many", "-20"], k / 7), "conveying": pick([None, "no", "yes"], k / 17)}
    return table(spark, sf_dir, "part").select("p_partkey", F.create_map(*[x for n, v in tags.items() for x in (F.lit(n), v)]).alias("tags"))


def flt_ways(spark, sf_dir):
    """All predicates of a way's tags; protected: indoors or covered."""
    t = F.col("tags")
    inside, cover = ways.indoor(t), ways.covered(t)
    return tagged(spark, sf_dir).select("p_partkey", ways.walkable(t).alias("walk"), inside.alias("indoor"), cover.alias("covered"), (inside | cover).alias("protected"), ways.deck(t).alias("deck"), ways.arterial(t).alias("arterial"), ways.conveying(t).alias("conveying"), ways.step_rise(t).alias("rise"), ways.default_hours(inside, cover, F.array_min(ways.storeys(t))).alias("hours_key"))


def flt_literals(spark, sf_dir):
    """Dates and times that are written as they must be; slots of the good ones."""
    day = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise("2024-02-30")
    time = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "HH:mm")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "H.mm")).when(F.col("event_id") % 4 == 2, "24:10")
    good_day = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    good_time = F.when(time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.substring(time, 1, 2).cast("int") * 60 + F.substring(time, 4, 2).cast("int"))
    return readings(spark, sf_dir).select("event_id", good_day.alias("day"), good_time.alias("minute"))


_LEVEL_SQL = "(VALUES (0, '0'), (1, '1,2'), (2, '-1'), (3, '-1,0'), (4, '-2,0'), (5, '1'), (6, '0'), (7, '0'), (8, '-2,3'), (9, '0')) AS v(place, levels)"
PLANS = {
    "text_open_hours": (text_open_hours, f"WITH {READINGS}, s(place, d0, d1, a, b) AS (VALUES {', '.join(str(x) for x in SPANS)}), t AS (SELECT event_id, (event_id % 14)::INTEGER AS place, isodow(ts) AS d, hour(ts) * 60 + minute(ts) AS m FROM r) SELECT event_id, place, CASE WHEN place < 7 THEN EXISTS (SELECT 1 FROM s WHERE s.place = t.place AND d BETWEEN d0 AND d1 AND m >= a AND m < b) END AS open FROM t"),
    "text_levels": (text_levels, f"SELECT p_partkey, CASE WHEN place < 9 THEN levels ELSE ['0', '1', '-1'][1 + trunc(p_partkey / 19 % 3)::INTEGER] END AS levels FROM part JOIN {_LEVEL_SQL} ON place = trunc(p_partkey / 2 % 10)"),
    "flt_ways": (flt_ways, f"""WITH t AS (SELECT p_partkey, p_partkey % 7 AS hw, (p_partkey / 7 % 3)::DOUBLE AS ft, p_partkey / 21 % 3 AS ac, p_partkey / 5 % 4 AS ind, p_partkey / 3 % 5 AS tu, trunc(p_partkey / 2 % 10)::INTEGER AS lv, p_partkey / 11 % 4 AS co, p_partkey / 13 % 3 AS br, p_partkey / 7 % 4 AS sc, p_partkey / 17 % 3 AS cv FROM part),
l AS (SELECT t.*, list_transform(string_split(levels, ','), lambda x: x::INTEGER) AS s FROM t JOIN {_LEVEL_SQL} ON place = lv),
b AS (SELECT *, trunc(ind) = 1 OR hw = 2 OR trunc(tu) = 1 AS inside, trunc(co) IN (1, 3) OR list_min(s) < 0 AS cover FROM l)
SELECT p_partkey, hw IN (0, 1, 2, 4, 5) AND trunc(ft) <> 2 AND trunc(ac) <> 2 AS walk, inside AS indoor, cover AS covered, inside OR cover AS protected, (trunc(br) = 2 OR list_max(s) > 0) AND NOT inside AS deck, hw = 4 AS arterial, trunc(cv) = 2 AS conveying,
 CASE WHEN hw = 1 THEN CASE trunc(sc)::INTEGER WHEN 1 THEN 12 * 0.17e0 WHEN 3 THEN 20 * 0.17e0 ELSE CASE WHEN list_max(s) > list_min(s) THEN 4 * (list_max(s) - list_min(s)) ELSE 4 END END END AS rise,
 CASE WHEN inside THEN 'indoor' WHEN cover AND list_min(s) < 0 THEN 'subway' END AS hours_key FROM b"""),
    "flt_literals": (flt_literals, f"WITH {READINGS} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts::DATE END AS day, CASE WHEN event_id % 4 = 0 THEN (hour(ts) * 60 + minute(ts))::INTEGER END AS minute FROM r"),
}
