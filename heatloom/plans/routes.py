"""Queries of routes, their legs and options: sums, doses, runs, badges, merges, sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import comfort
from heatloom.operators.skyline import pareto
from heatloom.plans.tables import LEGS, OPTIONS, dealt, legs, options, table

#: Walking speed (m/s), metres for a door, weight of stress: fixed values.
SPEED, DOOR, K = 1.35, 45.0, 0.10
ORDER = ("seq", "part", "price")


def win_run_length(spark, sf_dir):
    """Runs of legs of one state on each route: a run begins where the state is not that of the leg before."""
    line = table(spark, sf_dir, "lineitem")
    l = line.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("state"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"))
    w = Window.partitionBy("route").orderBy("seq", "part", "price")
    l = dealt(l, line.count(), "route").withColumn("begins", (~F.col("state").eqNullSafe(F.lag("state").over(w))).cast("int"))
    runs = l.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("route", "state", "run").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("legs")).drop("run")


def rise():
    return F.when(F.col("tax") > 0.02, F.col("tax") * 100)


def minutes():
    return comfort.equivalent_length(F.col("len"), rise(), F.col("conveying")) / SPEED / 60


def in_order(*keys):
    return Window.partitionBy(*keys).orderBy(*ORDER)


def agg_route_full(spark, sf_dir):
    """Distance, sun and indoor metres, climb, minutes, heat load, shares, doors and weighted minutes of each route."""
    l = legs(spark, sf_dir).withColumn("turn", (F.lag("indoor").over(in_order("route")) != F.col("indoor")).cast("int"))
    open_ = ~F.col("indoor")
    strain = comfort.stress(F.col("utci"))
    s = l.groupBy("route").agg(
        F.sum("len").alias("metres"), F.sum(F.when(open_, F.col("len") * (1 - F.col("shade"))).otherwise(0.0)).alias("sun"), F.sum(F.when(F.col("indoor"), F.col("len")).otherwise(0.0)).alias("inside"),
        F.sum(F.when(~F.col("conveying"), F.coalesce(rise(), F.lit(0.0))).otherwise(0.0)).alias("climb"), F.sum(minutes()).alias("minutes"), F.sum(minutes() * strain).alias("load"), F.coalesce(F.sum("turn"), F.lit(0)).alias("doors"),
    )
    return s.select("*", (100 * F.col("sun") / F.col("metres")).alias("sun_pct"), (F.col("minutes") + K * F.col("load") + F.col("doors") * DOOR / (60 * SPEED)).alias("weighted"))


def agg_thermal_dose(spark, sf_dir):
    """Heat and cold dose, exposed metres, peak and mean of the outdoor legs; null where no leg has a stress."""
    u = F.when(F.col("part") % 11 != 0, F.col("utci"))
    dose, out = minutes() * comfort.stress(u), ~F.col("indoor")
    some = F.count(u) > 0
    return legs(spark, sf_dir).groupBy("route").agg(
        F.when(some, F.coalesce(F.sum(F.when(u > 26, dose)), F.lit(0.0))).alias("heat"), F.when(some, F.coalesce(F.sum(F.when(u <= 26, dose)), F.lit(0.0))).alias("cold"),
        F.when(some, F.coalesce(F.sum(F.when(comfort.stress(u) > 0, F.col("len"))), F.lit(0.0))).alias("exposed"), F.max(u).alias("peak"),
        F.try_divide(F.sum(F.when(out & u.isNotNull(), u * F.col("len"))), F.sum(F.when(out & u.isNotNull(), F.col("len")))).alias("mean"),
    )


def agg_uv_dose(spark, sf_dir):
    part = F.when(F.col("indoor"), 0.0).otherwise(1 - F.col("shade"))
    return legs(spark, sf_dir).groupBy("route").agg(F.sum(8.0 * part * minutes()).alias("dose"), F.coalesce(F.sum(F.when(part > 0.5, minutes())), F.lit(0.0)).alias("exposed"), F.try_divide(F.sum(part * F.col("len")), F.sum("len")).alias("mean"), F.max(part).alias("peak"), comfort.sed(F.sum(8.0 * part * minutes())).alias("sed"))


def agg_known_means(spark, sf_dir):
    """Means over a route by length; unknown as soon as one leg lacks the value."""
    v = F.when(F.col("tax") > 0, F.col("utci"))
    return legs(spark, sf_dir).groupBy("route").agg(F.when(F.bool_and(v.isNotNull()), F.sum(v * F.col("len")) / F.sum("len")).alias("utci"), (F.sum(F.col("shade") * F.col("len")) / F.sum("len")).alias("shade"), F.bool_or(v.isNull()).alias("gap"))


def agg_delta_pct(spark, sf_dir):
    """What each option spares against the quickest of its pair; no share of next to nothing."""
    o = options(spark, sf_dir)
    base = o.groupBy("od").agg(F.min(F.struct("minutes", "load", "route")).alias("b")).select("od", F.col("b.minutes").alias("m"), F.col("b.load").alias("l"))
    o = o.join(base, "od")
    return o.select("route", "od", (F.col("minutes") - F.col("m")).alias("extra"), (F.col("l") - F.col("load")).alias("avoided"), F.when(F.col("l") > 0.01, 100 * (F.col("l") - F.col("load")) / F.col("l")).alias("pct"))


def agg_outdoor_mean(spark, sf_dir):
    """Mean of the outdoor legs by position, of all legs where none is outdoors: what walls face."""
    return legs(spark, sf_dir).groupBy("seq").agg(F.coalesce(F.avg(F.when(~F.col("indoor"), F.col("utci"))), F.avg("utci")).alias("around"), F.count(F.lit(1)).alias("n"))


def agg_signature(spark, sf_dir):
    """Twelve digits of a digest of a route's legs, in their order."""
    own = F.concat_ws(":", "seq", "part")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, own.alias("own")))), lambda x: x["own"])
    return legs(spark, sf_dir).groupBy("route").agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 12).alias("signature"))


def runs(spark, sf_dir):
    """Runs of legs in one state."""
    l = legs(spark, sf_dir).withColumn("new", F.coalesce((F.lag("indoor").over(in_order("route")) != F.col("indoor")).cast("int"), F.lit(1)))
    l = l.withColumn("run", F.sum("new").over(in_order("route").rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER))), lambda x: x["part"])
    return l.groupBy("route", "run", "indoor").agg(F.sum("len").alias("len"), (F.sum(F.col("shade") * F.col("len")) / F.sum("len")).alias("shade"), F.array_join(parts, ",").alias("path"))


def win_segments(spark, sf_dir):
    """Runs with their length, mean shade, legs in order, share of the route and exposure class."""
    kind = F.when(F.col("indoor"), "indoor").when(F.col("shade") >= 0.5, "shade").otherwise("sun")
    return runs(spark, sf_dir).withColumn("share", F.col("len") / F.sum("len").over(Window.partitionBy("route"))).withColumn("kind", kind)


def agg_dodges(spark, sf_dir):
    """Short indoor runs (a dodge: under 50) and long ones (a leg of the walk: from 150), the longest and the middle one of each route."""
    r = runs(spark, sf_dir).where("indoor").groupBy("route").agg(F.count_if(F.col("len") < 50).alias("dodges"), F.count_if(F.col("len") >= 150).alias("legs"), F.max("len").alias("longest"), F.median("len").alias("middle"))
    return r


def chosen(spark, sf_dir):
    """The best option of each pair under each of four preferences."""
    best = lambda k: F.min(F.struct((F.col("minutes") + k * F.col("load")).alias("cost"), "route", "minutes", "load"))
    # all preferences in one pass: a row of an option for each of them would be sorted
    rungs = F.array(*[F.struct(F.lit(k).alias("k"), best(F.lit(k)).alias("b")) for k in (0.0, 0.03, 0.10, 0.30)])
    c = options(spark, sf_dir).groupBy("od").agg(rungs.alias("c")).select("od", F.explode("c").alias("c"))
    return c.select("od", "c.k", "c.b.route", "c.b.minutes", "c.b.load")


def agg_ladder_steps(spark, sf_dir):
    """Means over all pairs for each preference, and the step from the one before."""
    s = chosen(spark, sf_dir).groupBy("k").agg(F.avg("load").alias("load"), F.avg("minutes").alias("minutes"), F.count(F.lit(1)).alias("pairs"))
    return s.withColumn("step", F.col("load") - F.lag("load").over(Window.orderBy("k")))  # one row for each preference


def win_plateau(spark, sf_dir):
    """The first preference that leads to the route that the strongest one leads to."""
    c = chosen(spark, sf_dir)
    last = c.groupBy("od").agg(F.max_by("route", "k").alias("route"))
    return c.join(last, ["od", "route"]).groupBy("od").agg(F.min("k").alias("k"), F.first("route").alias("route"))


def agg_census_area(spark, sf_dir):
    p = table(spark, sf_dir, "part").rollup("p_type", "p_brand").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("area"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("area"), "p_type", "p_brand")))


def agg_coverage(spark, sf_dir):
    """Legs as sample points of a route: share that is covered, any, most; then over core routes and the rest."""
    hit = (F.col("shade") >= 0.5).cast("double")
    edge = legs(spark, sf_dir).groupBy("route").agg(F.avg(hit).alias("share"))
    core = (F.col("route") % 10 == 0).alias("core")
    return edge.groupBy(core).agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("points"), F.avg((F.col("share") > 0).cast("double")).alias("any"), F.avg((F.col("share") >= 0.5).cast("double")).alias("most"))


def set_pareto(spark, sf_dir):
    return pareto(options(spark, sf_dir), "od", "minutes", "load").select("od", "route")


def rank_badges(spark, sf_dir):
    """Names of an option: coolest of its pair, least sun where that differs by over two, shortest; none where it is alone."""
    w = Window.partitionBy("od")
    o = options(spark, sf_dir).withColumn("uv", F.col("load") * 2)
    first = lambda *c: F.min(F.struct(*c, "route")).over(w)["route"] == F.col("route")
    gate = (F.max("uv").over(w) - F.min("uv").over(w) > 2) & (F.col("uv") > 0)
    names = F.array(F.when(first("load", "minutes"), "Coolest"), F.when(first("uv", "minutes") & gate, "Least UV"), F.when(first("minutes", "load"), "Shortest"))
    labels = F.when(F.count(F.lit(1)).over(w) > 1, F.filter(names, lambda n: n.isNotNull())).otherwise(F.array().cast("array<string>"))
    return o.select("od", "route", F.array_join(labels, ", ").alias("labels"))


def rank_by_distance(spark, sf_dir):
    """Ten nearest places of an origin, nearest first, no farther than 60."""
    s = table(spark, sf_dir, "supplier")
    x, y = F.col("s_suppkey") * 37 % 101, F.col("s_suppkey") * 53 % 97
    d = F.sqrt(F.pow(x - 50.0, F.lit(2.0)) + F.pow(y - 50.0, F.lit(2.0)))
    near = s.select("s_suppkey", d.alias("d")).where("d <= 60").orderBy("d", "s_suppkey").limit(10)
    return near.withColumn("place", F.row_number().over(Window.orderBy("d", "s_suppkey")))  # ten rows


def rank_most_common(spark, sf_dir):
    """The twelve most common labels."""
    word = F.explode(F.split("p_name", " ")).alias("word")
    return table(spark, sf_dir, "part").select(word).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(12)


def rank_greedy_merge(spark, sf_dir):
    """Options in the order of load and minutes; one that is the same walk as one kept before it (a minute, five of load, two of UV) is
    absorbed by the first such, whose place the quicker of the two takes. An origin's options are a few."""
    o = options(spark, sf_dir).groupBy("od").agg(F.array_sort(F.collect_list(F.struct("load", "minutes", "route"))).alias("all"))
    same = lambda a, b: (F.abs(a["minutes"] - b["minutes"]) <= 1) & (F.abs(a["load"] - b["load"]) <= 5) & (F.abs(0.6 * (a["load"] - b["load"])) <= 2)
    none = F.array().cast(o.schema["all"].dataType)

    def absorb(held, x):
        at = F.array_position(F.transform(held, lambda y: same(x, y)), F.lit(True))
        swapped = F.transform(held, lambda y, i: F.when((i + 1 == at) & (x["minutes"] < y["minutes"]), x).otherwise(y))
        return F.when(at > 0, swapped).otherwise(F.array_append(held, x))

    return o.select("od", F.posexplode(F.aggregate("all", none, absorb)).alias("place", "x")).select("od", F.col("x.route").alias("route"), "place")


def set_paths_reached(spark, sf_dir):
    """Distinct walks of a pair: the first route, and all that lead to it."""
    o = options(spark, sf_dir)
    return o.groupBy("od", "minutes", "load").agg(F.min("route").alias("route"), F.array_join(F.array_sort(F.collect_list("route")), ",").alias("reached"))


def set_rendered_first(spark, sf_dir):
    """The first place of each rendered name and brand."""
    name = F.lower(F.trim(F.regexp_replace("p_name", r"\s+", " ")))
    return table(spark, sf_dir, "part").groupBy(name.alias("name"), F.lower("p_brand").alias("brand")).agg(F.min("p_partkey").alias("p_partkey")).where(F.length("name") >= 2)


def set_joined_context(spark, sf_dir):
    """Distinct parts of an address in order, blanks left out; nothing where none is left."""
    parts = F.array("p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, F.col("p_type")), F.lit(""))
    text = F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull() & (x != ""))), ", ")
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(text, F.lit("")).alias("context"))


def cl_arrival(spark, sf_dir):
    """Arrival of an option that starts on its day at nine, and how its length is shown."""
    o, d = options(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), "o_orderdate")
    m = F.floor(F.col("minutes") + 0.5).cast("int")
    at = F.expr("o_orderdate + INTERVAL '9' HOUR + make_dt_interval(0, 0, CAST(floor(minutes + 0.5) AS INT))")
    text = F.when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")))
    return o.join(d, "route").select("route", at.alias("arrival"), text.alias("shown"))


MIN = "(len + CASE WHEN conveying OR NOT tax > 0.02 THEN 0 ELSE 300 * tax END) / 1.35e0 / 60"
RUNS = LEGS + ", a AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY seq, part, price) - row_number() OVER (PARTITION BY route, indoor ORDER BY seq, part, price) AS g FROM l), q AS (SELECT route, indoor, g, min((seq, part, price)) AS first_leg, sum(len) AS len, sum(shade * len) / sum(len) AS shade, string_agg(part::VARCHAR, ',' ORDER BY seq, part, price) AS path FROM a GROUP BY 1, 2, 3), u AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY first_leg) AS run, indoor, len, shade, path FROM q)"
CHOSEN = OPTIONS + ", c AS (SELECT od, k, route, minutes, load FROM (SELECT o.*, k, row_number() OVER (PARTITION BY od, k ORDER BY minutes + k * load, route) AS i FROM o, (SELECT unnest([0e0, 0.03e0, 0.1e0, 0.3e0]) AS k)) WHERE i = 1)"
PLANS = {
    "win_run_length": (win_run_length, None),  # its SQL is in shared
    "agg_route_full": (agg_route_full, f"WITH {LEGS}, d AS (SELECT *, lag(indoor) OVER (PARTITION BY route ORDER BY seq, part, price) AS was FROM l), s AS (SELECT route, sum(len) AS metres, sum(CASE WHEN indoor THEN 0 ELSE len * (1 - shade) END) AS sun, sum(CASE WHEN indoor THEN len ELSE 0 END) AS inside, sum(CASE WHEN conveying OR NOT tax > 0.02 THEN 0 ELSE tax * 100 END) AS climb, sum({MIN}) AS minutes, sum({MIN} * greatest(0, utci - 26, 9 - utci)) AS load, count(*) FILTER (was <> indoor) AS doors FROM d GROUP BY 1) SELECT *, 100 * sun / metres AS sun_pct, minutes + 0.1e0 * load + doors * 45 / 81e0 AS weighted FROM s"),
    "agg_thermal_dose": (agg_thermal_dose, f"WITH {LEGS}, d AS (SELECT *, CASE WHEN part % 11 <> 0 THEN utci END AS u, {MIN} AS m FROM l) SELECT route, CASE WHEN count(u) > 0 THEN coalesce(sum((u - 26) * m) FILTER (u > 26), 0) END AS heat, CASE WHEN count(u) > 0 THEN coalesce(sum((9 - u) * m) FILTER (u < 9), 0) END AS cold, CASE WHEN count(u) > 0 THEN coalesce(sum(len) FILTER (u < 9 OR u > 26), 0) END AS exposed, max(u) AS peak, sum(u * len) FILTER (NOT indoor) / sum(len) FILTER (NOT indoor AND u IS NOT NULL) AS mean FROM d GROUP BY 1"),
    "agg_uv_dose": (agg_uv_dose, f"WITH {LEGS}, d AS (SELECT *, CASE WHEN indoor THEN 0 ELSE 1 - shade END AS f, {MIN} AS m FROM l) SELECT route, sum(8 * f * m) AS dose, coalesce(sum(m) FILTER (f > 0.5), 0) AS exposed, sum(f * len) / sum(len) AS mean, max(f) AS peak, 0.12e0 * sum(f * m) AS sed FROM d GROUP BY 1"),
    "agg_known_means": (agg_known_means, f"WITH {LEGS} SELECT route, CASE WHEN min(tax) > 0 THEN sum(utci * len) / sum(len) END AS utci, sum(shade * len) / sum(len) AS shade, NOT min(tax) > 0 AS gap FROM l GROUP BY 1"),
    "agg_delta_pct": (agg_delta_pct, f"WITH {OPTIONS}, b AS (SELECT DISTINCT ON (od) od, minutes AS m, load AS l FROM o ORDER BY od, minutes, load, route) SELECT route, od, minutes - m AS extra, l - load AS avoided, CASE WHEN l > 0.01 THEN 100 * (l - load) / l END AS pct FROM o JOIN b USING (od)"),
    "agg_outdoor_mean": (agg_outdoor_mean, f"WITH {LEGS} SELECT seq, coalesce(avg(utci) FILTER (NOT indoor), avg(utci)) AS around, count(*) AS n FROM l GROUP BY 1"),
    "agg_signature": (agg_signature, f"WITH {LEGS} SELECT route, left(sha256(string_agg(seq || ':' || part, '|' ORDER BY seq, part, price)), 12) AS signature FROM l GROUP BY 1"),
    "win_segments": (win_segments, f"WITH {RUNS} SELECT route, run, indoor, len, shade, path, len / sum(len) OVER (PARTITION BY route) AS share, CASE WHEN indoor THEN 'indoor' WHEN shade >= 0.5 THEN 'shade' ELSE 'sun' END AS kind FROM u"),
    "agg_dodges": (agg_dodges, f"WITH {RUNS} SELECT route, count(*) FILTER (len < 50) AS dodges, count(*) FILTER (len >= 150) AS legs, max(len) AS longest, median(len) AS middle FROM u WHERE indoor GROUP BY 1"),
    "agg_ladder_steps": (agg_ladder_steps, f"WITH {CHOSEN}, s AS (SELECT k, avg(load) AS load, avg(minutes) AS minutes, count(*) AS pairs FROM c GROUP BY 1) SELECT a.*, a.load - b.load AS step FROM s a LEFT JOIN s b ON b.k = (SELECT max(k) FROM s z WHERE z.k < a.k)"),
    "win_plateau": (win_plateau, f"WITH {CHOSEN} SELECT a.od, min(b.k) AS k, a.route FROM c a JOIN c b ON b.od = a.od AND b.route = a.route WHERE a.k = 0.3e0 GROUP BY a.od, a.route"),
    "agg_census_area": (agg_census_area, "WITH s AS (SELECT p_type, p_brand, 0::BIGINT AS g, count(*) AS n, sum(p_size)::BIGINT AS area FROM part GROUP BY 1, 2 UNION ALL SELECT p_type, NULL, 1, count(*), sum(p_size)::BIGINT FROM part GROUP BY 1 UNION ALL SELECT NULL, NULL, 3, count(*), sum(p_size)::BIGINT FROM part) SELECT *, row_number() OVER (PARTITION BY g ORDER BY area DESC, p_type, p_brand)::INTEGER AS place FROM s"),
    "agg_coverage": (agg_coverage, f"WITH {LEGS}, e AS (SELECT route, count(*) FILTER (shade >= 0.5) / count(*) AS f FROM l GROUP BY 1) SELECT route % 10 = 0 AS core, count(*) AS n, avg(f) AS points, count(*) FILTER (f > 0) / count(*) AS any, count(*) FILTER (f >= 0.5) / count(*) AS most FROM e GROUP BY 1"),
    "set_pareto": (set_pareto, f"WITH {OPTIONS} SELECT a.od, a.route FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.od = a.od AND b.minutes <= a.minutes AND b.load <= a.load AND (b.minutes < a.minutes OR b.load < a.load))"),
    "rank_badges": (rank_badges, f"WITH {OPTIONS}, w AS (SELECT *, count(*) OVER (PARTITION BY od) AS n, row_number() OVER (PARTITION BY od ORDER BY load, minutes, route) = 1 AS c, row_number() OVER (PARTITION BY od ORDER BY minutes, load, route) = 1 AS s, 2 * (max(load) OVER (PARTITION BY od) - min(load) OVER (PARTITION BY od)) > 2 AND load > 0 AS gate FROM o) SELECT od, route, CASE WHEN n > 1 THEN concat_ws(', ', CASE WHEN c THEN 'Coolest' END, CASE WHEN c AND gate THEN 'Least UV' END, CASE WHEN s THEN 'Shortest' END) ELSE '' END AS labels FROM w"),
    "rank_by_distance": (rank_by_distance, "WITH d AS (SELECT s_suppkey, sqrt((s_suppkey * 37 % 101 - 50) ** 2 + (s_suppkey * 53 % 97 - 50) ** 2) AS d FROM supplier) SELECT *, row_number() OVER (ORDER BY d, s_suppkey)::INTEGER AS place FROM d WHERE d <= 60 ORDER BY d, s_suppkey LIMIT 10"),
    "rank_most_common": (rank_most_common, "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1 ORDER BY n DESC, word LIMIT 12"),
    "rank_greedy_merge": (rank_greedy_merge, f"""WITH RECURSIVE {OPTIONS}, i AS (SELECT od, {{'m': minutes, 'l': load, 'r': route}} AS own, row_number() OVER (PARTITION BY od ORDER BY load, minutes, route) AS i FROM o),
g AS (SELECT od, i, [own] AS held FROM i WHERE i = 1 UNION ALL SELECT x.od, x.i, CASE WHEN coalesce(x.pos, 0) = 0 THEN list_append(x.held, x.own) ELSE list_transform(x.held, lambda h, k: CASE WHEN k = x.pos AND x.own.m < h.m THEN x.own ELSE h END) END
 FROM (SELECT i.od, i.i, i.own, g.held, list_position(list_transform(g.held, lambda h: abs(h.m - i.own.m) <= 1 AND abs(h.l - i.own.l) <= 5 AND abs(0.6e0 * (h.l - i.own.l)) <= 2), true) AS pos FROM g JOIN i ON i.od = g.od AND i.i = g.i + 1) x),
z AS (SELECT od, held FROM g QUALIFY row_number() OVER (PARTITION BY od ORDER BY i DESC) = 1)
SELECT od, unnest(list_transform(held, lambda h: h.r)) AS route, (generate_subscripts(held, 1) - 1)::INTEGER AS place FROM z"""),
    "set_paths_reached": (set_paths_reached, f"WITH {OPTIONS} SELECT od, minutes, load, min(route) AS route, string_agg(route::VARCHAR, ',' ORDER BY route) AS reached FROM o GROUP BY 1, 2, 3"),
    "set_rendered_first": (set_rendered_first, "SELECT name, brand, p_partkey FROM (SELECT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name, lower(p_brand) AS brand, p_partkey, row_number() OVER (PARTITION BY lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), lower(p_brand) ORDER BY p_partkey) AS i FROM part) WHERE i = 1 AND length(name) >= 2"),
    "set_joined_context": (set_joined_context, "SELECT p_partkey, nullif(concat_ws(', ', p_type, CASE WHEN p_size % 2 = 0 THEN p_brand END), '') AS context FROM part"),
    "cl_arrival": (cl_arrival, f"WITH {OPTIONS}, m AS (SELECT route, round(minutes)::INTEGER AS m FROM o) SELECT route, o_orderdate + INTERVAL 9 HOUR + to_minutes(m) AS arrival, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || (m % 60) || ' min' END AS shown FROM m JOIN orders ON o_orderkey = route"),
}
