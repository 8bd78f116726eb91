"""Queries of air, sky, sun, people, surfaces and trees: columns of comfort.py and earth.py over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatloom.functions import comfort, earth
from heatloom.plans.tables import LEGS, READINGS, legs, readings, table

#: Air temperature, humidity and cloud, wind and sun of a reading.
AIR = READINGS + ", a AS (SELECT event_id, site, hh, k, value, value / 10 AS ta, CAST(k AS DOUBLE) AS rh, value / 4 AS wind, value * 2 AS direct, CAST(k AS DOUBLE) AS diffuse, k - 10.0e0 AS elev FROM r WHERE value IS NOT NULL)"
ES = "6.112e0 * exp(17.62e0 * {t} / (243.12e0 + {t}))"
SIGMA = "5.670374419e-8"


def air(spark, sf_dir):
    v, k = F.col("value"), F.col("k").cast("double")
    return readings(spark, sf_dir).where("value IS NOT NULL").select("event_id", "site", "hh", "k", "value", (v / 10).alias("ta"), k.alias("rh"), (v / 4).alias("wind"), (v * 2).alias("direct"), k.alias("diffuse"), (k - 10).alias("elev"))


def phys_vapour(spark, sf_dir):
    ta = F.col("ta")
    a = air(spark, sf_dir).withColumn("dew", F.when(F.col("k") % 3 == 0, ta - 5)).withColumn("hum", F.when(F.col("k") % 2 == 0, F.col("rh")))
    return a.select("event_id", comfort.sat_vapour(ta).alias("es"), comfort.vapour_of(F.lit(None).cast("double"), F.col("dew"), ta, F.col("hum")).alias("e"))


def phys_forcing(spark, sf_dir):
    f = air(spark, sf_dir).withColumn("f", comfort.forcing(*(F.col(c) for c in ("ta", "wind", "rh", "direct", "diffuse", "rh"))))
    q = comfort.absorbed(F.col("f"), F.col("k") / 100, F.lit(0.6), F.lit(0.2), F.lit(0.95))
    t = comfort.surface_step(F.col("f.ta_k"), q, F.col("f.ta_k"), F.col("f.h"), 0.95, 1.5e5, 300.0, 1.5, F.lit(290.0), 0.3)
    return f.select("event_id", "f.e", "f.u", "f.h", "f.l_sky", q.alias("q"), t.alias("after"))


def phys_sky_condition(spark, sf_dir):
    k, e = F.col("k"), F.when(F.col("k") % 11 != 0, F.col("elev"))
    rain = F.when(k % 13 == 0, F.lit(0.7)).when(k % 17 == 0, F.lit(0.2))
    out = comfort.sky_condition(F.col("direct"), F.col("diffuse"), rain, e, F.when(k % 5 != 0, e - 1))
    return air(spark, sf_dir).select("event_id", comfort.ghi_clear(e).alias("ghi"), comfort.beam_clear(e).alias("beam"), comfort.beam_fraction(F.col("direct"), e).alias("share"), out.alias("sky"))


def phys_mrt(spark, sf_dir):
    c = {n: F.col(n) for n in ("ta", "rh", "direct", "diffuse", "elev")}
    sky = comfort.sky_emissivity(c["ta"], comfort.vapour(c["ta"], c["rh"]), F.lit(0.3))
    out = comfort.radiant_temperature(c["ta"], c["rh"] / 100, F.col("k") % 4 / 4, c["direct"], c["diffuse"], c["elev"], c["ta"] + 8, c["ta"] + 2, sky)
    return air(spark, sf_dir).select("event_id", out.alias("mrt"))


def phys_index_inputs(spark, sf_dir):
    """The inputs of the climate index in its range, the flag of those outside, and the category of the radiant temperature."""
    x = comfort.index_inputs(F.col("ta") * 2, F.col("ta") + F.col("k"), F.col("wind") / 5)
    return air(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in x.items()), comfort.stress_category(F.col("ta") * 4 - 60).alias("category"))


def phys_uv_exposure(spark, sf_dir):
    """Index of the open sky, share that arrives on a leg, band and dose of an hour."""
    k, share = F.col("rh"), F.col("ta") / 40
    index = comfort.uv_under_cloud(comfort.uv_clear(F.col("elev")), k)
    part = comfort.uv_exposure(F.col("k") % 4 / 4, k / 100, share)
    band = F.when(index < 3, "Low").when(index < 6, "Moderate").when(index < 8, "High").when(index < 11, "Very high").otherwise("Extreme")
    return air(spark, sf_dir).select("event_id", index.alias("uv"), part.alias("part"), comfort.sed(index * part * 60).alias("sed"), band.alias("band"))


def phys_bias_apply(spark, sf_dir):
    """An hourly offset, between two hours by time, taken from air temperature and what follows it; humidity keeps its vapour pressure."""
    hour = F.hour("ts") * 60 + F.minute("ts")
    shape = lambda h: F.sin(F.pi() * (h % 24) / 12) * 1.5
    a = readings(spark, sf_dir).where("value IS NOT NULL").withColumn("ta", F.col("value") / 10).withColumn("rh", F.col("k").cast("double"))
    h0, part = F.floor(hour / 60), hour % 60 / 60.0
    a = a.withColumn("off", shape(h0) + (shape(h0 + 1) - shape(h0)) * part)
    return a.select("event_id", "off", (F.col("ta") - F.col("off")).alias("ta"), (F.col("ta") + 1 - F.col("off")).alias("apparent"), comfort.humidity_after(F.col("ta"), F.col("rh"), F.col("off")).alias("rh"))


def phys_tree_height(spark, sf_dir):
    cls = F.get(F.array(*map(F.lit, [*comfort.TREES, "unknown"])), (F.col("p_partkey") % 7).cast("int"))
    d, age = F.col("p_size") * 2.0, (F.col("p_partkey") % 30).cast("double")
    t = table(spark, sf_dir, "part").select("p_partkey", cls.alias("cls"), comfort.tree_height(d, cls).alias("grown"), age.alias("age"), (F.col("p_partkey") % 2 == 0).alias("imputed"))
    h = comfort.capped_by_age(F.col("grown"), F.col("age"), F.col("imputed"))
    return t.select("p_partkey", "cls", h.alias("height"), comfort.crown_base(h, F.col("cls")).alias("base"))


def phys_material(spark, sf_dir):
    """Depth that a day's cycle reaches, heat of that layer and conductance below it; ranges that a material must keep."""
    k, rho, c = F.col("p_size") / 10, F.col("p_retailprice"), F.lit(900.0)
    d = comfort.damping(k, rho, c)
    ok = (k > 0) & (rho.between(500, 3000)) & (d <= 0.3)
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("depth"), (rho * c * d).alias("heat"), (k / d).alias("conductance"), ok.alias("valid"))


def clock_rows(spark, sf_dir):
    """The hours of each site: means over all days of air temperature, wind, humidity and radiation, and those of the next hour."""
    return readings(spark, sf_dir).where("value IS NOT NULL").groupBy("site", F.hour("ts").alias("hr")).agg(F.avg("value").alias("v"), F.avg("k").alias("k"))


def phys_march_clock(spark, sf_dir):
    """Surface temperature at each hour of a repeated day: three loops of 24 hours of 12 steps."""
    f = comfort.forcing(F.col("v") / 4, F.col("v") / 4, F.col("k"), F.col("v") * 3, F.col("k"), F.col("k"))
    q = comfort.absorbed(F.col("f"), F.lit(0.25), F.lit(0.7), F.lit(0.12), F.lit(0.95))
    rows = clock_rows(spark, sf_dir).withColumn("f", f).select("site", "hr", q.alias("q"), F.col("f.ta_k").alias("air"), F.col("f.h").alias("h"))
    day = rows.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("hr", "q", "air", "h"))).alias("c")).where("size(c) = 24")
    nxt = lambda i: F.get("c", (i + 1) % 24)
    mid = F.transform("c", lambda x, i: F.struct(((x["q"] + nxt(i)["q"]) / 2).alias("q"), ((x["air"] + nxt(i)["air"]) / 2).alias("air"), ((x["h"] + nxt(i)["h"]) / 2).alias("h")))
    deep = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["air"]) / 24
    out = comfort.march_day(F.col("mid"), F.get("c", F.lit(0))["air"], 24, 0.95, 2.6e5, 2.0, F.col("deep"), 0.1)
    day = day.select("site", "c", mid.alias("mid"), deep.alias("deep")).select("site", out.alias("ts"))
    return day.select("site", F.posexplode("ts").alias("hr", "ts"))


def phys_wall_march(spark, sf_dir):
    """Facade temperature by orientation at each hour, and the one facade that emits as much."""
    hr = F.col("hr")
    f = comfort.forcing(F.col("v") / 4, F.col("v") / 4, F.col("k"), F.col("v") * 3, F.col("k"), F.col("k"))
    rows = clock_rows(spark, sf_dir).withColumn("f", f).withColumn("faces", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45))))
    q = comfort.wall_absorbed(F.col("f"), hr * 15.0, 60 * F.sin(F.pi() * (hr - 6) / 12), F.col("faces").cast("double"), F.col("f.ta_k"))
    rows = rows.select("site", "faces", "hr", q.alias("q"), F.col("f.ta_k").alias("air"), comfort.convection(0.6 * F.col("f.u")).alias("h"))
    day = rows.groupBy("site", "faces").agg(F.array_sort(F.collect_list(F.struct("hr", "q", "air", "h"))).alias("c")).where("size(c) = 24")
    nxt = lambda i: F.get("c", (i + 1) % 24)
    mid = F.transform("c", lambda x, i: F.struct(*[((x[n] + nxt(i)[n]) / 2).alias(n) for n in ("q", "air", "h")]))
    out = comfort.march_day(F.col("mid"), F.get("c", F.lit(0))["air"], 24, 0.90, 2.5e5, 1.5, 22.5 + 273.15)
    each = day.select("site", "faces", "c", mid.alias("mid")).select("site", "faces", F.posexplode(out).alias("hr", "ts"))
    return each.groupBy("site", "hr").agg(F.count(F.lit(1)).alias("faces"), comfort.flux_mean(F.collect_list("ts")).alias("wall"))


def phys_sun_position(spark, sf_dir):
    az, el = earth.sun_position(F.col("ts"), -37.8136, 144.9631)
    return table(spark, sf_dir, "events").select("event_id", az.alias("azimuth"), el.alias("elevation"), (el >= 5).alias("up"))


def phys_project(spark, sf_dir):
    lon, lat = 144.94 + F.col("s_suppkey") % 97 / 2000, -37.83 + F.col("s_suppkey") % 89 / 2500
    x, y = earth.to_grid(lon, lat)
    d = earth.metres(lat, lon, F.lit(-37.8136), F.lit(144.9631))
    return table(spark, sf_dir, "supplier").select("s_suppkey", x.alias("x"), y.alias("y"), d.alias("d"), (d <= 3000).alias("near"))


def phys_edge_cost(spark, sf_dir):
    """Equivalent length and cost of each leg for four preferences, and the ladder of a walker with two flags."""
    rise, bad = F.when(F.col("tax") > 0.02, F.col("tax") * 100), F.when(F.col("part") % 11 != 0, comfort.stress(F.col("utci")))
    costs = {f"c{int(k * 100)}": comfort.edge_cost(F.col("len"), rise, F.col("conveying"), bad, k) for k in (0.0, 0.03, 0.10, 0.30)}
    return legs(spark, sf_dir).select("route", "seq", "part", "price", comfort.equivalent_length(F.col("len"), rise, F.col("conveying")).alias("metres"), *(c.alias(n) for n, c in costs.items()))


def phys_alpha_ramp(spark, sf_dir):
    out = comfort.piecewise(F.col("value") / 400, [(0.05, 0.0), (0.3, 90.0), (0.8, 150.0)])
    return readings(spark, sf_dir).select("event_id", out.alias("alpha"))


def phys_solve(spark, sf_dir):
    """Inputs of the climate index at a leg: protected legs have the air's temperature all around, indoor ones 22.5 °C, still air
    and half humidity; covered ones 0.6 of the wind. An unknown surface is 8 K warmer than the air, unknown sky is 0.6 of it."""
    l = legs(spark, sf_dir)
    covered, ta = F.col("part") % 5 == 0, F.col("utci")
    indoor = F.col("indoor")
    temperature = F.when(indoor, 22.5).otherwise(ta)
    ground = F.coalesce(F.when(F.col("part") % 3 != 0, ta + 4), ta + 8)
    svf = F.coalesce(F.when(F.col("part") % 4 != 0, F.col("shade")), F.lit(0.6))
    mrt = comfort.radiant_temperature(ta, svf, F.col("shade"), F.lit(500.0), F.lit(80.0), F.lit(40.0), ground, ta + 1, F.lit(0.8))
    radiant = F.when(indoor | covered, temperature).otherwise(mrt)
    wind = F.greatest(F.lit(0.5), F.when(indoor, 0.5).when(covered, 3.0 * 0.6).otherwise(3.0))
    part = F.when(indoor | covered, 0.0).otherwise(comfort.clamp(comfort.uv_exposure(F.col("shade"), svf, F.lit(0.7)), 0.0, 1.0))
    humid = comfort.sat_vapour(temperature) * F.when(indoor, 50.0).otherwise(40.0) / 100
    return l.select("route", "seq", "part", "price", temperature.alias("ta"), radiant.alias("mrt"), wind.alias("wind"), humid.alias("e"), part.alias("uv_part"))


def _march_sql(group: str, faces: str, q: str, h: str, eps: str, heat: str, kd: str, deep: str, beta: str) -> str:
    """The march as a recursion over steps, one row a step; independent of the fold."""
    key = "site, faces" if faces else "site"
    same = "x.site = y.site AND x.faces = y.faces" if faces else "x.site = y.site"
    return f"""WITH RECURSIVE {READINGS}, c0 AS (SELECT site, hour(ts) AS hr, avg(value) AS v, avg(k) AS k FROM r WHERE value IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, v / 4 + 273.15 AS air, {ES.format(t="(v / 4)")} * k / 100 AS e, greatest(0.5e0, v / 4 / 3.6 * ln(1.1e0 / 0.03e0) / ln(10e0 / 0.03e0)) AS u, v * 3 AS sdir, k AS sdif FROM c0 WHERE site IN (SELECT site FROM c0 GROUP BY site HAVING count(*) = 24)),
g AS (SELECT *, {SIGMA} * air ** 4 * (k / 100 + (1 - k / 100) * (1 - (1 + 46.5e0 * e / air) * exp(-sqrt(1.2e0 + 3 * 46.5e0 * e / air)))) AS ls FROM f){faces},
a AS (SELECT {key}, hr, air, {h} AS h, {q} AS q FROM {group}),
b AS (SELECT {', '.join('x.' + c for c in key.split(', '))}, x.hr, (x.q + y.q) / 2 AS q, (x.air + y.air) / 2 AS air, (x.h + y.h) / 2 AS h FROM a x JOIN a y ON {same} AND y.hr = (x.hr + 1) % 24),
d AS (SELECT {key}, {deep} AS deep, max(CASE WHEN hr = 0 THEN air END) AS t0 FROM a GROUP BY {key}),
s AS (SELECT {key}, 0 AS n, t0 AS t, deep FROM d UNION ALL
 SELECT {', '.join('s.' + c for c in key.split(', '))}, n + 1, t + 300e0 * (b.q - {eps} * {SIGMA} * t ** 4 - b.h * (t - b.air) - {kd} * (t - s.deep) - {beta} * greatest(b.q - {eps} * {SIGMA} * t ** 4, 0)) / ({heat} + 300e0 * ((1 - {beta}) * 4 * {eps} * {SIGMA} * t ** 3 + b.h + {kd})), s.deep
 FROM s JOIN b ON {' AND '.join(f's.{c} = b.{c}' for c in key.split(', '))} AND b.hr = (n // 12) % 24 WHERE n < 863)
"""


PLANS = {
    "phys_vapour": (phys_vapour, f"WITH {AIR} SELECT event_id, {ES.format(t='ta')} AS es, CASE WHEN k % 3 = 0 THEN {ES.format(t='(ta - 5)')} ELSE {ES.format(t='ta')} * CASE WHEN k % 2 = 0 THEN rh ELSE 50 END / 100 END AS e FROM a"),
    "phys_forcing": (phys_forcing, f"""WITH {AIR}, f AS (SELECT *, ta + 273.15 AS tk, {ES.format(t='ta')} * rh / 100 AS e, greatest(0.5e0, wind / 3.6 * ln(1.1e0 / 0.03e0) / ln(10e0 / 0.03e0)) AS u FROM a),
g AS (SELECT *, {SIGMA} * tk ** 4 * (rh / 100 + (1 - rh / 100) * (1 - (1 + 46.5e0 * e / tk) * exp(-sqrt(1.2e0 + 3 * 46.5e0 * e / tk)))) AS l_sky FROM f),
q AS (SELECT *, 0.8e0 * (direct * (1 - k / 100) + diffuse * 0.6e0 + 0.04e0 * (direct + diffuse)) + 0.95e0 * (0.6e0 * l_sky + 0.4e0 * (0.9e0 * {SIGMA} * tk ** 4 + 0.1e0 * l_sky)) AS q, 2.8e0 + 3 * u AS h FROM g),
n AS (SELECT *, q - 0.95e0 * {SIGMA} * tk ** 4 AS net FROM q)
SELECT event_id, e, u, h, l_sky, q, tk + 300 * (net - 1.5e0 * (tk - 290) - 0.3e0 * greatest(net, 0)) / (1.5e5 + 300 * (0.7e0 * 4 * 0.95e0 * {SIGMA} * tk ** 3 + h + 1.5e0)) AS after FROM n"""),
    "phys_sky_condition": (phys_sky_condition, f"""WITH {AIR}, e AS (SELECT *, CASE WHEN k % 11 <> 0 THEN elev END AS el, CASE WHEN k % 13 = 0 THEN 0.7e0 WHEN k % 17 = 0 THEN 0.2e0 ELSE 0 END AS rain FROM a),
w AS (SELECT *, CASE WHEN k % 5 <> 0 THEN el - 1 ELSE el END AS er FROM e),
b AS (SELECT *, CASE WHEN el > 0 THEN 1098 * sin(radians(el)) * exp(-0.059e0 / sin(radians(el))) WHEN el <= 0 THEN 0 END AS ghi,
 CASE WHEN el > 0 THEN 1367 * 0.7e0 ** ((1 / (sin(radians(el)) + 0.50572e0 * (el + 6.07995e0) ** -1.6364e0)) ** 0.678e0) * sin(radians(el)) ELSE 0 END AS beam,
 CASE WHEN er > 0 THEN 1367 * 0.7e0 ** ((1 / (sin(radians(er)) + 0.50572e0 * (er + 6.07995e0) ** -1.6364e0)) ** 0.678e0) * sin(radians(er)) ELSE 0 END AS beam2 FROM w)
SELECT event_id, ghi, beam, CASE WHEN beam >= 10 THEN direct / beam END AS share,
 CASE WHEN rain >= 0.5 THEN 'rain' WHEN rain > 0 THEN 'drizzle' WHEN el <= 5 THEN 'night'
  WHEN el IS NOT NULL AND beam2 >= 10 THEN CASE WHEN direct / beam2 >= 0.5 THEN 'sunny' WHEN direct / beam2 >= 0.15 THEN 'partly_cloudy' ELSE 'cloudy' END
  WHEN diffuse >= 60 THEN 'cloudy' ELSE 'partly_cloudy' END AS sky FROM b"""),
    "phys_mrt": (phys_mrt, f"""WITH {AIR}, e AS (SELECT *, {ES.format(t='ta')} * rh / 100 AS vp, ta + 273.15 AS tk, rh / 100 AS svf, 1 - k % 4 / 4 AS lit, sin(radians(elev)) AS sb, elev > 0 AS up FROM a),
s AS (SELECT *, 0.3e0 + 0.7e0 * (1 - (1 + 46.5e0 * vp / tk) * exp(-sqrt(1.2e0 + 3 * 46.5e0 * vp / tk))) AS es, CASE WHEN up THEN direct / greatest(sb, sin(radians(2e0))) ELSE 0 END AS dn FROM e),
t AS (SELECT *, CASE WHEN up THEN (0.28e0 * cos(radians(elev)) + 0.06e0 * sb) * dn * lit ELSE 0 END + 0.5e0 * svf * diffuse
 + 0.075e0 * (CASE WHEN up THEN direct * lit ELSE 0 END + diffuse * svf)
 + 0.1e0 * (1 - svf) * (0.5e0 * dn * cos(radians(least(90, greatest(0, elev)))) * lit + 0.5e0 * diffuse * svf) AS sw,
 svf * es * {SIGMA} * tk ** 4 + (1 - svf) * (0.9e0 * {SIGMA} * (tk + 2) ** 4 + 0.1e0 * es * {SIGMA} * tk ** 4) AS down FROM s)
SELECT event_id, ((0.7e0 * sw + 0.97e0 * (0.5e0 * down + 0.5e0 * (0.95e0 * {SIGMA} * (tk + 8) ** 4 + 0.05e0 * down))) / (0.97e0 * {SIGMA})) ** 0.25e0 - 273.15 AS mrt FROM t"""),
    "phys_index_inputs": (phys_index_inputs, f"""WITH {AIR}, i AS (SELECT event_id, ta * 2 AS t, ta + k - ta * 2 AS x, wind / 5 AS w, ta * 4 - 60 AS u FROM a)
SELECT event_id, least(50, greatest(-50, t)) AS ta, least(70, greatest(-30, x)) AS excess, least(17, greatest(0.5, w)) AS wind, NOT (t BETWEEN -50 AND 50 AND x BETWEEN -30 AND 70 AND w BETWEEN 0.5 AND 17) AS outside,
 ['extreme cold stress', 'very strong cold stress', 'strong cold stress', 'moderate cold stress', 'slight cold stress', 'no thermal stress', 'moderate heat stress', 'strong heat stress', 'very strong heat stress', 'extreme heat stress'][1 + len(list_filter([-40, -27, -13, 0, 9, 26, 32, 38, 46], lambda b: b <= u))] AS category FROM i"""),
    "phys_uv_exposure": (phys_uv_exposure, f"""WITH {AIR}, u AS (SELECT *, 12.5e0 * greatest(0, sin(radians(elev))) ** 2.42e0 * (1 - 0.56e0 * (least(100, rh) / 100) ** 3.4e0) AS uv, 0.55e0 * least(1, ta / 40) AS b FROM a),
p AS (SELECT *, b * (1 - k % 4 / 4) + (1 - b) * rh / 100 AS part FROM u)
SELECT event_id, uv, part, 0.015e0 * uv * part * 60 AS sed, CASE WHEN uv >= 11 THEN 'Extreme' WHEN uv >= 8 THEN 'Very high' WHEN uv >= 6 THEN 'High' WHEN uv >= 3 THEN 'Moderate' ELSE 'Low' END AS band FROM p"""),
    "phys_bias_apply": (phys_bias_apply, f"""WITH {READINGS}, b AS (SELECT event_id, value / 10 AS t, k AS rh0, hour(ts) AS h, minute(ts) / 60 AS f FROM r WHERE value IS NOT NULL),
o AS (SELECT *, (1 - f) * 1.5e0 * sin(pi() * h / 12) + f * 1.5e0 * sin(pi() * ((h + 1) % 24) / 12) AS off FROM b)
SELECT event_id, off, t - off AS ta, t + 1 - off AS apparent, least(100, greatest(0, rh0 * ({ES.format(t='t')}) / ({ES.format(t='(t - off)')}))) AS rh FROM o"""),
    "phys_tree_height": (phys_tree_height, """WITH c(i, cls, a, b, c, m, n) AS (VALUES (0, 'large_broadleaf', 33, 0.00796e0, 0.7882e0, 0.1448e0, 1.3336e0), (1, 'eucalypt', 35, 0.01413e0, 1.0757e0, 0.3487e0, -0.1599e0), (2, 'conifer', 30, 0.02098e0, 1.4216e0, 0.1247e0, 0.7946e0), (3, 'evergreen_medium', 22, 0.01465e0, 0.9478e0, 0.1364e0, 1.5689e0), (4, 'small_tree', 13, 0.02806e0, 0.9351e0, 0.1708e0, 1.1401e0), (5, 'palm', 0, 0, 1, 0.8667e0, -2.4822e0), (6, 'unknown', 22, 0.01465e0, 0.9478e0, 0.1364e0, 1.5689e0)),
g AS (SELECT p_partkey, cls, m, n, p_partkey % 30 AS age, CASE cls WHEN 'palm' THEN 10 ELSE least(40, greatest(2, 1.3e0 + a * (1 - exp(-b * p_size * 2)) ** c)) END AS h FROM part JOIN c ON i = p_partkey % 7),
k AS (SELECT *, CASE WHEN p_partkey % 2 = 0 AND age > 0 AND h > 1.3e0 + 0.75e0 * age THEN greatest(2, 1.3e0 + 0.75e0 * age) ELSE h END AS height FROM g)
SELECT p_partkey, cls, height, greatest(0, least(0.9e0 * height, m * height + n)) AS base FROM k"""),
    "phys_material": (phys_material, """WITH d AS (SELECT p_partkey, p_size / 10 AS k, p_retailprice AS rho, least(0.3e0, sqrt(86400 / pi() * (p_size / 10) / (p_retailprice * 900))) AS depth FROM part)
SELECT p_partkey, depth, rho * 900 * depth AS heat, k / depth AS conductance, k > 0 AND rho BETWEEN 500 AND 3000 AS valid FROM d"""),
    "phys_march_clock": (phys_march_clock, _march_sql("g", "", f"0.88e0 * (sdir * 0.75e0 + sdif * 0.7e0 + 0.03e0 * (sdir + sdif)) + 0.95e0 * (0.7e0 * ls + 0.3e0 * (0.9e0 * {SIGMA} * air ** 4 + 0.1e0 * ls))", "2.8e0 + 3 * u", "0.95e0", "2.6e5", "2e0", "avg(air)", "0.1e0")
     + "SELECT site, ((n - 576) // 12)::INTEGER AS hr, t AS ts FROM s WHERE n >= 576 AND n % 12 = 0"),
    "phys_wall_march": (phys_wall_march, _march_sql("w", ", w AS (SELECT g.*, o.faces, radians(60 * sin(pi() * (hr - 6) / 12)) AS el FROM g, (SELECT unnest(range(0, 360, 45)) AS faces) o)", f"0.8e0 * (CASE WHEN el > 0 THEN sdir / greatest(sin(el), sin(radians(2e0))) * greatest(0, cos(el) * cos(radians(hr * 15 - faces))) ELSE 0 END + 0.5e0 * sdif + 0.075e0 * (sdir + sdif)) + 0.9e0 * (0.5e0 * ls + 0.5e0 * (0.9e0 * {SIGMA} * air ** 4 + 0.1e0 * ls))", "2.8e0 + 3 * 0.6e0 * u", "0.9e0", "2.5e5", "1.5e0", "295.65e0", "0e0")
     + "SELECT site, ((n - 576) // 12)::INTEGER AS hr, count(*) AS faces, avg(t ** 4) ** 0.25e0 - 273.15 AS wall FROM s WHERE n >= 576 AND n % 12 = 0 GROUP BY 1, 2"),
    "phys_sun_position": (phys_sun_position, """WITH d AS (SELECT event_id, (epoch_us(ts) / 86400e6 + 2440587.5 - 2451545) / 36525 AS c, (epoch_us(ts) % 86400000000) / 60e6 AS mi FROM events),
a AS (SELECT *, (280.46646e0 + c * (36000.76983e0 + c * 0.0003032e0)) AS l0, radians(357.52911e0 + c * (35999.05029e0 - 0.0001537e0 * c)) AS m, radians(125.04e0 - 1934.136e0 * c) AS om FROM d),
b AS (SELECT *, radians(l0 + sin(m) * (1.914602e0 - c * (0.004817e0 + 0.000014e0 * c)) + sin(2 * m) * (0.019993e0 - 0.000101e0 * c) + sin(3 * m) * 0.000289e0 - 0.00569e0 - 0.00478e0 * sin(om)) AS lam,
 radians(23 + (26 + (21.448e0 - c * (46.815e0 + c * (0.00059e0 - c * 0.001813e0))) / 60) / 60 + 0.00256e0 * cos(om)) AS ob, 0.016708634e0 - c * (0.000042037e0 + 0.0000001267e0 * c) AS ec FROM a),
g AS (SELECT *, asin(sin(ob) * sin(lam)) AS de, tan(ob / 2) ** 2 AS y FROM b),
h AS (SELECT *, mi + 4 * degrees(y * sin(2 * radians(l0)) - 2 * ec * sin(m) + 4 * ec * y * sin(m) * cos(2 * radians(l0)) - 0.5e0 * y * y * sin(4 * radians(l0)) - 1.25e0 * ec * ec * sin(2 * m)) + 4 * 144.9631e0 AS st FROM g),
i AS (SELECT *, radians(st / 4 - 180) AS ha, radians(-37.8136e0) AS phi FROM h),
j AS (SELECT event_id, degrees(asin(sin(phi) * sin(de) + cos(phi) * cos(de) * cos(ha))) AS e0, degrees(atan2(sin(ha), cos(ha) * sin(phi) - tan(de) * cos(phi))) + 180 AS az FROM i),
k AS (SELECT event_id, az - 360 * floor(az / 360) AS azimuth, e0 + CASE WHEN e0 > -1 THEN 1.02e0 / 60 / tan(radians(e0 + 10.3e0 / (e0 + 5.11e0))) ELSE 0 END AS elevation FROM j)
SELECT event_id, azimuth, elevation, elevation >= 5 AS up FROM k"""),
    "phys_project": (phys_project, """WITH p AS (SELECT s_suppkey, 144.94e0 + s_suppkey % 97 / 2000 AS lon, -37.83e0 + s_suppkey % 89 / 2500 AS lat FROM supplier UNION ALL SELECT -1, 144.9631e0, -37.8136e0),
c AS (SELECT *, 1 / 298.257222101e0 AS f FROM p), d AS (SELECT *, f / (2 - f) AS n, sqrt(f * (2 - f)) AS e, sin(radians(lat)) AS s, radians(lon - 147) AS w FROM c),
g AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t, 0.9996e0 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS q FROM d),
h AS (SELECT *, atan2(t, cos(w)) AS u, atanh(sin(w) / sqrt(1 + t * t)) AS v, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM g),
i AS (SELECT s_suppkey, 500000 + q * (v + a1 * cos(2 * u) * sinh(2 * v) + a2 * cos(4 * u) * sinh(4 * v) + a3 * cos(6 * u) * sinh(6 * v)) AS x, 10000000 + q * (u + a1 * sin(2 * u) * cosh(2 * v) + a2 * sin(4 * u) * cosh(4 * v) + a3 * sin(6 * u) * cosh(6 * v)) AS y FROM h)
SELECT a.s_suppkey, a.x, a.y, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3000 AS near FROM i a, i b WHERE b.s_suppkey = -1 AND a.s_suppkey >= 0"""),
    "phys_edge_cost": (phys_edge_cost, f"""WITH {LEGS}, m AS (SELECT *, len + CASE WHEN conveying OR NOT tax > 0.02 THEN 0 ELSE 300 * tax END AS metres, CASE WHEN part % 11 = 0 THEN 0 ELSE greatest(0, utci - 26, 9 - utci) END AS bad FROM l)
SELECT route, seq, part, price, metres, metres AS c0, metres * (1 + 0.03e0 * bad) AS c3, metres * (1 + 0.1e0 * bad) AS c10, metres * (1 + 0.3e0 * bad) AS c30 FROM m"""),
    "phys_alpha_ramp": (phys_alpha_ramp, f"WITH {READINGS}, x AS (SELECT event_id, value / 400 AS x FROM r) SELECT event_id, CASE WHEN x <= 0.05 THEN 0 WHEN x <= 0.3 THEN (x - 0.05e0) / 0.25e0 * 90 WHEN x <= 0.8 THEN 90 + (x - 0.3e0) / 0.5e0 * 60 ELSE CASE WHEN x IS NOT NULL THEN 150 END END::DOUBLE AS alpha FROM x"),
    "phys_solve": (phys_solve, f"""WITH {LEGS}, i AS (SELECT *, part % 5 = 0 AS cov, CASE WHEN indoor THEN 22.5e0 ELSE utci END AS t, utci + 273.15 AS tk, CASE WHEN part % 3 <> 0 THEN 4 ELSE 8 END AS dg, CASE WHEN part % 4 <> 0 THEN shade ELSE 0.6e0 END AS s, radians(40e0) AS el FROM l),
j AS (SELECT *, 0.7e0 * ((0.28e0 * cos(el) + 0.06e0 * sin(el)) * 500 / sin(el) * (1 - shade) + 40 * s + 0.075e0 * (500 * (1 - shade) + 80 * s) + 0.1e0 * (1 - s) * (250 / sin(el) * cos(el) * (1 - shade) + 40 * s)) AS sw,
 s * 0.8e0 * {SIGMA} * tk ** 4 + (1 - s) * {SIGMA} * (0.9e0 * (tk + 1) ** 4 + 0.08e0 * tk ** 4) AS dn FROM i)
SELECT route, seq, part, price, t AS ta, CASE WHEN indoor OR cov THEN t ELSE ((sw + 0.97e0 * (0.525e0 * dn + 0.475e0 * {SIGMA} * (tk + dg) ** 4)) / (0.97e0 * {SIGMA})) ** 0.25e0 - 273.15 END AS mrt,
 CASE WHEN indoor THEN 0.5e0 WHEN cov THEN 1.8e0 ELSE 3 END AS wind, {ES.format(t='t')} * CASE WHEN indoor THEN 0.5e0 ELSE 0.4e0 END AS e,
 CASE WHEN indoor OR cov THEN 0 ELSE least(1, greatest(0, 0.385e0 * (1 - shade) + 0.615e0 * s)) END AS uv_part FROM j"""),
}
