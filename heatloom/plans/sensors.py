"""Queries of sensor series against the model series: profiles, fits, scores, lags, clocks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.functions import comfort, earth
from heatloom.operators.quantiles import exact_quantiles
from heatloom.plans import physics
from heatloom.plans.tables import HOURLY, PAIRED, READINGS, hourly, paired, readings, table

SEASONS = ("DJF", "MAM", "JJA", "SON")
TRAIN_END = "2024-01-20"
#: Latitude and longitude of the sensors, and SQL of the sun above them at each reading.
PLACE = (-37.8136, 144.9631)
SUN = physics.PLANS["phys_sun_position"][1]


def hours(spark):
    return spark.range(24).select(F.col("id").cast("int").alias("hr"))


def over(*keys):
    return Window.partitionBy(*keys)


def agg_hour_profile_24(spark, sf_dir):
    """Hourly means of one day at each site, all 24 hours."""
    day = readings(spark, sf_dir).where("CAST(ts AS DATE) = DATE '2024-01-05'")
    sites = readings(spark, sf_dir).select("site").distinct()
    means = day.groupBy("site", F.hour("ts").alias("hr")).agg(F.avg("value").alias("mean"))
    return sites.crossJoin(F.broadcast(hours(spark))).join(means, ["site", "hr"], "left")


def agg_site_profile_full(spark, sf_dir):
    """First reading, rows, first and last day, share that is known, and the median."""
    r = readings(spark, sf_dir)
    first = F.min(F.when(F.col("value").isNotNull(), F.struct("ts", "event_id", "value")))
    plain = r.groupBy("site").agg(first["value"].alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("from_day"), F.max(F.to_date("ts")).alias("to_day"), (100 * F.count("value") / F.count(F.lit(1))).alias("pct"))
    middle = exact_quantiles(r, ["site"], "value", [0.5]).select("site", F.get("q", F.lit(0)).alias("median"))
    return plain.join(middle, "site", "left")


def agg_percentiles(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    q = exact_quantiles(line.join(part, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "l_extendedprice", [0.1, 0.5, 0.9])
    return q.select("p_brand", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p10", "p50", "p90"))))


def agg_median_impute(spark, sf_dir):
    """Unknown values take the median of their site and kind where 20 or more are known, else the median of all."""
    r = readings(spark, sf_dir).withColumn("kind", F.col("k") % 10)
    own = exact_quantiles(r, ["site", "kind"], "value", [0.5]).where("n >= 20").select("site", "kind", F.get("q", F.lit(0)).alias("own"))
    all_ = exact_quantiles(r, [], "value", [0.5]).select(F.get("q", F.lit(0)).alias("all_"))
    out = r.join(own, ["site", "kind"], "left").crossJoin(F.broadcast(all_))  # one row
    return out.select("event_id", F.coalesce("value", "own", "all_").alias("value"), F.col("value").isNull().alias("imputed"))


def agg_strata_median_diff(spark, sf_dir):
    """Difference of the medians of two strata where both have ten readings, and the smaller number."""
    q = exact_quantiles(readings(spark, sf_dir).withColumn("high", F.col("k") >= 50).where("k IS NOT NULL"), ["site", "high"], "value", [0.5])
    side = lambda h, c: F.max(F.when(F.col("high") == h, c))
    m = F.get("q", F.lit(0))
    both = q.groupBy("site").agg((side(True, m) - side(False, m)).alias("diff"), F.least(F.coalesce(side(True, F.col("n")), F.lit(0)), F.coalesce(side(False, F.col("n")), F.lit(0))).alias("n"))
    return both.where("n >= 10")


def agg_daily_ratio(spark, sf_dir):
    """Daily sums, and beam over all light; no ratio on days without light."""
    v = lambda site: F.sum(F.when(F.col("site") == site, F.col("value")))
    day = readings(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("value").alias("n"), v("click").alias("beam"), v("view").alias("light"))
    return day.withColumn("ratio", F.try_divide("beam", F.nullif("light", F.lit(0))))


def season_cells(rows):
    """Mean bias of each season and hour that occurs."""
    return rows.groupBy("season", "hr").agg(F.avg("bias").alias("v"), F.count(F.lit(1)).alias("n"), F.sum("bias").alias("s"))


def agg_pivot_24x4(spark, sf_dir):
    """Mean bias by hour and season, all cells; empty ones take the mean of the season's hourly means."""
    cells = paired(spark, sf_dir).groupBy("hr").pivot("season", list(SEASONS)).agg(F.avg("bias"))
    grid = F.broadcast(hours(spark)).join(cells, "hr", "left")
    whole = Window.partitionBy()  # 24 rows
    return grid.select("hr", *(F.coalesce(c, F.avg(c).over(whole)).alias(c) for c in SEASONS))


def centred(cells):
    """Shape of each season: its cells without their mean, which is the level."""
    mid = F.avg("v").over(over("season"))
    return cells.select("season", "hr", "n", (F.col("v") - mid).alias("shape"), mid.alias("level"))


def agg_centre_shape(spark, sf_dir):
    return centred(season_cells(paired(spark, sf_dir))).drop("level")


def agg_bias_fit(spark, sf_dir):
    """The training part's shape and level: grouped once; seasons' means come from the grouped cells."""
    return centred(season_cells(paired(spark, sf_dir).where(f"hh < TIMESTAMP_NTZ '{TRAIN_END} 00:00:00'")))


def agg_fit_full(spark, sf_dir):
    """A fit with its pooled shape, its level over all rows, and what it was fitted on."""
    train = paired(spark, sf_dir).where(f"hh < TIMESTAMP_NTZ '{TRAIN_END} 00:00:00'")
    shape = centred(season_cells(train)).select("season", "hr", "shape")
    pooled = train.groupBy("hr").agg(F.avg("bias").alias("v")).select("hr", (F.col("v") - F.avg("v").over(Window.partitionBy())).alias("pooled"))  # 24 rows
    meta = train.agg(F.avg("bias").alias("level"), F.count(F.lit(1)).alias("rows"), F.count_distinct("device").alias("devices"), F.min(F.to_date("hh")).alias("from_day"), F.max(F.to_date("hh")).alias("to_day"))
    return shape.join(F.broadcast(pooled), "hr").crossJoin(F.broadcast(meta))


def agg_skill(spark, sf_dir):
    """Errors of each device and of all; none below three pairs."""
    def some(c):
        return F.when(F.count(F.lit(1)) >= 3, c)

    s = paired(spark, sf_dir).rollup("device").agg(F.grouping("device").alias("pooled"), F.count(F.lit(1)).alias("n"), some(F.avg("bias")).alias("bias"), some(F.sqrt(F.avg(F.col("bias") * F.col("bias")))).alias("rmse"), some(F.corr("mod", "obs")).alias("r"))
    return s.select(F.when(F.col("pooled") == 1, "ALL").otherwise(F.col("device").cast("string")).alias("device"), "n", "bias", "rmse", "r")


def with_offsets(spark, sf_dir):
    """Pairs with the shape and the level of a fit on the training part."""
    p = paired(spark, sf_dir)
    fit = agg_bias_fit(spark, sf_dir).select("season", "hr", "shape", "level")
    pooled = p.where(f"hh < TIMESTAMP_NTZ '{TRAIN_END} 00:00:00'").agg(F.avg("bias").alias("all_level"))
    return p.join(F.broadcast(fit), ["season", "hr"], "left").crossJoin(F.broadcast(pooled)).withColumn("shape", F.coalesce("shape", F.lit(0.0)))


def agg_named_groups(spark, sf_dir):
    """Scores of overlapping groups under three corrections, of groups of 100 pairs or more."""
    p = with_offsets(spark, sf_dir)
    groups = F.filter(F.array(F.lit("all"), F.when(F.col("device") % 2 == 0, "even"), F.when(F.col("hr") >= 12, "late")), lambda g: g.isNotNull())
    zero = F.lit(0.0)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), c.alias("off")) for m, c in (("none", zero), ("shape", F.col("shape")), ("shape_level", F.col("shape") + F.col("all_level")))])
    e = F.col("bias") - F.col("m.off")
    s = p.select("bias", F.explode(groups).alias("grp"), modes.alias("modes")).select("bias", "grp", F.explode("modes").alias("m"))
    s = s.groupBy("grp", F.col("m.mode").alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).where("n >= 100")
    base = F.max(F.when(F.col("mode") == "none", F.col("rmse"))).over(over("grp"))
    return s.withColumn("gain", 100 * (1 - F.try_divide(F.col("rmse"), F.nullif(base, zero))))


def agg_leave_one_out_refit(spark, sf_dir):
    """Error of each device under the hourly offsets of all other devices: totals less its own, no refit for each."""
    p = paired(spark, sf_dir)
    own = p.groupBy("device", "hr").agg(F.sum("bias").alias("s"), F.count(F.lit(1)).alias("n"), F.sum(F.col("bias") * F.col("bias")).alias("q"))
    all_ = own.groupBy("hr").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    off = F.coalesce(F.try_divide(F.col("ts") - F.col("s"), F.nullif(F.col("tn") - F.col("n"), F.lit(0))), F.lit(0.0))
    cells = own.join(F.broadcast(all_), "hr").withColumn("off", off)  # 24 rows
    fixed = F.col("q") - 2 * F.col("off") * F.col("s") + F.col("n") * F.col("off") * F.col("off")
    return cells.groupBy("device").agg(F.sum("n").alias("n"), F.sqrt(F.sum("q") / F.sum("n")).alias("raw"), F.sqrt(F.greatest(F.sum(fixed), F.lit(0.0)) / F.sum("n")).alias("left_out"))


def agg_mae_vs_baseline(spark, sf_dir):
    p = with_offsets(spark, sf_dir)
    rows = p.select("season", "hr", F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("bias").alias("e")), F.struct(F.lit("shape").alias("model"), (F.col("bias") - F.col("shape")).alias("e")))).alias("x"))
    s = rows.groupBy("season", F.col("x.model").alias("model")).agg(F.avg(F.abs("x.e")).alias("mae"), F.sqrt(F.avg(F.col("x.e") * F.col("x.e"))).alias("rmse"))
    base = F.max(F.when(F.col("model") == "base", F.col("mae"))).over(over("season"))
    return s.withColumn("pct", 100 * (1 - F.try_divide(F.col("mae"), F.nullif(base, F.lit(0.0)))))


def agg_candidates(spark, sf_dir):
    """Error of the model anchored at the reading some hours earlier, by lead (0: its own hour)."""
    p = paired(spark, sf_dir)
    leads = p.select("device", "hr", "hh", "obs", "mod", F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 6, 12)))).alias("lead"))
    then = p.select(F.col("device").alias("d2"), F.col("hh").alias("h2"), F.col("bias").alias("then"))
    at = F.expr("hh - make_dt_interval(0, lead)")
    j = leads.join(then, (F.col("device") == F.col("d2")) & (at == F.col("h2")), "left")
    e = F.col("mod") - F.col("then") - F.col("obs")
    return j.groupBy("lead").agg(F.count("then").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def agg_pair_noise(spark, sf_dir):
    """Differences of devices that stand together (here: an odd one and the next), joined by hour, not by position."""
    h = hourly(spark, sf_dir)
    a, b = h.where("device % 2 = 1").select("device", "hh", "value"), h.where("device % 2 = 0").select((F.col("device") - 1).alias("device"), "hh", F.col("value").alias("other"))
    e = F.col("value") - F.col("other")
    return a.join(b, ["device", "hh"]).groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("most"))


def agg_board_screen(spark, sf_dir):
    """Site, rows, night over day, median daily range and live days of each device; kept: a range of 30 and three live days."""
    r = readings(spark, sf_dir)
    night = (F.hour("ts") < 6) | (F.hour("ts") >= 20)
    first = F.min(F.struct("ts", "event_id", "site"))["site"]
    board = r.groupBy("device").agg(first.alias("site"), F.count(F.lit(1)).alias("n"), F.try_divide(F.avg(F.when(night, F.col("value"))), F.avg(F.when(~night, F.col("value")))).alias("night"))
    days = r.groupBy("device", F.to_date("ts").alias("day")).agg((F.max("value") - F.min("value")).alias("span"), F.max("value").alias("top"))
    live = days.groupBy("device").agg(F.count_if(F.col("top") > 90).alias("live"), F.count(F.lit(1)).alias("days"))
    middle = exact_quantiles(days, ["device"], "span", [0.5]).select("device", F.get("q", F.lit(0)).alias("span"))
    return board.join(live, "device").join(middle, "device", "left").withColumn("kept", F.coalesce((F.col("span") >= 30) & (F.col("live") >= 3), F.lit(False)))


def win_lag_scan(spark, sf_dir):
    """The shift of -3 to 3 rows at which a device follows the model best; devices of 20 pairs or more."""
    order = Window.partitionBy("device").orderBy("hh")
    p = paired(spark, sf_dir).select("device", "obs", *(F.lag("mod", k).over(order).alias(f"m{k + 3}") if k >= 0 else F.lead("mod", -k).over(order).alias(f"m{k + 3}") for k in range(-3, 4)))
    s = p.groupBy("device").agg(F.count(F.lit(1)).alias("n"), *(F.corr("obs", f"m{i}").alias(f"r{i}") for i in range(7))).where("n >= 20")
    best = F.array_max(F.array(*[F.struct(F.col(f"r{i}").alias("r"), F.lit(-abs(i - 3)).alias("near"), F.lit(i - 3).alias("lag")) for i in range(7)]))
    return s.select("device", "n", best["lag"].alias("lag"), best["r"].alias("r"))


def win_argmax_hour(spark, sf_dir):
    """The hour with the highest mean at each site, the first of equal ones."""
    m = readings(spark, sf_dir).groupBy("site", F.hour("ts").alias("hr")).agg(F.avg("value").alias("v")).where("v IS NOT NULL")
    top = F.max(F.struct("v", (-F.col("hr")).alias("minus")))
    return m.groupBy("site").agg(top.alias("t")).select("site", (-F.col("t.minus")).alias("hr"), F.col("t.v").alias("v"))


def win_interp_clock(spark, sf_dir):
    """Values at the 48 half hours of one day between its hourly means, over midnight; one-sided where one hour is missing."""
    h = readings(spark, sf_dir).where("CAST(ts AS DATE) = DATE '2024-01-05'").groupBy("site", F.hour("ts").alias("hr")).agg(F.avg("value").alias("v"))
    slots = spark.range(0, 1440, 30).select(F.col("id").cast("int").alias("slot"))
    s = h.select("site").distinct().crossJoin(F.broadcast(slots)).withColumn("h0", F.floor(F.col("slot") / 60).cast("int"))
    a = h.select("site", F.col("hr").alias("h0"), F.col("v").alias("a"))
    b = h.select("site", ((F.col("hr") + 23) % 24).alias("h0"), F.col("v").alias("b"))
    j = s.join(a, ["site", "h0"], "left").join(b, ["site", "h0"], "left")
    v = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("slot") % 60 / 60))
    return j.select("site", "slot", v.alias("v"))


def win_rad_slots(spark, sf_dir):
    """Means of quarter-hour rows over each half hour of the day; null unless both variables have a value."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    quarter = readings(spark, sf_dir).groupBy("site", (F.floor(minute / 15) * 15).cast("int").alias("q")).agg(F.avg(F.when(F.col("k") % 3 == 0, F.col("value"))).alias("direct"), F.avg(F.when(F.col("k") % 3 == 1, F.col("value"))).alias("diffuse"))
    s = quarter.groupBy("site", (F.floor(F.col("q") / 30) * 30).cast("int").alias("slot")).agg(F.avg("direct").alias("direct"), F.avg("diffuse").alias("diffuse"))
    both = F.col("direct").isNotNull() & F.col("diffuse").isNotNull()
    return s.select("site", "slot", F.when(both, F.col("direct")).alias("direct"), F.when(both, F.col("diffuse")).alias("diffuse"), F.when(both, "minutely_15").otherwise("hourly").alias("rad_source"))


def agg_source_label(spark, sf_dir):
    """How much of a site's clock has its own radiation, as a label."""
    s = win_rad_slots(spark, sf_dir).groupBy("site").agg(F.count_if(F.col("rad_source") == "minutely_15").alias("n"), F.count(F.lit(1)).alias("of"), F.bool_or(F.col("direct").isNotNull()).alias("any"), F.bool_and(F.col("direct").isNull()).alias("none"))
    label = F.when(F.col("n") == F.col("of"), "minutely_15").when(F.col("n") == 0, "hourly").otherwise(F.concat(F.lit("minutely_15 on "), F.col("n").cast("string"), F.lit("/"), F.col("of").cast("string")))
    return s.select("site", label.alias("label"), "any", "none")


def agg_clear_sky(spark, sf_dir):
    """Readings over the clear-sky light of their hour, where the sky is clear (cloud 20 % at most) and the sun is high."""
    r = readings(spark, sf_dir).where("value IS NOT NULL").withColumn("elev", earth.sun_position(F.col("ts"), *PLACE)[1])
    r = r.where("elev > 20 AND k <= 20").withColumn("kt", F.col("value") / comfort.ghi_clear(F.col("elev")))
    return r.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg("kt").alias("kt"), F.stddev_samp("kt").alias("sd"), F.avg(F.least("kt", F.lit(1.2))).alias("clipped"))


def rank_best_day(spark, sf_dir):
    """For each kind of day the best one: most sites, then the warmest."""
    d = readings(spark, sf_dir).where("value IS NOT NULL").groupBy(F.to_date("ts").alias("day")).agg(F.count_distinct("device").alias("sites"), F.max("value").alias("tmax"), F.avg("k").alias("cloud"))
    kind = F.when((F.col("tmax") >= 250) & (F.col("cloud") < 50), "hot_clear").when(F.col("tmax") >= 250, "hot_dull").otherwise("mild")
    d = d.withColumn("kind", kind).withColumn("score", F.col("sites") * 1000 + F.col("tmax"))
    top = F.max(F.struct("score", F.col("day")))
    return d.groupBy("kind").agg(top.alias("t"), F.count(F.lit(1)).alias("days")).select("kind", "days", F.col("t.day").alias("day"), F.col("t.score").alias("score"))


def flt_gates(spark, sf_dir):
    """Readings of devices that are live that day and with the sun up, and what they are good for."""
    r = readings(spark, sf_dir)
    live = r.groupBy("device", F.to_date("ts").alias("day")).agg(F.max("value").alias("top")).where("top > 90").select("device", "day")
    r = r.withColumn("day", F.to_date("ts")).withColumn("elev", earth.sun_position(F.col("ts"), *PLACE)[1]).where("elev >= 5").join(live, ["device", "day"], "left_semi")
    kind = F.when(F.col("value") >= 150, "beam").when(F.col("value") < 50, "control").otherwise("mixed")
    return r.select("event_id", kind.alias("kind"))


def time_slot_forms(spark, sf_dir):
    """A time of day as minute, label, hour and half-hour slot; centred on the half hour before it; local and weekday."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    slot = (F.floor(minute / 30) * 30).cast("int")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Australia/Melbourne").cast("timestamp_ntz")
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return readings(spark, sf_dir).select(
        "event_id", minute.alias("minute"), F.concat(two(F.floor(slot / 60)), F.lit(":"), two(slot % 60)).alias("label"), F.floor(slot / 60).cast("int").alias("hour"), (slot % 60 == 0).alias("whole"),
        (F.col("ts") - F.expr("INTERVAL '30' MINUTE")).alias("centre"), local.alias("local"), F.weekday(local).alias("dow"), F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


FIT = PAIRED + f", c AS (SELECT season, hr, avg(bias) AS v, count(*) AS n FROM p WHERE hh < TIMESTAMP '{TRAIN_END}' GROUP BY 1, 2), f AS (SELECT c.season, hr, n, v - mid AS shape, mid AS level FROM c JOIN (SELECT season, avg(v) AS mid FROM c GROUP BY 1) x USING (season)), w AS (SELECT avg(bias) AS lv FROM p WHERE hh < TIMESTAMP '{TRAIN_END}'), b AS (SELECT p.*, coalesce(f.shape, 0) AS shape, lv FROM p LEFT JOIN f USING (season, hr), w)"
PLANS = {
    "agg_hour_profile_24": (agg_hour_profile_24, f"WITH {READINGS} SELECT s.site, g.hr::INTEGER AS hr, avg(r.value) AS mean FROM (SELECT DISTINCT site FROM r) s CROSS JOIN (SELECT unnest(range(24)) AS hr) g LEFT JOIN r ON r.site = s.site AND hour(r.ts) = g.hr AND r.ts::DATE = DATE '2024-01-05' GROUP BY 1, 2"),
    "agg_site_profile_full": (agg_site_profile_full, f"WITH {READINGS}, f AS (SELECT site, value FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ts, event_id) AS i FROM r WHERE value IS NOT NULL) WHERE i = 1) SELECT r.site, any_value(f.value) AS first, count(*) AS n, min(ts)::DATE AS from_day, max(ts)::DATE AS to_day, 100 * avg((r.value IS NOT NULL)::INT) AS pct, quantile_cont(r.value, 0.5) AS median FROM r LEFT JOIN f USING (site) GROUP BY r.site"),
    "agg_percentiles": (agg_percentiles, "SELECT p_brand, quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"),
    "agg_median_impute": (agg_median_impute, f"WITH {READINGS}, g AS (SELECT site, k % 10 AS kind, median(value) AS m FROM r GROUP BY 1, 2 HAVING count(value) >= 20) SELECT event_id, coalesce(value, m, (SELECT median(value) FROM r)) AS value, value IS NULL AS imputed FROM r LEFT JOIN g ON g.site = r.site AND g.kind = r.k % 10"),
    "agg_strata_median_diff": (agg_strata_median_diff, f"WITH {READINGS}, a AS (SELECT site, median(value) AS m, count(value) AS n FROM r WHERE k >= 50 GROUP BY 1 HAVING count(value) >= 10), b AS (SELECT site, median(value) AS m, count(value) AS n FROM r WHERE k < 50 GROUP BY 1 HAVING count(value) >= 10) SELECT site, a.m - b.m AS diff, least(a.n, b.n) AS n FROM a JOIN b USING (site)"),
    "agg_daily_ratio": (agg_daily_ratio, f"WITH {READINGS} SELECT ts::DATE AS day, count(value) AS n, sum(value) FILTER (site = 'click') AS beam, sum(value) FILTER (site = 'view') AS light, beam / nullif(light, 0) AS ratio FROM r GROUP BY 1"),
    "agg_pivot_24x4": (agg_pivot_24x4, f"WITH {PAIRED}, c AS (SELECT season, hr, avg(bias) AS v FROM p GROUP BY 1, 2), z AS (SELECT s AS season, avg(v) AS mid FROM (SELECT unnest(['DJF', 'MAM', 'JJA', 'SON']) AS s) LEFT JOIN c ON c.season = s GROUP BY 1), q AS (SELECT g.hr, z.season, coalesce(c.v, z.mid) AS v FROM (SELECT unnest(range(24)) AS hr) g CROSS JOIN z LEFT JOIN c ON c.hr = g.hr AND c.season = z.season) SELECT hr::INTEGER AS hr, max(v) FILTER (season = 'DJF') AS DJF, max(v) FILTER (season = 'MAM') AS MAM, max(v) FILTER (season = 'JJA') AS JJA, max(v) FILTER (season = 'SON') AS SON FROM q GROUP BY 1"),
    "agg_centre_shape": (agg_centre_shape, f"WITH {PAIRED}, c AS (SELECT season, hr, avg(bias) AS v, count(*) AS n FROM p GROUP BY 1, 2) SELECT c.season, hr::INTEGER AS hr, n, v - mid AS shape FROM c JOIN (SELECT season, avg(v) AS mid FROM c GROUP BY 1) USING (season)"),
    "agg_bias_fit": (agg_bias_fit, f"WITH {FIT} SELECT season, hr::INTEGER AS hr, n, shape, level FROM f"),
    "agg_fit_full": (agg_fit_full, f"WITH {FIT}, t AS (SELECT * FROM p WHERE hh < TIMESTAMP '{TRAIN_END}'), g AS (SELECT hr, avg(bias) AS v FROM t GROUP BY 1) SELECT f.season, f.hr::INTEGER AS hr, f.shape, g.v - (SELECT avg(v) FROM g) AS pooled, m.* FROM f JOIN g ON f.hr = g.hr CROSS JOIN (SELECT avg(bias) AS level, count(*) AS rows, count(DISTINCT device) AS devices, min(hh)::DATE AS from_day, max(hh)::DATE AS to_day FROM t) m"),
    "agg_skill": (agg_skill, f"WITH {PAIRED}, x AS (SELECT device::VARCHAR AS device, obs, mod, bias FROM p UNION ALL SELECT 'ALL', obs, mod, bias FROM p) SELECT device, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg(bias) END AS bias, CASE WHEN count(*) >= 3 THEN sqrt(avg(bias ** 2)) END AS rmse, CASE WHEN count(*) >= 3 THEN corr(mod, obs) END AS r FROM x GROUP BY 1"),
    "agg_named_groups": (agg_named_groups, f"WITH {FIT}, g AS (SELECT 'all' AS grp, * FROM b UNION ALL SELECT 'even', * FROM b WHERE device % 2 = 0 UNION ALL SELECT 'late', * FROM b WHERE hr >= 12), s AS (SELECT grp, 'none' AS mode, count(*) AS n, sqrt(avg(bias ** 2)) AS rmse FROM g GROUP BY 1 UNION ALL SELECT grp, 'shape', count(*), sqrt(avg((bias - shape) ** 2)) FROM g GROUP BY 1 UNION ALL SELECT grp, 'shape_level', count(*), sqrt(avg((bias - shape - lv) ** 2)) FROM g GROUP BY 1) SELECT s.grp, s.mode, s.n, s.rmse, 100 * (1 - s.rmse / z.rmse) AS gain FROM s JOIN s z ON z.grp = s.grp AND z.mode = 'none' WHERE s.n >= 100"),
    "agg_leave_one_out_refit": (agg_leave_one_out_refit, f"WITH {PAIRED}, d AS (SELECT DISTINCT device FROM p), o AS (SELECT d.device, x.hr, avg(x.bias) AS off FROM d JOIN p x ON x.device <> d.device GROUP BY 1, 2) SELECT p.device, count(*) AS n, sqrt(avg(bias ** 2)) AS raw, sqrt(avg((bias - coalesce(off, 0)) ** 2)) AS left_out FROM p LEFT JOIN o ON o.device = p.device AND o.hr = p.hr GROUP BY 1"),
    "agg_mae_vs_baseline": (agg_mae_vs_baseline, f"WITH {FIT}, s AS (SELECT season, 'base' AS model, avg(abs(bias)) AS mae, sqrt(avg(bias ** 2)) AS rmse FROM b GROUP BY 1 UNION ALL SELECT season, 'shape', avg(abs(bias - shape)), sqrt(avg((bias - shape) ** 2)) FROM b GROUP BY 1) SELECT s.*, 100 * (1 - s.mae / z.mae) AS pct FROM s JOIN s z ON z.season = s.season AND z.model = 'base'"),
    "agg_candidates": (agg_candidates, f"WITH {PAIRED} SELECT lead::INTEGER AS lead, count(q.bias) AS n, sqrt(avg((p.mod - q.bias - p.obs) ** 2)) AS rmse, avg(abs(p.mod - q.bias - p.obs)) AS mae FROM p CROSS JOIN (SELECT unnest([0, 1, 2, 3, 6, 12]) AS lead) LEFT JOIN p q ON q.device = p.device AND q.hh = p.hh - to_hours(lead) GROUP BY 1"),
    "agg_pair_noise": (agg_pair_noise, f"WITH {HOURLY} SELECT a.device, count(*) AS n, avg(a.value - b.value) AS bias, sqrt(avg((a.value - b.value) ** 2)) AS rmse, max(abs(a.value - b.value)) AS most FROM h a JOIN h b ON b.device = a.device + 1 AND a.hh = b.hh WHERE a.device % 2 = 1 GROUP BY 1"),
    "agg_board_screen": (agg_board_screen, f"WITH {READINGS}, y AS (SELECT device, ts::DATE AS day, max(value) - min(value) AS span, max(value) AS top FROM r GROUP BY 1, 2), z AS (SELECT device, median(span) AS span, count(*) FILTER (top > 90) AS live, count(*) AS days FROM y GROUP BY 1), f AS (SELECT DISTINCT ON (device) device, site FROM r ORDER BY device, ts, event_id), t AS (SELECT device, count(*) AS n, avg(value) FILTER (hour(ts) < 6 OR hour(ts) >= 20) / avg(value) FILTER (hour(ts) BETWEEN 6 AND 19) AS night FROM r GROUP BY 1) SELECT device, site, n, night, live, days, span, coalesce(span >= 30 AND live >= 3, false) AS kept FROM t JOIN f USING (device) JOIN z USING (device)"),
    "win_lag_scan": (win_lag_scan, f"WITH {PAIRED}, i AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY hh) AS i FROM p), c AS (SELECT a.device, l.lag, corr(a.obs, b.mod) AS r FROM i a CROSS JOIN (SELECT unnest(range(-3, 4)) AS lag) l LEFT JOIN i b ON b.device = a.device AND b.i = a.i - l.lag GROUP BY 1, 2), n AS (SELECT device, count(*) AS n FROM p GROUP BY 1) SELECT device, n, lag::INTEGER AS lag, r FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY r DESC, abs(lag), lag) AS k FROM c) JOIN n USING (device) WHERE k = 1 AND n >= 20"),
    "win_argmax_hour": (win_argmax_hour, f"WITH {READINGS}, m AS (SELECT site, hour(ts) AS hr, avg(value) AS v FROM r GROUP BY 1, 2) SELECT site, hr::INTEGER AS hr, v FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY v DESC, hr) AS k FROM m) WHERE k = 1"),
    "win_interp_clock": (win_interp_clock, f"WITH {READINGS}, h AS (SELECT site, hour(ts) AS hr, avg(value) AS v FROM r WHERE ts::DATE = DATE '2024-01-05' GROUP BY 1, 2), s AS (SELECT * FROM (SELECT DISTINCT site FROM h), (SELECT unnest(range(0, 1440, 30)) AS slot)) SELECT s.site, slot::INTEGER AS slot, coalesce(a.v * (1 - slot % 60 / 60) + b.v * (slot % 60 / 60), a.v, b.v) AS v FROM s LEFT JOIN h a ON a.site = s.site AND a.hr = slot // 60 LEFT JOIN h b ON b.site = s.site AND b.hr = (slot // 60 + 1) % 24"),
    "win_rad_slots": (win_rad_slots, f"WITH {READINGS}, q AS (SELECT site, (hour(ts) * 60 + minute(ts)) // 15 AS q, avg(value) FILTER (k % 3 = 0) AS a, avg(value) FILTER (k % 3 = 1) AS b FROM r GROUP BY 1, 2) SELECT site, (q // 2 * 30)::INTEGER AS slot, CASE WHEN count(b) > 0 THEN avg(a) END AS direct, CASE WHEN count(a) > 0 THEN avg(b) END AS diffuse, CASE WHEN count(a) > 0 AND count(b) > 0 THEN 'minutely_15' ELSE 'hourly' END AS rad_source FROM q GROUP BY site, q // 2"),
    "agg_source_label": (agg_source_label, f"WITH {READINGS}, q AS (SELECT site, (hour(ts) * 60 + minute(ts)) // 30 AS s, count(value) FILTER (k % 3 = 0) > 0 AND count(value) FILTER (k % 3 = 1) > 0 AS good FROM r GROUP BY 1, 2), c AS (SELECT site, count(*) FILTER (good) AS n, count(*) AS m FROM q GROUP BY 1) SELECT site, CASE WHEN n = m THEN 'minutely_15' WHEN n = 0 THEN 'hourly' ELSE format('minutely_15 on {{}}/{{}}', n, m) END AS label, n > 0 AS any, n = 0 AS none FROM c"),
    "agg_clear_sky": (agg_clear_sky, f"WITH {READINGS}, sun AS ({SUN}), e AS (SELECT r.*, elevation AS el FROM r JOIN sun USING (event_id) WHERE value IS NOT NULL AND k <= 20), t AS (SELECT site, value / (1098 * sin(radians(el)) * exp(-0.059e0 / sin(radians(el)))) AS kt FROM e WHERE el > 20) SELECT site, count(*) AS n, avg(kt) AS kt, stddev_samp(kt) AS sd, avg(least(kt, 1.2)) AS clipped FROM t GROUP BY 1"),
    "rank_best_day": (rank_best_day, f"WITH {READINGS}, d AS (SELECT ts::DATE AS day, count(DISTINCT device) * 1000 + max(value) AS score, CASE WHEN max(value) < 250 THEN 'mild' WHEN avg(k) < 50 THEN 'hot_clear' ELSE 'hot_dull' END AS kind FROM r WHERE value IS NOT NULL GROUP BY 1) SELECT kind, days, day, score FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS days, row_number() OVER (PARTITION BY kind ORDER BY score DESC, day DESC) AS i FROM d) WHERE i = 1"),
    "flt_gates": (flt_gates, f"WITH {READINGS}, sun AS ({SUN}) SELECT a.event_id, CASE WHEN value >= 150 THEN 'beam' WHEN value < 50 THEN 'control' ELSE 'mixed' END AS kind FROM r a JOIN sun USING (event_id) WHERE elevation >= 5 AND EXISTS (SELECT 1 FROM r b WHERE b.device = a.device AND b.ts::DATE = a.ts::DATE AND b.value > 90)"),
    "time_slot_forms": (time_slot_forms, f"WITH {READINGS}, t AS (SELECT event_id, ts, (hour(ts) * 60 + minute(ts))::INTEGER AS minute, ts + INTERVAL 11 HOUR AS local FROM r) SELECT event_id, minute, format('{{:02d}}:{{:02d}}', minute // 30 * 30 // 60, minute // 30 * 30 % 60) AS label, (minute // 60)::INTEGER AS hour, minute % 60 < 30 AS whole, ts - INTERVAL 30 MINUTE AS centre, local, (isodow(local) - 1)::INTEGER AS dow, strftime(local, '%Y-%m-%dT%H:%M:%S') AS iso FROM t"),
}
