"""Queries whose plan is plain SQL, the same text for both engines. Views: the tables, and those of PRELUDE."""

from __future__ import annotations

#: Sensor readings (quality code in props, values outside the valid range become null), their hourly means, the model
#: series (mean of all devices), route legs, route options, points, and the day class that stands for a season.
#: {first}: the number of an array's first element; {json}: the engine's function that takes a text value out of JSON.
PRELUDE = {
    "readings": r"SELECT event_id, user_id AS device, event_type AS site, ts, date_trunc('hour', ts) AS hh, CAST({json}(props, '$.k') AS INT) AS k, CASE WHEN value BETWEEN 1 AND 400 THEN value END AS value FROM events",
    "hourly": "SELECT device, hh, avg(value) AS value, count(value) AS n FROM readings GROUP BY device, hh HAVING count(value) > 0",
    "model": "SELECT hh, avg(value) AS value FROM hourly GROUP BY hh",
    "paired": "SELECT h.device, h.hh, extract(hour FROM h.hh) AS hr, CASE WHEN extract(day FROM h.hh) % 7 IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS cls, m.value - h.value AS bias, h.value AS obs, m.value AS mod FROM hourly h JOIN model m ON h.hh = m.hh",
    "legs": "SELECT l_orderkey AS route, l_linenumber AS seq, l_quantity AS len, l_discount AS shade, l_tax * 100 AS uv, l_returnflag AS state, l_extendedprice / l_quantity / 50 AS stress, l_partkey AS part, l_extendedprice AS price FROM lineitem",
    "options": "SELECT l_orderkey AS route, o_custkey AS od, sum(l_quantity) AS minutes, round(sum(l_quantity * (1 - l_discount)), 4) AS load, count(*) AS doors FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey",
    "points": "SELECT vec_id, label, embedding[{first}] * 100e0 AS x, embedding[{first} + 1] * 100e0 AS y FROM embeddings",
}

SHARED = {
    "scan_qc_null_out": "SELECT event_id, k, round(value, 4) AS value, value IS NULL AS bad FROM readings",
    "filter_in_null_safe": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IS NOT NULL",
    "filter_range_bbox": "SELECT vec_id FROM points WHERE x BETWEEN -10 AND 10 AND y BETWEEN -10 AND 10",
    "filter_case_when_class": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.02 THEN 'open' WHEN l_discount < 0.06 THEN 'part' ELSE 'covered' END AS cover FROM lineitem",
    "join_inner_multikey": "SELECT h.device, h.hh, h.n, count(*) AS m FROM hourly h JOIN readings r ON h.device = r.device AND h.hh = r.hh GROUP BY h.device, h.hh, h.n",
    "join_left_24h_grid": "SELECT g.hr, c.cls, count(p.bias) AS n FROM (SELECT explode(sequence(0, 23)) AS hr) g CROSS JOIN (VALUES ('weekday'), ('weekend')) AS c(cls) LEFT JOIN paired p ON p.hr = g.hr AND p.cls = c.cls GROUP BY g.hr, c.cls",
    "join_outer_dropna": "SELECT coalesce(a.device, b.device) AS device, a.n AS na, b.n AS nb FROM (SELECT device, count(*) AS n FROM readings WHERE site = 'click' GROUP BY device) a FULL OUTER JOIN (SELECT device, count(*) AS n FROM readings WHERE site = 'view' GROUP BY device) b ON a.device = b.device WHERE a.n IS NOT NULL AND b.n IS NOT NULL",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "join_left_null_not_true": "SELECT c.c_custkey, coalesce(o.open, FALSE) AS open FROM customer c LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1 AS open FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey",
    "join_time_offset": "SELECT k.k, count(*) AS n, round(avg(abs(a.value - b.value)), 4) AS mad FROM model a CROSS JOIN (VALUES (1), (2), (3), (6), (12)) AS k(k) JOIN model b ON b.hh = a.hh + k.k * INTERVAL '1' HOUR GROUP BY k.k",
    "join_broadcast_dim": "SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "join_season_hour_offset": "SELECT p.device, p.hh, p.mod - o.shift AS fixed FROM paired p JOIN (SELECT cls, hr, avg(bias) AS shift FROM paired GROUP BY cls, hr) o ON p.cls = o.cls AND p.hr = o.hr",
    "join_interval_open_hours": "SELECT r.event_id, h.name FROM readings r JOIN (VALUES ('early', 6, 10), ('day', 10, 19), ('late', 18, 21)) AS h(name, opens, closes) ON extract(hour FROM r.ts) >= h.opens AND extract(hour FROM r.ts) < h.closes",
    "join_bin_right_search": "SELECT b.bin, count(*) AS n FROM readings r JOIN (VALUES (0, 0.0, 10.0), (1, 10.0, 50.0), (2, 50.0, 100.0), (3, 100.0, 1000.0)) AS b(bin, lo, hi) ON r.value >= b.lo AND r.value < b.hi GROUP BY b.bin",
    "join_bin_right_closed": "SELECT b.bin, count(*) AS n FROM readings r JOIN (VALUES (0, 0.0, 10.0), (1, 10.0, 50.0), (2, 50.0, 100.0), (3, 100.0, 1000.0)) AS b(bin, lo, hi) ON r.value > b.lo AND r.value <= b.hi GROUP BY b.bin",
    "join_bbox_first_match": "SELECT vec_id, coalesce(zone, 'none') AS zone FROM (SELECT p.vec_id, z.zone, row_number() OVER (PARTITION BY p.vec_id ORDER BY z.ord) AS rn FROM points p LEFT JOIN (VALUES (1, 'core', -5.0, 5.0), (2, 'inner', -15.0, 15.0), (3, 'outer', -30.0, 30.0)) AS z(ord, zone, lo, hi) ON p.x BETWEEN z.lo AND z.hi AND p.y BETWEEN z.lo AND z.hi) t WHERE rn = 1",
    "gather_raster_mean": "SELECT cx, cy, count(*) AS n, round(avg(label), 4) AS mean FROM (SELECT floor(x / 5) AS cx, floor(y / 5) AS cy, label FROM points) t GROUP BY cx, cy",
    "gather_raster_mode": "SELECT cx, cy, label FROM (SELECT cx, cy, label, row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, label) AS rn FROM (SELECT floor(x / 5) AS cx, floor(y / 5) AS cy, label, count(*) AS n FROM points GROUP BY 1, 2, 3) a) b WHERE rn = 1",
    "agg_hour_profile": "SELECT extract(hour FROM hh) AS hr, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM hourly GROUP BY 1",
    "agg_site_profile": "SELECT site, count(*) AS n, count(value) AS good, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM readings GROUP BY site",
    "agg_two_level_having": "SELECT device, count(*) AS days, avg(hi) AS mean_max FROM (SELECT device, CAST(hh AS DATE) AS d, max(value) AS hi FROM hourly GROUP BY device, CAST(hh AS DATE) HAVING count(*) >= 2) t GROUP BY device HAVING count(*) >= 3",
    "agg_pct_non_null": "SELECT site, round(100e0 * count(value) / count(*), 3) AS pct FROM readings GROUP BY site",
    "agg_pivot_class_hour": "SELECT hr, round(avg(CASE WHEN cls = 'weekday' THEN bias END), 4) AS weekday, round(avg(CASE WHEN cls = 'weekend' THEN bias END), 4) AS weekend FROM paired GROUP BY hr",
    "agg_skill_rollup": "SELECT coalesce(cls, 'ALL') AS grp, count(*) AS n, round(avg(-bias), 4) AS bias, round(avg(abs(bias)), 4) AS mae, round(sqrt(avg(bias * bias)), 4) AS rmse FROM paired GROUP BY ROLLUP (cls)",
    "agg_leave_one_out": "SELECT d.device, round((t.s - d.s) / (t.n - d.n), 4) AS mean_without, t.n - d.n AS n FROM (SELECT device, sum(bias) AS s, count(*) AS n FROM paired GROUP BY device) d CROSS JOIN (SELECT sum(bias) AS s, count(*) AS n FROM paired) t",
    "agg_vs_baseline": "SELECT p.cls, round(sqrt(avg(bias * bias)), 4) AS base, round(100e0 * (1e0 - sqrt(avg((bias - o.shift) * (bias - o.shift))) / nullif(sqrt(avg(bias * bias)), 0)), 3) AS gain_pct FROM paired p JOIN (SELECT cls, hr, avg(bias) AS shift FROM paired GROUP BY cls, hr) o ON p.cls = o.cls AND p.hr = o.hr GROUP BY p.cls",
    "agg_contingency": "SELECT sum(CASE WHEN mod > 100 AND obs > 100 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN mod > 100 AND obs <= 100 THEN 1 ELSE 0 END) AS false_alarm, sum(CASE WHEN mod <= 100 AND obs > 100 THEN 1 ELSE 0 END) AS miss, sum(CASE WHEN mod <= 100 AND obs <= 100 THEN 1 ELSE 0 END) AS correct_no FROM paired",
    "agg_threshold_sweep": "SELECT t.t, sum(CASE WHEN obs > t.t THEN 1 ELSE 0 END) AS above, count(*) AS n FROM paired CROSS JOIN (VALUES (25), (50), (100), (200)) AS t(t) GROUP BY t.t",
    "agg_histogram": "SELECT CAST(floor(value / 25) AS INT) AS bin, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1",
    "agg_census_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS len FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT site, cohort, count(*) AS n FROM (SELECT site, device % 3 AS cohort FROM readings) q GROUP BY GROUPING SETS ((site), (cohort), ())",
    "agg_quartic_mean": "SELECT device, round(power(avg(power(value + 273.15e0, 4)), 0.25e0) - 273.15e0, 4) AS radiant FROM hourly GROUP BY device",
    "agg_count_distinct": "SELECT site, count(DISTINCT device) AS devices, count(DISTINCT hh) AS hours FROM readings GROUP BY site",
    "agg_regression": "SELECT p_brand, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2, round(corr(l_extendedprice, l_quantity), 4) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "agg_route_summary": "SELECT route, count(*) AS legs, sum(len) AS metres, sum(len) / 81e0 AS minutes, sum(len * shade) / sum(len) AS shaded, max(stress) AS peak FROM legs GROUP BY route",
    "agg_route_dose": "SELECT route, round(sum(len / 81e0 * stress), 4) AS dose FROM legs GROUP BY route",
    "agg_route_uv": "SELECT route, round(sum(len / 81e0 * uv * (1e0 - shade)) * 60e0 * 0.025e0 / 100e0, 5) AS sed FROM legs GROUP BY route",
    "agg_delta_baseline": "SELECT o.route, o.od, round(o.minutes - b.m, 4) AS extra, round(b.l - o.load, 4) AS avoided FROM options o JOIN (SELECT od, min(minutes) AS m, max(load) AS l FROM options GROUP BY od) b ON o.od = b.od",
    "win_lag": "SELECT device, hh, round(value - lag(value) OVER (PARTITION BY device ORDER BY hh), 4) AS step FROM hourly",
    "win_circular_next_mean": "SELECT hr, round((v + coalesce(lead(v) OVER (ORDER BY hr), first_value(v) OVER (ORDER BY hr))) / 2e0, 4) AS mid FROM (SELECT hr, avg(obs) AS v FROM paired GROUP BY hr) t",
    "win_run_length": "SELECT route, state, min(seq) AS first_seq, count(*) AS legs FROM (SELECT route, seq, state, row_number() OVER (PARTITION BY route ORDER BY seq, part, price) - row_number() OVER (PARTITION BY route, state ORDER BY seq, part, price) AS run FROM legs) t GROUP BY route, state, run",
    "win_state_changes": "SELECT route, sum(CASE WHEN was IS NOT NULL AND was <> state THEN 1 ELSE 0 END) AS doors FROM (SELECT route, state, lag(state) OVER (PARTITION BY route ORDER BY seq, part, price) AS was FROM legs) t GROUP BY route",
    "win_linear_interp": "SELECT device, hh, pv + (nv - pv) * (({epoch_hh}) - pt) / (nt - pt) AS filled FROM (SELECT device, hh, lag(value) OVER w AS pv, lead(value) OVER w AS nv, lag({epoch_hh}) OVER w AS pt, lead({epoch_hh}) OVER w AS nt FROM hourly WINDOW w AS (PARTITION BY device ORDER BY hh)) t WHERE pv IS NOT NULL AND nv IS NOT NULL",
    "rank_three_key": "SELECT od, route, row_number() OVER (PARTITION BY od ORDER BY minutes, load, route) AS place FROM options",
    "rank_argmin_badges": "SELECT od, max(CASE WHEN qm = 1 THEN route END) AS quickest, max(CASE WHEN ql = 1 THEN route END) AS coolest FROM (SELECT od, route, row_number() OVER (PARTITION BY od ORDER BY minutes, route) AS qm, row_number() OVER (PARTITION BY od ORDER BY load, route) AS ql FROM options) t GROUP BY od",
    "rank_recommend": "SELECT od, route FROM (SELECT od, route, row_number() OVER (PARTITION BY od ORDER BY minutes + 0.1e0 * load, route) AS rn, count(*) OVER (PARTITION BY od) AS n FROM options) t WHERE rn = 1 AND n > 1",
    "rank_topk": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3",
    "rank_painter_last_wins": "SELECT device, event_id, site FROM (SELECT device, event_id, site, row_number() OVER (PARTITION BY device ORDER BY ts DESC, event_id DESC) AS rn FROM readings) t WHERE rn = 1",
    "set_union_all": "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey AS nation, 'customer' AS kind FROM customer",
    "set_intersect": "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey AS nation FROM customer",
    "set_except": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'",
    "set_dedupe_first": "SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY {digest}",
    "graph_degree": "SELECT c_nationkey AS node, count(*) AS degree FROM customer GROUP BY c_nationkey",
    "time_slot_snap": "SELECT event_id, CAST({half_even}((extract(hour FROM ts) * 60 + extract(minute FROM ts)) / 30e0, 0) AS INT) * 30 % 1440 AS slot FROM readings",
    "time_season": "SELECT o_orderkey, CASE WHEN extract(month FROM o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN extract(month FROM o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN extract(month FROM o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season FROM orders",
    "phys_stress_cost": "SELECT route, seq, part, price, CASE WHEN stress < 9 THEN 9e0 - stress WHEN stress > 26 THEN stress - 26e0 ELSE 0e0 END AS strain, len / 81e0 * (1e0 + 0.1e0 * CASE WHEN stress < 9 THEN 9e0 - stress WHEN stress > 26 THEN stress - 26e0 ELSE 0e0 END) AS cost FROM legs",
    "scan_composite_split": "SELECT p_partkey, split(p_name, ' ')[{first}] AS head, split(p_name, ' ')[{first} + 1] AS tail FROM part",
    "join_intersect_time": "SELECT DISTINCT a.hh FROM readings a WHERE a.site = 'click' AND EXISTS (SELECT 1 FROM readings b WHERE b.hh = a.hh AND b.site = 'view')",
    "agg_named_groups_modes": "SELECT device, site, n FROM (SELECT device, site, n, row_number() OVER (PARTITION BY device ORDER BY n DESC, site) AS rn FROM (SELECT device, site, count(*) AS n FROM readings GROUP BY device, site) a) b WHERE rn = 1",
    "win_row_lag_corr": "SELECT device, count(was) AS n, round(corr(value, was), 4) AS r FROM (SELECT device, value, lag(value) OVER (PARTITION BY device ORDER BY hh) AS was FROM hourly) t WHERE was IS NOT NULL GROUP BY device HAVING count(was) >= 3",
    "win_running_dose": "SELECT route, seq, part, round(sum(len / 81e0 * stress) OVER (PARTITION BY route ORDER BY seq, part, price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS dose FROM legs",
    "rank_recents": "SELECT device, site, place FROM (SELECT device, site, row_number() OVER (PARTITION BY device ORDER BY last DESC, site) AS place FROM (SELECT device, site, max(ts) AS last FROM readings GROUP BY device, site) a) b WHERE place <= 8",
    "set_upsert_last_wins": "SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY age DESC) AS rn FROM (SELECT c_custkey AS id, c_name AS name, 0 AS age FROM customer UNION ALL SELECT s_suppkey AS id, s_name AS name, 1 AS age FROM supplier) u) t WHERE rn = 1",
    "time_floor_hour": "SELECT event_id, hh, CAST(extract(minute FROM ts) AS INT) AS past FROM readings",
    "raster_shift": "SELECT g.cx, g.cy, g.h, coalesce(e.h, 0) AS east, coalesce(n.h, 0) AS north FROM (SELECT CAST(floor(x / 5) AS INT) AS cx, CAST(floor(y / 5) AS INT) AS cy, max(label) AS h FROM points GROUP BY 1, 2) g LEFT JOIN (SELECT CAST(floor(x / 5) AS INT) AS cx, CAST(floor(y / 5) AS INT) AS cy, max(label) AS h FROM points GROUP BY 1, 2) e ON e.cx = g.cx + 1 AND e.cy = g.cy LEFT JOIN (SELECT CAST(floor(x / 5) AS INT) AS cx, CAST(floor(y / 5) AS INT) AS cy, max(label) AS h FROM points GROUP BY 1, 2) n ON n.cx = g.cx AND n.cy = g.cy + 1",
    "phys_contingency_scores": "SELECT round(a / nullif(a + c, 0), 4) AS pod, round(b / nullif(b + d, 0), 4) AS pofd, round(a / nullif(a + c, 0) - b / nullif(b + d, 0), 4) AS pss, round((a + b) / nullif(a + c, 0), 4) AS freq_bias FROM (SELECT 1e0 * sum(CASE WHEN mod > 100 AND obs > 100 THEN 1 ELSE 0 END) AS a, 1e0 * sum(CASE WHEN mod > 100 AND obs <= 100 THEN 1 ELSE 0 END) AS b, 1e0 * sum(CASE WHEN mod <= 100 AND obs > 100 THEN 1 ELSE 0 END) AS c, 1e0 * sum(CASE WHEN mod <= 100 AND obs <= 100 THEN 1 ELSE 0 END) AS d FROM paired) t",
    "phys_k_multiplier": "SELECT l_orderkey, l_linenumber, round(power(1.8e0, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END), 4) AS k FROM lineitem",
}
