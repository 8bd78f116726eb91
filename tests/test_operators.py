"""Operators on small fixtures: closed forms, brute force and odd input."""

import datetime as dt
import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions import comfort, earth, ways
from heatloom.operators import graph, joins, raster, tiles
from heatloom.operators.quantiles import exact_quantiles
from heatloom.operators.skyline import pareto
from heatloom.plans import catalog, routes, tables

DAY = dt.datetime(2024, 1, 31, 22)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(x):
    return F.lit(None if x is None else float(x)).cast("double")


@pytest.mark.parametrize("hours", [24.0, 1.0])
def test_asof_with_nulls_and_ends_of_months(spark, hours):
    at = lambda h: DAY + dt.timedelta(hours=h)
    right = spark.createDataFrame([(1, at(0), 1.0), (1, at(3), None), (1, None, 9.0), (None, at(1), 8.0), (1, at(30), 5.0), (2, at(1), 2.0), (2, at(1), 3.0)], "k int, ts timestamp_ntz, v double")
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate([(1, at(-1)), (1, at(0)), (1, at(2)), (1, at(4)), (1, at(29)), (2, at(90)), (3, at(1)), (None, at(1)), (1, None)])], "id int, k int, ts timestamp_ntz")
    got = {r.id: r.v for r in joins.asof_backward(left, right, "k", "ts", "v", hours).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: None, 4: None, 5: 3.0, 6: None, 7: None, 8: None}
    got = {r.id: r.v for r in joins.asof_nearest(left, right, "k", "ts", "v", hours).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None, 3: None, 4: 5.0, 5: 3.0, 6: None, 7: None, 8: None}


def test_quantiles_of_uneven_groups(spark):
    rng = random.Random(1)
    groups = {"a": [5.0] * 900 + [1.0], "b": [rng.gauss(0, 1) for _ in range(501)], "c": [float(i % 7) for i in range(1000)], None: [2.0], "e": [None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("b", None)]
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
    assert set(got) == set(groups) - {"e"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile(groups[g], probs))
    assert exact_quantiles(spark.createDataFrame(rows, "g string, v double").limit(0), ["g"], "v", [0.5]).collect() == []


def test_pareto_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), float(rng.randrange(12)), float(rng.randrange(12))) for i in range(300)] + [(900, "a", None, 1.0)]
    got = {r.id for r in pareto(spark.createDataFrame(rows, "id int, g string, x double, y double"), "g", "x", "y", lots=3).collect()}
    good = [r for r in rows if r[2] is not None]
    assert got == {i for i, g, x, y in good if not any(h == g and u <= x and v <= y and (u < x or v < y) for _, h, u, v in good)}


def brute_state_search(edges, start, door, jump):
    out = {}
    for a, b, cost, *kind in edges:
        out.setdefault(a, []).append((b, cost, tuple(kind)))
        out.setdefault(b, []).append((a, cost, tuple(kind)))
    best, heap = {}, [(0.0, start, None)]
    while heap:
        c, n, s = heapq.heappop(heap)
        if (n, s) in best:
            continue
        best[n, s] = c
        for m, cost, k in out.get(n, []):
            more = 0.0 if s is None else (door if s[0] != k[0] else 0) + (0 if s[2] or k[2] else jump * abs(s[1] - k[1]))
            if (m, k) not in best:
                heapq.heappush(heap, (c + cost + more, m, k))
    low = {}
    for (n, _), c in best.items():
        low[n] = min(c, low.get(n, c))
    return low


def test_state_search_is_cheapest(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(1, 9)), rng.random() < 0.5, rng.randint(0, 2), rng.random() < 0.2) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long, cost double, indoor boolean, level int, stepped boolean")
    found = graph.cheapest_by_state(df, edges[0][0], 4.0, 3.0).collect()
    assert {r.node: r.cost for r in found} == pytest.approx(brute_state_search(edges, edges[0][0], 4.0, 3.0))
    assert all(r.path[0] == edges[0][0] and r.path[-1] == r.node for r in found)


def test_preferred_route_is_relaxed_and_capped(spark):
    # the shady way is 1.3 times as long, the shadiest 2 times
    rows = [(0, 1, 100.0, 10.0), (0, 2, 65.0, 1.0), (2, 1, 65.0, 1.0), (0, 3, 100.0, 0.0), (3, 1, 100.0, 0.0)]
    e = spark.createDataFrame([(a, b, n, s, False, 0, False) for a, b, n, s in rows], "a long, b long, length double, bad double, indoor boolean, level int, stepped boolean")
    go = lambda k: graph.preferred(e, 0, 1, k, F.col("bad")).first()
    assert go(0.0).path == [0, 1] and go(0.0).attempts == 0
    assert go(0.1).path == [0, 2, 1] and go(0.1).ratio == pytest.approx(1.3)
    strong = go(1.0)
    assert strong.path == [0, 2, 1] and strong.k == 0.5 and strong.attempts == 1
    assert go(1000.0).path == [0, 1] and go(1000.0).k == 0.0
    assert graph.preferred(e, 0, 99, 1.0, F.col("bad")).first().path is None


def test_largest_component_and_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13)], "a long, b long")
    assert {r.node for r in graph.largest_component(e).collect()} == {10, 11, 12, 13}
    assert {r.node for r in graph.ends(e).collect()} == {1, 3, 10, 13}


def test_points_in_a_polygon_with_a_hole(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    edges = F.concat(joins.ring_edges(ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))), joins.ring_edges(ring((4, 4), (6, 4), (6, 6), (4, 6))))
    polygons = spark.range(1).select(F.lit(1).alias("pid"), edges.alias("edges"))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0), (4, 9.5, 9.9), (5, -0.1, 5.0)], "id int, x double, y double")
    assert {r.id for r in joins.points_in_polygons(points, polygons, 3.0).collect()} == {1, 4}


def grid(spark, height, n=21):
    rows = [(r, c, float(height(r, c))) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "row int, col int, h double")


def test_a_tower_throws_its_shadow(spark):
    cells = grid(spark, lambda r, c: 20 if (r, c) == (10, 15) else 0)
    dark = {(r.row, r.col) for r in raster.shadow(cells, 90.0, 45.0, 20.0, 2.0).where("shadow").collect()}
    assert dark == {(10, c) for c in range(15 - 9, 16)}  # the beam is 2 m higher each cell: below 20 m less the margin for nine; the ground below the tower is dark
    assert raster.shadow(cells, 90.0, 4.0, 20.0, 2.0).where("shadow").count() == 21 * 21
    crown = cells.withColumnRenamed("h", "top").withColumn("base", F.col("top") * 0.49)
    under = {(r.row, r.col) for r in raster.canopy_shadow(crown, 90.0, 45.0, 20.0, 2.0).where("under").collect()}
    assert under == {(10, c) for c in range(6, 11)}  # from the base's 9.8 m up
    raised = spark.createDataFrame([(1, 10, 8, 0.0), (2, 10, 8, 9.0), (3, 0, 0, 0.0)], "id int, row int, col int, z0 double")
    assert {r.id: r.shaded for r in raster.point_shade(raised, cells, 90.0, 45.0, 20.0, 2.0).collect()} == {1: True, 2: False, 3: False}


def test_sky_of_a_canyon_and_of_an_open_field(spark):
    # walls of 10 m at both sides of a street; from its middle line: the half width over the way to the edge
    cells = grid(spark, lambda r, c: 10 if c <= 12 or c >= 28 else 0, 41)
    got = {(r.row, r.col): r.svf for r in tiles.sky_view(cells, 2.0, azimuths=32, radius=80.0).collect()}
    assert abs(got[20, 20] - 16 / math.hypot(16, 8.9)) < 0.05
    assert all(r.svf == 1.0 for r in tiles.sky_view(grid(spark, lambda r, c: 0, 5), 2.0).collect())


def test_a_disc_overhead_hides_its_share(spark):
    cells = grid(spark, lambda r, c: 11.1 if math.hypot(r - 20, c - 20) * 2 <= 20 else 0, 41)
    got = {(r.row, r.col): r.blocked for r in tiles.blocked_above(cells, 2.0, radius=40.0).collect()}
    assert abs(got[20, 20] - 400 / (400 + 100)) < 0.05


def test_radiant_temperature_closes(spark):
    for svf in (0.0, 0.25, 0.5, 0.75, 1.0):  # the same temperature all around, by night, and walls and sky as black as they are
        sky = lit(1.0)
        t = comfort.radiant_temperature(lit(22), lit(svf), lit(0), lit(0), lit(0), lit(-5), lit(22), lit(22), sky)
        assert abs(one(spark, t=t).t - 22) < 1e-9
    sky = comfort.sky_emissivity(lit(27), comfort.vapour(lit(27), lit(45)), lit(0.2))
    square = comfort.radiant_temperature(lit(27), lit(0.9), lit(0), lit(610), lit(150), lit(48), lit(44), lit(29), sky)
    alley = comfort.radiant_temperature(lit(27), lit(0.2), lit(1), lit(610), lit(150), lit(48), lit(28), lit(27), sky)
    night = comfort.radiant_temperature(lit(27), lit(0.9), lit(0), lit(0), lit(0), lit(-20), lit(24), lit(27), sky)
    r = one(spark, square=square, alley=alley, night=night)
    assert r.night < r.alley < r.square and r.night < 27 and r.square - r.alley > 15


def test_saturation_formulas_agree(spark):
    """Three formulas against each other, and against the triple point and the boiling point of water (hPa)."""
    for ta in (-8, 3, 14, 27, 38):
        r = one(spark, a=comfort.sat_vapour(lit(ta)), b=comfort.sat_vapour_bolton(lit(ta)), c=comfort.sat_vapour_log(lit(ta)))
        assert max(r) / min(r) - 1 < 6e-3
    assert abs(one(spark, e=comfort.sat_vapour_log(lit(0.01))).e / 6.11657 - 1) < 1e-3
    assert abs(one(spark, e=comfort.sat_vapour_log(lit(99.974))).e / 1013.25 - 1) < 2e-2


def test_stress_and_categories(spark):
    r = one(spark, **{f"s{i}": comfort.stress(lit(x)) for i, x in enumerate((9, 26, 4, 31, None))}, c=comfort.stress_category(lit(26)), d=comfort.stress_category(lit(50)), n=comfort.stress_category(lit(None)))
    assert (r.s0, r.s1, r.s2, r.s3, r.s4) == (0, 0, 5, 5, None) and (r.c, r.d, r.n) == ("moderate heat stress", "extreme heat stress", None)


def test_climate_index_with_a_table_of_terms(spark):
    rng = np.random.default_rng(4)
    terms = [(float(rng.normal()) / 10 ** (a + b + c + d), a, b, c, d) for a in range(3) for b in range(3) for c in range(3) for d in range(2) if a + b + c + d <= 4]
    rows = [tuple(map(float, r)) for r in np.column_stack([rng.uniform(-20, 40, 50), rng.uniform(-20, 80, 50), rng.uniform(0.6, 16, 50), rng.uniform(1, 40, 50)])]
    df = spark.createDataFrame(rows, "t double, m double, v double, e double")
    got = [r.u for r in df.select(comfort.climate_index(*(F.col(c) for c in "tmve"), terms).alias("u")).collect()]
    for u, (t, m, v, e) in zip(got, rows):
        x = min(70.0, max(-30.0, m - t))
        assert u == pytest.approx(t + sum(k * t**a * v**b * x**c * (e / 10) ** d for k, a, b, c, d in terms))
    bad = [r.outside for r in spark.createDataFrame([(20.0, 20.0, 2.0), (60.0, 60.0, 2.0), (20.0, 20.0, 0.1), (20.0, 120.0, 2.0)], "t double, m double, v double").select(comfort.index_inputs(F.col("t"), F.col("m"), F.col("v"))["outside"].alias("outside")).collect()]
    assert bad == [False, True, True, True]


def test_march_reaches_its_steady_state(spark):
    row = F.struct(lit(400).alias("q"), lit(293.15).alias("air"), lit(10).alias("h"))
    out = one(spark, ts=comfort.march_day(F.array(*[row] * 24), lit(293.15), 24, 0.95, 1.5e5)).ts
    assert len(out) == 24
    low, high = 250.0, 350.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 400 - 0.95 * comfort.SIGMA * mid**4 - 10 * (mid - 293.15) > 0 else (low, mid)
    assert abs(out[-1] - low) < 0.005
    half = one(spark, ts=comfort.march_day(F.array(*[row] * 48), lit(293.15), 48, 0.95, 1.5e5)).ts
    assert max(abs(a - b) for a, b in zip(out, half[::2])) < 0.05


def test_sun_and_map_grid(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    az, el = earth.sun_position(at("2024-03-20 12:00:00"), 0.0, 0.0)  # equinox, equator: the sun is overhead at noon but for the equation of time
    r = one(spark, el=el, noon=earth.sun_position(at("2024-12-21 02:20:00"), -37.8136, 144.9631)[1], az=earth.sun_position(at("2024-06-21 02:22:00"), -37.8136, 144.9631)[0])
    assert r.el > 87 and abs(r.noon - (90 - 37.8136 + 23.44)) < 0.3 and (r.az < 2 or r.az > 358)
    x, y = earth.to_grid(lit(147), lit(0))
    x2, y2 = earth.to_grid(lit(144.9631), lit(-37.8136))
    r = one(spark, x=x, y=y, x2=x2, y2=y2, d=earth.metres(lit(-37.8136), lit(144.9631), lit(-37.8146), lit(144.9631)))
    assert abs(r.x - 500000) < 1e-6 and abs(r.y - 1e7) < 1e-6
    assert 320_000 < r.x2 < 321_500 and 5_812_000 < r.y2 < 5_814_000 and abs(r.d - 110.99 * 1.0) < 0.3


def test_piecewise_and_costs(spark):
    r = one(spark, a=comfort.piecewise(lit(0.4), [(0.2, 0.0), (0.6, 100.0)]), b=comfort.piecewise(lit(9), [(0.2, 0.0), (0.6, 100.0)]), c=comfort.piecewise(lit(None), [(0.2, 0.0), (0.6, 100.0)]), d=comfort.edge_cost(lit(100), lit(4), F.lit(False), lit(None), 0.3), e=comfort.edge_cost(lit(100), lit(4), F.lit(True), lit(5), 0.1))
    assert r.a == pytest.approx(50.0) and (r.b, r.c, r.d, r.e) == (100.0, None, 112.0, 150.0)


@pytest.mark.parametrize(("text", "at", "want"), [
    ("Fr-Mo 11:15-16:00; Tu 08:00-12:30", "2025-03-09 11:15", True), ("Fr-Mo 11:15-16:00; Tu 08:00-12:30", "2025-03-10 15:59", True), ("Fr-Mo 11:15-16:00; Tu 08:00-12:30", "2025-03-11 12:30", False),
    ("Fr-Mo 11:15-16:00; Tu 08:00-12:30", "2025-03-12 12:00", False), ("Th 05:05-05:10", "2025-03-13 05:09", True), ("Th 05:05-05:10", "2025-03-13 05:04", False), ("We,Sa 08:20-11:40,17:05-18:55", "2025-03-15 17:05", True),
    ("We,Sa 08:20-11:40,17:05-18:55", "2025-03-15 12:00", False), ("We,Sa 08:20-11:40,17:05-18:55", "2025-03-14 09:00", False), ("Tu-Sa 06:45-13:15; Th off", "2025-03-13 07:00", False), ("Tu-Sa 06:45-13:15; Th off", "2025-03-15 13:14", True),
    ("Mo-Su 19:30-04:15", "2025-03-12 23:59", True), ("Mo-Su 19:30-04:15", "2025-03-12 04:14", True), ("Mo-Su 19:30-04:15", "2025-03-12 04:15", False), ("24/7", "2025-12-31 23:59", True), ("00:00-24:00", "2025-01-01 00:00", True),
    ("dawn-dusk", "2025-03-12 12:00", None), ("Sa 07:00+", "2025-03-15 08:00", None), ("Oct-Dec 08:00-12:00", "2025-11-03 09:00", None), ("Sa 07:00-11:00 || Su 08:00-09:00", "2025-03-15 08:00", None), ("We-Th", "2025-03-12 12:00", None),
    ("12:15-12:15", "2025-03-12 12:15", None), ("ask inside", "2025-03-12 12:00", None), ("", "2025-03-12 12:00", None), (" \t", "2025-03-12 12:00", None), (None, "2025-03-12 12:00", None),
])
def test_opening_hours(spark, text, at, want):
    t = dt.datetime.fromisoformat(at)
    assert one(spark, o=ways.open_at(F.lit(text).cast("string"), F.lit(t.weekday()), F.lit(t.hour * 60 + t.minute))).o is want


def test_contingency_without_events(spark, tmp_path):
    spark.createDataFrame([(i, DAY + dt.timedelta(hours=i), 1, "click", 5.0, '{"k": 1}') for i in range(3)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    r = catalog.queries()["phys_contingency_scores"](spark, str(tmp_path)).first()
    assert r.pod is None and r.pofd == 0


def test_edges_between_suppliers_at_one_place(spark, tmp_path):
    spark.createDataFrame([(1, 1, 9798), (1, 2, 1), (1, 3, 2)], "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (9798,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.a, r.b): r.length for r in catalog.queries()["graph_edges"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(1, 2), (1, 9798)} and got[1, 9798] == 0.0


def test_quantiles_when_tasks_end_in_another_order(spark):
    values = np.random.default_rng(5).lognormal(3.0, 2.0, 100_000)

    def stirred(batches):
        """The same rows, in another order whenever they are computed."""
        rng = np.random.default_rng()
        for pdf in batches:
            yield pdf.sample(frac=1.0, random_state=int(rng.integers(1 << 30)))

    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame([(float(v),) for v in values], "v double").mapInPandas(stirred, "v double")
        wanted = [i / 400 for i in range(1, 400)]
        got = exact_quantiles(df, [], "v", wanted).first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert got.n == len(values) and len(got.q) == len(wanted)
    assert np.allclose(got.q, np.quantile(values, wanted), rtol=1e-12)


def test_preferences_are_chosen_in_one_pass(spark):
    plan = routes.chosen(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # above the choice, not below it


def test_nearest_in_a_crowd_meets_few_points(spark, monkeypatch):
    rng, met, plain = random.Random(3), [], joins.within_radius
    at = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(300)] + [(9.0, 9.0), (30.0, 0.0)]
    left = [(i, x + 0.01, y) for i, (x, y) in enumerate(at)]
    right = [(1000 + i, *at[i % 300]) for i in range(1500)]

    def counted(*args):
        met.append((out := plain(*args)).count())
        return out

    monkeypatch.setattr(joins, "within_radius", counted)
    got = {r.id: (r.id2, round(r.d, 9)) for r in joins.nearest_within(spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "id long, x double, y double"), 12.0).collect()}
    want = {i: min((math.hypot(x - u, y - v), j) for j, u, v in right) for i, x, y in left}
    assert got == {i: (j, round(d, 9)) for i, (d, j) in want.items() if d <= 12.0}
    assert sum(met) < 20_000  # of 450,000 pairs


def test_partners_at_one_place_grow_by_the_row(spark):
    """3,000 points at one place on either side are nine million pairs: they are not made, and all get their partners."""
    here = [(i, 0.0, 0.0, i % 2) for i in range(6000)] + [(6001, 3.0, 0.0, 1), (6003, 0.5, 0.0, 1), (6004, 40.0, 0.0, 0), (6006, 41.0, 0.0, 0), (6008, 44.0, 0.0, 0), (6010, 0.0, 4.0, 0)]
    p = spark.createDataFrame(here, "id long, x double, y double, odd int").withColumn("tags", F.struct("odd", F.lit(None).cast("int").alias("none")))
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    within = joins.within_radius
    joins.within_radius = lambda *a, **k: (lambda df: df.mapInArrow(counted, df.schema))(within(*a, **k))
    try:
        got = joins.top_within(p.where("id % 3 = 0"), p.where("id % 3 <> 0"), 5.0, F.lit(True), [F.col("tags2.odd")], best=F.col("tags2.odd") == 0).collect()
    finally:
        joins.within_radius = within
    want = {}
    right = [h for h in here if h[0] % 3]
    for place in {h[1:3] for h in here}:
        near = sorted((o, math.hypot(x - place[0], y - place[1]), i) for i, x, y, o in right)
        want[place] = [(k, i, d) for k, (_, d, i) in enumerate([n for n in near if n[1] <= 5.0][:2])]
    assert sorted((r.id, r.place, r.id2, r.d) for r in got) == sorted((h[0], k, i, d) for h in here if h[0] % 3 == 0 for k, i, d in want[h[1:3]])
    assert made.value < 200


def test_runs_are_dealt_by_rows(spark, monkeypatch):
    """Tasks get more, not larger: with tasks of 1,000 rows none of 60,000 sorts many more, and the runs are those of plain Python."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 1000, raising=False)
    sf = "/root/testdata/sf0.01"
    df = catalog.queries()["win_run_length"](spark, sf)
    parts = df.select("legs", F.spark_partition_id().alias("p")).groupBy("p").agg(F.sum("legs").alias("n")).collect()
    assert sum(r.n for r in parts) == 60_000 and max(r.n for r in parts) < 3000
    want, was = [], None
    for r in sorted(tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag").collect()):
        if was == (r[0], r[4]):
            want[-1][3] += 1
        else:
            want.append([r[0], r[4], r[1], 1])
        was = (r[0], r[4])
    assert sorted(map(list, df.select("route", "state", "first_seq", "legs").collect())) == sorted(want)
