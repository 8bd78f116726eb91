"""Overlay searches, tiles, rings, samples, snaps, rasters by ranges, the edge index and bootstraps on fixtures of their own."""

import heapq
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.functions import comfort, index_terms
from heatloom.operators import digests, edge_index, overlay, pairs, resample, rings, tiles
from heatloom.sources import npy


def heap_search(edges, start, door, jump):
    """Cost of each node, by states."""
    out = {}
    for a, b, c, *kind in edges:
        if c is not None:
            out.setdefault(a, []).append((b, c, tuple(kind)))
            out.setdefault(b, []).append((a, c, tuple(kind)))
    done, heap, best = set(), [(0.0, start, ("", "", ""))], {}
    while heap:
        cost, n, kind = heapq.heappop(heap)
        if (n, kind) in done:
            continue
        done.add((n, kind))
        best.setdefault(n, cost)
        for b, c, k in out.get(n, []):
            more = 0.0
            if kind[0] != "" and None not in (kind[0], k[0]) and kind[0] != k[0]:
                more += door
            if kind[0] != "" and None not in (kind[1], k[1], kind[2], k[2]) and not (kind[2] or k[2]):
                more += jump * abs(kind[1] - k[1])
            heapq.heappush(heap, (cost + c + more, b, k))
    return best


def grid_graph(rows, cols, seed=1, plain=False):
    rng = random.Random(seed)
    edges, nodes = [], [(r * cols + c, float(c), float(r)) for r in range(rows) for c in range(cols)]
    for r in range(rows):
        for c in range(cols):
            for b in [r * cols + c + 1] * (c + 1 < cols) + [(r + 1) * cols + c] * (r + 1 < rows):
                kind = (False, 0, False) if plain else (rng.random() < 0.4, rng.randrange(3), rng.random() < 0.2)
                edges.append((r * cols + c, b, float(rng.randint(1, 9)), *kind))
    return nodes, edges


EDGES = "a long, b long, cost double, indoor boolean, level int, stepped boolean"
NODES = "node long, x double, y double"


def test_states_over_an_overlay(spark):
    nodes, edges = grid_graph(12, 15)
    edges += [(0, 179, None, False, 0, False), (5, 5, 1.0, False, 0, False), (900, 901, 1.0, True, 0, False), (20, 95, 2.0, True, 2, False)]
    nodes += [(900, 3.0, 3.0), (901, 30.0, 3.0), (902, 1.0, 1.0)]
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    costs = {0: (0.0, 0.0), 1: (5.0, 2.0)}
    o = overlay.build(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 30), costs)
    assert o.regions.select("region").distinct().count() > 3
    starts = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 100), (4, 1, 902), (5, 0, 900)], "q long, variant int, node long")
    got = {}
    for r in overlay.costs(o, overlay.search(o, starts)).collect():
        got.setdefault(r.q, {})[r.node] = r.cost
    for q, variant, start in [(1, 0, 0), (2, 1, 0), (3, 1, 100), (4, 1, 902), (5, 0, 900)]:
        want = heap_search(edges, start, *costs[variant])
        assert {n: round(c, 9) for n, c in got[q].items()} == {n: round(c, 9) for n, c in want.items()}


def test_paths_and_landmarks(spark):
    nodes, edges = grid_graph(14, 14, seed=4)
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.lit(0))
    o = overlay.build(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 25), {0: (6.0, 3.0)})
    base = overlay.build(e.withColumn("variant", F.lit(0)), o.regions, {0: (0.0, 0.0)})
    marks = overlay.landmark_costs(base, spark.createDataFrame([(0, 0), (0, 13), (0, 182)], "variant int, node long"))
    targets = [(1, 0, 0, 195), (2, 0, 7, 8), (3, 0, 100, 3), (4, 0, 50, 50)]
    starts = spark.createDataFrame(targets, "q long, variant int, node long, target long")
    blind, led = overlay.search(o, starts), overlay.search(o, starts, marks)
    ends = {r.q: r.total for r in led.ends.collect()}
    assert ends == {r.q: r.total for r in blind.ends.collect()} == {q: heap_search(edges, s, 6.0, 3.0)[t] for q, _, s, t in targets}
    assert sum(w[2] for w in led.work) > sum(w[2] for w in blind.work)
    by = {frozenset(x[:2]): x for x in edges}
    for q, _, s, t in targets:
        steps = [(r.a, r.b) for r in overlay.paths(o, led).where(F.col("q") == q).orderBy("place").collect()]
        walked = [s] + [b for _, b in steps]
        assert [a for a, _ in steps] == walked[:-1] and walked[-1] == t
        cost, was = 0.0, None
        for a, b in steps:
            _, _, c, *kind = by[frozenset((a, b))]
            cost += c + (0 if was is None else 6.0 * (was[0] != kind[0]) + (0 if was[2] or kind[2] else 3.0 * abs(was[1] - kind[1])))
            was = kind
        assert cost == pytest.approx(ends[q])


def test_large_grid_in_few_rounds(spark):
    nodes, edges = grid_graph(125, 400, plain=True)
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.lit(0))
    o = overlay.build(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 1600), {0: (0.0, 0.0)})
    found = overlay.search(o, spark.createDataFrame([(1, 0, 0)], "q long, variant int, node long"))
    got = {r.node: r.cost for r in overlay.costs(o, found).collect()}
    assert got == heap_search(edges, 0, 0.0, 0.0)


def test_preferred_is_relaxed(spark):
    nodes, edges = grid_graph(9, 9, seed=8)
    rng = random.Random(3)
    bad = [rng.choice([0.0, 1.0, 40.0]) for _ in edges]
    rows = [(a, b, c, i, n, s, w) for (a, b, c, i, n, s), w in zip(edges, bad)]
    e = spark.createDataFrame(rows, "a long, b long, length double, indoor boolean, level int, stepped boolean, bad double")
    targets = [(1, 0, 80), (2, 4, 40), (3, 70, 9), (4, 0, 777), (5, 8, 72)]
    nodes.append((777, 50.0, 50.0))
    pairs_ = spark.createDataFrame(targets, "pair long, start long, target long")
    for k in (0.9, 0.0):
        out, found = overlay.preferred(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 12), pairs_, k, F.col("bad"), [0, 8], 2.0, 1.0)
        got = {r.pair: r for r in out.collect()}
        assert len(got) == 5 and got[4].path is None
        length = {frozenset(r[:2]): r[2] for r in rows}
        for pair, s, t in targets[:3] + targets[4:]:
            base, want, weight = heap_search(edges, s, 0.0, 0.0)[t], None, k
            r = got[pair]
            assert r.base == pytest.approx(base)
            walked = sum(length[frozenset((p.a, p.b))] for p in r.path)
            assert walked == pytest.approx(r.ratio * base) and r.ratio <= 1.4
            for i in range(5 if k else 0):
                cost = heap_search([(a, b, c * (1 + weight * w), *kind) for (a, b, c, *kind, w) in rows], s, 2.0, 1.0)[t]
                if i < r.attempts or r.k == 0:
                    weight /= 2
                    continue
                assert r.k == pytest.approx(weight)
                was, total = None, 0.0
                for p in r.path:
                    x = next(y for y in rows if frozenset(y[:2]) == frozenset((p.a, p.b)))
                    total += x[2] * (1 + weight * x[6]) + (0 if was is None else 2.0 * (was[3] != x[3]) + (0 if was[5] or x[5] else abs(was[4] - x[4])))
                    was = x
                assert total == pytest.approx(cost)
                break


def brute_sky(h, rays, eye=1.1):
    n, m = h.shape
    out = np.ones((n, m))
    for r in range(n):
        for c in range(m):
            lost = 0.0
            for steps in rays:
                t = max([0.0] + [(h[r + dr, c + dc] - eye) * per for dr, dc, per in steps if 0 <= r + dr < n and 0 <= c + dc < m])
                lost += t * t / (1 + t * t)
            out[r, c] = 1 - lost / len(rays)
    return out


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_sky_by_tiles(spark, tile):
    rng = np.random.default_rng(2)
    h = np.where(rng.random((17, 13)) < 0.3, rng.integers(2, 12, (17, 13)), 0).astype(float)
    cells = spark.createDataFrame([(r - 5, c - 3, float(h[r, c])) for r in range(17) for c in range(13)], "row int, col int, h double")
    rays, _ = tiles.sky_rays(2.0, 8, 14.0)
    want = brute_sky(h, rays)
    got = tiles.sky_view(cells, 2.0, 8, 14.0, tile=tile).collect()
    assert len(got) == h.size and all(abs(r.svf - want[r.row + 5, r.col + 3]) < 1e-12 for r in got)
    assert all(r.blocked == 0 for r in tiles.blocked_above(cells.withColumn("h", F.lit(1.0)), 2.0, tile=tile).collect())


def test_crowns_are_bounded_by_a_solid_horizon(spark):
    cells = spark.createDataFrame([(r, c, 12.0 if c == 0 else 0.0, 9.0 if 4 <= c <= 9 else 0.0) for r in range(12) for c in range(14)] + [(50, 50, None, None)], "row int, col int, house double, crown double")
    for r in tiles.sky_with_crowns(cells, 2.0, 16, 40.0, 20.0, tile=5).collect():
        assert 0 <= r.svf <= r.svf_house and r.blocked <= r.svf_house - r.svf_all + 1e-12
        assert r.svf == pytest.approx(max(0.0, r.svf_house - 0.97 * r.blocked))
        if r.row == 50:
            assert r.svf == 1.0


def test_sky_of_a_large_raster(spark):
    """500 x 500 cells, 64 rays of 400 m: what is shuffled stays within the bound, and open ground sees all."""
    cells = spark.range(250_000).select((F.col("id") / 500).cast("int").alias("row"), (F.col("id") % 500).cast("int").alias("col")).withColumn("h", F.when((F.col("row") % 97 < 12) & (F.col("col") % 83 < 15), F.lit(20.0)).otherwise(0.0))
    got = tiles.sky_view(cells, 2.0).agg(F.count("*").alias("n"), F.min("svf").alias("low"), F.max("svf").alias("high")).first()
    assert got.n == 250_000 and 0 < got.low < got.high < 1


def square(x, y, s):
    return [(float(x - s), float(y - s)), (float(x + s), float(y - s)), (float(x + s), float(y + s)), (float(x - s), float(y + s))]


def cut_ring(ring, parts, rng):
    n = len(ring)
    at = sorted(rng.sample(range(n), min(parts, n)))
    out = []
    for i, a in enumerate(at):
        b = at[(i + 1) % len(at)]
        pts = [ring[(a + k) % n] for k in range((b - a) % n + 1 if len(at) > 1 else n + 1)]
        out.append(pts[::-1] if rng.random() < 0.5 else pts)
    return out


def test_rings_in_any_order(spark):
    rng = random.Random(6)
    around = lambda x, y, r, n: [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    shapes = [(1, "outer", around(0, 0, 10, 40), 7), (1, "inner", square(2, 2, 1), 3), (1, "inner", square(-3, -3, 1), 1), (1, None, around(40, 0, 5, 30), 30), (1, "inner", square(40, 0, 1.5), 2), (1, "inner", square(90, 0, 1.5), 2), (2, "outer", square(0, 0, 3), 4)]
    rows, frag = [], 0
    for poly, role, ring, parts in shapes:
        for pts in cut_ring(ring, parts, rng):
            rows.append((poly, role, frag, pts))
            frag += 1
    rows += [(3, "outer", 900, [(0.0, 0.0), (1.0, 0.0)]), (3, "outer", 901, [(1.0, 0.0), (1.0, 1.0)]), (3, "outer", 902, []), (3, "outer", 903, None), (4, "outer", 904, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)])]
    rng.shuffle(rows)
    f = spark.createDataFrame(rows, "poly int, role string, frag long, points array<struct<x double, y double>>").repartition(4)
    got, lost = rings.assemble(f)
    assert {r.frag for r in lost.collect()} == {900, 901, 902, 903}
    assert sorted((r.poly, len(r.points)) for r in got.collect()) == sorted((p, len(ring)) for p, _, ring, _ in shapes)
    whole = {(r.poly, len(r.points)): r for r in rings.with_holes(got, 4.0).collect()}
    area = lambda r, n: n / 2 * r * r * math.sin(2 * math.pi / n)
    assert whole[1, 40].holes == 2 and whole[1, 40].area == pytest.approx(area(10, 40) - 8)
    assert whole[1, 30].holes == 1 and whole[1, 30].area == pytest.approx(area(5, 30) - 9)
    assert whole[2, 4].holes == 0 and whole[2, 4].area == pytest.approx(36) and len(whole) == 3
    none, _ = rings.assemble(f.where("false"))
    assert none.collect() == []


def test_sampled_pairs(spark):
    rng = random.Random(1)
    nodes = [(i, rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(500)] + [(999, None, 1.0)]
    at = {i: (x, y) for i, x, y in nodes}
    df = spark.createDataFrame(nodes, NODES)
    got = [tuple(r) for r in pairs.sample_pairs(df.repartition(5), 40, 600, 2000, (1500, 1500), 1400).orderBy("place").collect()]
    assert got == [tuple(r) for r in pairs.sample_pairs(df.coalesce(1), 40, 600, 2000, (1500, 1500), 1400).orderBy("place").collect()]
    assert [r[0] for r in got] == list(range(40)) and len({r[1] for r in got}) > 20
    for _, a, b, d in got:
        assert 600 < d < 2000 and d == pytest.approx(math.dist(at[a], at[b])) and math.dist(at[a], (1500, 1500)) < 1400
    assert pairs.sample_pairs(df, 5, 1e6, 2e6, rounds=2).collect() == [] == pairs.sample_pairs(df.where("false"), 5, 1, 2).collect()


def test_numbers_are_a_permutation(spark):
    got = [r.number for r in pairs.numbered(spark.range(3000).withColumnRenamed("id", "node"), "node", 3).orderBy("node").collect()]
    assert sorted(got) == list(range(3000)) and got != sorted(got)


def test_snapping_knows_components(spark):
    # two chains end to end, a third one beside both, the street at 4; node 30 is on another storey
    nodes = [(1, 0, 0, [0]), (2, 10, 0, [0]), (3, 13, 0, [0]), (4, 23, 0, [0]), (5, 11, 2, [0]), (6, 11, 12, [0]), (20, 25, 1, [0]), (21, 40, 1, [0]), (30, 0, 1, [2]), (31, 90, 90, None)]
    edges = [(1, 2, True), (3, 4, True), (5, 6, True), (20, 21, False)]
    n = spark.createDataFrame([(a, float(x), float(y), lv) for a, x, y, lv in nodes], "node long, x double, y double, levels array<int>")
    e = spark.createDataFrame(edges, "a long, b long, inside boolean")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)], "node long, root long")
    got = {(frozenset((r.a, r.b)), r.kind) for r in pairs.snap(e, n, roots, 5.0).collect()}
    assert (frozenset((2, 5)), 0) in got and (frozenset((4, 20)), 1) in got
    joined = {frozenset(p) for p, k in got if k == 0}
    assert len(joined) == 2 and all(p in ({2, 5}, {5, 3}, {2, 3}) for p in joined)  # three parts become one by two links
    assert pairs.snap(e, n, roots, 0.5).collect() == []


def test_snapping_takes_few_rounds(spark):
    """Sixty chains that become one part: as links taken one by one, the shortest first, but not in a round for each."""
    rng = random.Random(5)
    at = [(rng.uniform(0, 30), rng.uniform(0, 30)) for _ in range(140)]
    chains, radius = [(2 * i, 2 * i + 1) for i in range(60)], 6.0  # nodes from 120 on are of the street
    n = spark.createDataFrame([(i, x, y, [0]) for i, (x, y) in enumerate(at)], "node long, x double, y double, levels array<int>")
    e = spark.createDataFrame([(a, b, True) for a, b in chains], "a long, b long, inside boolean")
    roots = spark.createDataFrame([(x, c[0]) for c in chains for x in c], "node long, root long")
    got = pairs.snap(e, n, roots, radius).collect()
    part, spare, want = {x: x // 2 for x in range(120)}, [2] * 120, set()
    near = sorted((math.dist(at[a], at[b]), a, b) for a in range(120) for b in range(a + 1, 140) if math.dist(at[a], at[b]) <= radius)
    for _, a, b in near:
        if b < 120 and part[a] != part[b] and spare[a] and spare[b]:
            want.add((a, b, 0))
            spare[a], spare[b] = spare[a] - 1, spare[b] - 1
            part = {x: part[a] if p == part[b] else p for x, p in part.items()}
    for _, a, b in near:
        if b >= 120 and spare[a]:
            want.add((a, b, 1))
            spare[a] -= 1
    assert {(r.a, r.b, r.kind) for r in got} == want and len(got) == len(want)
    assert max(r["round"] for r in got) <= 12 < sum(k == 0 for _, _, k in want)


def test_convection_is_found_for_many_days_at_once(spark):
    """Like one day after the other; 20,000 days of 24 hours are 19 million steps, which take no minute."""
    rng = random.Random(3)

    def last(day, h, at):
        t = 290.0
        for q, air in day[: at + 1]:
            if q is None:
                return None
            t += 3600.0 * (q - 0.95 * 5.670374419e-8 * t**4 - h * (t - air)) / (2.5e5 + 3600.0 * (4 * 0.95 * 5.670374419e-8 * t**3 + h))
        return t

    rows = [(i, [(rng.uniform(450, 850), rng.uniform(280, 305)) for _ in range(1 + i % 7)], i % 5) for i in range(60)]
    rows += [(60, [(500.0, 290.0), (None, 290.0)], 1), (61, [], 0), (62, None, 0), (63, [(500.0, 290.0), (None, 290.0)], 0)]
    df = spark.createDataFrame(rows, "id long, s array<struct<absorbed: double, air: double>>, at int").withColumn("goal", F.when(F.col("id") != 7, 300.0 + F.col("id") % 20))
    got = {r.id: r.h for r in df.repartition(3).select("id", comfort.convection_for(F.col("s"), F.lit(290.0), F.col("goal"), F.col("at")).alias("h")).collect()}
    for i, day, at in rows:
        if i == 7 or not day or len(day) <= at:
            assert got[i] is None
            continue
        low, high = 2.0, 60.0
        for _ in range(40):
            t = last(day, (low + high) / 2, at)
            low, high = ((low + high) / 2, high) if t is not None and t > 300.0 + i % 20 else (low, (low + high) / 2)
        assert got[i] == pytest.approx((low + high) / 2, abs=1e-6)
    many = spark.range(20_000).select(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda k: F.struct((450.0 + (F.col("id") + k) % 300).alias("absorbed"), (280.0 + k).alias("air"))).alias("s"))
    start = time.monotonic()
    found = many.repartition(1).select(comfort.convection_for(F.col("s"), F.lit(290.0), F.lit(305.0), F.lit(23)).alias("h")).agg(F.count("h"), F.min("h"), F.max("h")).first()
    assert time.monotonic() - start < 60 and found[0] == 20_000 and 2.0 <= found[1] < found[2] <= 60.0


def test_connectors_need_both_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.2, 0.0), (3, 100.0, 0.0), (4, 5.0, 5.0)], NODES)
    w = spark.createDataFrame([(1, 2, "x"), (1, 3, "y"), (1, 4, "z"), (9, 1, "w")], "a long, b long, name string")
    good, bad = pairs.connectors(e, n, w)
    assert {(r.name, r.length, r.implausible) for r in good.collect()} == {("x", 1.0, False), ("y", 100.0, True)}
    assert {(r.name, r.missing) for r in bad.collect()} == {("z", 4), ("w", 9)}


def test_one_changed_cell_is_found_in_one_tile(spark, tmp_path):
    a = spark.range(1_000_000).select((F.col("id") / 1000).cast("int").alias("row"), (F.col("id") % 1000).cast("int").alias("col"), (F.col("id") % 251).cast("double").alias("v"))
    b = a.withColumn("v", F.when((F.col("row") == 700) & (F.col("col") == 123), -1.0).otherwise(F.col("v")))
    for name, df in (("a", a), ("b", b.repartition(3))):
        digests.write_raster(df, f"{tmp_path}/{name}", tile=250)
    got = digests.file_differences(spark, f"{tmp_path}/a", f"{tmp_path}/b", tile=250)
    assert [tuple(r) for r in got.collect()] == [(700, 123, 700123 % 251, -1.0)]
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x]
    assert scans and any("tr" in x.split("PartitionFilters")[1] for x in scans)
    assert digests.differences(a.limit(5), a.limit(5), tile=2).collect() == []
    odd = spark.createDataFrame([(0, 0, None), (0, 1, float("nan")), (0, 2, 0.0)], "row int, col int, v double")
    other = spark.createDataFrame([(0, 0, None), (0, 1, float("nan")), (0, 2, 1.0), (70, 70, 2.0)], "row int, col int, v double")
    assert sorted((r.row, r.a, r.b) for r in digests.differences(odd, other).collect()) == [(0, 0.0, 1.0), (70, None, 2.0)]


def test_raster_by_ranges(spark, tmp_path):
    grid = np.arange(700 * 30, dtype=np.float32).reshape(700, 30)
    np.save(tmp_path / "shade_13.npy", grid)
    df = npy.read_raster(spark, f"{tmp_path}/shade_13.npy", rows=100)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 21_000
    assert {(r.row, r.col, r.h) for r in df.where("row >= 690 and col = 29").collect()} == {(r, 29, float(r * 30 + 29)) for r in range(690, 700)}
    (tmp_path / "second").mkdir()
    np.save(tmp_path / "second" / "shade_1330.npy", grid[:2] * 0)
    read = lambda slot, path: npy.read_raster(spark, path, slot=slot).agg(F.count("*"), F.max("h")).first()
    both = f"{tmp_path}/second;{tmp_path}"
    assert tuple(read(810, both)) == (60, 0.0) and tuple(read(795, both)) == (21_000, 20_999.0)  # its own file; that of the hour
    assert tuple(read(900, both)) == (0, None)
    r = npy.NpyReader({"path": f"{tmp_path}/shade_13.npy", "rows": "50"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    left = list(r.pushFilters([EqualTo(("col",), 3), GreaterThan(("row",), 99), LessThanOrEqual(("row",), 102), EqualTo(("h",), 1.0)]))
    parts = r.partitions()
    assert len(left) == 1 and [(p.first, p.stop, p.left, p.right) for p in parts] == [(100, 103, 3, 4)]
    assert [b.to_pydict()["h"] for b in r.read(parts[0])] == [[3003.0, 3033.0, 3063.0]]
    np.save(tmp_path / "flat.npy", np.zeros(3))
    with pytest.raises(ValueError):
        npy.layout_of(f"{tmp_path}/flat.npy")


def test_edges_by_slot(spark, tmp_path):
    edges = spark.createDataFrame([(i, 10.0 * i, i == 3, i == 4, None if i == 5 else 0.5) for i in range(40)], "edge long, length double, indoor boolean, covered boolean, svf double")
    index = edge_index.EdgeIndex(spark, f"idx_{os.getpid()}", f"{tmp_path}/idx", 4)
    index.create(edges)
    flat = edges.select("edge", (F.col("edge") / 40).alias("shade"))
    index.put(600, flat, spark.createDataFrame([(7, 0.9), (3, 0.1)], "edge long, shade double"))
    index.put(630, flat.where("edge < 10"))
    got = {(r.edge, r.slot): r for r in index.gather([600, 630, 660]).collect()}
    assert len(got) == 120
    assert (got[7, 600].shade, got[7, 600].raised, got[8, 600].shade, got[8, 600].raised) == (0.9, True, 0.2, False)
    assert got[3, 600].shade == 1.0 and got[3, 600].svf == 0.0 and got[4, 630].shade == 1.0 and got[5, 600].svf is None
    assert got[20, 630].shade == 1.0 and got[9, 630].shade == 9 / 40 and got[9, 660].shade == 1.0
    index.put(630, flat.select("edge", F.lit(0.25).alias("shade")))
    again = {(r.edge, r.slot): r.shade for r in index.gather([600, 630]).collect()}
    assert again[20, 630] == 0.25 and again[8, 600] == 0.2  # the other slot stays
    index.drop_slot(630)
    assert {r.shade for r in index.gather([630]).collect()} == {1.0}
    plan = index.gather([600, 630])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan


def test_bootstrap_of_medians(spark):
    rng = np.random.default_rng(5)
    groups = {"odd": rng.normal(1, 2, 31), "even": rng.normal(-1, 1, 24), "ties": np.repeat([0.0, 1.0, 5.0], 7), "few": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own] + [("odd", None)], "g string, v double")
    got = {r.g: r for r in resample.bootstrap_median(df, ["g"], "v", 4000, seed=1).collect()}
    again = {r.g: r for r in resample.bootstrap_median(df.repartition(7), ["g"], "v", 4000, seed=1).collect()}
    assert got == again and got["few"].n == 2 and got["few"].median is None and got["few"].p is None
    for g in ("odd", "even", "ties"):
        v, r = groups[g], got[g]
        own = np.median(rng.choice(v, (20_000, len(v))), axis=1)  # resampled row by row
        assert r.n == len(v) and r.median == pytest.approx(np.median(v)) and r.pos == (v > 0).sum()
        for end, p in ((r.low, 2.5), (r.high, 97.5)):
            # within the sampling error of 4,000 resamples: four standard errors of a share of 2.5 %
            low, high = np.percentile(own, [max(0, p - 1.0), min(100, p + 1.0)])
            assert low - 1e-9 <= end <= high + 1e-9
        k, n = max(r.pos, r.n - r.pos), r.n
        assert r.p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n))


def test_bootstrap_of_a_million_rows(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("g"), (F.col("id") / 1e6).alias("v"))
    r = resample.bootstrap_median(df, ["g"], "v", 500).first()
    assert r.median == pytest.approx(0.4999995) and abs(r.low - (0.5 - 1.96 * 0.0005)) < 2e-4 and abs(r.high - (0.5 + 1.96 * 0.0005)) < 2e-4
    assert resample.sign_test(500_000, 1_000_000) == 1.0 and resample.sign_test(505_000, 1_000_000) < 1e-20


def test_climate_index_of_known_points(spark):
    """Still air of no excess and half humidity feels as it is, about; more radiation is warmer, more wind cooler; nulls stay."""
    rows = [(t, t + d, w) for t in (-30.0, -5.0, 12.0, 29.0, 41.0) for d in (-10.0, 0.0, 45.0) for w in (0.5, 6.0)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "ta double, tr double, wind double")
    index = comfort.climate_index(F.col("ta"), F.col("tr"), F.col("wind"), comfort.vapour(F.col("ta"), F.lit(50)), index_terms.terms())
    got = {(r.ta, r.tr, r.wind): r.i for r in df.select("*", index.alias("i")).collect()}
    assert got.pop((None, 1.0, 1.0)) is None and len(index_terms.terms()) == 210
    for t in (-30.0, -5.0, 12.0, 29.0, 41.0):
        assert got[t, t - 10, 0.5] < got[t, t, 0.5] < got[t, t + 45, 0.5]
        assert got[t, t, 6.0] < got[t, t, 0.5]
    assert abs(got[29.0, 29.0, 0.5] - 29) < 2 and abs(got[12.0, 12.0, 0.5] - 12) < 3
    far = comfort.climate_index(F.lit(70.0), F.lit(70.0), F.lit(0.5), F.lit(10.0), index_terms.terms()), comfort.climate_index(F.lit(50.0), F.lit(50.0), F.lit(0.5), F.lit(10.0), index_terms.terms())
    a, b = spark.range(1).select(*far).first()
    assert a == b


def test_places_snap_to_the_main_part(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0), (3, 200.0, 0.0), (4, 240.0, 0.0), (5, 250.0, 0.0)], NODES)
    edges = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, "mall"), (4, 5, None)], "a long, b long, hours_key string")
    points = spark.createDataFrame([(1, 245.0, 0.0), (2, 600.0, 0.0), (3, 0.0, 60_000.0)], "id long, x double, y double")
    closed = spark.createDataFrame([("mall",)], "hours_key string")
    got = {r.id: r for r in pairs.snap_to_main(points, nodes, edges, closed, 300.0, (0.0, 0.0)).collect()}
    assert (got[1].node, got[1].d, got[1].from_origin) == (3, 45.0, 245.0)  # 4 and 5 are nearer, but cut off
    assert got[2].node is None and got[3].node is None and got[3].from_origin is None
    free = pairs.snap_to_main(points, nodes, edges, closed.where("false")).where("id = 1").first()
    assert free.node == 4 and free.d == 5.0 and free.from_origin is None


def test_labels_name_what_decided(spark):
    rows = [(810, 810, 7.5, None, 0.0, 40.0), (810, 840, 7.5, 8.0, 50.0, 40.0), (0, 1, None, None, 100.0, 30.0), (0, 0, None, None, 10.0, None)]
    df = spark.createDataFrame(rows, "slot int, now int, m double, feed double, cloud double, el double")
    c = F.col
    u = comfort.uv_index_for(c("slot"), c("now"), c("m"), F.lit("13:00"), c("feed"), c("cloud"), c("el"), "roof")
    got = [(r.u["index"], r.u["source"]) for r in df.select(u.alias("u")).collect()]
    assert got[0] == (7.5, "roof measured 13:00") and got[3] == (None, "no index in the feed and no measurement")
    assert got[1] == (round(8 * (1 - 0.56 * 0.5**3.4), 1), "feed clear-sky x cloud (50%)")
    assert got[2] == (round(12.5 * 0.5**2.42 * 0.44, 1), "modelled clear-sky at 30 deg elevation x cloud (100%)")
    r = spark.range(1).select(comfort.preference_ladder([0.0, 0.1], F.lit(True), F.lit(True)).alias("both"), comfort.preference_ladder([0.1], F.lit(None).cast("boolean"), F.lit(False)).alias("none"), comfort.diffuse_share(F.lit(0.2)).alias("low"), comfort.diffuse_share(F.lit(0.9)).alias("high"), comfort.explicit_step(2e5, 0.95, 10.0, F.lit(300.0)).alias("dt")).first()
    assert list(r.both) == [0.0, 0.324] and list(r.none) == [0.1] and (r.low, r.high) == (1 - 0.018, 0.165)
    assert r.dt == pytest.approx(4e5 / (10 + 4 * 0.95 * 5.670374419e-8 * 300**3))


@pytest.mark.parametrize("block", [1, 3, 100])
def test_trees_by_blocks(spark, block):
    nodes, edges = grid_graph(14, 14, seed=4)
    nodes.append((900, 3.0, 3.0))
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    costs = {0: (6.0, 3.0), 1: (0.0, 0.0)}
    roots = spark.createDataFrame([(5, 0, 0), (6, 1, 100), (7, 0, 900)], "q long, variant int, node long")
    t = overlay.trees(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 25), roots, costs, block)
    want = {5: heap_search(edges, 0, 6.0, 3.0), 6: heap_search(edges, 100, 0.0, 0.0)}
    got = {(r.q, r.node): r.cost for r in overlay.tree_costs(t).collect()}
    assert got == {(q, n): c for q, w in want.items() for n, c in w.items()} | {(7, 900): 0.0}
    ends = spark.createDataFrame([(1, 5, 195), (2, 5, 0), (3, 6, 3), (4, 5, 900)], "id long, q long, node long")
    by = {frozenset(x[:2]): x for x in edges}
    for reverse in (False, True):
        reached, steps = overlay.tree_paths(t, ends, reverse)
        assert {r.id: r.cost for r in reached.collect()} == {1: want[5][195], 2: 0.0, 3: want[6][3]}
        rows = steps.orderBy("id", "place").collect()
        for i, start, end, door, jump, total in ((1, 0, 195, 6.0, 3.0, want[5][195]), (3, 100, 3, 0.0, 0.0, want[6][3])):
            walk = [(r.a, r.b) for r in rows if r.id == i]
            first, last = (end, start) if reverse else (start, end)
            assert walk[0][0] == first and walk[-1][1] == last and all(x[1] == y[0] for x, y in zip(walk, walk[1:]))
            kinds = [by[frozenset(s)][2:] for s in walk]
            cost = sum(k[0] for k in kinds) + sum(door * (x[1] != y[1]) + (0 if x[3] or y[3] else jump * abs(x[2] - y[2])) for x, y in zip(kinds, kinds[1:]))
            assert cost == pytest.approx(total)


def test_many_regions_take_few_rounds(spark):
    nodes, edges = grid_graph(100, 4, plain=True)
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.lit(0))
    regions = overlay.regions_of(spark.createDataFrame(nodes, NODES), 8)  # some 50, one after another
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("trees", "searches")
    t = overlay.trees(e, regions, spark.createDataFrame([(0, 0, 0)], "q long, variant int, node long"), {0: (0.0, 0.0)})
    assert {r.node: r.cost for r in overlay.tree_costs(t).collect()} == heap_search(edges, 0, 0.0, 0.0)
    assert len(tracker.getJobIdsForGroup("trees")) < 60


def least_walks(edges, start, door, jump):
    """(cost, edges, metres) of the best way to each node, the least of each in this order, by states; edges: a, b, cost, length, kind."""
    out, length = {}, {}
    for a, b, c, m, *kind in edges:
        length[frozenset((a, b))] = min(m, length.get(frozenset((a, b)), m))
        if c is not None:
            out.setdefault(a, []).append((b, c, tuple(kind)))
            out.setdefault(b, []).append((a, c, tuple(kind)))
    done, heap, best = set(), [((0.0, 0, 0.0), start, ())], {}
    while heap:
        (cost, n, m), node, kind = heapq.heappop(heap)
        if (node, kind) in done:
            continue
        done.add((node, kind))
        best.setdefault(node, (cost, n, m))
        for b, c, k in out.get(node, []):
            more = 0.0
            if kind:
                more = door * (kind[0] != k[0]) + (0.0 if kind[2] or k[2] else jump * abs(kind[1] - k[1]))
            heapq.heappush(heap, ((cost + c + more, n + 1, m + length[frozenset((node, b))]), b, k))
    return best


@pytest.mark.parametrize("block", [2, 100])
def test_figures_of_ways_need_no_ways(spark, block):
    nodes, plain = grid_graph(40, 4, seed=5)
    edges = [(a, b, c, float((a * 7 + b) % 5), *kind) for a, b, c, *kind in plain]
    edges += [(a, b, c + 1, m / 2, *kind) for a, b, c, m, *kind in edges[::9]] + [(0, 159, None, 1.0, False, 0, False), (1, 2, 0.0, 3.0, True, 1, False)]
    nodes.append((900, 3.0, 3.0))
    e = spark.createDataFrame(edges, "a long, b long, cost double, length double, indoor boolean, level int, stepped boolean").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    costs = {0: (6.0, 3.0), 1: (0.0, 0.0)}
    regions = overlay.regions_of(spark.createDataFrame(nodes, NODES), 10)
    t = overlay.trees(e, regions, spark.createDataFrame([(5, 0, 0), (8, 0, 77), (6, 1, 100), (7, 0, 900)], "q long, variant int, node long"), costs, block)
    ends = [(1000 * q + n, q, n) for q in (5, 6, 7, 8) for n in [*range(0, 160, 3), 900]]
    got = {r.id: (r.cost, r.edges, r.walked) for r in overlay.tree_walks(t, spark.createDataFrame(ends, "id long, q long, node long")).collect()}
    want = {q: least_walks(edges, start, *costs[v]) for q, v, start in ((5, 0, 0), (8, 0, 77), (6, 1, 100), (7, 0, 900))}
    assert got == {i: want[q][n] for i, q, n in ends if n in want[q]}
    _, steps = overlay.tree_paths(t, spark.createDataFrame(ends, "id long, q long, node long").where("q = 8"))
    assert {r.id: r.n for r in steps.groupBy("id").agg(F.count("*").alias("n")).collect()} == {i: g[1] for i, g in got.items() if i >= 8000 and g[1]}


def test_blocks_are_not_searched_backwards(spark):
    nodes, edges = grid_graph(60, 4, plain=True)
    e = spark.createDataFrame([(a, b, 1.0, *k) for a, b, _, *k in edges], EDGES).withColumn("variant", F.lit(0))
    t = overlay.trees(e, overlay.regions_of(spark.createDataFrame(nodes, NODES), 20), spark.createDataFrame([(0, 0, 0)], "q long, variant int, node long"), {0: (0.0, 0.0)}, 3)
    assert t.labels.where("pb >= 0").count() == 4 * 3  # four ways into each of three more blocks, none back


def test_regions_are_runs_in_few_partitions(spark):
    nodes = spark.createDataFrame(grid_graph(60, 50)[0], NODES)
    regions = overlay.regions_of(nodes, 6)
    assert regions.rdd.getNumPartitions() < 20
    sizes = {r.region: r["count"] for r in regions.groupBy("region").count().collect()}
    assert sorted(sizes) == list(range(500)) and set(sizes.values()) == {6}
    assert overlay.regions_of(nodes.where("false"), 6).count() == 0


def test_preferences_are_the_figures_of_preferred(spark):
    nodes, edges = grid_graph(30, 4, seed=8)
    e = spark.createDataFrame([(*x, float(i * 7 % 5)) for i, x in enumerate(edges)], EDGES.replace("cost", "length") + ", bad double")
    pairs_ = spark.createDataFrame([(i, 9 * i, 0) for i in range(1, 13)] + [(20, 500, 0), (21, 0, 0)], "pair long, start long, target long")
    regions = overlay.regions_of(spark.createDataFrame([*nodes, (500, 0.0, 90.0)], NODES), 8)
    p = overlay.preferences(e, regions, pairs_, 0.8, F.col("bad"), 2.0, 1.0)
    got = {r.pair: r for r in p.figures.collect()}
    assert got[20].edges is None and got[21].edges == 0
    length = {frozenset(x[:2]): x[2] for x in edges}
    out, _ = overlay.preferred(e, regions, pairs_.where("pair < 20"), 0.8, F.col("bad"), None, 2.0, 1.0)
    for r in out.collect():
        assert (r.k, r.attempts, r.ratio, r.base, len(r.path)) == (got[r.pair].k, got[r.pair].attempts, got[r.pair].ratio, got[r.pair].base, got[r.pair].edges)
        assert sum(length[frozenset((s.a, s.b))] for s in r.path) == pytest.approx(r.ratio * r.base)
        assert r.path[0].a == 9 * r.pair and r.path[-1].b == 0


def test_odd_tables_of_streets(spark):
    nodes, edges = grid_graph(12, 4, plain=True)
    e = spark.createDataFrame(edges, EDGES).withColumn("variant", F.lit(0)).withColumn("length", F.col("cost"))
    regions = overlay.regions_of(spark.createDataFrame(nodes + nodes[::2], NODES), 7)  # nodes given twice
    roots = spark.createDataFrame([(0, 0, 0)] * 2, "q long, variant int, node long")
    t = overlay.trees(e.union(e), regions, roots, {0: (0.0, 0.0)}, 2)
    ends = spark.createDataFrame([(n, 0, n) for n in (6, 6, 30, 47)], "id long, q long, node long")
    want = heap_search(edges, 0, 0.0, 0.0)
    assert sorted((r.id, r.cost, r.walked) for r in overlay.tree_walks(t, ends).collect()) == [(n, want[n], want[n]) for n in (6, 30, 47)]
    assert sorted((r.node, r.cost) for r in overlay.tree_costs(t).collect()) == sorted(want.items())
    with pytest.raises(Exception, match="not negative"):
        overlay.trees(e.withColumn("cost", -F.col("cost")), regions, roots, {0: (0.0, 0.0)}, 2)
