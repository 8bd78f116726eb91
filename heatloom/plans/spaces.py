"""Queries of graphs, rasters and places."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heatloom.operators import graph, joins, raster
from heatloom.operators.quantiles import exact_quantiles
from heatloom.plans.tables import READINGS, readings, table

#: The sun of the raster queries, cell width, and the highest value of a cell.
AZIMUTH, ELEVATION, CELL, HIGHEST = 310.0, 20.0, 2.0, 9.0


def net(spark, sf_dir):
    """A graph of suppliers: each is an edge to another key; of several over one pair the last wins."""
    s = table(spark, sf_dir, "supplier")
    to = (F.col("s_suppkey") * 7 + 3) % 997
    e = s.select(F.col("s_suppkey").alias("way"), F.least("s_suppkey", to).cast("long").alias("a"), F.greatest("s_suppkey", to).cast("long").alias("b")).where("a <> b")
    e = e.groupBy("a", "b").agg(F.max("way").alias("way"))
    w = F.col("way")
    return e.select("a", "b", "way", (1.0 + w % 13).alias("cost"), (w % 3 == 0).alias("indoor"), (w % 2).cast("int").alias("level"), (w % 5 == 0).alias("stepped"), F.when(w % 4 == 0, "lane").when(w % 4 == 1, "mall").alias("hours_key"))


def links(spark, sf_dir):
    """Customers (from 1000 on) and nations; every tenth supplier joins its own nation to the customer of its number."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    own = c.select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") + 1000).alias("b"))
    return own.unionByName(s.where("s_suppkey % 10 = 0").select(F.col("s_nationkey").cast("long").alias("a"), (F.col("s_suppkey") + 1000).alias("b")))


def graph_edges(spark, sf_dir):
    """Edges of ways: the suppliers of an order's parts in their order; two suppliers at one place have an edge too."""
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("seq")).agg(F.min("l_suppkey").alias("node"))
    nodes = table(spark, sf_dir, "supplier").where("s_suppkey % 17 <> 0").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") * 37 % 101).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 97).cast("double").alias("y"))
    return graph.edges_of_ways(steps, nodes, touching=True)


def graph_gated(spark, sf_dir):
    closed = spark.createDataFrame([("mall",)], "hours_key string")
    return graph.gated(net(spark, sf_dir), closed).select("a", "b", "way")


def graph_ends(spark, sf_dir):
    return graph.ends(links(spark, sf_dir))


def graph_hops(spark, sf_dir):
    return graph.hops(links(spark, sf_dir), 0, 4)


def graph_components(spark, sf_dir):
    return graph.components(links(spark, sf_dir))


def graph_component_profile(spark, sf_dir):
    """Size, nations, range of each component, the largest first."""
    c = graph.components(links(spark, sf_dir))
    p = c.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("node") < 1000).alias("nations"), F.max("node").alias("last"), F.avg("node").alias("centre"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "root")))  # one row for each component


def places(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"), "label")


def diamonds(spark, sf_dir, size=3.0):
    """Squares on their corners around every fifth place."""
    p = places(spark, sf_dir).where("id % 5 = 0")
    x, y = F.col("x"), F.col("y")
    ring = F.array(*[F.struct((x + dx * size).alias("x"), (y + dy * size).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    return p.select(F.col("id").alias("pid"), "x", "y", "label", joins.ring_edges(ring).alias("edges"))


def join_points_in_polygons(spark, sf_dir):
    """The highest value among the points that each polygon holds; those without a known one have none."""
    p = places(spark, sf_dir).where("id % 5 <> 0").withColumn("v", F.when(F.col("label") > 0, F.col("label")))
    held = joins.points_in_polygons(p, diamonds(spark, sf_dir).select("pid", "edges"), 4.0)
    return held.join(p.select("id", "v"), "id").groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


def join_left_over_nearest(spark, sf_dir):
    """Polygons without a point take the nearest one within 6, else the median of all."""
    d, p = diamonds(spark, sf_dir), places(spark, sf_dir).where("id % 5 <> 0")
    held = joins.points_in_polygons(p, d.select("pid", "edges"), 4.0).select("pid").distinct()
    rest = d.join(held, "pid", "left_anti").select(F.col("pid").alias("id"), "x", "y")
    near = joins.nearest_within(rest, p, 6.0).join(p.select(F.col("id").alias("id2"), "label"), "id2")
    middle = exact_quantiles(p, [], "label", [0.5]).select(F.get("q", F.lit(0)).alias("middle"))
    out = rest.select("id").join(near.select("id", "label", "d"), "id", "left").crossJoin(F.broadcast(middle))  # one row
    return out.select(F.col("id").alias("pid"), F.coalesce(F.col("label").cast("double"), "middle").alias("v"), "d")


def join_constrained_top(spark, sf_dir):
    """The two best partners of each endpoint within 5: not of its own label, sharing a level; even ones first."""
    p = places(spark, sf_dir).withColumn("tags", F.struct("label", F.array(F.col("label") % 3, F.col("id") % 4).alias("levels"), (F.col("id") % 2).alias("odd")))
    allowed = (F.col("tags.label") != F.col("tags2.label")) & F.arrays_overlap(F.col("tags.levels").cast("array<long>"), F.col("tags2.levels").cast("array<long>"))
    return joins.top_within(p.where("id % 5 = 0"), p.where("id % 5 <> 0"), 5.0, allowed, [F.col("tags2.odd")], best=F.col("tags2.odd") == 0)


def join_cell_class(spark, sf_dir):
    """Height of each raster cell from its nearest tree, a default beyond 8."""
    trees = places(spark, sf_dir).where("label > 0")
    c = cells(spark, sf_dir).select((F.col("row") * 1000 + F.col("col")).alias("id"), (F.col("col") * CELL).cast("double").alias("x"), (-F.col("row") * CELL).cast("double").alias("y"))
    near = joins.nearest_within(c, trees, 8.0).join(trees.select(F.col("id").alias("id2"), "label"), "id2")
    return c.select("id").join(near.select("id", "label"), "id", "left").select("id", F.coalesce(F.col("label"), F.lit(8)).alias("height"))


def join_pairs_between(spark, sf_dir):
    """Pairs of points of two labels at most 6 apart, counted, with the shortest."""
    p = places(spark, sf_dir)
    d = joins.within_radius(p.where("label = 1"), p.where("label = 2"), 6.0)
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))


def join_hours_gate(spark, sf_dir):
    """Whether each reading's place is open at its time: by class and weekday; no span is closed, an unknown class open."""
    spans = [("click", d, 8.0, 18.0 if d < 4 else 21.5) for d in range(6)] + [("view", d, None, None) for d in range(7)] + [("signup", d, 0.0, 24.0) for d in range(7)]
    hours = spark.createDataFrame([(s, d, a, b) for s, d, a, b in spans], "site string, dow int, opens double, closes double")
    known = hours.select("site").distinct().withColumn("known", F.lit(True))
    at = F.hour("ts") + F.minute("ts") / 60
    r = readings(spark, sf_dir).select("event_id", "site", F.weekday("ts").alias("dow"), at.alias("at"))
    j = r.join(F.broadcast(hours), ["site", "dow"], "left").join(F.broadcast(known), "site", "left")
    inside = F.coalesce((F.col("at") >= F.col("opens")) & (F.col("at") < F.col("closes")), F.lit(False))
    return j.select("event_id", F.when(F.col("known"), inside).otherwise(True).alias("open"))


def join_nearest_set(spark, sf_dir):
    """For each day the shade set whose noon sun is nearest to its own; of sets that are fine enough if there are such; the first of equal ones."""
    sets = spark.createDataFrame([(0, "winter", "2023-06-21", 60), (1, "spring", "2023-09-21", 30), (2, "summer", "2023-12-21", 30), (3, "late", "2024-01-26", 60), (4, "autumn", "2024-03-21", 30)], "ord int, name string, day string, step int")
    noon = lambda d: 52.2 + 23.4 * F.cos(2 * F.pi() * (F.dayofyear(F.to_date(d)) + 10) / 365)
    days = readings(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    s = sets.select("ord", "name", "step", noon(F.col("day")).alias("sun"))
    j = days.crossJoin(F.broadcast(s))  # five sets
    best = F.min(F.struct((F.col("step") > 30).alias("coarse"), F.abs(F.col("sun") - noon(F.col("day"))).alias("off"), "ord", "name"))
    return j.groupBy("day").agg(best.alias("b")).select("day", "b.name", "b.off")


def cells(spark, sf_dir):
    """A raster: the highest label of the points in each cell."""
    p = places(spark, sf_dir)
    return p.groupBy((-F.floor(F.col("y") / 2)).cast("int").alias("row"), F.floor(F.col("x") / 2).cast("int").alias("col")).agg(F.max("label").alias("h"), F.min("label").alias("m"))


def raster_shadow(spark, sf_dir):
    return raster.shadow(cells(spark, sf_dir), AZIMUTH, ELEVATION, HIGHEST, CELL).select("row", "col", "shadow")


def raster_shade_factor(spark, sf_dir):
    """Crowns between a base and a top, buildings over all."""
    c = cells(spark, sf_dir).withColumns({"top": F.when(F.col("h") % 2 == 1, F.col("h")).otherwise(0), "base": F.col("h") * 0.4, "house": F.when(F.col("h") % 4 == 0, F.col("h")).otherwise(0)})
    c = raster.canopy_shadow(raster.shadow(c, AZIMUTH, ELEVATION, HIGHEST, CELL, height="house"), AZIMUTH, ELEVATION, HIGHEST, CELL)
    return c.select("row", "col", raster.shade_factor(F.col("shadow"), F.col("under")).alias("shade"))


def raster_point_shade(spark, sf_dir):
    """Raised receivers at every third place."""
    p = places(spark, sf_dir).where("id % 3 = 0").select("id", (-F.floor(F.col("y") / 2)).cast("int").alias("row"), F.floor(F.col("x") / 2).cast("int").alias("col"), (F.col("label") / 2).alias("z0"))
    return raster.point_shade(p, cells(spark, sf_dir), AZIMUTH, ELEVATION, HIGHEST, CELL).select("id", "shaded")


def raster_polygons(spark, sf_dir):
    """Diamonds drawn by height, the last of the highest on top; unmapped cells take the nearest class within two."""
    d = diamonds(spark, sf_dir).withColumn("v", F.col("label") + 1)
    return raster.rasterise(d, CELL, "v", ["label", "pid"])


def raster_fill(spark, sf_dir):
    return raster.nearest_class(cells(spark, sf_dir).select("row", "col", F.when(F.col("h") > 4, F.col("h")).otherwise(0).alias("v")), "v", 3)


def raster_edge_gather(spark, sf_dir):
    """Mean and most frequent value of the cells under eight points of each edge; edges lead from a place to the next one."""
    p = places(spark, sf_dir)
    e = p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")).join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2")), "id")
    s = raster.edge_samples(e, 40.0, -40.0, 4.0)
    grid = p.groupBy(((40 - F.col("y")) / 4).cast("int").alias("row"), ((F.col("x") + 40) / 4).cast("int").alias("col")).agg(F.max("label").alias("h"))
    return raster.gather(s, grid, "id", "h").withColumnRenamed("h", "mean").join(raster.gather(s, grid, "id", "h", "mode").withColumnRenamed("h", "mode"), "id")


def flt_edge_defaults(spark, sf_dir):
    """Shade and sky of edges: protected ones are dark; unknown material properties take their defaults; decks by height."""
    e = net(spark, sf_dir)
    w, known = F.col("way"), F.when(F.col("way") % 3 != 0, F.col("cost"))
    deck = F.when(known > 2, known).otherwise(F.greatest(F.col("level"), F.lit(0)) * 4.0)
    return e.select("a", "b", F.when(F.col("indoor"), 1.0).otherwise(F.coalesce(known / 14, F.lit(1.0))).alias("shade"), F.when(F.col("indoor"), 0.0).otherwise(F.coalesce(known / 28, F.lit(0.6))).alias("svf"), F.coalesce(F.when(w % 2 == 0, w / 100.0), F.lit(0.20)).alias("albedo"), deck.alias("deck"))


NET = "e0 AS (SELECT least(s_suppkey, (s_suppkey * 7 + 3) % 997)::BIGINT AS a, greatest(s_suppkey, (s_suppkey * 7 + 3) % 997)::BIGINT AS b, max(s_suppkey) AS way FROM supplier WHERE s_suppkey <> (s_suppkey * 7 + 3) % 997 GROUP BY 1, 2), e AS (SELECT *, 1e0 + way % 13 AS cost, way % 3 = 0 AS ind, way % 2 AS lev, way % 5 = 0 AS st FROM e0)"
LINKS = "e AS (SELECT c_nationkey::BIGINT AS a, c_custkey + 1000 AS b FROM customer UNION ALL SELECT s_nationkey, s_suppkey + 1000 FROM supplier WHERE s_suppkey % 10 = 0), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"
#: Nations that a customer joins, closed; a customer's root is its nation's.
ROOTS = LINKS + ", n AS (SELECT DISTINCT x.a, y.a AS b FROM e x JOIN e y ON x.b = y.b), t AS (SELECT a, b FROM n UNION SELECT t.a, n.b FROM t JOIN n ON t.b = n.a), r AS (SELECT a, min(b) AS root FROM t GROUP BY 1), c AS (SELECT a AS node, root FROM r UNION SELECT e.b, r.root FROM e JOIN r ON r.a = e.a)"
POINTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, label FROM embeddings)"
CELLS = POINTS + ", c AS (SELECT (-floor(y / 2))::INTEGER AS row, floor(x / 2)::INTEGER AS col, max(label) AS h FROM p GROUP BY 1, 2)"
RAY = "o AS (SELECT dr, dc, 2 * sqrt(dr * dr + dc * dc) * tan(radians(20e0)) AS beam FROM (SELECT DISTINCT round_even(-i * 0.25e0 * cos(radians(310e0)), 0)::INTEGER AS dr, round_even(i * 0.25e0 * sin(radians(310e0)), 0)::INTEGER AS dc FROM range(1, 1 + (9 / (tan(radians(20e0)) * 0.5e0))::INTEGER) t(i)))"


PLANS = {
    "graph_edges": (graph_edges, "WITH s AS (SELECT l_orderkey AS way, l_linenumber AS seq, min(l_suppkey) AS node FROM lineitem GROUP BY 1, 2), x AS (SELECT way, node, lead(node) OVER (PARTITION BY way ORDER BY seq) AS nx FROM s), y AS (SELECT least(node, nx) AS a, greatest(node, nx) AS b, max(way) AS way FROM x WHERE nx <> node GROUP BY 1, 2) SELECT a, b, way, sqrt((a * 37 % 101 - b * 37 % 101) ** 2 + (a * 53 % 97 - b * 53 % 97) ** 2) AS length FROM y WHERE a % 17 <> 0 AND b % 17 <> 0"),
    "graph_gated": (graph_gated, f"WITH {NET} SELECT a, b, way FROM e WHERE way % 4 <> 1"),
    "graph_ends": (graph_ends, f"WITH {LINKS}, v AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) SELECT a AS node FROM v GROUP BY 1 HAVING count(*) = 1"),
    "graph_hops": (graph_hops, f"WITH RECURSIVE {LINKS}, r(node, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON r.node = u.a WHERE r.hops < 4) SELECT node, min(hops)::INTEGER AS hops FROM r GROUP BY node"),
    "graph_components": (graph_components, f"WITH RECURSIVE {ROOTS} SELECT node, root FROM c"),
    "graph_component_profile": (graph_component_profile, f"WITH RECURSIVE {ROOTS}, s AS (SELECT root, count(*) AS n, count(*) FILTER (node < 1000) AS nations, max(node) AS last, avg(node) AS centre FROM c GROUP BY 1) SELECT *, row_number() OVER (ORDER BY n DESC, root)::INTEGER AS place FROM s"),
    "join_points_in_polygons": (join_points_in_polygons, f"WITH {POINTS} SELECT a.id AS pid, count(*) AS n, max(nullif(b.label, 0)) AS top FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0 AND abs(a.x - b.x) + abs(a.y - b.y) < 3 GROUP BY 1"),
    "join_left_over_nearest": (join_left_over_nearest, f"WITH {POINTS}, m AS (SELECT a.id AS pid, b.label, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.id) AS i, bool_or(abs(a.x - b.x) + abs(a.y - b.y) < 3) OVER (PARTITION BY a.id) AS held FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0) SELECT pid, CASE WHEN d <= 6 THEN label::DOUBLE ELSE (SELECT median(label) FROM p WHERE id % 5 <> 0) END AS v, CASE WHEN d <= 6 THEN d END AS d FROM m WHERE i = 1 AND NOT held"),
    "join_constrained_top": (join_constrained_top, f"WITH {POINTS}, j AS (SELECT a.id, b.id AS id2, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id % 5 = 0 AND b.id % 5 <> 0 AND a.label <> b.label AND (a.label % 3 IN (b.label % 3, b.id % 4) OR a.id % 4 IN (b.label % 3, b.id % 4))) SELECT id, place, id2, d FROM (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY id2 % 2, d, id2) - 1)::INTEGER AS place FROM j WHERE d <= 5) WHERE place < 2"),
    "join_cell_class": (join_cell_class, f"WITH {CELLS}, j AS (SELECT c.row * 1000 + c.col AS id, label, (c.col * 2 - x) ** 2 + (-c.row * 2 - y) ** 2 AS d2, row_number() OVER (PARTITION BY c.row, c.col ORDER BY (c.col * 2 - x) ** 2 + (-c.row * 2 - y) ** 2, p.id) AS i FROM c, p WHERE label > 0) SELECT id, CASE WHEN d2 <= 64 THEN label ELSE 8 END AS height FROM j WHERE i = 1"),
    "join_pairs_between": (join_pairs_between, f"WITH {POINTS} SELECT a.id, count(*) AS n, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b ON a.label = 1 AND b.label = 2 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6 GROUP BY 1"),
    "join_hours_gate": (join_hours_gate, f"WITH {READINGS}, t AS (SELECT event_id, site, isodow(ts) AS d, hour(ts) + minute(ts) / 60 AS h FROM r) SELECT event_id, CASE site WHEN 'click' THEN d < 7 AND h >= 8 AND h < CASE WHEN d < 5 THEN 18 ELSE 21.5 END WHEN 'view' THEN false ELSE true END AS open FROM t"),
    "join_nearest_set": (join_nearest_set, f"WITH {READINGS}, d AS (SELECT DISTINCT ts::DATE AS day FROM r), s(ord, name, doy) AS (VALUES (1, 'spring', 264), (2, 'summer', 355), (4, 'autumn', 81)), j AS (SELECT day, name, abs(23.4e0 * cos(2 * pi() * (doy + 10) / 365) - 23.4e0 * cos(2 * pi() * (dayofyear(day) + 10) / 365)) AS off, ord FROM d, s) SELECT day, name, off FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY off, ord) AS i FROM j) WHERE i = 1"),
    "raster_shadow": (raster_shadow, f"WITH {CELLS}, {RAY} SELECT c.row, c.col, coalesce(max(b.h - beam) > 0.05, false) AS shadow FROM c CROSS JOIN o LEFT JOIN c b ON b.row = c.row + dr AND b.col = c.col + dc GROUP BY 1, 2"),
    "raster_shade_factor": (raster_shade_factor, f"WITH {CELLS}, {RAY}, s AS (SELECT c.row, c.col, coalesce(max(CASE WHEN b.h % 4 = 0 THEN b.h - beam END) > 0.05, false) AS house, coalesce(bool_or(b.h % 2 = 1 AND b.h - beam > 0.05 AND b.h * 0.4e0 <= beam), false) AS crown FROM c CROSS JOIN o LEFT JOIN c b ON b.row = c.row + dr AND b.col = c.col + dc GROUP BY 1, 2) SELECT row, col, CASE WHEN house THEN 1 WHEN crown THEN 0.97e0 ELSE 0 END::DOUBLE AS shade FROM s"),
    "raster_point_shade": (raster_point_shade, f"WITH {CELLS}, {RAY}, q AS (SELECT id, (-floor(y / 2))::INTEGER AS row, floor(x / 2)::INTEGER AS col, label / 2 AS z FROM p WHERE id % 3 = 0) SELECT id, coalesce(max(b.h - beam - z) > 0.05, false) AS shaded FROM q CROSS JOIN o LEFT JOIN c b ON b.row = q.row + dr AND b.col = q.col + dc GROUP BY 1"),
    "raster_polygons": (raster_polygons, f"WITH {POINTS}, g AS (SELECT i AS cx, j AS cy FROM range(-40, 40) a(i), range(-40, 40) b(j)) SELECT -cy - 1 AS row, cx AS col, arg_max(label + 1, (label, id)) AS v FROM g JOIN p ON id % 5 = 0 AND abs(cx * 2 + 1 - x) + abs(cy * 2 + 1 - y) < 3 GROUP BY 1, 2"),
    "raster_fill": (raster_fill, f"WITH {CELLS}, j AS (SELECT a.row, a.col, b.h AS v, row_number() OVER (PARTITION BY a.row, a.col ORDER BY (a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.h) AS i FROM c a JOIN c b ON b.h > 4 AND (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9) SELECT c.row, c.col, coalesce(v, 0) AS v FROM c LEFT JOIN j ON j.row = c.row AND j.col = c.col AND j.i = 1"),
    "raster_edge_gather": (raster_edge_gather, f"WITH {POINTS}, e AS (SELECT a.id, a.x + (b.x - a.x) * (k + 0.5e0) / 8 AS x, a.y + (b.y - a.y) * (k + 0.5e0) / 8 AS y FROM p a JOIN p b ON b.id = a.id + 1, range(8) t(k)), g AS (SELECT trunc((40 - y) / 4)::INTEGER AS row, trunc((x + 40) / 4)::INTEGER AS col, max(label) AS h FROM p GROUP BY 1, 2), s AS (SELECT e.id, g.h FROM e LEFT JOIN g ON g.row = trunc((40 - e.y) / 4) AND g.col = trunc((e.x + 40) / 4)), f AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY (h IS NULL)::INT, count(*) DESC, h) AS i FROM s GROUP BY id, h) SELECT s.id, coalesce(sum(s.h), 0) / greatest(count(s.h), 1) AS mean, any_value(coalesce(f.h, 0)) AS mode FROM s JOIN f ON f.id = s.id AND f.i = 1 GROUP BY s.id"),
    "flt_edge_defaults": (flt_edge_defaults, f"WITH {NET}, k AS (SELECT *, CASE WHEN way % 3 <> 0 THEN cost END AS known FROM e) SELECT a, b, CASE WHEN ind THEN 1 ELSE coalesce(known / 14, 1) END AS shade, CASE WHEN ind THEN 0 ELSE coalesce(known / 28, 0.6) END AS svf, CASE WHEN way % 2 = 0 THEN way / 100 ELSE 0.2e0 END AS albedo, CASE WHEN known > 2 THEN known ELSE lev * 4e0 END AS deck FROM k"),
}
