"""Seeded samples of pairs, and links that join parts of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .graph import ensure_checkpoints
from .joins import nearest_within, widening, within_radius
from .quantiles import kept

#: Leading bits of a hash that number nodes by buckets.
BUCKET_BITS = 12


def numbered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `number` from 0, in the order of a seeded hash of key (whose values are unique): counts of hash buckets run up,
    and rows are numbered inside their bucket, so that the numbers do not depend on partitions and no task holds all rows."""
    h = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key).cast("string"))).withColumn("__b", F.shiftrightunsigned("__h", 64 - BUCKET_BITS).cast("int"))
    sums = h.groupBy("__b").agg(F.count("*").alias("__n"))  # 2^BUCKET_BITS rows at most
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1
    return h.withColumn("__i", inside).join(F.broadcast(sums.select("__b", before.alias("__from"))), "__b").withColumn("number", F.col("__from") + F.col("__i")).select(*df.columns, "number")


def sample_pairs(nodes: DataFrame, k: int, low: float, high: float, centre: tuple[float, float] | None = None, radius: float | None = None, seed: int = 7, rounds: int = 12) -> DataFrame:
    """place (from 0), a, b, d: k pairs of different nodes (node, x, y), more than low and less than high apart, of nodes within
    `radius` of the centre. Pairs are drawn by a seeded hash from all pairs and kept if they are apart as wanted, like dice thrown
    again: the first k that fit, in the order of draws. No list of pairs is made: each round draws twice as many as the one before,
    4 k at first; a pair may be drawn again. Fewer than k come back if `rounds` rounds find no more."""
    spark = nodes.sparkSession
    ensure_checkpoints(spark)
    near = nodes.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    if centre is not None and radius is not None:
        near = near.where(F.hypot(F.col("x") - centre[0], F.col("y") - centre[1]) < radius)
    near = numbered(near, "node", seed).checkpoint()
    n = near.count()
    found, drawn, size = None, 0, 4 * k
    for _ in range(rounds if n > 1 else 0):
        t = spark.range(drawn, drawn + size).withColumnRenamed("id", "t")
        pick = lambda part, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(part), "t"), F.lit(m))
        # the second is drawn from the other n - 1
        t = t.withColumn("i", pick("a", n)).withColumn("j0", pick("b", n - 1)).withColumn("j", F.col("j0") + (F.col("j0") >= F.col("i")).cast("long"))
        at = lambda i, name: near.select(F.col("number").alias(i), F.col("node").alias(name), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}"))
        d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
        fits = t.join(at("i", "a"), "i").join(at("j", "b"), "j").select("t", "a", "b", d.alias("d")).where((F.col("d") > low) & (F.col("d") < high)).orderBy("t").limit(k)
        found = (fits if found is None else found.unionByName(fits)).orderBy("t").limit(k).checkpoint()  # k rows at most
        drawn, size = drawn + size, 2 * size
        if found.count() >= k:
            break
    if found is None:
        return spark.createDataFrame([], "place int, t long, d double").join(near.select(F.col("node").alias("a")).limit(0), F.lit(False)).join(near.select(F.col("node").alias("b")).limit(0), F.lit(False)).select("place", "a", "b", "d")
    return found.select((F.row_number().over(Window.orderBy("t")) - 1).alias("place"), "a", "b", "d")


def snap_to_main(points: DataFrame, nodes: DataFrame, edges: DataFrame, closed: DataFrame, reach: float = 300.0, origin: tuple[float, float] | None = None, far: float = 50_000.0) -> DataFrame:
    """points (id, x, y) with node and d, the nearest node (node, x, y) of the largest component of the edges (a, b, hours_key) that are not
    closed, at most `reach` away (else nulls), and from_origin, the distance to an origin (null from beyond `far`)."""
    main = graph.largest_component(graph.gated(edges, closed).select("a", "b"))
    open_ = nodes.join(main, "node", "left_semi").select(F.col("node").alias("id"), "x", "y")
    near = nearest_within(points.select("id", "x", "y"), open_, reach).select("id", F.col("id2").alias("node"), "d")
    away = F.lit(None).cast("double") if origin is None else F.hypot(F.col("x") - origin[0], F.col("y") - origin[1])
    return points.join(near, "id", "left").withColumn("from_origin", F.when(away <= far, away))


def connectors(edges: DataFrame, nodes: DataFrame, authored: DataFrame, far: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """authored links (a, b and others) whose ends both exist, with length (1 at least) and `implausible` (over far); and those with
    an unknown end, with `missing` (the first such end). An end exists if an edge (a, b) touches it; nodes: node, x, y."""
    known = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(nodes.select("node", "x", "y"), "node")
    at = lambda n: known.select(F.col("node").alias(n), F.col("x").alias(f"__x{n}"), F.col("y").alias(f"__y{n}"))
    j = authored.join(at("a"), "a", "left").join(at("b"), "b", "left")
    d = F.hypot(F.col("__xa") - F.col("__xb"), F.col("__ya") - F.col("__yb"))
    there = F.col("__xa").isNotNull() & F.col("__xb").isNotNull()
    good = j.where(there).select(*authored.columns, F.greatest(d, F.lit(1.0)).alias("length"), (d > far).alias("implausible"))
    return good, j.where(~there).select(*authored.columns, F.when(F.col("__xa").isNull(), F.col("a")).otherwise(F.col("b")).alias("missing"))


def snap(edges: DataFrame, nodes: DataFrame, roots: DataFrame, radius: float, per_node: int = 2) -> DataFrame:
    """Links that join loose ends: a, b, d, kind (0: to another indoor component, 1: to the street) and round.

    edges: a, b, inside (boolean); nodes: node, x, y, levels (array); roots: node, root: components of the inside edges. A loose end is a node that
    one inside edge touches. Candidates are nodes within the radius on a shared level, without an edge to the end, not of its own component.
    Links between components come first: the shortest of all that are open is taken, ties to the smaller nodes, and its components are then
    one, again and again. Ends with links to spare then take the nearest nodes of the street, ties to the smaller. An end gets `per_node` links at most.

    Many links are taken in a round: a component's shortest one is surely taken if nothing shorter may use up the end on its other side. `round`
    counts these rounds, and one more for all links to the street. Radii double up to the radius, as all links within the smaller one come first."""
    ensure_checkpoints(edges.sparkSession)
    touch = kept(edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "inside").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "inside")))
    loose = touch.where("inside").groupBy("node").agg(F.count_distinct("other").alias("n")).where("n = 1").select(F.col("node").alias("id"), F.lit(per_node).alias("spare"))
    known = touch.where("node is not null and other is not null").select(F.col("node").alias("id"), F.col("other").alias("id2")).distinct()
    placed = nodes.select(F.col("node").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.coalesce("levels", F.array(F.lit(0)).cast(nodes.schema["levels"].dataType)).alias("levels"))
    placed = kept(placed.where("x is not null and y is not null").join(loose, "id", "left").join(roots.select(F.col("node").alias("id"), "root"), "id", "left"))  # spare: null but for ends

    taken, i = [], 0
    indoor, street = placed.where("root is not null"), placed.where("root is null").drop("root", "spare")
    for r in widening(indoor, radius):
        links = kept(_open_links(indoor, known, r, radius))
        while not links.isEmpty():
            i += 1
            won = kept(_surely_taken(links, per_node))
            taken.append(won.select("a", "b", "d", F.lit(0).alias("kind"), F.lit(i).alias("round")))
            now = kept(graph.components(won.select(F.col("r1").alias("a"), F.col("r2").alias("b"))))
            used = won.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("used"))
            links = links.join(won.select("a", "b"), ["a", "b"], "left_anti")
            for n, root, spare in (("a", "r1", "s1"), ("b", "r2", "s2")):
                links = _moved(links, now, used, n, root, spare)
            links = kept(links.where("r1 <> r2 and s1 > 0 and (s2 is null or s2 > 0)"))
            indoor = kept(_moved(indoor, now, used, "id", "root", "spare"))

    # an end's links to the street touch no other end's: copies at one place beyond those that one end could take never count
    ends = indoor.where("spare > 0").select("id", "x", "y", "levels", "spare")
    most = touch.where("not inside").groupBy("node").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] + per_node
    copy = F.row_number().over(Window.partitionBy("x", "y", "levels").orderBy("id"))
    street = kept(street.withColumn("copy", copy).where(F.col("copy") <= most).drop("copy"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("d", "id2"))
    for r in widening(street, radius):
        near = within_radius(ends.select("id", "x", "y"), street.select("id", "x", "y"), r).where("id <> id2")
        near = near.join(ends.select("id", "levels", "spare"), "id").join(street.select(F.col("id").alias("id2"), F.col("levels").alias("l2")), "id2").where(F.arrays_overlap("levels", "l2"))
        near = near.join(known, ["id", "id2"], "left_anti").withColumn("place", place).where((F.col("place") <= per_node) & (F.col("place") <= F.col("spare")))
        near = kept(near.select("id", "id2", "d"))
        whole = near.groupBy("id").agg(F.count("*").alias("n")).join(ends, "id").where((F.col("n") >= F.col("spare")) | F.lit(r == radius)).select("id")
        taken.append(near.join(whole, "id", "left_semi").select(F.col("id").alias("a"), F.col("id2").alias("b"), "d", F.lit(1).alias("kind"), F.lit(i + 1).alias("round")))
        ends = kept(ends.join(whole, "id", "left_anti"))
    return reduce(DataFrame.unionByName, taken)


def _open_links(indoor: DataFrame, known: DataFrame, r: float, radius: float) -> DataFrame:
    """a, b, d, r1, r2, s1, s2: pairs of an end a and another component's node b (a < b if both are ends) within r, with the components' roots and the links to spare
    (null: no end). Cells all of whose nodes are of an end's own component are not looked into."""
    cell = lambda c: F.floor(F.col(c) / r)
    there = indoor.where("spare is null or spare > 0").select(F.col("id").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("levels").alias("l2"), F.col("root").alias("r2"), F.col("spare").alias("s2"), cell("x").alias("cx"), cell("y").alias("cy"))
    here = indoor.where("spare > 0").withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    here = here.select(F.col("id").alias("a"), "x", "y", "levels", F.col("root").alias("r1"), F.col("spare").alias("s1"), (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))
    mixed = there.groupBy("cx", "cy").agg(F.min("r2").alias("low"), F.max("r2").alias("high"))
    here = here.join(mixed, ["cx", "cy"]).where("low <> r1 or high <> r1")
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    pairs = here.join(there, ["cx", "cy"]).where("r1 <> r2 and (s2 is null or a < b)").withColumn("d", d).where((F.col("d") <= r) & F.arrays_overlap("levels", "l2"))
    return pairs.join(known.toDF("a", "b"), ["a", "b"], "left_anti").select("a", "b", "d", "r1", "r2", "s1", "s2")


def _surely_taken(links: DataFrame, per_node: int) -> DataFrame:
    """The open links (as of _open_links) that are the shortest of one of their components, and come early enough at their ends to be taken whatever the others do."""
    order = F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    o = links.withColumn("o", order)
    first = o.select(F.explode(F.array("r1", "r2")).alias("root"), "o").groupBy("root").agg(F.min("o").alias("o"))
    best = o.join(first.select("o").distinct(), "o", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("s1").alias("spare")), F.struct(F.col("b").alias("end"), F.col("s2").alias("spare"))))
    rank = F.row_number().over(Window.partitionBy("end").orderBy("o"))
    early = o.select("a", "b", "o", ends.alias("e")).select("a", "b", "o", "e.*").where("spare is not null").withColumn("rank", rank).where((F.col("rank") <= per_node) & (F.col("rank") <= F.col("spare")))
    fits = early.groupBy("a", "b").agg(F.count("*").alias("n"))
    return best.join(fits, ["a", "b"]).where("n = if(s2 is null, 1, 2)").select("a", "b", "d", "r1", "r2")


def _moved(df: DataFrame, now: DataFrame, used: DataFrame, node: str, root: str, spare: str) -> DataFrame:
    """df with the roots of merged components and without the links that its nodes have used."""
    to = df.join(now.toDF(root, "__now"), root, "left").join(used.toDF(node, "__used"), node, "left")
    return to.withColumn(root, F.coalesce("__now", root)).withColumn(spare, F.col(spare) - F.coalesce("__used", F.lit(0))).select(*df.columns)
