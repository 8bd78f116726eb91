"""Graph operators by repeated joins: edges of ways, gates, hops, components, cheapest paths with and without state."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def ensure_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def edges_of_ways(steps: DataFrame, nodes: DataFrame, touching: bool = False) -> DataFrame:
    """a, b, way, length of the edges between consecutive nodes of ways: steps (way, seq, node), nodes (node, x, y).
    The smaller node comes first; of several ways over one edge the last wins; loops and unknown nodes are left out, edges
    between two nodes at one place too unless `touching`."""
    nxt = F.lead("node").over(Window.partitionBy("way").orderBy("seq", "node"))
    pairs = steps.select("way", "node", nxt.alias("next")).where("next IS NOT NULL AND next <> node")
    pairs = pairs.select("way", F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))
    last = pairs.groupBy("a", "b").agg(F.max("way").alias("way"))
    at = lambda n: nodes.select(F.col("node").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    placed = last.join(at("a"), "a").join(at("b"), "b")
    length = F.sqrt(F.pow(F.col("xa") - F.col("xb"), F.lit(2.0)) + F.pow(F.col("ya") - F.col("yb"), F.lit(2.0)))
    out = placed.select("a", "b", "way", length.alias("length"))
    return out if touching else out.where("length > 0")


def gated(edges: DataFrame, closed: DataFrame, key: str = "hours_key") -> DataFrame:
    """edges without those whose key is closed; edges without a key are never closed."""
    return edges.join(closed.select(F.col(key)).distinct(), key, "left_anti").select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def ends(edges: DataFrame) -> DataFrame:
    """Nodes that one edge touches."""
    return both_ways(edges.select("a", "b")).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree")).where("degree = 1").select("node")


def hops(edges: DataFrame, start: int, most: int) -> DataFrame:
    """node, hops: least number of edges (a, b), both ways, from start; at most `most`."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = edges.sparkSession.createDataFrame([(start, 0)], "node long, hops int")
    for _ in range(most):
        nxt = reached.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("hops") + 1).alias("hops"))
        reached = reached.union(nxt).groupBy("node").agg(F.min("hops").alias("hops"))
    return reached


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node that edges (a, b), taken both ways, connect to it. Labels take the smallest
    label of a neighbour, then that label's own label, so that long chains halve; lineage is cut each round. Halving
    needs few rounds (their number grows with the logarithm of the longest chain); more than `rounds` are an error."""
    ensure_checkpoints(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "m").alias("low"))
        own = labels.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        new = low.join(own, F.col("low") == F.col("n2")).select("node", F.col("root").alias("old"), F.least("low", "r2").alias("root")).checkpoint()
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels
    raise ValueError(f"components need more than {rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component, of equal ones that with the smallest node."""
    labels = components(edges)
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return labels.join(F.broadcast(sizes), "root", "left_semi").select("node")  # one row


def cheapest(edges: DataFrame, start: int, rounds: int = 10_000) -> DataFrame:
    """node, cost, path of the cheapest paths from start over edges (a, b, cost), both ways, costs not negative. Each round
    joins only the nodes that the round before made cheaper. Of equal paths the one whose nodes come first is taken."""
    return cheapest_by_state(edges.select("a", "b", "cost", F.lit(False).alias("indoor"), F.lit(0).alias("level"), F.lit(False).alias("stepped")), start, 0.0, 0.0, rounds)


def cheapest_by_state(edges: DataFrame, start: int, door: float = 45.0, jump: float = 12.0, rounds: int = 10_000) -> DataFrame:
    """node, cost, path: as cheapest, but where one edge follows another, a change of indoor costs `door`, and each level of a
    change costs `jump` unless one of the two edges is stepped (indoor, level, stepped: of an edge). The first edge is free of
    both. A state is a node and the kind of the edge that led to it."""
    spark = edges.sparkSession
    ensure_checkpoints(spark)
    kind = ["indoor", "level", "stepped"]
    out = both_ways(edges.select("a", "b", F.col("cost").cast("double").alias("cost"), *kind)).where("cost IS NOT NULL").checkpoint()
    schema = "node long, cost double, path array<long>, indoor boolean, level int, stepped boolean"
    best = spark.createDataFrame([(start, 0.0, [start], None, None, None)], schema)
    fresh = best
    for _ in range(rounds):
        f = fresh.select("node", F.col("cost").alias("c"), "path", *[F.col(k).alias(f"was_{k}") for k in kind])
        change = F.when(F.col("was_indoor") != F.col("indoor"), F.lit(float(door))).otherwise(0.0)
        climb = F.when(F.col("was_stepped") | F.col("stepped"), 0.0).otherwise(F.abs(F.col("was_level") - F.col("level")) * float(jump))
        nxt = out.join(f, F.col("a") == F.col("node")).select(F.col("b").cast("long").alias("node"), (F.col("c") + F.col("cost") + change + F.coalesce(climb, F.lit(0.0))).alias("cost"), F.array_append("path", F.col("b").cast("long")).alias("path"), *kind)
        tried = best.withColumn("new", F.lit(0)).unionByName(nxt.withColumn("new", F.lit(1)))
        merged = tried.groupBy("node", *kind).agg(F.min(F.struct("cost", "new", "path")).alias("b")).select("node", "b.cost", "b.path", *kind, "b.new").checkpoint()
        best, fresh = merged.drop("new"), merged.where("new = 1").drop("new")
        if fresh.isEmpty():
            break
    else:
        raise ValueError(f"cheapest paths need more than {rounds} rounds")
    return best.groupBy("node").agg(F.min(F.struct("cost", "path")).alias("b")).select("node", "b.cost", "b.path")


def path_edges(paths: DataFrame) -> DataFrame:
    """node, place, a, b: the edges of each path in their order, the smaller node first."""
    steps = paths.select("node", F.posexplode("path").alias("place", "a"), "path").withColumn("b", F.get("path", F.col("place") + 1)).where("b IS NOT NULL")
    return steps.select("node", "place", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def preferred(edges: DataFrame, start: int, end: int, k: float, badness: Column, door: float = 45.0, jump: float = 12.0, most_detour: float = 1.4, attempts: int = 5) -> DataFrame:
    """One row: the path from start to end that a walker prefers who weighs badness by k, with k halved until the path is at
    most `most_detour` times as long as the shortest; the shortest itself with k = 0 or after all attempts.
    edges: a, b, length, indoor, level, stepped and what badness needs. Null path: there is none."""
    spark = edges.sparkSession
    base = cheapest(edges.withColumn("cost", F.col("length")), start).where(F.col("node") == end).first()
    schema = "path array<long>, k double, attempts int, ratio double, base double"
    if base is None:
        return spark.createDataFrame([(None, 0.0, 0, None, None)], schema)
    lengths = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("length").alias("length"))
    for i in range(attempts if k > 0 else 0):
        found = cheapest_by_state(edges.withColumn("cost", F.col("length") * (1 + k * badness)), start, door, jump).where(F.col("node") == end).checkpoint()
        ratio = path_edges(found).join(lengths, ["a", "b"]).agg(F.sum("length")).first()[0] / base.cost
        if ratio <= most_detour:
            return spark.createDataFrame([(found.first().path, float(k), i, ratio, base.cost)], schema)
        k /= 2
    return spark.createDataFrame([(base.path, 0.0, attempts - 1 if k > 0 else 0, 1.0, base.cost)], schema)
