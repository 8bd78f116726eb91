"""Exact quantiles of groups of any size: no task holds a whole group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import shared_folder

#: Slices of a group's values; only slices that hold a wanted rank are sorted.
SLICES = 64
#: How far below and above a wanted quantile its slice is cut.
NEAR = 0.005


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is used twice is then the same both times."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(counts: DataFrame, at: list[float]) -> DataFrame:
    """g, n (all counts together) and edges (bounds of slices about the quantiles `at`, null: one slice) of each group of counts (g, v, c).

    One value of eight, by its hash, gives the edges: they only keep slices small. Approximate quantiles depend on the order in which
    tasks end, so that they are written before two plans use them."""
    some = F.when(F.pmod(F.xxhash64("v"), F.lit(8)) == 0, F.col("v"))
    return kept(counts.groupBy("g").agg(F.sum("c").alias("n"), F.percentile_approx(some, at, 1000).alias("edges")))


def value_counts(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, list[str]]:
    """k0, k1 ... (the keys), g (all of them as one text), v, c: how often each group holds a value that is not null."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    names = [f"k{i}" for i in range(len(by))]
    key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("g")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("g", key), names


def at_ranks(counts: DataFrame, ranks: DataFrame, edges: DataFrame | None = None, bounds: int = 0) -> DataFrame:
    """ranks (g, rank from 0, and others) with v, the value at that rank of the group. counts: g, v, c; a value may come in several rows.

    Approximate quantiles cut each group's rows into slices (edges as of sliced, `bounds` of them), whose counts run up to the ranks that are
    wanted; exact ranks are then taken inside those slices alone."""
    if edges is None:
        edges, bounds = sliced(counts, [i / SLICES for i in range(1, SLICES)]), SLICES - 1
    over = sum((F.coalesce((F.get("edges", F.lit(i)) < F.col("v")).cast("int"), F.lit(0)) for i in range(bounds)), F.lit(0))
    cut = counts.select("g", "v", "c").join(edges.select("g", "edges"), "g").select("g", "v", "c", over.alias("s"))
    sums = cut.groupBy("g", "s").agg(F.sum("c").alias("own"))
    upto = F.sum("own").over(Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))  # at most SLICES rows of a group
    slices = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("own"))
    held = kept(ranks.join(slices.select("g", "s", "upto", "before"), "g").where("rank >= before AND rank < upto").drop("upto"))
    inside = cut.join(held.select("g", "s", "before").distinct(), ["g", "s"]).groupBy("g", "s", "before", "v").agg(F.sum("c").alias("c"))
    run = F.sum("c").over(Window.partitionBy("g", "s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("stop", F.col("before") + run).withColumn("start", F.col("stop") - F.col("c")).select("g", "s", "v", "start", "stop")
    return held.drop("before").join(inside, ["g", "s"]).where("rank >= start AND rank < stop").drop("s", "start", "stop")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """by, n and q: the linearly interpolated quantiles of the values that are not null, as an array.

    Groups and values alone are written once and read in passes; only rows of slices that hold a wanted rank are shuffled and sorted.
    Groups without a value are left out; null keys are a group."""
    g = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)]) if by else F.lit(0)
    rows = kept(df.where(F.col(value).isNotNull()).select(g.alias("g"), F.col(value).cast("double").alias("v"))).withColumn("c", F.lit(1).cast("long"))
    near = sorted({min(1.0, max(0.0, p + d)) for p in probabilities for d in (-NEAR, NEAR)})
    near = near if len(near) < SLICES else [i / SLICES for i in range(1, SLICES)]
    whole = sliced(rows, near)
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    at = whole.select("g", F.posexplode(F.transform(wanted, lambda p: p * (F.col("n") - 1))).alias("i", "at"))
    ranks = at.select("g", "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = at_ranks(rows, ranks, whole, len(near))
    part = F.col("at") - F.floor("at")
    pair = found.groupBy("g", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first(part).alias("part"))
    q = pair.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q")))).alias("qs"))
    return whole.select("g", "n").join(q, "g").select(*[F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)], "n", F.transform("qs", lambda x: x["q"]).alias("q"))
