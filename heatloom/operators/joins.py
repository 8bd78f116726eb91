"""Joins that the engine lacks: as-of, nearest in time, nearest point, points in a radius, points in polygons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import ensure_checkpoints
from .quantiles import kept


def _as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, hours: float) -> tuple[DataFrame, Column, Column]:
    """Left rows (row, t) with the last right row at or before them and the first at or after them, as structs (t, v).

    Rows are cut into stretches of a key's time; a stretch takes what the stretches before and after it end and begin
    with, so that a key of any size is dealt over many tasks."""
    stretch = F.floor(F.unix_micros(F.col("t").cast("timestamp")) / (hours * 3_600_000_000))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in left.columns])
    lefts = left.select(F.col(by).alias("k"), F.col(at).alias("t"), row.alias("row"))
    found = F.struct(F.col(at).alias("t"), F.col(value).alias("v"))
    rights = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(F.col(by).alias("k"), F.col(at).alias("t"), found.alias("r"))
    keyed = lefts.where("k IS NOT NULL AND t IS NOT NULL")
    both = keyed.select("k", "t", "row", F.lit(None).cast(rights.schema["r"].dataType).alias("r"), F.lit(1).alias("side"))
    both = both.unionByName(rights.select("k", "t", F.lit(None).cast(lefts.schema["row"].dataType).alias("row"), "r", F.lit(0).alias("side"))).withColumn("s", stretch)
    parts = both.groupBy("k", "s").agg(F.max("r").alias("last"), F.min("r").alias("first"))
    up, down = Window.partitionBy("k").orderBy("s"), Window.partitionBy("k").orderBy(F.desc("s"))
    parts = parts.select("k", "s", F.max("last").over(up.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("first").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    inner = both.join(parts, ["k", "s"])
    up, down = Window.partitionBy("k", "s").orderBy("t", "side", "r"), Window.partitionBy("k", "s").orderBy(F.desc("t"), F.asc("side"), F.desc("r"))
    upto = Window.unboundedPreceding
    inner = inner.withColumn("b", F.last("r", ignorenulls=True).over(up.rowsBetween(upto, 0))).withColumn("f", F.last("r", ignorenulls=True).over(down.rowsBetween(upto, 0)))
    inner = inner.where("side = 1").select("t", "row", F.coalesce("b", "earlier").alias("b"), F.coalesce("f", "later").alias("f"))
    none = F.lit(None).cast(rights.schema["r"].dataType)
    whole = inner.unionByName(lefts.where("k IS NULL OR t IS NULL").select("t", "row", none.alias("b"), none.alias("f")))
    return whole, F.col("b"), F.col("f")


def _unpacked(df: DataFrame, names: list[str], value: str, found: Column) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in names if c != value], found.alias(value))


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, value: str, hours: float = 24.0) -> DataFrame:
    """left with `value` of the last right row of the same key at or before it, be it null; null where there is none, and
    where a left row's key or time is null. Right rows without key or time take no part; of several at one time the
    largest value counts. hours: the stretch of a key's time that one task holds."""
    rows, back, _ = _as_of(left, right, by, at, value, hours)
    return _unpacked(rows, left.columns, value, back["v"])


def asof_nearest(left: DataFrame, right: DataFrame, by: str, at: str, value: str, hours: float = 24.0) -> DataFrame:
    """left with `value` of the right row of the same key nearest in time; ties to the earlier row. Nulls as in asof_backward."""
    rows, back, ahead = _as_of(left, right, by, at, value, hours)
    later = back.isNull() | (ahead["t"] - F.col("t") < F.col("t") - back["t"])
    return _unpacked(rows, left.columns, value, F.when(later, ahead["v"]).otherwise(back["v"]))


def within_radius(left: DataFrame, right: DataFrame, radius: float, tags: bool = False) -> DataFrame:
    """Pairs (id, id2, d) of points (id, x, y) at most `radius` apart: an equi-join on grid cells as wide as the
    radius, each left point sent to its nine cells, then the exact distance. tags: with the points' tags and tags2."""
    own, other = (["tags"], [F.col("tags").alias("tags2")]) if tags else ([], [])
    cell = lambda c: F.floor(F.col(c) / radius)
    near = left.withColumn("dx", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dy", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    near = near.select("id", "x", "y", *own, (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))
    far = right.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), *other, cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    return near.join(far, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= radius).select("id", "id2", "d", *own, *["tags2"] * tags)


def widening(points: DataFrame, radius: float) -> list[float]:
    """Radii that double up to the radius, from one at which a cell holds a few of the points (x, y)."""
    span = points.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    crowd = (span.x1 - span.x0) * (span.y1 - span.y0) / span.n if span.n else 0.0
    steps = max(0, min(12, math.ceil(math.log2(radius / math.sqrt(crowd))))) if 0 < crowd < math.inf else 0
    return [radius / 2**i for i in range(steps, -1, -1)]


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """The nearest right point of each left point within the radius; ties to the smaller id.

    Of right points at one place the smallest id stands for all. Radii double up to the radius, from one at which a cell holds a few points;
    a point that has found one takes no part in wider searches, so that crowded places meet few points."""
    ensure_checkpoints(left.sparkSession)
    spots = right.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id")).checkpoint()
    found, rest = None, left.select("id", "x", "y")
    for r in widening(spots, radius):
        got = within_radius(rest, spots, r).groupBy("id").agg(F.min(F.struct("d", "id2")).alias("best")).select("id", F.col("best.id2").alias("id2"), F.col("best.d").alias("d"))
        got = got.checkpoint() if r < radius else got
        found = got if found is None else found.unionByName(got)
        if r < radius:
            rest = rest.join(got, "id", "left_anti").checkpoint()
    return found


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Whether a point lies in a polygon: edges is an array of structs (x1, y1, x2, y2) of all its rings (holes too)."""
    def crosses(e):
        over = (e["y1"] > y) != (e["y2"] > y)
        return over & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(over, e["y2"] - e["y1"]) + e["x1"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of structs (x, y), closed or not; edges without length cross nothing."""
    def edge(a, i):
        b = F.get(ring, (i + 1) % F.size(ring))
        return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))

    return F.transform(ring, edge)


def cells_of(polygons: DataFrame, cell: float) -> DataFrame:
    """polygons (edges) once for each grid cell (cx, cy) that its bounds touch."""
    low = lambda n: F.floor(F.array_min(F.transform("edges", lambda e: e[n])) / cell)
    high = lambda n: F.floor(F.array_max(F.transform("edges", lambda e: e[n])) / cell)
    return polygons.withColumn("cx", F.explode(F.sequence(low("x1"), high("x1")))).withColumn("cy", F.explode(F.sequence(low("y1"), high("y1"))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Pairs (id, pid) of points (id, x, y) and polygons (pid, edges) that hold them: an equi-join on grid cells, then the exact test."""
    here = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return cells_of(polygons, cell).join(here, ["cx", "cy"]).where(inside(F.col("x"), F.col("y"), F.col("edges"))).select("id", "pid")


def top_within(left: DataFrame, right: DataFrame, radius: float, allowed: Column, rank: list[Column], k: int = 2, best: Column | None = None) -> DataFrame:
    """The k best right points of each left point (both: id, x, y, tags) within a radius: `allowed`, `rank` and `best` use the columns
    d, tags and tags2; ties of a rank to the nearer, then to the smaller id2.

    Left points at one place with the same tags are searched for once, and of such right points only the k smallest ids can count. best: holds
    for a right point whose rank none can beat; radii double up to the radius, and a left point that has found k of these takes no part in wider
    searches. Without it all pairs within the radius are ranked."""
    spot = ["x", "y", "tags"]
    own = left.select("id", *spot).where("x is not null and y is not null")
    places = kept(own.groupBy(*spot).agg(F.min("id").alias("id")))
    copy = F.row_number().over(Window.partitionBy(*spot).orderBy("id"))
    there = kept(right.select("id", *spot).where("x is not null and y is not null").withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*rank, "d", "id2"))  # each task keeps k rows of a point before anything is shuffled
    rest, found = places, []
    for r in widening(there, radius) if best is not None else [radius]:
        top = within_radius(rest, there, r, tags=True).where(allowed).withColumn("place", place).where(F.col("place") <= k)
        top = kept(top.select("id", (F.col("place") - 1).alias("place"), "id2", "d", (F.lit(False) if best is None else F.coalesce(best, F.lit(False))).alias("sure")))
        if r < radius:
            done = kept(top.where("sure").groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("id"))
            top, rest = top.join(done, "id", "left_semi"), kept(rest.join(done, "id", "left_anti"))
        found.append(top.drop("sure"))
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}")) for c in spot]
    copies = own.alias("o").join(places.alias("p"), reduce(Column.__and__, same)).select(F.col("p.id").alias("one"), F.col("o.id").alias("id"))
    return copies.join(reduce(DataFrame.unionByName, found).withColumnRenamed("id", "one"), "one").select("id", "place", "id2", "d")
