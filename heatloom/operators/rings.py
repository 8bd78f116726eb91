"""Rings of polygons from fragments of ways, in any order and direction, and their holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import ensure_checkpoints
from .joins import cells_of, inside, ring_edges


def _last(a: Column) -> Column:
    return F.element_at(a, -1)


def assemble(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings (poly, role, ring, points) and the fragments (poly, role, frag) that close to none.

    fragments: poly, role, frag, points (array of structs x, y). A fragment can be walked in two directions; each leads to the
    fragment that shares its end. Where more than two ends meet, they pair in the order of fragments. Places along a
    ring come by list ranking: each step learns of twice as many fragments, so that a ring of any length takes
    the logarithm of its length in rounds, and no task holds a ring before its points are put together.
    A ring begins with its smallest fragment, in that one's direction, and closes (its first point is not repeated).
    A null role is `outer`. Rings of fewer than three points are none; fragments of fewer than two points close to nothing."""
    ensure_checkpoints(fragments.sparkSession)
    key = ["poly", "role"]
    known = fragments.select("poly", F.coalesce("role", F.lit("outer")).alias("role"), "frag", F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("points")).checkpoint()
    good = known.where("size(points) > 1")
    closed = F.get("points", F.lit(0)) == _last(F.col("points"))
    whole = good.where(closed).select(*key, F.col("frag").alias("ring"), F.expr("slice(points, 1, size(points) - 1)").alias("points"))
    open_ = good.where(~closed)
    # ends: back = true is the first point, where a walk against the fragment's direction comes out
    ends = open_.select(*key, "frag", F.explode(F.array(F.struct(F.lit(True).alias("back"), F.get("points", F.lit(0)).alias("at")), F.struct(F.lit(False).alias("back"), _last(F.col("points")).alias("at")))).alias("e")).select(*key, "frag", "e.back", "e.at")
    here = Window.partitionBy(*key, "at").orderBy("frag", "back")
    ends = ends.withColumn("i", F.row_number().over(here) - 1).withColumn("pair", F.floor(F.col("i") / 2))
    other = ends.select(*key, "at", "pair", F.col("i").alias("j"), F.col("frag").alias("next"), (~F.col("back")).alias("next_back"))
    # coming out at a fragment's end, the walk enters the partner at that same point: forwards if it is the partner's first point
    linked = ends.join(other, [*key, "at", "pair"], "left").where("j is null or i <> j").groupBy(*key, "frag", "back").agg(F.max(F.struct("next", "next_back")).alias("n"))
    state = ends.select(*key, "frag", "back").join(linked, [*key, "frag", "back"], "left").select(*key, "frag", "back", "n.next", "n.next_back", F.struct("frag", "back").alias("least")).checkpoint()
    longest = open_.groupBy(*key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    rounds = max(1, int(longest).bit_length())
    first = state
    # the smallest fragment of each walk; a walk that ends nowhere is open
    for _ in range(rounds):
        ahead = state.select(*key, F.col("frag").alias("next"), F.col("back").alias("next_back"), F.col("next").alias("n2"), F.col("next_back").alias("b2"), F.col("least").alias("l2"))
        state = state.join(ahead, [*key, "next", "next_back"], "left").select(*key, "frag", "back", F.col("n2").alias("next"), F.col("b2").alias("next_back"), F.least("least", F.coalesce("l2", "least")).alias("least")).checkpoint()
    walks = state.where("next is not null").select(*key, "frag", "back", F.col("least.frag").alias("ring"), F.col("least.back").alias("ring_back"))
    # of the two directions of a ring the one in which its smallest fragment runs forwards
    walks = first.select(*key, "frag", "back", "next", "next_back").join(walks.where("not ring_back"), [*key, "frag", "back"])
    leads = (F.col("frag") == F.col("ring")) & ~F.col("back")
    left = walks.select(*key, "frag", "back", "ring", F.when(leads, F.col("frag")).otherwise(F.col("next")).alias("next"), F.when(leads, False).otherwise(F.col("next_back")).alias("next_back"), F.when(leads, 0).otherwise(1).cast("long").alias("d")).checkpoint()
    for _ in range(rounds):
        ahead = left.select(*key, F.col("frag").alias("next"), F.col("back").alias("next_back"), F.col("next").alias("n2"), F.col("next_back").alias("b2"), F.col("d").alias("d2"))
        left = left.join(ahead, [*key, "next", "next_back"]).select(*key, "frag", "back", "ring", F.col("n2").alias("next"), F.col("b2").alias("next_back"), (F.col("d") + F.col("d2")).alias("d")).checkpoint()
    walked = F.when(F.col("back"), F.reverse("points")).otherwise(F.col("points"))
    part = left.join(open_, [*key, "frag"]).select(*key, "ring", F.struct(F.when(F.col("d") == 0, -(1 << 60)).otherwise(-F.col("d")).alias("place"), F.slice(walked, 1, F.size("points") - 1).alias("points")).alias("part"))
    joined = part.groupBy(*key, "ring").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(*key, "ring", F.flatten(F.transform("parts", lambda p: p["points"])).alias("points"))
    rings = whole.unionByName(joined).where("size(points) > 2").checkpoint()
    used = left.select(*key, "frag").distinct().unionByName(whole.select(*key, F.col("ring").alias("frag")))
    lost = known.select(*key, "frag").join(used, [*key, "frag"], "left_anti")
    return rings, lost


def point_inside(points: Column) -> Column:
    """A point (x, y) strictly inside a ring: halfway up to its second lowest vertex, in the middle of the first stretch there."""
    ys = F.array_sort(F.array_distinct(F.transform(points, lambda p: p["y"])))
    y = (F.get(ys, F.lit(0)) + F.get(ys, F.lit(1))) / 2
    cut = F.filter(ring_edges(points), lambda e: (e["y1"] > y) != (e["y2"] > y))
    xs = F.array_sort(F.transform(cut, lambda e: e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])))
    return F.struct(((F.get(xs, F.lit(0)) + F.get(xs, F.lit(1))) / 2).alias("x"), y.alias("y"))


def area(points: Column) -> Column:
    twice = F.aggregate(ring_edges(points), F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(twice) / 2


def with_holes(rings: DataFrame, cell: float) -> DataFrame:
    """Outer rings (poly, ring, points) with `edges`, those of the ring and of all holes of the same polygon whose inner point
    it holds (for the even-odd test), `holes` and `area` (less that of the holes). cell: side of the grid cells on which holes meet
    outer rings. Rings whose role is not `inner` are outer; rings without area hold nothing and fill nothing."""
    flat = rings.where(area(F.col("points")) > 0)
    outer = flat.where("role <> 'inner'").select("poly", "role", "ring", "points", ring_edges(F.col("points")).alias("edges"))
    inner = flat.where("role = 'inner'").select("poly", F.col("ring").alias("hole"), ring_edges(F.col("points")).alias("hole_edges"), area(F.col("points")).alias("hole_area"), point_inside(F.col("points")).alias("p"))
    at = inner.withColumn("cx", F.floor(F.col("p.x") / cell)).withColumn("cy", F.floor(F.col("p.y") / cell))
    held = cells_of(outer.select("poly", "role", "ring", "edges"), cell).join(at, ["poly", "cx", "cy"]).where(inside(F.col("p.x"), F.col("p.y"), F.col("edges")))
    sums = held.groupBy("poly", "role", "ring").agg(F.flatten(F.collect_list("hole_edges")).alias("more"), F.count("*").alias("holes"), F.sum("hole_area").alias("less"))
    out = outer.join(sums, ["poly", "role", "ring"], "left")
    edges = F.concat("edges", F.coalesce("more", F.array().cast(outer.schema["edges"].dataType)))
    return out.select("poly", "ring", "points", edges.alias("edges"), F.coalesce("holes", F.lit(0)).alias("holes"), (area(F.col("points")) - F.coalesce("less", F.lit(0.0))).alias("area"))
