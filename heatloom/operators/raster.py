"""Rasters as tables of cells (row, col, values); row 0 is north, col 0 west. Neighbourhoods are joins on offsets.

High cells send what they do to the cells that they reach, and only where they do reach: offsets whose beam is above a
cell's top are dropped before any shuffle. Lists of offsets are small tables of a known bound (MAX_STEPS a ray)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import cells_of, inside

#: Part of a cell that a ray advances by, lowest sun, margin of a blocker (m), steps of a ray: fixed values.
STEP, LOW_SUN, MARGIN, MAX_STEPS = 0.25, 5.0, 0.05, 8000


def ray(azimuth: float, steps: int) -> list[tuple[int, int]]:
    """Cells that a ray from a cell visits, each once, in their order."""
    a, out = math.radians(azimuth), {}
    for i in range(1, steps + 1):
        out.setdefault((round(-i * STEP * math.cos(a)), round(i * STEP * math.sin(a))))
    return list(out)


def beam_offsets(spark: SparkSession, azimuth: float, elevation: float, highest: float, cell: float) -> DataFrame:
    """dr, dc, beam: the height of the beam to the sun over each cell of the ray, up to the highest blocker."""
    slope = math.tan(math.radians(elevation))
    steps = min(int(highest / (slope * cell * STEP)), MAX_STEPS)
    return spark.createDataFrame([(dr, dc, cell * math.hypot(dr, dc) * slope) for dr, dc in ray(azimuth, steps)], "dr int, dc int, beam double")


def _hit(cells: DataFrame, offsets: DataFrame, blocks: Column) -> DataFrame:
    """row, col of the cells that a cell blocks."""
    pairs = cells.join(F.broadcast(offsets), blocks)
    return pairs.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col")).distinct()


def shadow(cells: DataFrame, azimuth: float, elevation: float, highest: float, cell: float, height: str = "h", out: str = "shadow") -> DataFrame:
    """cells with whether the sun is behind something higher; below five degrees all are in shadow. highest: of all heights."""
    if elevation < LOW_SUN:
        return cells.withColumn(out, F.lit(True))
    offsets = beam_offsets(cells.sparkSession, azimuth, elevation, highest, cell)
    dark = _hit(cells, offsets, F.col(height) - F.col("beam") > MARGIN)
    return cells.join(dark.withColumn(out, F.lit(True)), ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def canopy_shadow(cells: DataFrame, azimuth: float, elevation: float, highest: float, cell: float, top: str = "top", base: str = "base", out: str = "under") -> DataFrame:
    """cells with whether the beam passes through a crown, between its base and its top; nothing below five degrees."""
    if elevation < LOW_SUN:
        return cells.withColumn(out, F.lit(False))
    offsets = beam_offsets(cells.sparkSession, azimuth, elevation, highest, cell)
    under = _hit(cells, offsets, (F.col(top) - F.col("beam") > MARGIN) & (F.col(base) - F.col("beam") <= 0))
    return cells.join(under.withColumn(out, F.lit(True)), ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def shade_factor(shadow_: Column, under: Column, through: float = 0.03) -> Column:
    """Share of the beam that is kept off: all of it by buildings, all but what leaves let through by crowns."""
    return F.when(shadow_, 1.0).when(under, 1.0 - through).otherwise(0.0)


def point_shade(points: DataFrame, cells: DataFrame, azimuth: float, elevation: float, highest: float, cell: float, height: str = "h") -> DataFrame:
    """points (id, row, col, z0) with whether something higher than the beam above their own height z0 is towards the sun;
    what lies off the grid is open sky."""
    if elevation < LOW_SUN:
        return points.withColumn("shaded", F.lit(True))
    offsets = beam_offsets(points.sparkSession, azimuth, elevation, highest, cell)
    ahead = points.join(F.broadcast(offsets), F.lit(highest) - F.col("beam") - F.col("z0") > MARGIN).select("id", "z0", "beam", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    dark = ahead.join(cells.select("row", "col", F.col(height).alias("h")), ["row", "col"]).where(F.col("h") - F.col("beam") - F.col("z0") > MARGIN).select("id").distinct()
    return points.join(dark.withColumn("shaded", F.lit(True)), "id", "left").withColumn("shaded", F.coalesce("shaded", F.lit(False)))


def rasterise(polygons: DataFrame, cell: float, value: str, order: list[str]) -> DataFrame:
    """row, col, value of the cells whose centre a polygon (edges, value) holds; the last in `order` wins. Cells count from
    y = 0 southwards: row r covers -(r + 1) to -r cells."""
    tried = cells_of(polygons, cell)
    x, y = (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell
    held = tried.where(inside(x, y, F.col("edges")))
    top = F.max(F.struct(*order, value))[value]
    return held.groupBy((-F.col("cy") - 1).cast("int").alias("row"), F.col("cx").cast("int").alias("col")).agg(top.alias(value))


def edge_samples(edges: DataFrame, top: float, left: float, cell: float, samples: int = 8) -> DataFrame:
    """edges (x1, y1, x2, y2) at the middles of `samples` equal parts, with the cell (row, col) of each; cells are cut off towards zero."""
    s = edges.withColumn("at", F.explode(F.array(*[F.lit((i + 0.5) / samples) for i in range(samples)])))
    x, y = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("at"), F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("at")
    return s.withColumn("row", ((top - y) / cell).cast("int")).withColumn("col", ((x - left) / cell).cast("int"))


def gather(samples: DataFrame, cells: DataFrame, key: str, value: str, how: str = "mean") -> DataFrame:
    """key, value: over the samples inside the raster the mean (0 where none is) or the most frequent value (of equal ones the smallest)."""
    j = samples.select(key, "row", "col").join(cells.select("row", "col", F.col(value).alias("v")), ["row", "col"], "left")
    if how == "mean":
        return j.groupBy(key).agg((F.coalesce(F.sum("v"), F.lit(0.0)) / F.greatest(F.count("v"), F.lit(1))).alias(value))
    return j.groupBy(key).agg(F.coalesce(F.mode("v", deterministic=True), F.lit(0)).alias(value))


def nearest_class(cells: DataFrame, value: str, reach: int) -> DataFrame:
    """cells whose value is 0 take that of the nearest other cell within `reach` cells, of equal ones the smallest."""
    around = [(dr, dc, dr * dr + dc * dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if 0 < dr * dr + dc * dc <= reach * reach]
    offsets = cells.sparkSession.createDataFrame(around, "dr int, dc int, d int")
    sent = cells.where(F.col(value) != 0).join(F.broadcast(offsets)).select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "d", F.col(value).alias("v"))
    best = sent.groupBy("row", "col").agg(F.min(F.struct("d", "v"))["v"].alias("near"))
    return cells.join(best, ["row", "col"], "left").withColumn(value, F.when(F.col(value) != 0, F.col(value)).otherwise(F.coalesce("near", F.lit(0)))).drop("near")
