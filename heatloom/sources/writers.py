"""Writers: rasters by slot, manifests, fits, score tables, map lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raster(cells: DataFrame, path: str) -> None:
    """Cells (slot, row, col, values), a folder for each slot."""
    cells.repartition("slot", "row").write.partitionBy("slot").mode("overwrite").parquet(path)


def shade_set(cells: DataFrame, path: str, date: str, step: int, stamp: dict[str, str] | None = None) -> None:
    """A raster and its manifest. The manifest is written when all cells are, so that a set that can be found is whole, and again
    with the stamp of what made it, which readers may miss but need not wait for."""
    spark = cells.sparkSession
    raster(cells, f"{path}/cells")
    slots = [r.slot for r in spark.read.parquet(f"{path}/cells").select("slot").distinct().orderBy("slot").collect()]  # at most a day's slots
    plain = spark.createDataFrame([(date, step, slots)], "date string, step_min int, slots array<int>")
    plain.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if stamp is not None:
        plain.withColumn("stamp", F.lit(None) if not stamp else F.create_map(*[F.lit(x) for kv in sorted(stamp.items()) for x in kv])).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def fit(shapes: DataFrame, path: str, kind: str = "diurnal_shape") -> None:
    """A fit (season, hr, shape, level) as one JSON document."""
    by = shapes.groupBy("season").agg(F.transform(F.array_sort(F.collect_list(F.struct("hr", "shape"))), lambda x: x["shape"]).alias("shape"), F.first("level").alias("level"))
    doc = by.agg(F.first("level").alias("level"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("season", "shape")))).alias("seasons"))  # one row for each season
    doc.select(F.lit(kind).alias("kind"), "level", "seasons").coalesce(1).write.mode("overwrite").json(path)


def scores(table: DataFrame, path: str) -> None:
    """A small table as one CSV file with names."""
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def line_feature(points: Column, **properties: Column) -> Column:
    """GeoJSON text of a line: points is an array of structs (lon, lat)."""
    pairs = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"), geometry.alias("geometry")))
