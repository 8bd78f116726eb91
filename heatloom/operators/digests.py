"""Where two rasters differ: digests of tiles are compared first, cells only where those differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells of a tile's side, and tiles of the side of a tile one level up.
TILE, FAN = 64, 8


def tile_of(tile: int = TILE) -> list[Column]:
    return [F.floor(F.col(c) / tile).cast("long").alias(n) for c, n in (("row", "tr"), ("col", "tc"))]


def digests(cells: DataFrame, value: str = "v", tile: int = TILE, fan: int = FAN, levels: int = 3) -> DataFrame:
    """level (0: tiles), tr, tc, n, digest: sums of two hashes of each cell's place and value, so that neither the order of cells nor
    their partitioning matters; a level's digests are the sums of the one below, fan * fan of them. Equal bit for bit: -0.0
    and 0.0 differ, and NaNs are equal to NaNs."""
    bits = F.when(F.col(value).cast("double") == 0, F.col(value).cast("string")).otherwise(F.col(value).cast("double").cast("string"))
    hashed = [F.sum(F.xxhash64(F.lit(seed), F.col("row").cast("long"), F.col("col").cast("long"), F.coalesce(bits, F.lit("null"))).cast("decimal(20,0)")).alias(n) for seed, n in ((1, "d1"), (2, "d2"))]
    out = cells.groupBy(*tile_of(tile)).agg(F.count("*").alias("n"), *hashed).withColumn("level", F.lit(0))
    own = whole = out
    for i in range(1, levels):
        up = [F.floor(F.col(c) / fan).alias(c) for c in ("tr", "tc")]
        own = own.groupBy(*up).agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2")).withColumn("level", F.lit(i))
        whole = whole.unionByName(own.select(*[F.col(c).cast(out.schema[c].dataType) for c in out.columns]))
    return whole.select("level", "tr", "tc", "n", F.concat_ws(":", "n", "d1", "d2").alias("digest"))


def differing_tiles(a: DataFrame, b: DataFrame, fan: int = FAN) -> DataFrame:
    """tr, tc of the tiles that differ, from digests of both, found from the top level down."""
    levels = a.agg(F.max("level")).first()[0]
    open_ = None
    for i in range(0 if levels is None else levels, -1, -1):
        x, y = (d.where(F.col("level") == i).select("tr", "tc", F.col("digest").alias(n)) for d, n in ((a, "x"), (b, "y")))
        if open_ is not None:
            up = [F.floor(F.col(c) / fan).cast("long").alias(f"u{c}") for c in ("tr", "tc")]
            above = open_.select(F.col("tr").alias("utr"), F.col("tc").alias("utc"))
            x, y = (d.select("*", *up).join(above, ["utr", "utc"], "left_semi").select("tr", "tc", n) for d, n in ((x, "x"), (y, "y")))
        open_ = x.join(y, ["tr", "tc"], "full").where("not (x <=> y)").select("tr", "tc")
    return open_


def differences(a: DataFrame, b: DataFrame, value: str = "v", tile: int = TILE, da: DataFrame | None = None, db: DataFrame | None = None) -> DataFrame:
    """row, col, a, b of the cells (row, col, value) that only one raster has or that differ; da, db: their digests, if known. Only cells of
    differing tiles are joined."""
    tiles = differing_tiles(digests(a, value, tile) if da is None else da, digests(b, value, tile) if db is None else db)

    def held(cells: DataFrame, name: str) -> DataFrame:
        named = cells if {"tr", "tc"} <= set(cells.columns) else cells.select("*", *tile_of(tile))
        return named.join(tiles, ["tr", "tc"], "left_semi").select("row", "col", F.col(value).alias(name), F.lit(True).alias(f"in_{name}"))

    j = held(a, "a").join(held(b, "b"), ["row", "col"], "full")
    return j.where("not (in_a <=> true and in_b <=> true and a <=> b)").select("row", "col", "a", "b")


def write_raster(cells: DataFrame, path: str, value: str = "v", tile: int = TILE) -> None:
    """cells by tile, a folder each, and their digests beside them."""
    cells.select("row", "col", value, *tile_of(tile)).repartition("tr", "tc").write.partitionBy("tr", "tc").parquet(f"{path}/cells")
    digests(cells, value, tile).write.parquet(f"{path}/digests")


def file_differences(spark: SparkSession, first: str, second: str, value: str = "v", tile: int = TILE, most: int = 1000) -> DataFrame:
    """differences of two rasters of write_raster: only folders of differing tiles are read where there are at most `most`; else
    all are read and joined."""
    da, db = (spark.read.parquet(f"{p}/digests") for p in (first, second))
    a, b = (spark.read.parquet(f"{p}/cells") for p in (first, second))
    tiles = differing_tiles(da, db)
    named = tiles.limit(most + 1).collect()
    if len(named) <= most:
        here = F.lit(False)
        for t in named:
            here |= (F.col("tr") == t.tr) & (F.col("tc") == t.tc)
        a, b = a.where(here), b.where(here)
    return differences(a, b, value, tile, da, db)
