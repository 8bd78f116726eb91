"""Edges by slot: two tables bucketed by edge, so that gathers, decks and solves join without a shuffle.

The static table holds what does not change with the time of day; the slots table a shade for each edge and slot, a folder a slot, so
that one slot is replaced without touching the others."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class EdgeIndex:
    """name: of the tables in the session's catalogue; path: the shared folder that holds them."""

    spark: SparkSession
    name: str
    path: str
    buckets: int = 32

    def _save(self, df: DataFrame, part: str, mode: str, by: list[str]) -> None:
        w = df.repartition(self.buckets, "edge").sortWithinPartitions(*by, "edge").write.format("parquet").mode(mode).option("path", f"{self.path}/{part}").bucketBy(self.buckets, "edge").sortBy("edge")
        (w.partitionBy(*by) if by else w).saveAsTable(f"{self.name}_{part}")

    def create(self, edges: DataFrame) -> None:
        """edges: edge (unique), length, indoor, covered, svf (null: not known) and others. Replaces all slots, too."""
        self._save(edges, "static", "overwrite", [])
        empty = edges.select("edge", F.lit(0.0).alias("shade"), F.lit(False).alias("raised"), F.lit(0).alias("slot")).limit(0)
        self._save(empty, "slots", "overwrite", ["slot"])

    def put(self, slot: int, flat: DataFrame, decks: DataFrame | None = None) -> None:
        """Replace one slot: flat (edge, shade) from the ground, decks (edge, shade) of raised edges, which overwrite it."""
        new = flat.select("edge", F.col("shade").cast("double").alias("shade"), F.lit(False).alias("raised"))
        if decks is not None:
            own = decks.select("edge", F.col("shade").cast("double").alias("deck"))
            joined = new.join(own, "edge", "full")
            new = joined.select("edge", F.coalesce("deck", "shade").alias("shade"), F.col("deck").isNotNull().alias("raised"))
        view = f"{self.name}_{uuid.uuid4().hex}"
        new.select("edge", "shade", "raised").repartition(self.buckets, "edge").sortWithinPartitions("edge").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name}_slots PARTITION (slot = {int(slot)}) SELECT edge, shade, raised FROM {view}")
        self.spark.catalog.dropTempView(view)

    def drop_slot(self, slot: int) -> None:
        """The slot has no raster any more: the sun is down, all of it is shade."""
        self.spark.sql(f"ALTER TABLE {self.name}_slots DROP IF EXISTS PARTITION (slot = {int(slot)})")

    def gather(self, slots: list[int]) -> DataFrame:
        """The static columns, slot, shade and raised. Edges and slots without a shade are dark; indoor and covered ones
        are dark and see no sky. One merge of the two tables' buckets; no rows move."""
        static = self.spark.table(f"{self.name}_static")
        known = self.spark.table(f"{self.name}_slots").where(F.col("slot").isin([int(s) for s in slots]))
        # a map for each edge: the buckets by edge serve the grouping and the join
        own = known.groupBy("edge").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct("shade", "raised")))).alias("__own"))
        j = static.hint("merge").join(own, "edge", "left").withColumn("slot", F.explode(F.array(*[F.lit(int(s)) for s in slots])))
        here = F.try_element_at("__own", F.col("slot"))
        shut = F.coalesce("indoor", F.lit(False)) | F.coalesce("covered", F.lit(False))
        shade = F.when(shut, 1.0).otherwise(F.coalesce(here["shade"], F.lit(1.0)))
        rest = [F.when(shut, 0.0).otherwise(F.col("svf")).alias("svf") if c == "svf" else F.col(c) for c in static.columns]
        return j.select(*rest, "slot", shade.alias("shade"), F.coalesce(here["raised"], F.lit(False)).alias("raised"))
