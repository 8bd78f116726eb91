"""The rows that no other row of their group beats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pareto(df: DataFrame, by: str, x: str, y: str, lots: int = 16) -> DataFrame:
    """Rows to which no row of the same group is at least as good in x and y and better in one (smaller is better).

    The least y of each x is kept, then a running minimum over smaller x decides; first in lots of a group, so that a
    group of any size is dealt over several tasks, then among what the lots leave. Rows with a null in x or y are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    lows = rows.groupBy(by, x).agg(F.min(y).alias(y))

    def left(points: DataFrame, *keys: str) -> DataFrame:
        before = F.min(y).over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
        return points.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(y) < F.col("__before"))).drop("__before")

    best = left(left(lows.withColumn("__lot", F.pmod(F.xxhash64(x), F.lit(lots))), by, "__lot").drop("__lot"), by)
    return rows.join(best.select(F.col(by).alias("__b"), F.col(x).alias("__x"), F.col(y).alias("__y")), F.col(by).eqNullSafe(F.col("__b")) & (F.col(x) == F.col("__x")) & (F.col(y) == F.col("__y")), "left_semi")
