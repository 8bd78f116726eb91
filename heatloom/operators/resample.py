"""Bootstrap of medians for groups of any size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import ensure_checkpoints
from .quantiles import at_ranks, exact_quantiles, value_counts

#: Resamples of a row of work.
LOT = 250


def median_ranks(n: int, lots: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of `lots` resamples with replacement from n sorted values the ranks (from 0) whose values' mean is the median.

    A resample takes the value at rank floor(n u) for each of n uniform numbers, so that its median needs no more than the middle
    ones of n sorted uniform numbers. Those have Beta distributions: the m-th of n is Beta(m, n - m + 1), and the next one
    lies in what is left of it above by Beta(1, n - m)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    m = (n + 1) // 2
    low = rng.beta(m, n - m + 1, lots)
    high = low if n % 2 else low + (1.0 - low) * rng.beta(1, n - m, lots)
    return tuple(np.minimum((u * n).astype(np.int64), n - 1) for u in (low, high))


def sign_test(up: int, n: int) -> float:
    """Exact two-sided probability of at least so uneven a split of n fair coins, `up` of which show heads."""
    k = max(up, n - up)
    i = np.arange(1, n + 1, dtype=float)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n + 1 - i) / i))]) - n * np.log(2.0)  # of the binomial weights
    return min(1.0, 2.0 * float(np.exp(logs[k:]).sum()))


def bootstrap_median(df: DataFrame, by: list[str], value: str, resamples: int = 4000, seed: int = 0, least: int = 3) -> DataFrame:
    """by, n, median, low, high (2.5 and 97.5 % of the medians of resamples), pos (values above 0) and p (sign test). Groups of fewer than
    `least` values have n and nulls. Only the ranks of medians are drawn, by lots that are seeded by the group's key, so that
    neither partitions nor other groups matter; values are then looked up by rank. No task holds a group."""
    ensure_checkpoints(df.sparkSession)
    counts, names = value_counts(df, by, value)
    counts = counts.checkpoint()
    whole = counts.groupBy("g", *names).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") > 0, F.col("c")).otherwise(0)).alias("pos")).checkpoint()
    lots = -(-resamples // LOT)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, n, lot in zip(pdf["g"], pdf["n"], pdf["lot"], strict=True):
                size = min(LOT, resamples - lot * LOT)
                low, high = median_ranks(int(n), size, [seed, zlib.crc32(g.encode()), int(lot)])
                yield pd.DataFrame({"g": g, "i": lot * LOT + np.arange(size), "low": low, "high": high})

    large = whole.where(F.col("n") >= least)
    drawn = large.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")).repartition("g", "lot").mapInPandas(draw, "g string, i long, low long, high long").checkpoint()
    ranks = drawn.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = at_ranks(counts, ranks).select("g", "rank", "v").checkpoint()
    at = lambda c: found.select("g", F.col("rank").alias(c), F.col("v").alias(f"v_{c}"))
    medians = drawn.join(at("low"), ["g", "low"]).join(at("high"), ["g", "high"]).select("g", ((F.col("v_low") + F.col("v_high")) / 2).alias("m"))
    ends = exact_quantiles(medians, ["g"], "m", [0.025, 0.975]).select("g", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    middle = at_ranks(counts, large.select("g", F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank"))).groupBy("g").agg(F.avg("v").alias("median"))

    @F.pandas_udf("double")
    def split(up: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([sign_test(int(a), int(b)) for a, b in zip(up, n, strict=True)], dtype=float)

    out = whole.join(middle, "g", "left").join(ends, "g", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], "n", "median", "low", "high", "pos", F.when(F.col("n") >= least, split("pos", "n")).alias("p"))
