"""Streaming forms of the time-series operators; all of them run on streams and on tables, but for the stateful march."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(readings: DataFrame, late: str) -> DataFrame:
    return readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def window_mean(readings: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Mean value by site and window; rows later than `late` are left out."""
    w = _timed(readings, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "value", "n")


def dedupe_first(readings: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    return _timed(readings, late).dropDuplicatesWithinWatermark([key])


def dedupe_latest(readings: DataFrame, key: str = "user_id", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """The latest row of each key in each window; of rows at one time the one that is largest in its other columns, in their order."""
    rest = [c for c in readings.columns if c not in (key, "ts")]
    w = _timed(readings, late).groupBy(F.window("ts", width).alias("w"), key).agg(F.max(F.struct("ts", *rest)).alias("last"))
    return w.select(key, F.col("w.start").alias("start"), "last.*")


def lagged_pairs(readings: DataFrame, model: DataFrame, lag: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Readings (device, ts, value) beside the model row (device, ts, value) that is at most `lag` older, by an interval join that the watermark bounds."""
    a = _timed(readings, late).select("device", F.col("ts").alias("at"), F.col("value").alias("obs"))
    b = _timed(model, late).select(F.col("device").alias("d2"), F.col("ts").alias("of"), F.col("value").alias("mod"))
    return a.join(b, F.expr(f"device = d2 AND of <= at AND of > at - INTERVAL {lag}")).drop("d2")


def fresh(live: DataFrame, now: DataFrame, step: int = 30) -> DataFrame:
    """live (slot, value) where it is of the slot that `now` (minute) is nearest to, half to even."""
    slot = (F.bround(F.col("minute") / step) * step % 1440).cast("int")
    return live.join(F.broadcast(now.select(slot.alias("slot"))), "slot", "left_semi")


def march_stream(forcing: DataFrame, step: Callable[[float, float, float], float], start: float = 293.15) -> DataFrame:
    """site, ts, t: the temperature before each row of a stream of (site, ts, q, air), in the order of time in a batch; the state of a
    site, one number, is carried from batch to batch. step: temperature, q, air -> the next temperature."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, q, air in zip(rows["ts"], rows["q"], rows["air"], strict=True):
            out.append((key[0], ts, t))
            t = step(t, q, air)
        state.update((t,))
        yield pd.DataFrame(out, columns=["site", "ts", "t"])

    return forcing.groupBy("site").applyInPandasWithState(run, "site string, ts timestamp, t double", "t double", "append", GroupStateTimeout.NoTimeout)


def emit_slots(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Give each batch to a sink as it comes, nothing is kept: the query that runs until what there is has been read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
