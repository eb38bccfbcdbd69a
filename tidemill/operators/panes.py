"""Sliding windows over panes: rows are aggregated once by slide, and only panes are copied into windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.timeutil import sliding, tumbling


def pane_aggregate(df: DataFrame, slide: str, keys: tuple[str, ...], sums: dict[str, Column], ts: str = "ts") -> DataFrame:
    """pane, keys, the named sums, and last_ts, the latest event time."""
    made = [F.sum(e).cast("bigint").alias(n) for n, e in sums.items()]
    return df.groupBy(tumbling(F.col(ts), slide).alias("_w"), *keys).agg(*made, F.max(ts).alias("last_ts")).select(F.col("_w.start").alias("pane"), *keys, *sums, "last_ts")


def slide_over(panes: DataFrame, size: str, slide: str, keys: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """window_start, keys, sums, last_ts. ``size`` has to be a multiple of ``slide``."""
    made = [F.sum(n).alias(n) for n in sums]
    return panes.groupBy(sliding(F.col("pane"), size, slide).alias("_w"), *keys).agg(*made, F.max("last_ts").alias("last_ts")).select(F.col("_w.start").alias("window_start"), *keys, *sums, "last_ts")


def windowed(df: DataFrame, size: str, slide: str | None, keys: tuple[str, ...], sums: dict[str, Column], ts: str = "ts", panes: bool = True) -> DataFrame:
    """Sums by window and keys; ``panes=False`` lets every row be copied into its windows, for comparison."""
    if slide is None:
        return pane_aggregate(df, size, keys, sums, ts).withColumnRenamed("pane", "window_start")
    if panes:
        return slide_over(pane_aggregate(df, slide, keys, sums, ts), size, slide, keys, tuple(sums))
    made = [F.sum(e).cast("bigint").alias(n) for n, e in sums.items()]
    return df.groupBy(sliding(F.col(ts), size, slide).alias("_w"), *keys).agg(*made, F.max(ts).alias("last_ts")).select(F.col("_w.start").alias("window_start"), *keys, *sums, "last_ts")
