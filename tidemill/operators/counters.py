"""Twenty-four hour-of-day counters: by day, rolled up to weeks, and since the beginning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.schemas import COUNTERS, HOURS
from tidemill.functions.timeutil import DAY, WEEK, dublin_hour, sliding, tumbling


def counter_columns(hour: Column) -> list[Column]:
    return [F.count_if(hour == h).alias(c) for h, c in zip(HOURS, COUNTERS, strict=True)]


def hour_counters(df: DataFrame, size: str = DAY, keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """keys, ts (window start) and the counters of Dublin hours of a window; incremental, from raw rows."""
    hour = dublin_hour(F.col(ts))
    counted = df.groupBy(*keys, tumbling(F.col(ts), size).alias("_w")).agg(*counter_columns(hour))
    return counted.select(*keys, F.col("_w.start").alias("ts"), *COUNTERS)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS]


def roll_up(counters: DataFrame, window: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of counter rows (of days, say) by a window over their ts."""
    return counters.groupBy(*keys, window.alias("_w")).agg(*_sums()).select(*keys, F.col("_w.start").alias("ts"), *COUNTERS)


def weekly_sliding(daily: DataFrame) -> DataFrame:
    """Seven-day windows that start every day, those before the first full week included."""
    return roll_up(daily, sliding(F.col("ts"), WEEK, DAY))


def weekly_tumbling(daily: DataFrame) -> DataFrame:
    return roll_up(daily, tumbling(F.col("ts"), WEEK))


def all_time(counters: DataFrame) -> DataFrame:
    """One row: the least window start and the sums over everything. No rows for no input."""
    return counters.agg(F.min("ts").alias("ts"), *_sums()).where("ts is not null")


def running(counters: DataFrame) -> DataFrame:
    """For each row (a day or a week), the sums up to it; the rows are as many as windows, not as events."""
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return counters.select("ts", *[F.sum(c).over(so_far).alias(c) for c in COUNTERS])


def running_total_stamped_first(counters: DataFrame) -> DataFrame:
    """``running``, each row stamped with the first window's start: what a running all-time process emits."""
    so_far = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return counters.select(F.min("ts").over(so_far).alias("ts"), F.col("ts").alias("upto"), *[F.sum(c).over(so_far).alias(c) for c in COUNTERS])


def add_arrays(a: Column, b: Column) -> Column:
    """Element-wise sum of two arrays of counters."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def as_array() -> Column:
    return F.array(*COUNTERS)


def total(counters: DataFrame) -> DataFrame:
    """ts and the sum of all 24 counters."""
    return counters.select("ts", reduce(lambda x, y: x + y, map(F.col, COUNTERS)).alias("total"))
