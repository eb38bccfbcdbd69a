"""Latency and progress figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemill.functions.timeutil import HOUR, tumbling


def stamped(df: DataFrame, column: str = "ingest_ts") -> DataFrame:
    """Rows with the time they were read."""
    return df.withColumn(column, F.current_timestamp())


def latency_since(column: str = "ingest_ts") -> Column:
    """Milliseconds from the stamp to now; one clock for both."""
    return F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(column))


def latency_by_window(df: DataFrame, latency: Column, size: str = HOUR, ts: str = "ts") -> DataFrame:
    """window_start, max, min and mean latency, the number of rows, and the sum in hundredths (exact to add up)."""
    w = df.groupBy(tumbling(F.col(ts), size).alias("_w"))
    made = w.agg(F.max(latency).alias("max_latency"), F.min(latency).alias("min_latency"), F.round(F.avg(latency), 6).alias("avg_latency"), F.count("*").alias("n"), F.sum(F.round(latency * 100).cast("bigint")).alias("sum_cents"))
    return made.select(F.col("_w.start").alias("window_start"), "max_latency", "min_latency", "avg_latency", "n", "sum_cents")


def running_mean(windows: DataFrame) -> DataFrame:
    """Mean latency of everything up to each window."""
    so_far = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return windows.select("window_start", F.round(F.sum("sum_cents").over(so_far) / F.sum("n").over(so_far) / F.lit(100.0), 6).alias("mean_latency"))


class LatencyMeter:
    """Mean of samples, reported every ``every`` of them and then begun anew."""

    def __init__(self, every: int = 10_000, report=print) -> None:
        self.every, self.report, self.count, self.total = every, report, 0, 0.0

    def add(self, latency_ms: float) -> None:
        self.count += 1
        self.total += latency_ms
        if self.count == self.every:
            self.report(self.mean())
            self.count, self.total = 0, 0.0

    def mean(self) -> float:
        return self.total / self.count if self.count else 0.0


class ProgressLog(StreamingQueryListener):
    """Keeps rows per second and batch duration of each micro-batch of every query."""

    def __init__(self, keep: int = 1000) -> None:
        self.keep, self.batches = keep, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((p.name, p.batchId, p.numInputRows, p.processedRowsPerSecond, p.batchDuration))
        del self.batches[: -self.keep]

    def onQueryTerminated(self, event) -> None:
        pass
