"""Streaming twins of the analytics.

Windowed counts and panes are the batch functions on a stream. Two operators need another form: the first friendship of a
pair is found in the micro-batch and kept by a state per pair, and a ranking is a sorted, sliced list per window instead of
a row number. Results in append mode are each window's final value. A bounded run is closed by a row far in the future, so
that the last windows are passed by the watermark; it is filtered out again.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.schemas import COUNTERS, TOP
from tidemill.functions.timeutil import DAY, HOUR, tumbling
from tidemill.operators import counters, dedupe, ranking, routing
from tidemill.session import ship_package
from tidemill.sources import tables
from tidemill.streaming.folders import shared_folder

SENTINEL = dt.datetime(2200, 1, 1)  # within the range of nanosecond clocks
EVENTS = tables.EVENTS.replace("TIMESTAMP_NTZ", "TIMESTAMP")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores: without preallocated files (some 4 MB for each operator's partition), and with one memory limit an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
BUCKETS = 32  # of pairs, for each shuffle partition: enough to be dealt evenly
HELD_ROWS = 1 << 17  # rows that a bucket holds before they are reduced to one a pair


class LeastOfPairs(StatefulProcessor):
    """Passes on the least (ts, event_id) row of each pair in a bucket's rows of a micro-batch, nulls last; keeps no state.

    Python is called once a bucket, not once a pair, and holds one row a pair of it. Late rows are dropped before, so that
    a pair's late row doesn't hide a later one that counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, n, limit = [], 0, HELD_ROWS
        for part in rows:
            parts.append(part[["hi", "lo", "ts", "no_id", "event_id"]])
            n += len(part)
            if n > limit:
                parts = [_least(parts)]
                n = len(parts[0])
                limit = max(HELD_ROWS, 2 * n)
        if n:
            yield _least(parts)

    def close(self) -> None:
        pass


def _least(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(parts).sort_values(["ts", "no_id", "event_id"]).drop_duplicates(["hi", "lo"])


def first_friendships(friendships: DataFrame) -> DataFrame:
    """hi, lo, ts, event_id of each pair's least row in the first micro-batch that has the pair, and nothing after.

    The state, one flag a pair, is never dropped. Built-in deduplication keeps it, but of rows that come together it passes
    on any, so it is given one row a pair. Buckets hold no state: their number may change between runs.
    """
    spark = friendships.sparkSession
    ship_package(spark)
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = (F.lit(x).cast("bigint") for x in (-(2**63), 2**63 - 1))  # hi below lo: no users; a null would make floats of all ids in pandas
    pairs = dedupe.canonical_pair(friendships).select(F.coalesce("hi", low).alias("hi"), F.coalesce("lo", high).alias("lo"), "ts", F.isnull("event_id").alias("no_id"), F.coalesce("event_id", F.lit(0)).alias("event_id"))
    buckets = pairs.withColumn("bucket", F.pmod(F.xxhash64("hi", "lo"), F.lit(n))).groupBy("bucket")
    least = buckets.transformWithStateInPandas(LeastOfPairs(), "hi bigint, lo bigint, ts timestamp, no_id boolean, event_id bigint", "Append", "EventTime", eventTimeColumnName="ts")
    first, known = least.dropDuplicates(["hi", "lo"]), F.col("hi") >= F.col("lo")
    return first.select(F.when(known, F.col("hi")).alias("hi"), F.when(known, F.col("lo")).alias("lo"), "ts", F.when(~F.col("no_id"), F.col("event_id")).alias("event_id"))


def first_friendships_within(friendships: DataFrame, horizon: str) -> DataFrame:
    """Bounded alternative: a pair is new again after ``horizon``; keeps any of the rows that come together."""
    return dedupe.canonical_pair(friendships).withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["hi", "lo"])


def top_k_list(scores: DataFrame, window: Column, id_col: str, columns: tuple[str, ...] = (), k: int = TOP) -> DataFrame:
    """The batch top-k as an aggregate: rank, id, columns, score, last_ts of the best k of each window."""
    row = F.struct(F.col("score"), F.col("last_ts"), F.col(id_col), *columns)
    best = scores.groupBy(window.alias("window")).agg(F.slice(F.sort_array(F.collect_list(row), asc=False), 1, k).alias("best"))
    return best.select("window", F.posexplode("best").alias("pos", "row")).select("window", (F.col("pos") + 1).alias("rank"), "row.*")


def _events(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Events whose watermark stays ``delay`` behind the latest; rows behind the watermark are late and dropped."""
    return events.withWatermark("ts", delay)


def friendships_daily(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return counters.hour_counters(first_friendships(tables.friendships(_events(events, delay))))


def friendships_all_time(events: DataFrame) -> DataFrame:
    """Complete mode: the least row of each pair; ``all_time_of`` counts them when a micro-batch is written."""
    kept = tables.friendships(events.where(F.col("ts") < F.lit(SENTINEL)))
    return dedupe.canonical_pair(kept).groupBy("hi", "lo").agg(F.min(F.struct("ts", "event_id")).alias("first")).select("first.ts")


def all_time_of(pairs: DataFrame) -> DataFrame:
    """One row: the first day and the counters since then."""
    made = pairs.agg(F.min(F.date_trunc("day", "ts")).alias("ts"), *counters.counter_columns(counters.dublin_hour(F.col("ts"))))
    return made.where("ts is not null")


def posts_hourly(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    hits = routing.post_comments(tables.comments(_events(events, delay))).select("ts", F.col("parent_id").alias("post_id"))
    scores = hits.groupBy(tumbling(F.col("ts"), HOUR).alias("window"), "post_id").agg(F.count("*").alias("score"), F.max("ts").alias("last_ts"))
    best = top_k_list(scores, F.col("window"), "post_id")
    return best.select(F.col("window.start").alias("window_start"), F.col("rank").cast("int"), "post_id", F.col("score").alias("num_comments"))


def posts_daily_rollup(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    hits = routing.post_comments(tables.comments(_events(events, delay))).select("ts", F.col("parent_id").alias("post_id"))
    scores = hits.groupBy(tumbling(F.col("ts"), HOUR).alias("window"), "post_id").agg(F.count("*").alias("score"), F.max("ts").alias("last_ts"))
    hourly = top_k_list(scores, F.col("window"), "post_id")
    summed = hourly.groupBy(F.window("window", DAY).alias("window"), "post_id").agg(F.sum("score").alias("score"), F.max("last_ts").alias("last_ts"), F.min("window.start").alias("stamp"))
    row = F.struct(F.col("score"), F.col("last_ts"), F.col("post_id"))
    best = summed.groupBy("window").agg(F.slice(F.sort_array(F.collect_list(row), asc=False), 1, TOP).alias("best"), F.min("stamp").alias("ts"))
    rows = best.select("window", "ts", F.posexplode("best").alias("pos", "row"))
    return rows.select(F.col("window.start").alias("window_start"), (F.col("pos") + 1).cast("int").alias("rank"), "row.post_id", F.col("row.score").alias("num_comments"), "ts")


def users_hourly(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    e = _events(events, delay)
    rows = ranking.activity(tables.sign_ups(e), tables.posts(e), tables.comments(e))
    sums = [F.sum(c).cast("bigint").alias(c) for c in "abc"]
    scores = rows.groupBy(tumbling(F.col("ts"), HOUR).alias("window"), "user_id").agg(*sums, F.max("ts").alias("last_ts")).withColumn("score", ranking.activity_score())
    best = top_k_list(scores, F.col("window"), "user_id", ("a", "b", "c"))
    return best.select(F.col("window.start").alias("window_start"), F.col("rank").cast("int"), "user_id", "a", "b", "c", "score")


def bounded_run(events: DataFrame, pipeline: Callable[[DataFrame], DataFrame], flush: bool = True, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a pipeline over a bounded table of events as a stream, and read its result back.

    The table is staged in the shared folder, since a file stream reads folders; with ``flush`` a closing row is staged
    too. With ``finish`` the stream runs in complete mode, and each micro-batch replaces the result by ``finish`` of the whole.
    The result has time stamps without zone, as the batch queries have.
    """
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    staged = events.select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    staged.write.parquet(f"{folder}/in")
    if flush:  # of every type, so that each branch of a pipeline sees it; ids of its own
        kinds = [(-1 - i, SENTINEL, -1 - i, t, 0.0, '{"k": -1}') for i, t in enumerate(("click", "purchase", "signup"))]
        spark.createDataFrame(kinds, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    own = spark.newSession()  # so that runs at the same time don't disturb each other's settings
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    for name, value in STATE.items():
        own.conf.set(name, value)
    made = pipeline(own.readStream.schema(EVENTS).parquet(f"{folder}/in"))
    writer = made.writeStream.outputMode("append" if finish is None else "complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if finish is None:
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
    else:
        writer.foreachBatch(lambda df, _: finish(df).write.mode("overwrite").parquet(f"{folder}/out")).start().awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{folder}/out") if finish is None else spark.read.parquet(f"{folder}/out")
    times = [c for c, kind in out.dtypes if kind == "timestamp"]
    first = times[0]
    return out.where(F.col(first) < F.lit(SENTINEL) - F.expr("INTERVAL 8 DAYS")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def over_events(pipeline: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query that runs a pipeline over the events table."""
    return lambda spark, sf_dir: bounded_run(tables.events(spark, sf_dir), pipeline, finish=finish)


__all__ = ["COUNTERS", "LeastOfPairs", "bounded_run", "first_friendships", "friendships_all_time", "friendships_daily", "over_events", "posts_daily_rollup", "posts_hourly", "top_k_list", "users_hourly"]
