"""All registered queries of the activity analytics over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import metrics
from tidemill.functions import parsing
from tidemill.operators import counters, dedupe, ranking, routing
from tidemill.plans import oracle, queries as q
from tidemill.sinks import store
from tidemill.sources import tables
from tidemill.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]


def _friendships(spark: SparkSession, d: str) -> DataFrame:
    return tables.friendships(tables.events(spark, d))


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return tables.comments(tables.events(spark, d))


def _activity(spark: SparkSession, d: str) -> DataFrame:
    e = tables.events(spark, d)
    return ranking.activity(tables.sign_ups(e), tables.posts(e), tables.comments(e))


def _order_days(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").alias("ts"))


def _merge_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rankings of the first and second half of each day."""
    rows = routing.post_comments(_comments(spark, d)).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "ts", F.col("parent_id").alias("id"))

    def half(df: DataFrame) -> DataFrame:
        return ranking.top_k(df.groupBy("day", "id").agg(F.count("*").alias("score"), F.max("ts").alias("last_ts")), ("day",), "id").drop("rank")

    return half(rows.where(F.hour("ts") < 12)), half(rows.where(F.hour("ts") >= 12))


def _merged(combine) -> Query:
    return lambda s, d: combine(*_merge_inputs(s, d), ("day",), "id").select("day", "rank", "id", "score")


def _board_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.events(spark, d).select(F.col("user_id").alias("id"), F.lit(1).alias("score"), "ts")
    return ranking.top_k(ranking.board(rows), (), "id").select("rank", "id", "score")


def _board_last(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.events(spark, d).select(F.col("user_id").alias("id"), tables.target().alias("score"), "ts", "event_id")
    return ranking.top_k(ranking.board_of_last(rows, order=("ts", "event_id")), (), "id").select("rank", "id", "score")


def _board_score_of(spark: SparkSession, d: str) -> DataFrame:
    e = tables.events(spark, d)
    board = ranking.board(e.where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.lit(1).alias("score"), "ts"))
    return ranking.score_of(board, e.select(tables.target().alias("id")).distinct())


def _pair_keys(spark: SparkSession, d: str) -> DataFrame:
    return _friendships(spark, d).groupBy(dedupe.pair_key(F.col("user_id1"), F.col("user_id2")).alias("pair_key")).agg(F.count("*").alias("n"))


def _parsed(kind: str) -> Query:
    parse = {"friendships": parsing.parse_friendships, "comments": parsing.parse_comments, "posts": parsing.parse_posts}[kind]
    return lambda s, d: parse(tables.text_lines(tables.events(s, d), kind)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _unchecked(spark: SparkSession, d: str) -> DataFrame:
    """Time stamps and users read from lines without validation."""
    line = F.col("value")
    return tables.text_lines(tables.events(spark, d), "posts").select(parsing.timestamp_of(line).cast("timestamp_ntz").alias("ts"), parsing.author_of(line).alias("user_id"))


def _union_activity(spark: SparkSession, d: str) -> DataFrame:
    return _activity(spark, d).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in "abc"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    frames = {n: q.published_posts(q.commented_posts(_comments(spark, d), *w)) for n, w in q.TUMBLING.items()}
    return routing.labelled_union("granularity", **frames)


def _split(spark: SparkSession, d: str) -> DataFrame:
    parts = routing.split_by(tables.events(spark, d), "event_type", "click", "view")
    return routing.labelled_union("tag", **parts).groupBy("tag").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def _posts(w: str, windows: dict, more: dict | None = None) -> Query:
    return lambda s, d: q.published_posts(q.commented_posts(_comments(s, d), *windows[w], **(more or {})))


def _users(w: str, windows: dict) -> Query:
    return lambda s, d: q.published_users(q.active_users(_activity(s, d), *windows[w]))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "q1_dedupe_pairs": lambda s, d: q.new_friendships(_friendships(s, d)).select("hi", "lo", "ts", "event_id"),
        "q1_pair_key": _pair_keys,
        "q1_daily": lambda s, d: q.friendships_daily(_friendships(s, d)),
        "q1_daily_dst": lambda s, d: counters.hour_counters(_order_days(s, d)),
        "q1_daily_by_user": lambda s, d: counters.hour_counters(_friendships(s, d).withColumnRenamed("user_id1", "user_id"), keys=("user_id",)),
        "q1_weekly_by_user": lambda s, d: counters.roll_up(counters.hour_counters(_friendships(s, d).withColumnRenamed("user_id1", "user_id"), keys=("user_id",)), F.window("ts", "7 days"), ("user_id",)),
        "q1_weekly_sliding": lambda s, d: q.friendships_weekly(_friendships(s, d)),
        "q1_weekly_tumbling": lambda s, d: q.friendships_weekly(_friendships(s, d), sliding=False),
        "q1_alltime": lambda s, d: q.friendships_all_time(_friendships(s, d)),
        "q1_alltime_by_week": lambda s, d: counters.running(q.friendships_weekly(_friendships(s, d), sliding=False)),
        "q1_alltime_running": lambda s, d: counters.running_total_stamped_first(q.friendships_daily(_friendships(s, d))),
        "q2_hourly_tumbling": _posts("hourly", q.TUMBLING),
        "q2_weekly_tumbling": _posts("weekly", q.TUMBLING),
        "q2_hourly_sliding": _posts("hourly", q.SLIDING),
        "q2_daily_sliding": _posts("daily", q.SLIDING),
        "q2_weekly_sliding": _posts("weekly", q.SLIDING),
        "q2_daily_sliding_direct": _posts("daily", q.SLIDING, {"use_panes": False}),
        "q2_daily_rollup": lambda s, d: q.published_posts(q.commented_posts_rollup(_comments(s, d)), "ts"),
        "q2_weekly_rollup": lambda s, d: q.published_posts(q.commented_posts_rollup(_comments(s, d), "weekly"), "ts"),
        "q2_hourly_wide": lambda s, d: ranking.wide(q.commented_posts(_comments(s, d), *q.TUMBLING["hourly"]), "window_start", "post_id", "score", "post_id", "num_comments"),
        "q2_daily_rendered": lambda s, d: ranking.render(q.commented_posts(_comments(s, d), *q.TUMBLING["daily"]), "window_start", "post_id", F.col("score")),
        "q3_hourly_tumbling": _users("hourly", q.TUMBLING),
        "q3_hourly_sliding": _users("hourly", q.SLIDING),
        "q3_daily_sliding": _users("daily", q.SLIDING),
        "q3_weekly_sliding": _users("weekly", q.SLIDING),
        "q3_daily_rollup": lambda s, d: q.published_users(q.active_users_rollup(_activity(s, d)), "ts"),
        "q3_weekly_rollup": lambda s, d: q.published_users(q.active_users_rollup(_activity(s, d), "weekly"), "ts"),
        "q3_hourly_wide": lambda s, d: ranking.wide(q.active_users(_activity(s, d), *q.TUMBLING["hourly"]), "window_start", "user_id", "score", "user", "rating"),
        "parse_friendships": _parsed("friendships"),
        "parse_comments": _parsed("comments"),
        "parse_posts": _parsed("posts"),
        "parse_unchecked": _unchecked,
        "filter_post_comments": lambda s, d: routing.post_comments(_comments(s, d)).select("ts", "comment_id", "parent_id"),
        "union_activity": _union_activity,
        "union_granularities": _labelled,
        "split_streams": _split,
        "rank_merge": _merged(ranking.merge_rankings),
        "rank_incremental_merge": _merged(ranking.add_rankings),
        "board_topk": _board_topk,
        "board_insert_last_wins": _board_last,
        "board_score_of": _board_score_of,
        "latency_by_window": lambda s, d: metrics.latency_by_window(tables.events(s, d), F.col("value")),
        "latency_running_mean": lambda s, d: metrics.running_mean(metrics.latency_by_window(tables.events(s, d), F.col("value"))),
        "results_store_roundtrip": lambda s, d: store.round_trip(q.published_posts(q.commented_posts(_comments(s, d), *q.TUMBLING["daily"])), "posts_day"),
        "stream_q1_daily": pipelines.over_events(pipelines.friendships_daily),
        "stream_q2_hourly": pipelines.over_events(pipelines.posts_hourly),
        "stream_q2_daily_rollup": pipelines.over_events(pipelines.posts_daily_rollup),
        "stream_q3_hourly": pipelines.over_events(pipelines.users_hourly),
        "stream_q1_alltime": pipelines.over_events(pipelines.friendships_all_time, pipelines.all_time_of),
    }
    return found


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
