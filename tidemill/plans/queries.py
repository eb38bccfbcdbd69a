"""The three analytics, as functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.timeutil import DAY, HOUR, WEEK
from tidemill.operators import counters, dedupe, panes, ranking, routing

#: Windows by name: size and slide (None: tumbling).
TUMBLING = {"hourly": (HOUR, None), "daily": (DAY, None), "weekly": (WEEK, None)}
SLIDING = {"hourly": (HOUR, "30 minutes"), "daily": ("24 hours", HOUR), "weekly": (WEEK, DAY)}


def new_friendships(friendships: DataFrame) -> DataFrame:
    """hi, lo, ts, event_id of each pair's first friendship."""
    return dedupe.first_wins(dedupe.canonical_pair(friendships))


def friendships_daily(friendships: DataFrame) -> DataFrame:
    return counters.hour_counters(new_friendships(friendships))


def friendships_weekly(friendships: DataFrame, sliding: bool = True) -> DataFrame:
    daily = friendships_daily(friendships)
    return counters.weekly_sliding(daily) if sliding else counters.weekly_tumbling(daily)


def friendships_all_time(friendships: DataFrame) -> DataFrame:
    return counters.all_time(friendships_daily(friendships))


def commented_posts(comments: DataFrame, size: str, slide: str | None, k: int = 10, use_panes: bool = True) -> DataFrame:
    """window_start, rank, post_id, num_comments and last_ts of the most commented posts."""
    rows = routing.post_comments(comments).select("ts", F.col("parent_id").alias("post_id"))
    scores = panes.windowed(rows, size, slide, ("post_id",), ranking.one(), panes=use_panes)
    return ranking.top_k(scores, ("window_start",), "post_id", k=k)


def commented_posts_rollup(comments: DataFrame, upto: str = "daily", k: int = 10) -> DataFrame:
    """The tumbling chain: the day's posts from the hours' best, the week's from the days' best."""
    hourly = commented_posts(comments, *TUMBLING["hourly"], k=k).withColumn("ts", F.col("window_start"))
    daily = ranking.roll_up(hourly, DAY, "post_id", ("score",), F.col("score"), k)
    return daily if upto == "daily" else ranking.roll_up(daily, WEEK, "post_id", ("score",), F.col("score"), k)


def active_users(activity: DataFrame, size: str, slide: str | None, k: int = 10, use_panes: bool = True) -> DataFrame:
    """window_start, rank, user_id, a, b, c, score and last_ts of the most active users."""
    scores = panes.windowed(activity, size, slide, ("user_id",), ranking.activity_sums(), panes=use_panes).withColumn("score", ranking.activity_score())
    return ranking.top_k(scores, ("window_start",), "user_id", k=k)


def active_users_rollup(activity: DataFrame, upto: str = "daily", k: int = 10) -> DataFrame:
    hourly = active_users(activity, *TUMBLING["hourly"], k=k).withColumn("ts", F.col("window_start"))
    daily = ranking.roll_up(hourly, DAY, "user_id", ("a", "b", "c"), ranking.activity_score(), k)
    return daily if upto == "daily" else ranking.roll_up(daily, WEEK, "user_id", ("a", "b", "c"), ranking.activity_score(), k)


POST_COLUMNS = ("window_start", "rank", "post_id", "num_comments")
USER_COLUMNS = ("window_start", "rank", "user_id", "a", "b", "c", "score")


def published_posts(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.withColumnRenamed("score", "num_comments").select(*POST_COLUMNS, *more)


def published_users(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.select(*USER_COLUMNS, *more)
