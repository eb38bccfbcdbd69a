"""Views of an event table as the three activity streams.

Every event is a friendship of its user with user ``k``; clicks, views and errors are comments on ``k`` (errors are
replies); purchases are posts. For activity scores sign-ups count as friendships.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
COMMENT_TYPES = ("click", "view", "error")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def target() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def friendships(df: DataFrame) -> DataFrame:
    """event_id, ts, user_id1, user_id2."""
    return df.select("event_id", "ts", F.col("user_id").alias("user_id1"), target().alias("user_id2"))


def comments(df: DataFrame) -> DataFrame:
    """ts, comment_id, user_id, is_post_comment, parent_id."""
    chosen = df.where(F.col("event_type").isin(*COMMENT_TYPES))
    return chosen.select("ts", F.col("event_id").alias("comment_id"), "user_id", (F.col("event_type") != "error").alias("is_post_comment"), target().alias("parent_id"))


def posts(df: DataFrame) -> DataFrame:
    return df.where("event_type = 'purchase'").select("ts", F.col("event_id").alias("post_id"), "user_id")


def sign_ups(df: DataFrame) -> DataFrame:
    """The friendships that count in activity scores."""
    return df.where("event_type = 'signup'").select("event_id", "ts", F.col("user_id").alias("user_id1"), target().alias("user_id2"))


def text_lines(df: DataFrame, kind: str) -> DataFrame:
    """Events written as activity lines, every seventh of them spoilt, for the parsers."""
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000"))
    spoilt = F.col("event_id") % 7
    user, k, text = F.col("user_id").cast("string"), target().cast("string"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" "))
    own = F.when(spoilt == 1, F.lit("wrong")).when(spoilt == 2, F.concat(F.lit("-"), (F.col("event_id") + 1).cast("string"))).otherwise(F.col("event_id").cast("string"))
    name = F.concat(F.lit("user "), user)
    if kind == "friendships":
        return df.select(F.concat_ws("|", ts, F.when(spoilt < 3, own).otherwise(user), k).alias("value"))
    if kind == "posts":
        return df.select(F.concat_ws("|", ts, own, user, F.when(spoilt == 3, F.lit("")).otherwise(text), F.when(spoilt == 4, F.lit("")).otherwise(name)).alias("value"))
    on_post = F.col("event_type") != "error"
    return df.select(
        F.concat_ws("|", ts, own, user, F.when(spoilt == 3, F.lit("")).when(spoilt == 4, F.lit("a|b")).otherwise(text), name, F.when(on_post, F.lit("")).otherwise(k), F.when(on_post, k).otherwise(F.lit(""))).alias("value")
    )
