"""A results store: sorted sets of JSON records under keys.

A member is stored with the time it was written as its score; a member written again keeps its latest score. The store is
a folder of Parquet files partitioned by key, which all executors have to share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.streaming.folders import shared_folder

SCHEMA = "score BIGINT, member STRING, key STRING"


def put(df: DataFrame, key: str, folder: str) -> None:
    """Add the rows of ``df`` to the set at ``key``."""
    rows = df.select(F.unix_millis(F.current_timestamp()).alias("score"), F.to_json(F.struct(*df.columns)).alias("member"), F.lit(key).alias("key"))
    rows.write.mode("append").partitionBy("key").parquet(folder)


def get(spark: SparkSession, key: str, folder: str) -> DataFrame:
    """key, member, score of the set at ``key``; sort by score to have it in order."""
    found = spark.read.schema(SCHEMA).parquet(folder).where(F.col("key") == key)
    return found.groupBy("key", "member").agg(F.max("score").alias("score"))


def sink(key: str, folder: str):
    """For ``foreachBatch``: a micro-batch that is run again adds nothing new."""
    return lambda df, batch_id: put(df, key, folder)


def round_trip(df: DataFrame, key: str) -> DataFrame:
    """Write a result twice, read it back: each member once."""
    folder = f"{shared_folder(df.sparkSession)}/store-{uuid.uuid4().hex}"
    put(df, key, folder)
    put(df, key, folder)
    return get(df.sparkSession, key, folder).select("key", "member")
