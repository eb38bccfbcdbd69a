"""Text files of activity lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions import parsing

PARSERS = {"friendships": parsing.parse_friendships, "comments": parsing.parse_comments, "posts": parsing.parse_posts}


def lines(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Column ``value``, a row per line."""
    if not streaming:
        return spark.read.text(path)
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def read(spark: SparkSession, kind: str, path: str, mode: str = parsing.PERMISSIVE, streaming: bool = False) -> DataFrame:
    """Typed rows of friendships, comments or posts."""
    return PARSERS[kind](lines(spark, path, streaming), mode=mode)


def show_lines(spark: SparkSession, path: str, n: int = 20) -> None:
    """Print the first lines of a file."""
    for row in lines(spark, path).limit(n).collect():
        print(row.value)
