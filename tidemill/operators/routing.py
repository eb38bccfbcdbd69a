"""Unions and splits of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, by column name, repeats included."""
    return reduce(DataFrame.unionByName, frames)


def labelled_union(column: str, **frames: DataFrame) -> DataFrame:
    """``union_all`` with the name of each frame in ``column``."""
    return union_all(*(df.withColumn(column, F.lit(name)) for name, df in frames.items()))


def split_by(df: DataFrame, column: str, *tags: str) -> dict[str, DataFrame]:
    """A frame for each tag."""
    return {t: df.where(F.col(column) == t) for t in tags}


def post_comments(comments: DataFrame) -> DataFrame:
    """Comments on posts, without replies to comments."""
    return comments.where("is_post_comment")
