"""Undirected pairs, each kept once: at its first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_pair(df: DataFrame, a: str = "user_id1", b: str = "user_id2") -> DataFrame:
    """Replace the two users by hi and lo."""
    return df.withColumns({"hi": F.greatest(a, b), "lo": F.least(a, b)}).drop(a, b)


def pair_key(a: Column, b: Column) -> Column:
    """The pair as text, smaller id first."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def first_wins(df: DataFrame, keys: tuple[str, ...] = ("hi", "lo"), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first row of each key in the given order, which should be total.

    The least struct of order columns and the rest is an aggregate, so each task passes on one row a key, and a pair that
    is repeated very often is no burden to the task that owns it.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(*keys, "_first.*")
