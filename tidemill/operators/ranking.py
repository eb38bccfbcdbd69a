"""Scores and rankings. Ties go to the latest activity, then to the larger id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.schemas import TOP
from tidemill.functions.timeutil import tumbling

WINDOW_START = "window_start"


def one() -> dict[str, Column]:
    """The simple score: one per row."""
    return {"score": F.lit(1)}


def activity(friendships: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """ts, user_id and a one-hot score: a for a friendship's first user, b for a post, c for a comment or reply."""

    def marked(df: DataFrame, user: str, at: str) -> DataFrame:
        return df.select("ts", F.col(user).alias("user_id"), *[F.lit(int(n == at)).alias(n) for n in "abc"])

    return marked(friendships, "user_id1", "a").unionByName(marked(posts, "user_id", "b")).unionByName(marked(comments, "user_id", "c"))


def activity_sums() -> dict[str, Column]:
    return {n: F.col(n) for n in "abc"}


def activity_score() -> Column:
    return F.col("a") + F.col("b") + F.col("c")


def top_k(scores: DataFrame, by: tuple[str, ...], id_col: str, score_col: str = "score", k: int = TOP, last: str = "last_ts") -> DataFrame:
    """Add rank (1 to k) within ``by`` and keep those rows.

    The limit on the rank is applied in every task before the exchange too, so at most k rows of a group leave a task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score_col), F.desc(last), F.desc(id_col))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def roll_up(ranked: DataFrame, size: str, id_col: str, sums: tuple[str, ...], score: Column, k: int = TOP, ts: str = "ts") -> DataFrame:
    """Rankings of shorter windows as one of a longer: their rows' sums by id, cut to k once.

    ``ts`` of a row is the least time stamp among the rankings merged, and windows are taken over it; the result is a
    ranking of the ranked, which may differ from one of all rows.
    """
    kept = [F.sum(n).alias(n) for n in sums]
    windows = ranked.select(tumbling(F.col(ts), size).alias("_w"), ts, id_col, "last_ts", *sums)
    stamps = windows.groupBy("_w").agg(F.min(ts).alias("ts"))  # as many rows as windows
    summed = windows.groupBy("_w", id_col).agg(*kept, F.max("last_ts").alias("last_ts")).withColumn("score", score)
    best = top_k(summed.withColumn(WINDOW_START, F.col("_w.start")), (WINDOW_START,), id_col, k=k)
    return best.join(stamps, "_w").drop("_w")


def merge_rankings(a: DataFrame, b: DataFrame, by: tuple[str, ...], id_col: str, k: int = TOP) -> DataFrame:
    """Union without repeated (id, score), the best k of each group."""
    both = a.unionByName(b).groupBy(*by, id_col, "score").agg(F.max("last_ts").alias("last_ts"))
    return top_k(both, by, id_col, k=k)


def add_rankings(a: DataFrame, b: DataFrame, by: tuple[str, ...], id_col: str, k: int = TOP) -> DataFrame:
    """Scores of equal ids added up, the best k of each group."""
    both = a.unionByName(b).groupBy(*by, id_col).agg(F.sum("score").alias("score"), F.max("last_ts").alias("last_ts"))
    return top_k(both, by, id_col, k=k)


def board(increments: DataFrame, id_col: str = "id", score_col: str = "score", ts: str = "ts") -> DataFrame:
    """All ids with their summed scores and latest increment."""
    return increments.groupBy(id_col).agg(F.sum(score_col).alias("score"), F.max(ts).alias("last_ts"))


def board_of_last(values: DataFrame, id_col: str = "id", score_col: str = "score", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """All ids with the score set last."""
    last = F.max(F.struct(*order, F.col(score_col).alias("_set"))).alias("_last")
    return values.groupBy(id_col).agg(last).select(id_col, F.col("_last._set").alias("score"), F.col(f"_last.{order[0]}").alias("last_ts"))


def score_of(scores: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores of the given ids, -1 for those without one."""
    return ids.join(scores.select(id_col, "score"), id_col, "left").select(id_col, F.coalesce("score", F.lit(-1)).alias("score"))


def wide(ranked: DataFrame, ts: str, id_col: str, score_col: str, id_name: str, score_name: str, k: int = TOP) -> DataFrame:
    """One row per window: ts, then id and score of each rank, 0 where there is none."""
    at = lambda c, i: F.coalesce(F.max(F.when(F.col("rank") == i, F.col(c))), F.lit(0))
    return ranked.groupBy(F.col(ts).alias("ts")).agg(*[at(c, i).alias(f"{n}_{i}") for i in range(1, k + 1) for c, n in ((id_col, id_name), (score_col, score_name))])


def render(ranked: DataFrame, ts: str, id_col: str, score: Column, k: int = TOP) -> DataFrame:
    """A text line per window: its start, the ranked elements in order, and k."""
    element = F.format_string("(ID: %s, score: %s)", F.col(id_col).cast("string"), score.cast("string"))
    rows = ranked.groupBy(F.col(ts).alias("ts")).agg(F.sort_array(F.collect_list(F.struct("rank", element.alias("e")))).alias("es"))
    return rows.select(F.format_string("(%s, List(%s), %s)", F.col("ts").cast("string"), F.array_join(F.col("es.e"), ", "), F.lit(str(k))).alias("value"))
