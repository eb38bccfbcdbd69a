"""Typed rows from pipe-delimited lines.

Trailing empty fields are dropped and fields are trimmed of every character up to the space, so a comment on a post has
seven fields and a reply six. Malformed lines give null in PERMISSIVE mode, which the parsers drop, and an error in
FAILFAST mode. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.timeutil import parse_instant, strict_instant

PERMISSIVE, FAILFAST = "PERMISSIVE", "FAILFAST"


def fields(line: Column) -> Column:
    """The trimmed fields of a line."""
    parts = F.split(F.regexp_replace(line, r"\|+$", ""), r"\|")
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _id(parts: Column, i: int) -> Column:
    """A non-negative integer, else null."""
    value = F.when(_field(parts, i).rlike(r"^[+-]?[0-9]+$"), _field(parts, i).try_cast("bigint"))
    return F.when(value >= 0, value)


def _valid(lines: DataFrame, column: str, mode: str, size: Column, row: Column, required: list[str]) -> DataFrame:
    """Rows whose line has the right number of fields and all required values."""
    made = lines.select("*", fields(F.col(column)).alias("_parts")).select(*lines.columns, F.when(size, row).alias("_row"))
    whole = F.col("_row").isNotNull()
    for name in required:
        whole = whole & F.col(f"_row.{name}").isNotNull()
    if mode == FAILFAST:
        checked = F.when(whole, F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.coalesce(F.col(column), F.lit("null")))).cast(made.schema["_row"].dataType))
        return made.select(checked.alias("_row")).select("_row.*")
    return made.where(whole).select("_row.*")


def parse_friendships(lines: DataFrame, column: str = "value", mode: str = PERMISSIVE) -> DataFrame:
    """``ts|user|user`` -> ts, user_id1, user_id2."""
    p = F.col("_parts")
    row = F.struct(parse_instant(_field(p, 0)).alias("ts"), _id(p, 1).alias("user_id1"), _id(p, 2).alias("user_id2"))
    return _valid(lines, column, mode, F.size(p) == 3, row, ["ts", "user_id1", "user_id2"])


def parse_posts(lines: DataFrame, column: str = "value", mode: str = PERMISSIVE) -> DataFrame:
    """``ts|post|user|content|name`` -> typed columns; the content may be empty, the name may not."""
    p = F.col("_parts")
    name = F.when(F.length(_field(p, 4)) > 0, _field(p, 4))
    row = F.struct(parse_instant(_field(p, 0)).alias("ts"), _id(p, 1).alias("post_id"), _id(p, 2).alias("user_id"), _field(p, 3).alias("content"), name.alias("user_name"))
    return _valid(lines, column, mode, F.size(p) == 5, row, ["ts", "post_id", "user_id", "content", "user_name"])


def parse_comments(lines: DataFrame, column: str = "value", mode: str = PERMISSIVE) -> DataFrame:
    """``ts|comment|user|content|name|comment replied to|post`` -> typed columns; the parent is the post or the comment."""
    p = F.col("_parts")
    on_post = F.size(p) == 7
    filled = lambda i: F.when(F.length(_field(p, i)) > 0, _field(p, i))
    row = F.struct(
        parse_instant(_field(p, 0)).alias("ts"), _id(p, 1).alias("comment_id"), _id(p, 2).alias("user_id"), filled(3).alias("content"), filled(4).alias("user_name"),
        on_post.alias("is_post_comment"), F.when(on_post, _id(p, 6)).otherwise(_id(p, 5)).alias("parent_id"),
    )
    return _valid(lines, column, mode, F.size(p).isin(6, 7), row, ["ts", "comment_id", "user_id", "content", "user_name", "parent_id"])


def timestamp_of(line: Column) -> Column:
    """The first field as an instant, unchecked: an error if it isn't one."""
    return strict_instant(_field(fields(line), 0))


def author_of(line: Column) -> Column:
    """User of a comment or post line, unchecked."""
    return _field(fields(line), 2).cast("bigint")


def first_friend_of(line: Column) -> Column:
    """First user of a friendship line, unchecked."""
    return _field(fields(line), 1).cast("bigint")
