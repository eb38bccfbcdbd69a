"""Command line: run an analytic over text files, print the head of a source, or replay a data set.

python -m tidemill.cli q2 --comments lines/ --window sliding --granularity daily --output out/
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import session
from tidemill.operators import ranking
from tidemill.plans import queries as q
from tidemill.sinks import files as sinks
from tidemill.sources import bus, files, replay


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("q1", "q2", "q3"):
        p = commands.add_parser(name)
        for source in {"q1": ["friendships"], "q2": ["comments"], "q3": ["friendships", "comments", "posts"]}[name]:
            p.add_argument(f"--{source}", required=True, help=f"text file or folder of {source}")
        p.add_argument("--window", choices=("tumbling", "sliding", "rollup"), default="sliding")
        p.add_argument("--granularity", choices=("hourly", "daily", "weekly", "all"), default="daily")
        p.add_argument("--output", help="folder of the result; printed if absent")
        p.add_argument("--format", choices=sinks.FORMATS, default="parquet")
        p.add_argument("--failfast", action="store_true", help="stop at the first malformed line")
    dump = commands.add_parser("dump")
    dump.add_argument("path", help="text files, or a topic with --servers")
    dump.add_argument("--servers")
    dump.add_argument("--rows", type=int, default=20)
    again = commands.add_parser("replay")
    again.add_argument("path")
    again.add_argument("staged")
    again.add_argument("live")
    again.add_argument("--slices", type=int, default=16)
    again.add_argument("--speed-up", type=int, default=replay.SPEED_UP, help="how much faster than event time")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The result of an analytic."""
    mode = "FAILFAST" if args.failfast else "PERMISSIVE"
    read = lambda kind: files.read(spark, kind, getattr(args, kind), mode)
    windows = q.SLIDING if args.window == "sliding" else q.TUMBLING
    if args.command == "q1":
        f = read("friendships").withColumn("event_id", F.xxhash64("user_id1", "user_id2"))
        if args.granularity == "all":
            return q.friendships_all_time(f)
        return q.friendships_weekly(f, args.window == "sliding") if args.granularity == "weekly" else q.friendships_daily(f)
    if args.command == "q2":
        comments = read("comments")
        if args.window == "rollup":
            return q.published_posts(q.commented_posts_rollup(comments, args.granularity), "ts")
        return q.published_posts(q.commented_posts(comments, *windows[args.granularity]))
    activity = ranking.activity(read("friendships"), read("posts"), read("comments"))
    if args.window == "rollup":
        return q.published_users(q.active_users_rollup(activity, args.granularity), "ts")
    return q.published_users(q.active_users(activity, *windows[args.granularity]))


#: Granularities by command and kind of window; a friendship count has no rollup.
CHOICES = {
    ("q1", "tumbling"): ("daily", "weekly", "all"),
    ("q1", "sliding"): ("daily", "weekly", "all"),
    **{(c, w): ("hourly", "daily", "weekly") for c in ("q2", "q3") for w in ("tumbling", "sliding")},
    **{(c, "rollup"): ("daily", "weekly") for c in ("q2", "q3")},
}


def checked(argv: list[str] | None = None) -> argparse.Namespace:
    """The arguments; choices that don't go together end with a message."""
    top = parser()
    args = top.parse_args(argv)
    if args.command in ("q1", "q2", "q3") and args.granularity not in (fit := CHOICES.get((args.command, args.window), ())):
        top.error(f"{args.command} has no {args.window} window that is {args.granularity}; there is {', '.join(fit) or 'none'}")
    return args


def main(argv: list[str] | None = None) -> None:
    args = checked(argv)
    spark = session.build()
    if args.command == "dump":
        if args.servers:
            bus.topic(spark, args.servers, args.path, streaming=False).show(args.rows, truncate=False)
        else:
            files.show_lines(spark, args.path, args.rows)
    elif args.command == "replay":
        replay.write_slices(spark.read.parquet(args.path), args.staged, args.slices)
        for part in replay.release(args.staged, args.live, replay.slice_gaps(spark.read.parquet(args.staged)), args.speed_up):
            print(part)
    elif args.output:
        sinks.write(run(spark, args), args.output, args.format)
    else:
        run(spark, args).show(truncate=False)


if __name__ == "__main__":
    main()
