import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import counters, panes, ranking
from tidemill.plans import queries as q
from tidemill.sources import tables
from tidemill.streaming import pipelines

AT = dt.datetime
F1 = [(1, AT(2010, 1, 5, 23, 30), 4, 5), (2, AT(2010, 7, 1, 23, 30), 1, 2), (3, AT(2010, 7, 1, 23, 40), 2, 1), (4, AT(2010, 7, 2, 0, 10), 3, 1)]


@pytest.fixture
def friendships(spark):
    return spark.createDataFrame(F1, "event_id bigint, ts timestamp_ntz, user_id1 bigint, user_id2 bigint")


def counts(row):
    return {int(c[-2:]): row[c] for c in counters.COUNTERS if row[c]}


def test_first_friendships_and_daylight_saving(friendships):
    kept = {(r.hi, r.lo): r.ts for r in q.new_friendships(friendships).collect()}
    assert kept == {(5, 4): F1[0][1], (2, 1): F1[1][1], (3, 1): F1[3][1]}
    daily = {r.ts: counts(r) for r in q.friendships_daily(friendships).collect()}
    assert daily == {AT(2010, 1, 5): {23: 1}, AT(2010, 7, 1): {0: 1}, AT(2010, 7, 2): {1: 1}}
    (total,) = q.friendships_all_time(friendships).collect()
    assert (total.ts, counts(total)) == (AT(2010, 1, 5), {0: 1, 1: 1, 23: 1})


def test_sliding_weeks(friendships):
    weekly = {r.ts: counts(r) for r in q.friendships_weekly(friendships).collect()}
    july = {d: c for d, c in weekly.items() if d >= AT(2010, 6, 1)}
    assert min(july) == AT(2010, 6, 25) and max(july) == AT(2010, 7, 2)
    assert july[AT(2010, 6, 26)] == {0: 1, 1: 1} and july[AT(2010, 7, 2)] == {1: 1}


def test_weeks_start_on_thursday(spark):
    df = spark.createDataFrame([(AT(2010, 2, 3, 12),)], "ts timestamp_ntz")
    assert df.select(F.window("ts", "7 days").start.alias("w")).first().w == AT(2010, 1, 28)


def hits(spark, *spec):
    rows = [(AT(2010, 1, 7, h, m), i, 1, True, p) for i, (h, m, p) in enumerate(spec)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, comment_id bigint, user_id bigint, is_post_comment boolean, parent_id bigint")


def test_rollup_is_not_exact(spark):
    comments = hits(spark, *[(0, m, 1) for m in range(3)], *[(0, m, 2) for m in range(2)], *[(1, m, 3) for m in range(3)], *[(1, m, 2) for m in range(2)])
    (r,) = q.commented_posts_rollup(comments, k=1).collect()
    (e,) = q.commented_posts(comments, "1 day", None, k=1).collect()
    assert (r.post_id, r.score, r.window_start, r.ts) == (3, 3, AT(2010, 1, 7), AT(2010, 1, 7))
    assert (e.post_id, e.score) == (2, 4)


def test_user_scores(spark):
    ts = AT(2010, 1, 7, 1)
    f = spark.createDataFrame([(1, ts, 7, 8)], "event_id bigint, ts timestamp_ntz, user_id1 bigint, user_id2 bigint")
    p = spark.createDataFrame([(ts, 1, 7)], "ts timestamp_ntz, post_id bigint, user_id bigint")
    c = spark.createDataFrame([(ts, 2, 8)], "ts timestamp_ntz, comment_id bigint, user_id bigint")
    found = {r.user_id: (r.a, r.b, r.c, r.score) for r in q.active_users(ranking.activity(f, p, c), "1 hour", None).collect()}
    assert found == {7: (1, 1, 0, 2), 8: (0, 0, 1, 1)}


def board(spark, scores):
    return spark.createDataFrame([(i, s, t) for t, (i, s) in enumerate(scores)], "id bigint, score bigint, ts bigint")


def test_boards(spark):
    b = ranking.board(board(spark, [(1, 1), (10, 2), (1, 1), (10, 3), (1, 1)]))
    wanted = spark.createDataFrame([(1,), (10,), (20,)], "id bigint")
    assert {r.id: r.score for r in ranking.score_of(b, wanted).collect()} == {1: 3, 10: 5, 20: -1}
    ties = ranking.top_k(ranking.board(board(spark, [(i, 1) for i in range(1, 6)])), (), "id")
    assert [r.id for r in ties.orderBy("rank").collect()] == [5, 4, 3, 2, 1]
    scores = [(1, 2), (2, 10), (3, 5), (4, 1), (5, 1), (6, 9), (7, 2), (8, 2), (9, 22), (10, 101), (11, 99)]
    best = [r.id for r in ranking.top_k(ranking.board(board(spark, scores)), (), "id").orderBy("rank").collect()]
    assert best[:6] == [10, 11, 9, 2, 6, 3] and len(best) == 10
    last = ranking.board_of_last(board(spark, [(1, 5), (1, 2)]))
    assert last.first().score == 2


def test_merges(spark):
    make = lambda d: board(spark, d).select(F.lit(0).alias("w"), "id", "score", F.col("ts").alias("last_ts"))
    a, b = make([(1, 2), (2, 10), (3, 5), (4, 1), (5, 1)]), make([(6, 100), (7, 999), (8, 11), (9, 6), (10, 4)])
    assert [r.id for r in ranking.merge_rankings(a, b, ("w",), "id", k=5).orderBy("rank").collect()] == [7, 6, 8, 2, 9]
    added = ranking.add_rankings(a, make([(3, 6)]), ("w",), "id", k=2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in added] == [(3, 11), (2, 10)]


def test_many_ids(spark):
    rows = spark.range(100_000).select("id", F.lit(1).alias("score"), F.col("id").alias("ts"))
    assert ranking.board(rows).count() == 100_000


def test_panes_equal_direct_windows(spark):
    rows = spark.range(3000).select(F.timestamp_seconds(1_700_000_000 + F.pmod(F.xxhash64("id"), F.lit(400_000))).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("post_id"))
    for size, slide in q.SLIDING.values():
        by_panes, direct = (panes.windowed(rows, size, slide, ("post_id",), ranking.one(), panes=p) for p in (True, False))
        assert by_panes.exceptAll(direct).isEmpty() and direct.exceptAll(by_panes).isEmpty()


def test_days_add_up(friendships):
    daily = q.friendships_daily(friendships)
    assert sum(r.total for r in counters.total(daily).collect()) == q.new_friendships(friendships).count()
    last = counters.running(daily).orderBy(F.desc("ts")).first()
    assert counts(last) == counts(q.friendships_all_time(friendships).first())


def small_events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy(F.rand(3))


def test_stream_equals_batch_even_shuffled(spark):
    events = small_events(spark)
    stream = pipelines.bounded_run(events, pipelines.friendships_daily)
    batch = q.friendships_daily(tables.friendships(events))
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()


def test_first_friendships_of_a_stream_are_kept_by_built_in_state(spark, tmp_path):
    """Python sees buckets of pairs and keeps nothing; late rows, a pair of none and large ids are told apart."""
    day, large = dt.datetime(2024, 1, 1), 2**60 + 1
    batches = [
        [(1, 0, 1, 2), (2, 2, 3, 4), (3, 1, 4, 3), (4, 1, 4, 3), (5, 0, None, None), (6, 0, large, large + 2), (large, 1, large, large + 1), (None, 1, large, large + 1)],
        [(8, 240, 8, 9)],
        [(9, 241, 8, 9)],
        [(10, 3, 5, 6), (11, 250, 6, 5), (12, 249, 5, 6), (13, 250, 1, 2)],  # the first is late
    ]
    for i, rows in enumerate(batches):
        events = [(e, day + dt.timedelta(hours=h), a, "view", 0.0, f'{{"k": {b}}}' if b is not None else "{}") for e, h, a, b in rows]
        made = tmp_path / f"made{i}"
        spark.createDataFrame(events, pipelines.EVENTS).coalesce(1).write.parquet(str(made))
        (tmp_path / "in").mkdir(exist_ok=True)
        to = next(made.glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(to, (1000 + i, 1000 + i))
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", pipelines.ROCKSDB)
    stream = own.readStream.schema(pipelines.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    found = pipelines.first_friendships(tables.friendships(stream))
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    rows = {(r.hi, r.lo, r.event_id) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()}
    assert rows == {(2, 1, 1), (4, 3, 3), (None, None, 5), (large + 2, large, 6), (large + 1, large, large), (9, 8, 8), (6, 5, 12)}
    state = {o["operatorName"]: o["numRowsTotal"] for o in query.lastProgress["stateOperators"]}
    assert state == {"transformWithStateInPandasExec": 0, "dedupe": len(rows)}


def test_a_bucket_is_reduced_as_it_comes(monkeypatch):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"hi": rng.integers(50, 60, 900), "lo": rng.integers(0, 20, 900), "ts": pd.to_datetime(rng.integers(0, 40, 900), unit="h"), "no_id": rng.random(900) < 0.3, "event_id": rng.permutation(900), "bucket": 1})
    want = rows.sort_values(["ts", "no_id", "event_id"]).groupby(["hi", "lo"], as_index=False).first()[["hi", "lo", "ts", "no_id", "event_id"]]
    monkeypatch.setattr(pipelines, "HELD_ROWS", 64)
    [got] = pipelines.LeastOfPairs().handleInputRows((1,), (rows[i : i + 30] for i in range(0, 900, 30)), None)
    assert got.sort_values(["hi", "lo"]).reset_index(drop=True).equals(want)


def test_open_windows_need_the_closing_row(spark):
    events = small_events(spark)
    windows = q.commented_posts(tables.comments(events), "1 hour", None).select("window_start").distinct().count()
    open_run = pipelines.bounded_run(events, pipelines.posts_hourly, flush=False).select("window_start").distinct().count()
    assert open_run == windows - 1


def test_plans_stay_in_built_in_functions(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = q.commented_posts(tables.comments(events), *q.SLIDING["daily"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "WindowGroupLimit" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,props:string>".replace("event_id:bigint,", "") in plan.replace("event_id:bigint,", "")
