import datetime as dt
import json

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill import metrics
from tidemill.functions import schemas
from tidemill.plans import registry
from tidemill.sinks import files, store
from tidemill.sources import bus, replay
from tidemill.sources import files as sources

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", [n for n in registry.queries() if not n.startswith("stream_") or n in ("stream_q2_daily_rollup", "stream_q1_alltime")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, SF)
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in wanted.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["window_start", "rank", "post_id", "num_comments"]


def test_store_keeps_members_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    folder = str(tmp_path / "store")
    store.put(df, "k", folder)
    store.sink("k", folder)(df, 0)
    store.put(df.limit(1), "other", folder)
    found = store.get(spark, "k", folder).collect()
    assert sorted(json.loads(r.member)["id"] for r in found) == [1, 2] and all(r.score > 0 for r in found)


def test_files_and_streams(spark, tmp_path):
    lines = spark.createDataFrame([("2010-02-03T22:35:50.015+0000|1|2",), ("bad",)], "value string")
    files.write(lines, str(tmp_path / "in"), "text")
    assert sources.read(spark, "friendships", str(tmp_path / "in")).count() == 1
    stream = sources.read(spark, "friendships", str(tmp_path / "in"), streaming=True)
    files.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    files.write(lines, str(tmp_path / "in"), "text", mode="append")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert spark.read.text(str(tmp_path / "in")).count() == 4
    assert files.result_name("q2", "hourly", "tumbling") == "results/q2-hourly-tumbling"


def test_replay(spark, tmp_path):
    assert [replay.pause_ms(g) for g in (0, 1, 5_000_000, 10_000_000, 20_000_001)] == [0, 0, 0, 1, 2]
    events = spark.read.parquet(f"{SF}/events.parquet")
    replay.write_slices(events, str(tmp_path / "staged"), 4)
    parts = list(replay.release(str(tmp_path / "staged"), str(tmp_path / "live"), [0, 0, 0]))
    firsts = [spark.read.parquet(str(p)).agg({"ts": "min"}).first()[0] for p in parts]
    assert len(parts) == 4 and firsts == sorted(firsts)


def test_avro_schemas():
    assert len(schemas.RESULTS) == 9
    fields = json.loads(schemas.avro("posts_hour"))["fields"]
    assert [f["name"] for f in fields[:3]] == ["ts", "post_id_1", "num_comments_1"] and len(fields) == 21
    assert json.loads(schemas.avro("comments"))["fields"][0]["type"]["logicalType"] == "timestamp-millis"


def test_topics_need_their_connector(spark):
    if not bus.available(spark):
        with pytest.raises(RuntimeError, match="kafka"):
            bus.read(spark, "comments", "localhost:9092")


def test_latency_meter():
    said = []
    meter = metrics.LatencyMeter(every=3, report=said.append)
    for x in (1, 2, 3, 4):
        meter.add(x)
    assert said == [2.0] and meter.mean() == 4.0
