"""File, console and topic sinks of results, in batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.sources import bus

FORMATS = ("text", "json", "parquet", "console")


def result_name(query: str, granularity: str, kind: str) -> str:
    """Folder of a result: ``results/q2-hourly-tumbling``, say."""
    return f"results/{query}-{granularity}-{kind}"


def as_lines(df: DataFrame) -> DataFrame:
    """One text column: the only string column, else the row as JSON."""
    if df.dtypes == [("value", "string")]:
        return df
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Write a result; ``mode="append"`` adds to what is there."""
    if kind == "console":
        df.show(truncate=False)
        return
    (as_lines(df) if kind == "text" else df).write.mode(mode).format(kind).save(path)


def start(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append", name: str | None = None, once: bool = True) -> StreamingQuery:
    """Start a streaming write; ``once`` takes what is there and stops."""
    writer = (as_lines(df) if kind == "text" else df).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.format("console").start() if kind == "console" else writer.format(kind).start(path)


def write_topic(df: DataFrame, kind: str, servers: str, topic: str, ts: str = "ts") -> None:
    """Publish a result as Avro records keyed by event time; needs the connector."""
    bus.encoded(df, kind, ts).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
