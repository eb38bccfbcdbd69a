"""Kafka topics of Avro records, where Spark has the connector and Avro jars.

``available`` says whether it has; without them the functions raise an error that names what is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.schemas import INPUTS, avro


def available(spark: SparkSession) -> bool:
    """Whether both the Kafka source and the Avro functions can be loaded."""
    load = spark.sparkContext._jvm.org.apache.spark.util.Utils.classForName
    try:
        for name in ("org.apache.spark.sql.kafka010.KafkaSourceProvider", "org.apache.spark.sql.avro.AvroDataToCatalyst"):
            load(name, True, False)
    except Exception:
        return False
    return True


def _require(spark: SparkSession) -> None:
    if not available(spark):
        raise RuntimeError("start Spark with the spark-sql-kafka-0-10 and spark-avro packages to use topics")


def decoded(value: Column, kind: str) -> Column:
    from pyspark.sql.avro.functions import from_avro

    return from_avro(value, avro(kind))


def encoded(df: DataFrame, kind: str, ts: str = "ts") -> DataFrame:
    """key (event time in milliseconds, as text) and value (the row as an Avro record)."""
    from pyspark.sql.avro.functions import to_avro

    _require(df.sparkSession)
    return df.select(F.unix_millis(F.col(ts).cast("timestamp")).cast("string").alias("key"), to_avro(F.struct(*df.columns), avro(kind)).alias("value"))


def topic(spark: SparkSession, servers: str, name: str, streaming: bool = True) -> DataFrame:
    """Raw records of a topic: from the end as a stream, from start to end in batch."""
    _require(spark)
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", name)
    return (reader if streaming else reader.option("startingOffsets", "earliest").option("endingOffsets", "latest")).load()


def read(spark: SparkSession, kind: str, servers: str, name: str | None = None, streaming: bool = True) -> DataFrame:
    """Typed rows of friendships, comments or posts from their topic."""
    if kind not in INPUTS:
        raise ValueError(f"unknown stream: {kind}")
    return topic(spark, servers, name or kind, streaming).select(decoded(F.col("value"), kind).alias("row")).select("row.*")
