"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.session import ship_package
from tidemill.streaming.folders import shared_folder

#: Texts of one Arrow batch are handed to Python together; this bounds their number, Spark's byte bound bounds their size.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one input table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_bytes(name: str, path: str | None = None) -> bytes:
    """The file of a public tokenizer; ``path`` overrides the installed place."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_bytes()


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into zero-copy slices of at most ``rows`` rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose function sees slices of bounded row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(s for b in batches for s in slices(b))

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> F.Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset (tests), a local folder is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written as Parquet to the shared folder and read again; and what deletes those files."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(df.schema).parquet(folder), lambda: files.delete(path, True)


#: A sieve has 2 ** 16 to 2 ** 26 bits (a million words of 64), and otherwise 16 for each hash.
SIEVE_BITS = 16, 26


def sift(df: DataFrame, name: str, hashes: DataFrame, into: str) -> DataFrame:
    """Add boolean ``into``: whether the long ``name`` may be among ``hashes`` (its only column); null never is.

    False is certain, true is wrong for about one in 16, and for more beyond four million hashes. So it only saves
    shuffles: what it lets through has to be joined. The bits are a table of words of bounded size, which is broadcast.
    """
    low, high = SIEVE_BITS
    bits, column = 1 << min(max((16 * hashes.count()).bit_length(), low), high), hashes.columns[0]
    word, place = fresh(df, "_word"), fresh(df, "_bits")
    at = lambda c: F.shiftright(F.col(c).bitwiseAND(F.lit(bits - 1)), 6)
    words = hashes.groupBy(at(column).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))")).alias(place))
    met = df.withColumn(word, at(name)).join(F.broadcast(checkpointed(words)), word, "left")
    held = F.expr(f"shiftright({place}, cast({name} & 63 AS INT)) & 1 = 1")
    return met.withColumn(into, F.coalesce(held, F.lit(False))).drop(word, place)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
