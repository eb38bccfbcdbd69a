"""Replay of a data set as a stream: files in event order, released at a multiple of real time."""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEED_UP = 10_000_000


def pause_ms(gap_ms: int, speed_up: int = SPEED_UP) -> int:
    """Milliseconds to wait for a gap between events: whole milliseconds after division, a rest is dropped."""
    return max(0, gap_ms // speed_up)


def write_slices(df: DataFrame, folder: str, slices: int, ts: str = "ts") -> None:
    """The rows as ``slices`` files whose event times follow each other, in a folder that all executors share."""
    df.repartitionByRange(slices, ts).sortWithinPartitions(ts).write.mode("overwrite").parquet(folder)


def release(staged: str, live: str, gaps_ms: list[int], speed_up: int = SPEED_UP) -> Iterator[Path]:
    """Move staged part files, in order, into the folder a stream reads, with pauses for the gaps between them."""
    Path(live).mkdir(parents=True, exist_ok=True)
    for part, gap in zip(sorted(Path(staged).glob("part-*")), [0, *gaps_ms], strict=False):
        time.sleep(pause_ms(gap, speed_up) / 1000)
        to = Path(live) / part.name
        part.replace(to)
        yield to


def slice_gaps(staged: DataFrame, ts: str = "ts") -> list[int]:
    """Event-time gaps in milliseconds between the first rows of consecutive staged files (a row a file)."""
    starts = staged.groupBy(F.input_file_name().alias("part")).agg(F.min(ts).alias("start")).orderBy("part").collect()
    return [int((b.start - a.start).total_seconds() * 1000) for a, b in zip(starts, starts[1:], strict=False)]
