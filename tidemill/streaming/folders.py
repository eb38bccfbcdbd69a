"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=4)
def _own(app: str) -> str:
    return tempfile.mkdtemp(prefix="tidemill-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set and all runs on this machine, as in tests, one made here."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own(spark.sparkContext.applicationId)
