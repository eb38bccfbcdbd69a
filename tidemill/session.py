"""Session settings, and shipping of this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings every query relies on; event time is UTC throughout.
CONF = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}

_shipped: set[str] = set()


def build(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidemill-")) / "tidemill_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
