"""The session settings that the engine's semantics need."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

REQUIRED = {
    "spark.sql.ansi.enabled": "true",  # an overflow fails the job
    "spark.sql.session.timeZone": "UTC",
}
RETRY = {"spark.task.maxFailures": "3", "spark.stage.maxConsecutiveAttempts": "2"}
SCALE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
#: Python workers and the JVM hold an Arrow batch each; records have no bound, so batches are bounded by bytes.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings; conf names with underscores stand for dots."""
    builder = SparkSession.builder.appName("rillwork")
    if master:
        builder = builder.master(master)
    for k, v in (REQUIRED | RETRY | SCALE | ARROW | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  Where it is unset, a single-process session (as in tests) gets the system's temporary one; on a
    cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.gettempdir()}"
    return path


def check(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        raise ValueError("spark.sql.ansi.enabled must be true: without it integer overflow passes silently")
