"""The text source, and the registry of other sources."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.errors import PermanentFailure

#: A source opens a path of a given width, at the time of an action, as a frame with a column ``record``; columns ``ord_major`` (long)
#: and ``ord_minor`` (long), if it has them, give the order of the records.
Source = Callable[[SparkSession, str, int], DataFrame]


def _regular_file(spark: SparkSession, path: str):
    """The file's size; permanent failures for what is missing, not a plain file, or would be decompressed on reading."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    try:
        status = p.getFileSystem(conf).getFileStatus(p)
    except Exception as e:  # the Java exception's class tells which
        if "FileNotFoundException" in str(e) or "does not exist" in str(e):
            raise PermanentFailure(f"open text source {path}: file does not exist") from e
        raise PermanentFailure(f"open text source {path}: {e}") from e
    if not status.isFile():
        raise PermanentFailure(f"open text source {path}: not a regular file")
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p) is not None:
        raise PermanentFailure(f"open text source {path}: compressed files are not read")
    return status.getLen()


def text_file(spark: SparkSession, path: str, num_partitions: int) -> DataFrame:
    """Lines of one file: split at \\n alone, one trailing \\r taken off, blank lines kept, order kept by (split, row).

    The frame has num_partitions partitions: Spark's splits of the file are put together where there are more, which moves nothing, and cut by
    ranges of rows where there are fewer, as for small files."""
    _regular_file(spark, path)
    plain = re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
    lines = spark.read.option("lineSep", "\n").text(plain)
    v = F.col("value")  # cut by characters, not by a pattern: patterns replace bytes that aren't UTF-8
    line = F.when(v.endswith("\r"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v)
    rows = lines.select(line.alias("record"), F.col("_metadata.file_block_start").alias("ord_major"), F.monotonically_increasing_id().alias("ord_minor"))
    if rows.rdd.getNumPartitions() >= num_partitions:
        return rows.coalesce(num_partitions)
    return rows.repartitionByRange(num_partitions, "ord_major", "ord_minor").sortWithinPartitions("ord_major", "ord_minor")


def from_frame(make: Callable[[SparkSession], DataFrame]) -> Source:
    """A source that ignores the path: make(spark) gives the frame."""
    return lambda spark, path, num_partitions: make(spark)


def from_partitions(partitions: list[list], schema: str = "string") -> Source:
    """In-memory partitions, in order."""

    def open_(spark: SparkSession, path: str, num_partitions: int) -> DataFrame:
        rows = [(v, i, j) for i, part in enumerate(partitions) for j, v in enumerate(part)]
        return spark.createDataFrame(rows, f"record {schema}, ord_major long, ord_minor long")

    return open_
