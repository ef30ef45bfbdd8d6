"""What several operators share: the shared folder for cut lineage, and connected components."""

from __future__ import annotations

import ctypes
import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch.  Spark's usual 64 MB are held by the JVM and by the worker, for each of several steps of a task.
BATCH_BYTES = 4 << 20
_BATCH, _SPARK = "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "64MB", "67108864")


def bounded_batches(df: DataFrame) -> DataFrame:
    """Keeps the Arrow batches of the session small, unless they are set to something else than Spark's default; returns df.  Spark reads this
    setting when a query runs, not when it is made, so it stays set; it changes no result.  session.build() sets it from the start."""
    if df.sparkSession.conf.get(_BATCH, None) in _SPARK:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


@functools.cache
def _malloc_trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)  # the C library may lack it


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def trimmed(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A grouped function that trims after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = work(table)
        trim()
        return out

    return run


def sliced(batches: Iterable[pa.RecordBatch], n_text: int, chars: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most so many characters of text each (a longer text alone), so that what a worker holds follows text and not rows."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(b.column(n_text)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + chars, side="right")))
            yield b.slice(a, z - a)
            a = z
        trim()


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, or the first of name_1, name_2 and so on that no column has (names are compared without case)."""
    low = {t.lower() for t in taken}
    return next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in low)


def hash_sample(rows: DataFrame, group: str, key: str, most: int) -> list[tuple]:
    """(group, key, hash) of at most so many distinct keys of each group, those with the smallest hashes (of the whole table: where rows stand doesn't matter).

    The distinct keys of groups are counted first (by a sketch), so that each task passes on only the keys below a hash that about twice as many
    reach, and the smallest of all: neither a task nor the driver gets more than that, however many rows, copies or tasks there are."""
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << 40) - 1))
    counts = rows.groupBy(group).agg(F.approx_count_distinct(key).alias("_n"), F.min(F.struct(h.alias("h"), F.col(key).alias("k"))).alias("_first"))
    low = (h * F.col("_n") < F.lit(2 * most * float(1 << 40))) | (h == F.col("_first.h")) & F.col(key).eqNullSafe(F.col("_first.k"))
    found = rows.select(group, key).join(F.broadcast(counts), group).where(low).select(group, key, h.alias("_h")).distinct().collect()
    out, held = [], {}
    for g, k, x in sorted(((r[group], r[key], r["_h"]) for r in found), key=lambda r: (str(r[0]), r[2], r[1] is not None, r[1])):
        held[g] = held.get(g, 0) + 1
        if held[g] <= most:
            out.append((g, k, x))
    return out


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.  Where it is unset, a single-process session (as in tests) gets a temporary one; on a
    cluster that is an error, since executors don't share a machine's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="rillwork-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet into the shared folder and reads it back: lineage ends here, and no executor's loss matters."""
    path = f"{checkpoint_dir(df.sparkSession)}/rillwork-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): component is the smallest node that is reachable.

    Alternates large-star and small-star steps, until nothing changes: each node's neighbours are linked to its smallest neighbour.  Only minima
    are aggregated per node, so a node with very many edges is combined before the shuffle; the joins may be split by AQE.
    Where rounds is given and too few, that is an error; links are never left out.
    """
    def kept(d: DataFrame) -> tuple[DataFrame, tuple]:
        """Stored, with its number of edges and a sum of their hashes, taken while it is written."""
        seen = Observation()
        d = stored(d.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")))
        return d, (seen.get["n"], seen.get["h"])

    e, before = kept(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for done in itertools.count() if before[0] else ():
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        # Without hints each of these joins would gather one side on the driver, again and again, as long as edges are few.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e, after = kept(small.select("x.*").where("a <> b").distinct())
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
