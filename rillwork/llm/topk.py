"""Exact top-k inner-product search: tiled matrix products, partial selection, tree merging.

Vectors are quantised (floor(64 * x)) natively and packed, in the partition where they are read, into tiles of at most
``TILE`` candidates; the queries are packed into tiles of at most ``QUERIES``.  Every candidate tile is paired with every query tile through an equi-join on a slot
number (about ``PER_SLOT`` candidate tiles have one); each pair is one matrix product, from which the best k of each query are selected.  The lists of a query are merged first within
groups of tiles and then over the groups, by rank limits that Spark applies before the shuffle too.

Scale.  A task holds one tile pair (a few MB).  Packing needs no shuffle, so no hot key exists; the number of rows shuffled is k a query and
candidate tile.  The work is queries times candidates, as for any exact search.

Exactness.  The product runs in the narrowest of single precision, double precision and Python integers that holds every
partial sum exactly, by a bound computed for each tile pair.

Defined results.  A vector that is null, or holds a null or non-finite component, takes no part.  Vectors are compared with those of the same length;
empty vectors score 0 with each other.  A query's own row is every row of its vec_id.  Repeated candidate rows each take a rank, and equal scores go to the
smaller vec_id.  Queries that repeat with the same vector give one list; a vec_id with several different vectors gives a list for
each.  Whole components beyond 2**62 count as 2**62, and scores beyond a long saturate.  Null ids take no part.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCALE = 64
TILE = 4096
QUERIES = 2048
#: Candidate tiles that share a slot, about.
PER_SLOT = 2
FAN_IN = 16
_LIMIT = float(2**62)


def _quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q array<double>): whole numbers; only usable vectors."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.where(~bad).select("vec_id", F.transform("e", lambda x: F.least(F.greatest(_floor(x), F.lit(-_LIMIT)), F.lit(_LIMIT))).alias("q"))


def _floor(x):
    """floor(64 * x) as a double; beyond 2^53 every double is whole."""
    y = x * F.lit(float(SCALE))
    return F.when(F.abs(y) < F.lit(float(2**53)), F.floor(y).cast("double")).otherwise(y)


def _pack(batches, rows: int):
    """Tiles (dim, ids, matrix, most): at most ``rows`` vectors of one length."""
    held: dict[int, list] = {}

    def tile(dim: int, own: list) -> pa.RecordBatch:
        ids = np.array([o[0] for o in own], dtype="<i8")
        m = np.array([o[1] for o in own], dtype="<f8").reshape(len(own), dim)
        most = float(np.abs(m).max(initial=0.0))
        kind = "<i2" if most < 2**15 else "<f8"
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.astype(kind).tobytes()], pa.binary()), pa.array([most])], names=["dim", "ids", "matrix", "most"])

    for b in batches:
        lists = b.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for i, vec_id in enumerate(b.column(0).to_pylist()):
            v = values[offsets[i] : offsets[i + 1]]
            own = held.setdefault(len(v), [])
            own.append((vec_id, v))
            if len(own) >= rows:
                yield tile(len(v), held.pop(len(v)))
    for dim, own in held.items():
        yield tile(dim, own)


_TILE_SCHEMA = "dim int, ids binary, matrix binary, most double"


def product(q: np.ndarray, c: np.ndarray, q_most: float, c_most: float) -> np.ndarray:
    """Exact whole inner products."""
    bound = max(1.0, q_most) * max(1.0, c_most) * max(1, q.shape[1])
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in c], dtype=object).reshape(c.shape).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _read(row, side: str):
    dim, most = row["dim"], row[f"{side}_most"]
    ids = np.frombuffer(row[f"{side}_ids"], dtype="<i8")
    m = np.frombuffer(row[f"{side}_matrix"], dtype="<i2" if most < 2**15 else "<f8").reshape(len(ids), dim)
    return ids, m, most


def _search(batches, k: int):
    names = ["query_id", "query_key", "vec_id", "score", "tile"]
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
            (q_ids, q, q_most), (ids, c, c_most) = _read(row, "q"), _read(row, "c")
            order = np.argsort(ids, kind="stable")
            ids, c = ids[order], c[order]
            keys = np.frombuffer(row["q_keys"], dtype="<i8")
            out = []
            for a in range(0, len(q_ids), 256):
                s = product(q[a : a + 256], c, q_most, c_most)
                for j in range(len(s)):
                    score, ok = s[j], ids != q_ids[a + j]
                    n = int(ok.sum())
                    if n == 0:
                        continue
                    at = np.flatnonzero(ok)
                    own = score[at]
                    if n > k:
                        cut = np.partition(own, n - k)[n - k]
                        keep = np.flatnonzero(own > cut)
                        keep = np.concatenate([keep, np.flatnonzero(own == cut)[: k - len(keep)]])  # ids ascend: ties go to the smaller
                        at, own = at[keep], own[keep]
                    out.append((np.full(len(at), q_ids[a + j]), np.full(len(at), keys[a + j]), ids[at], own))
            if out:
                cols = [np.concatenate(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), row["tile"]), pa.int32())], names=names)


def _with_keys(batches):
    """Adds q_keys: a hash of each query's vector, so that equal ids with different vectors stay apart."""
    import xxhash

    for b in batches:
        keys = []
        for i in range(b.num_rows):
            n, m = len(b.column(1)[i].as_py()) // 8, b.column(2)[i].as_py()
            step = len(m) // max(1, n)
            keys.append(np.array([xxhash.xxh64_intdigest(m[j * step : (j + 1) * step]) >> 1 for j in range(n)], dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], names=[*b.schema.names, "q_keys"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, *, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query."""
    side = lambda df, s: df.select("dim", *(F.col(c).alias(f"{s}_{c}") for c in ("ids", "matrix", "most")), *[c for c in ("q_keys", "slot", "tile") if c in df.columns])
    own = _quantised(queries).distinct()
    n_tiles = max(1, -(-own.count() // QUERIES))
    packed = own.repartition(n_tiles, "vec_id").mapInArrow(lambda it: _pack(it, QUERIES), _TILE_SCHEMA)
    q = packed.mapInArrow(_with_keys, _TILE_SCHEMA + ", q_keys binary")
    # Each query tile goes to every slot, and each candidate tile to one: an equi-join pairs all tiles.
    tiles = -(-vectors.count() // tile)
    slots = max(16, tiles // PER_SLOT)
    q = q.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    # Many small partitions would give many small tiles.
    c = _quantised(vectors).coalesce(max(tiles, vectors.sparkSession.sparkContext.defaultParallelism)).mapInArrow(lambda it: _pack(it, tile), _TILE_SCHEMA)
    c = c.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int")).withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(1 << 30)).cast("int"))
    pairs = side(q, "q").join(side(c, "c"), ["dim", "slot"])
    schema = "query_id long, query_key long, vec_id long, score long, tile int"
    lists = pairs.mapInArrow(lambda it: _search(it, k), schema)
    by = lambda *keys: Window.partitionBy("query_id", "query_key", *keys).orderBy(F.desc("score"), F.asc("vec_id"))
    lists = lists.withColumn("group", F.pmod(F.col("tile"), F.lit(FAN_IN)))
    merged = lists.withColumn("rank", F.row_number().over(by("group"))).where(F.col("rank") <= k).drop("rank")
    merged = merged.withColumn("rank", F.row_number().over(by())).where(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 20 = 0) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
