"""Sharding by fixed virtual slots (DataFrame functions only).

A record's virtual slot is a hash of its doc_id modulo a fixed number of slots; a small versioned map sends
slots to shards.  Growing or rebalancing edits the map: only records of the moved slots change shards.

    ``slot_bytes(docs)``                 bytes and rows of each slot
    ``slot_map(spark, shards, sizes)``   version 0: slots dealt round robin, with their bytes and rows
    ``grow(map)``                        one more shard takes an even share of slots from each of the others
    ``rebalance(map)``                   moves slots from shards above the mean of bytes to those below (and so gives up the law ``key``)
    ``write_version`` / ``read_version`` the stored, versioned map
    ``place(docs, map)``                 every row with shard and its gapless place in the shard

The query aggregates bytes per slot, stores version 0 in the shared folder, reads it back, stores the map that ``grow`` makes of it as version 1,
and places all rows by both stored versions.  Its law is ``key``: doc_id and the number of shards alone decide, so bytes are kept in the map and
reported, but move no slot.

The map has a row a slot (4,096 of them at any size of the input), so it may be broadcast and the map edits may
be planned on the driver.

Scale.  ``place`` numbers rows in (virtual slot, salt) groups and adds the offset of the group, so no task holds a
shard.  The salt comes from the text's CRC, which spreads a doc_id that holds a large part of all rows; rows that are
equal are counted on the map side and told apart after the shuffle.

Defined results.  Null text counts as no bytes; its CRC is that of the empty text (0).  A null doc_id hashes to one
fixed slot.  Repeated rows each get a place of their own.  Ties in a group are broken by doc_id (null first), CRC and size; rows that
are equal in those are interchangeable.  Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm.common import checkpoint_dir, stored

SLOTS = 4096
#: Parts of a virtual slot, by content.
SALTS = 16
SHARDS = 40
LAW = "key"


def _hash(value: Column) -> Column:
    """The first 32 bits of the MD5 of a number's decimal digits (of nothing, for null): the same in every system."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(_hash(doc_id.cast("long")), F.lit(slots)).cast("int")


def _sized(docs: DataFrame, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, salt) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumns({"vslot": virtual_slot(F.col("doc_id"), slots), "salt": (F.col("text_crc32") % SALTS).cast("int")})


def group_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, salt, bytes, rows): partial sums on the map side; at most slots * SALTS rows after."""
    return _sized(docs, slots).groupBy("vslot", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of each slot that holds a row."""
    return _of_slots(group_bytes(docs, slots))


def _of_slots(groups: DataFrame) -> DataFrame:
    return groups.groupBy("vslot").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))


def slot_map(spark: SparkSession, shards: int, slots: int = SLOTS, sizes: DataFrame | None = None) -> DataFrame:
    """(version, vslot, shard, bytes, rows): version 0 for a number of shards."""
    if not 0 < shards <= slots:
        raise ValueError("shards must be from 1 to the number of slots")
    dealt = spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))
    if sizes is None:
        return dealt.withColumns({"bytes": F.lit(0).cast("long"), "rows": F.lit(0).cast("long")})
    return dealt.join(F.broadcast(sizes), "vslot", "left").select("version", "vslot", "shard", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bytes", "rows")))


def grow(assigned: DataFrame) -> DataFrame:
    """The next version, with one more shard.  Each shard gives up its first slots in hash order, so that all keep an
    even share; no slot moves between old shards.  The input is one version of a map of a fixed number of rows."""
    of_shard = Window.partitionBy("shard").orderBy(_hash(F.col("vslot")), "vslot")
    everywhere = Window.partitionBy(F.lit(0))
    n, shards = F.count(F.lit(1)).over(everywhere), F.max("shard").over(everywhere) + 1
    # Take floor(slots / (shards + 1)) slots: one from each shard in turn, by rank and then by shard.
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("turn", "shard"))
    ranked = assigned.withColumns({"turn": F.row_number().over(of_shard), "n": n, "shards": shards}).withColumn("order", turn)
    shard = F.when(F.col("order") <= F.floor(F.col("n") / (F.col("shards") + 1)), F.col("shards")).otherwise(F.col("shard")).cast("int")
    return ranked.select((F.col("version") + 1).alias("version"), "vslot", shard.alias("shard"), "bytes", "rows")


def rebalance(assigned: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The next version: the fewest greedy moves of whole slots that bring every shard's bytes within the tolerance of the mean,
    as far as whole slots allow.  A map has a row a slot, so the edit is planned on the driver."""
    rows = assigned.collect()
    at, of = {r.vslot: r.shard for r in rows}, {r.vslot: r.bytes for r in rows}
    load = dict.fromkeys(at.values(), 0)
    for v, s in at.items():
        load[s] += of[v]
    mean = sum(load.values()) / max(1, len(load))
    for _ in range(len(at)):
        high, low = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = min(load[high] - mean, mean - load[low]) if load[high] > mean * (1 + tolerance) else 0
        fit = [v for v, s in at.items() if s == high and 0 < of[v] < load[high] - load[low]]
        if not fit or load[high] <= mean * (1 + tolerance):
            break
        v = min(fit, key=lambda v: (abs(of[v] - gap), v))
        at[v] = low
        load[high] -= of[v]
        load[low] += of[v]
    new = [(r.version + 1, r.vslot, at[r.vslot], r.bytes, r.rows) for r in sorted(rows, key=lambda r: r.vslot)]
    return assigned.sparkSession.createDataFrame(new, "version int, vslot int, shard int, bytes long, rows long")


def write_version(assigned: DataFrame, path: str, version: int) -> None:
    """Stores a map as a version; one that is there already is never changed (writing it again is an error)."""
    assigned.drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest if none is named."""
    held = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = held.agg(F.max("version")).first()[0]
    return held.where(F.col("version") == version).select(F.col("version").cast("int"), "vslot", "shard", "bytes", "rows")


def place(docs: DataFrame, assigned: DataFrame, grown: DataFrame | None = None, slots: int = SLOTS, groups: DataFrame | None = None) -> DataFrame:
    """Adds size, text_crc32, vslot, shard, slot (gapless from 0 in each shard) and grown_shard to doc_id; groups is what group_bytes(docs) gives."""
    group = ["vslot", "salt"]
    # Equal rows are interchangeable: they are counted before the shuffle and told apart after it.
    base = _sized(docs, slots).groupBy(*group, "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    moves = assigned.select("vslot", "shard")
    if grown is not None:
        moves = moves.join(F.broadcast(grown.select("vslot", F.col("shard").alias("grown_shard"))), "vslot")
    # At most slots * SALTS rows, of fixed width: bounded, so they may be broadcast.
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (group_bytes(docs, slots) if groups is None else groups).select(*group, "rows").join(F.broadcast(moves), "vslot")
    offsets = offsets.withColumn("offset", F.coalesce(F.sum("rows").over(before("shard").orderBy(*group)), F.lit(0))).drop("rows")
    within = F.coalesce(F.sum("copies").over(before(*group).orderBy("doc_id", "text_crc32", "size")), F.lit(0))
    placed = base.withColumn("within", within).join(F.broadcast(offsets), group)
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return placed.withColumn("slot", F.col("offset") + F.col("within") + F.col("copy")).drop("offset", "within", "copy", "copies", "salt")


def shard(docs: DataFrame, shards: int, path: str) -> DataFrame:
    """Every row placed by the map stored at path: version 0 for so many shards, and version 1 for one more."""
    spark = docs.sparkSession
    groups = stored(group_bytes(docs))
    write_version(slot_map(spark, shards, sizes=_of_slots(groups)), path, 0)
    write_version(grow(read_version(spark, path, 0)), path, 1)
    return place(docs, read_version(spark, path, 0), read_version(spark, path, 1), groups=groups)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shard(docs, SHARDS, f"{checkpoint_dir(spark)}/rillwork-shards-{uuid.uuid4().hex}")
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def _crc_table() -> list[int]:
    """The table of the reflected CRC-32 polynomial, by its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


_SQL_HASH = "CAST(('0x' || substr(md5(coalesce(CAST(%s AS VARCHAR), '')), 1, 8)) AS BIGINT)"
SQL = f"""
WITH raw AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(('0x' || h) AS BIGINT)) AS b FROM documents
), d AS (
  SELECT doc_id, CAST(len(b) + 16 AS BIGINT) AS size, {_SQL_HASH % "doc_id"} % {SLOTS} AS vslot,
    xor(list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), 4294967295) AS text_crc32
  FROM raw, (SELECT {_crc_table()}::BIGINT[] AS t)
), m AS (
  SELECT vslot, vslot % {SHARDS} AS shard, row_number() OVER (PARTITION BY vslot % {SHARDS} ORDER BY {_SQL_HASH % "vslot"}, vslot) AS turn FROM (SELECT unnest(range({SLOTS})) AS vslot)
), g AS (
  SELECT vslot, shard, CASE WHEN row_number() OVER (ORDER BY turn, shard) <= {SLOTS} // {SHARDS + 1} THEN {SHARDS} ELSE shard END AS grown_shard FROM m
)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY vslot, text_crc32 % {SALTS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN g USING (vslot)
"""
