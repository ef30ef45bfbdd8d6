"""The registered queries over the driver's tables, and the DuckDB SQL that checks them.

Each query is a pipeline of the lazy API; its source is a table column instead of a text file."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import session
from rillwork.functions.builtin import default_registry
from rillwork.functions.partitioner import partition_column
from rillwork.functions.registry import FunctionRegistry
from rillwork.operators.dataset import Context, Dataset
from rillwork.plans.lineage import hash_partitioner


def _registry() -> FunctionRegistry:
    r = default_registry()
    r.register_map("pad", column=lambda c: F.concat(F.lit("\t "), c, F.lit(chr(12288))))
    r.register_map("blank_some", column=lambda c: F.when(F.length(c) % 3 == 0, F.lit("")).otherwise(c))
    r.register_map("event_type", column=lambda c: c["event_type"])
    r.register_filter("known_type", column=lambda c: c != "")
    r.register_pair_map("part_line", column=lambda c: (c["l_partkey"].cast("string"), c["l_linenumber"].cast("long")))
    r.register_pair_map("customer_order", column=lambda c: (c["o_custkey"].cast("string"), c["o_orderkey"]))
    r.register_pair_map("conversation_role", column=lambda c: (c["conv_id"].cast("string"), c["role"]))
    r.register_value_map("double", column=lambda v: v * 2)
    r.register_filter("over_4000", column=lambda p: p["value"] > 4000)
    r.register_reduce("max", aggregate=F.max)
    r.register_map("shout", lambda x: x.upper() + "!", returns="string")
    r.register_reduce("join_plus", lambda a, b: f"{a}+{b}", returns="string")
    r.register_reduce("join_bar", column=lambda a, b: F.concat(a, F.lit("|"), b))
    return r


def _pipeline(spark: SparkSession, sf_dir: str, table: str, record: Callable[[DataFrame], DataFrame]) -> Dataset:
    def source(spark: SparkSession, path: str, num_partitions: int) -> DataFrame:
        return record(spark.read.parquet(path))

    return Context(spark, _registry(), source).text_file(f"{sf_dir}/{table}.parquet", 8)


def _column(name: str, *order: str):
    return lambda df: df.select(F.col(name).alias("record"), *_order(order))


def _struct(*names: str, order: tuple[str, ...] = ()):
    return lambda df: df.select(F.struct(*names).alias("record"), *_order(order))


def _order(names) -> list[Column]:
    return [F.col(n).cast("long").alias(o) for n, o in zip(names, ("ord_major", "ord_minor"))]


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("text", "\n")).alias("record"))


def _words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.split("text", " ")).alias("record"))


def _events(spark, sf_dir) -> Dataset:
    return _pipeline(spark, sf_dir, "events", _column("event_type"))


def _event_counts(spark, sf_dir) -> Dataset:
    return _events(spark, sf_dir).map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(8))


def _text(spark: SparkSession, sf_dir: str) -> Dataset:
    """The event types as lines of a text file below the shared folder, read by the text source."""
    folder = f"{session.shared_folder(spark)}/rillwork-lines-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("value")).coalesce(1).write.text(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return Context(spark, _registry()).text_file(found[0].getPath().toString(), 8)


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What collect returns after a reduce, with its place in the result."""
    rows = _pipeline(spark, sf_dir, "lineitem", _struct("l_partkey", "l_linenumber")).map_to_pair("part_line").reduce_by_key("sum_int", hash_partitioner(7)).collect()
    return spark.createDataFrame([(i, r.key, r.value) for i, r in enumerate(rows)], "place long, key string, value long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "source_lines": lambda s, d: _pipeline(s, d, "documents", _lines).to_frame(),
    "map_normalize": lambda s, d: _pipeline(s, d, "documents", _lines).map("pad").map("normalize").to_frame(),
    "filter_non_empty": lambda s, d: _pipeline(s, d, "documents", _lines).map("blank_some").filter("non_empty").to_frame(),
    "map_to_pair": lambda s, d: _events(s, d).map_to_pair("word_pair").to_frame(),
    "map_values": lambda s, d: _events(s, d).map_to_pair("word_pair").map_values("double").to_frame(),
    "reduce_by_key": lambda s, d: _event_counts(s, d).to_frame(),
    "reduce_high_card": lambda s, d: _pipeline(s, d, "lineitem", _struct("l_partkey", "l_linenumber")).map_to_pair("part_line").reduce_by_key("sum_int", hash_partitioner(64)).to_frame(),
    "reduce_custom_max": lambda s, d: _pipeline(s, d, "orders", _struct("o_custkey", "o_orderkey")).map_to_pair("customer_order").reduce_by_key("max", hash_partitioner(64)).to_frame(),
    "reduce_ordered": lambda s, d: _pipeline(s, d, "conversations", _struct("conv_id", "role", order=("conv_id", "turn"))).map_to_pair("conversation_role").reduce_by_key("join_bar", hash_partitioner(16)).to_frame(),
    "post_shuffle": lambda s, d: _event_counts(s, d).map_values("double").filter("over_4000").to_frame(),
    "count_narrow": lambda s, d: _events(s, d).filter("known_type").count_frame(),
    "count_keys": lambda s, d: _event_counts(s, d).count_frame(),
    "hash_partition": lambda s, d: _event_counts(s, d).placed_frame(31).select("key", "value", partition_column(F.col("key"), 31).alias("partition")),
    "word_count": lambda s, d: _pipeline(s, d, "documents", _words).map("normalize").filter("non_empty").map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(64)).to_frame(),
}

QUERIES |= {
    "text_file": lambda s, d: _text(s, d).to_frame(),
    "text_count": lambda s, d: _text(s, d).count_frame(),
    "text_reduce": lambda s, d: _text(s, d).map("normalize").filter("non_empty").map_to_pair("word_pair").reduce_by_key("sum_int", hash_partitioner(4)).to_frame(),
    "map_python": lambda s, d: _events(s, d).map("shout").to_frame(),
    "reduce_python": lambda s, d: _pipeline(s, d, "conversations", _struct("conv_id", "role", order=("conv_id", "turn"))).map_to_pair("conversation_role").reduce_by_key("join_plus", hash_partitioner(16)).to_frame(),
    "collect_order": _collected,
}

# White space in DuckDB's expression syntax.
_W = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TRIM = rf"regexp_replace(%s, '\A[{_W}]+|[{_W}]+\z', '', 'g')"
_LINES = "SELECT unnest(string_split(text, chr(10))) AS record FROM documents"
_COUNTS = "SELECT event_type AS key, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY 1"

#: The partitioner's hash of key, an unsigned 64-bit number.
_FNV = """list_reduce(
          list_prepend(14695981039346656037::HUGEINT,
            list_transform(range(0, octet_length(encode(key))), lambda i: CAST(('0x' || substr(hex(encode(key)), CAST(i * 2 + 1 AS BIGINT), 2)) AS HUGEINT))),
          lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""

ORACLE_SQL: dict[str, str] = {
    "source_lines": _LINES,
    "map_normalize": f"SELECT {_TRIM % 'chr(9) || chr(32) || record || chr(12288)'} AS record FROM ({_LINES})",
    "filter_non_empty": f"SELECT record FROM (SELECT CASE WHEN length(record) % 3 = 0 THEN '' ELSE record END AS record FROM ({_LINES})) WHERE record <> ''",
    "map_to_pair": "SELECT event_type AS key, CAST(1 AS BIGINT) AS value FROM events",
    "map_values": "SELECT event_type AS key, CAST(2 AS BIGINT) AS value FROM events",
    "reduce_by_key": _COUNTS,
    "reduce_high_card": "SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1",
    "reduce_custom_max": "SELECT CAST(o_custkey AS VARCHAR) AS key, max(o_orderkey) AS value FROM orders GROUP BY 1",
    "reduce_ordered": "SELECT CAST(conv_id AS VARCHAR) AS key, string_agg(role, '|' ORDER BY turn) AS value FROM conversations GROUP BY 1",
    "post_shuffle": f"SELECT key, value * 2 AS value FROM ({_COUNTS}) WHERE value * 2 > 4000",
    "count_narrow": "SELECT count(*) AS n FROM events WHERE event_type <> ''",
    "count_keys": "SELECT count(DISTINCT event_type) AS n FROM events",
    "text_file": "SELECT event_type AS record FROM events",
    "text_count": "SELECT count(*) AS n FROM events",
    "text_reduce": _COUNTS,
    "map_python": "SELECT upper(event_type) || '!' AS record FROM events",
    "reduce_python": "SELECT CAST(conv_id AS VARCHAR) AS key, string_agg(role, '+' ORDER BY turn) AS value FROM conversations GROUP BY 1",
    "collect_order": f"""
        SELECT row_number() OVER (ORDER BY {_FNV} % 7, encode(key)) - 1 AS place, key, value
        FROM (SELECT CAST(l_partkey AS VARCHAR) AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1)""",
    "hash_partition": f"SELECT key, value, CAST({_FNV} % 31 AS INTEGER) AS partition FROM ({_COUNTS})",
    "word_count": f"SELECT w AS key, CAST(count(*) AS BIGINT) AS value FROM (SELECT {_TRIM % 'w'} AS w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) WHERE w <> '' GROUP BY 1",
}
