"""From lineage to DataFrames.

An edge of the lineage is a typed column: ``record``, or ``key`` (string) and ``value``.  Functions that are column expressions keep it
in Catalyst.  Functions that are Python run in mapInArrow, and what they return without a declared type is carried as JSON text (marked
in the column's metadata), so that any JSON value and any integer passes exactly.

Two hidden columns carry the order of the records (split and row for a source; partition and key after a reduce).  They are only read
where order shows: when collecting, and by reducers that aren't commutative.  Otherwise Catalyst prunes them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.errors import PermanentFailure, PlanError
from rillwork.functions.partitioner import partition_column
from rillwork.functions.registry import Function, KeyValue
from rillwork.plans.lineage import Node

#: Bytes of one record that a shuffle takes.
RECORD_BYTES = 1 << 20
_FLUSH_KEYS = 200_000


class JsonNumber(float):
    """A JSON number that is no integer, with its text."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.json_text = text
        return self


def decode(text: str | None) -> Any:
    return None if text is None else json.loads(text, parse_float=JsonNumber)


def encode(value: Any) -> str:
    """JSON text of a value; the text of a JsonNumber stays as it was."""
    if isinstance(value, JsonNumber):
        return value.json_text
    if isinstance(value, KeyValue):
        return encode({"key": value.key, "value": value.value})
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise PermanentFailure("record is not JSON: an object's keys must be strings")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{encode(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(encode, value)) + "]"
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise PermanentFailure(f"record is not JSON: {e}") from None


@dataclass(frozen=True)
class Edge:
    """A frame with what is known of its columns."""

    df: DataFrame
    pair: bool
    dynamic: bool  # record (or value) is JSON text
    order: tuple[str, ...]
    reduced: bool = False

    @property
    def column(self) -> str:
        return "value" if self.pair else "record"

    @property
    def names(self) -> list[str]:
        return ["key", "value"] if self.pair else ["record"]

    @property
    def type(self) -> T.DataType:
        return self.df.schema[self.column].dataType

    def public(self) -> DataFrame:
        return self.df.select(*self.names)

    def with_columns(self, *columns: Column, **changes) -> Edge:
        return replace(self, df=self.df.select(*columns, *self.order), **changes)


def _spark_type(kind) -> T.DataType:
    return kind if isinstance(kind, T.DataType) else T.DataType.fromDDL(kind)


def _native(fn: Function, edge: Edge) -> bool:
    if (fn.column is None and fn.aggregate is None) or edge.dynamic:
        return False
    return fn.accepts is None or edge.type.simpleString() in fn.accepts


def _need_python(fn: Function, edge: Edge) -> Callable:
    if fn.python is None:
        what = "JSON values" if edge.dynamic else edge.type.simpleString()
        raise PlanError(f'function "{fn.id}" does not take {what}')
    return fn.python


def _run_python(edge: Edge, work: Callable, out: list[tuple[str, T.DataType]]) -> DataFrame:
    """work: an iterator of tuples of the public columns and the order columns to an iterator of tuples of out and the order columns."""
    names = [*edge.names, *edge.order]
    dynamic = edge.column if edge.dynamic else None
    schema = T.StructType([*(T.StructField(n, t) for n, t in out), *(edge.df.schema[o] for o in edge.order)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(names))]
            if dynamic:
                at = names.index(dynamic)
                cols[at] = list(map(decode, cols[at]))
            rows = list(work(zip(*cols)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return edge.df.select(*names).mapInArrow(run, schema)


def _map(edge: Edge, fn: Function) -> Edge:
    if _native(fn, edge):
        own = F.struct("key", "value") if edge.pair else F.col("record")
        return edge.with_columns(fn.column(own).alias("record"), pair=False)
    f, dynamic = _need_python(fn, edge), fn.returns is None
    kind = T.StringType() if dynamic else _spark_type(fn.returns)
    if edge.pair:
        work = lambda rows: ((encode(y) if dynamic else y, *o) for k, v, *o in rows for y in (f(KeyValue(k, v)),))
    else:
        work = lambda rows: ((encode(y) if dynamic else y, *o) for x, *o in rows for y in (f(x),))
    return replace(edge, df=_run_python(edge, work, [("record", kind)]), pair=False, dynamic=dynamic)


def _filter(edge: Edge, fn: Function) -> Edge:
    if _native(fn, edge):
        own = F.struct("key", "value") if edge.pair else F.col("record")
        return replace(edge, df=edge.df.where(fn.column(own)))
    f = _need_python(fn, edge)
    back = encode if edge.dynamic else (lambda v: v)
    if edge.pair:
        work = lambda rows: ((k, back(v), *o) for k, v, *o in rows if f(KeyValue(k, v)))
    else:
        work = lambda rows: ((back(x), *o) for x, *o in rows if f(x))
    return replace(edge, df=_run_python(edge, work, [(c, edge.df.schema[c].dataType) for c in edge.names]))


def _map_to_pair(edge: Edge, fn: Function) -> Edge:
    if _native(fn, edge):
        own = F.struct("key", "value") if edge.pair else F.col("record")
        k, v = fn.column(own)
        return edge.with_columns(k.alias("key"), v.alias("value"), pair=True)
    f, dynamic = _need_python(fn, edge), fn.returns is None
    kind = T.StringType() if dynamic else _spark_type(fn.returns)

    def pair(y, o):
        if not isinstance(y, tuple) or len(y) != 2 or not isinstance(y[0], str):
            raise PermanentFailure("expected KeyValue")
        return (y[0], encode(y[1]) if dynamic else y[1], *o)

    if edge.pair:
        work = lambda rows: (pair(f(KeyValue(k, v)), o) for k, v, *o in rows)
    else:
        work = lambda rows: (pair(f(x), o) for x, *o in rows)
    return replace(edge, df=_run_python(edge, work, [("key", T.StringType()), ("value", kind)]), pair=True, dynamic=dynamic)


def _as_pair(edge: Edge, operator: str) -> Edge:
    """A pair edge; a map may have returned pairs as struct(key, value)."""
    if edge.pair:
        return edge
    kind = edge.type
    if not edge.dynamic and isinstance(kind, T.StructType) and kind.names == ["key", "value"] and isinstance(kind["key"].dataType, T.StringType):
        return edge.with_columns(F.col("record.key").alias("key"), F.col("record.value").alias("value"), pair=True)
    raise PlanError(f"{operator}: expected KeyValue")


def _map_values(edge: Edge, fn: Function) -> Edge:
    edge = _as_pair(edge, "map_values")
    if _native(fn, edge):
        return edge.with_columns(F.col("key"), fn.column(F.col("value")).alias("value"))
    f, dynamic = _need_python(fn, edge), fn.returns is None
    kind = T.StringType() if dynamic else _spark_type(fn.returns)
    work = lambda rows: ((k, encode(y) if dynamic else y, *o) for k, v, *o in rows for y in (f(v),))
    return replace(edge, df=_run_python(edge, work, [("key", T.StringType()), ("value", kind)]), dynamic=dynamic)


def _guarded_key(edge: Edge, limit: int | None) -> Column:
    """The key, failing where a shuffle record would be refused: invalid UTF-8, or too many bytes."""
    key = F.col("key")
    guard = F.when(key.isNull(), F.raise_error(F.lit("expected KeyValue"))).when(~F.is_valid_utf8(key), F.raise_error(F.lit("invalid record: key is not valid UTF-8")))
    if limit is not None:
        small = isinstance(edge.type, (T.IntegralType, T.FractionalType, T.BooleanType))
        size = F.octet_length(key) + (F.lit(64) if small else F.octet_length("value") if isinstance(edge.type, T.StringType) else F.octet_length(F.to_json(F.struct("value"))))
        guard = guard.when(size > limit, F.raise_error(F.lit(f"record too large: more than {limit} bytes")))
    return guard.otherwise(key)


def _reduce(edge: Edge, fn: Function, n: int, limit: int | None) -> Edge:
    edge = _as_pair(edge, "reduce_by_key")
    key = _guarded_key(edge, limit)
    placed = lambda df, **how: Edge(df.select("key", "value", partition_column(F.col("key"), n).cast("long").alias("ord_major"), F.col("key").alias("ord_minor")), True, order=("ord_major", "ord_minor"), reduced=True, **how)
    if _native(fn, edge) and fn.aggregate is not None:
        df = edge.df.select(key.alias("key"), "value").groupBy("key").agg(fn.aggregate(F.col("value")).alias("value"))
        return placed(df, dynamic=False)
    if len(edge.order) != 2:
        # Without an order of its own a source has that of its partitions, so that a hot key is gathered a partition at a time.
        edge = replace(edge, df=edge.df.withColumns({"ord_major": F.spark_partition_id().cast("long"), "ord_minor": F.monotonically_increasing_id()}), order=("ord_major", "ord_minor"))
    if _native(fn, edge):
        return placed(_fold_columns(edge, key, fn), dynamic=False)
    return placed(_fold_python(edge, key, fn), dynamic=edge.dynamic or fn.returns is None)


def _fold_columns(edge: Edge, key: Column, fn: Function) -> DataFrame:
    """An associative fold in the order of the records: within each split first, then over the splits, so that a hot key is
    gathered only a split at a time."""

    def fold(values: Column) -> Column:
        ordered = F.transform(F.sort_array(values), lambda x: x["v"])
        rest = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0)))
        return F.aggregate(rest, F.get(ordered, F.lit(0)), lambda a, b: fn.column(a, b))

    rows = edge.df.select(key.alias("key"), F.col("ord_major"), F.struct("ord_minor", F.col("value").alias("v")).alias("x"))
    part = rows.groupBy("key", "ord_major").agg(F.collect_list("x").alias("xs")).select("key", F.struct("ord_major", fold(F.col("xs")).alias("v")).alias("x"))
    return part.groupBy("key").agg(F.collect_list("x").alias("xs")).select("key", fold(F.col("xs")).alias("value"))


def _fold_python(edge: Edge, key: Column, fn: Function) -> DataFrame:
    """The same with a Python function: combined within each task, in order, before the shuffle."""
    f = _need_python(fn, edge)
    dynamic = edge.dynamic or fn.returns is None
    read = decode if edge.dynamic else (lambda v: v)
    write = encode if dynamic else (lambda v: v)
    kind = T.StringType() if dynamic else _spark_type(fn.returns)
    order = [edge.df.schema[o] for o in edge.order]
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kind), *order])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def out(held: dict) -> pa.RecordBatch:
        rows = [(k, write(v), *o) for k, (v, o) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(arrow)], schema=arrow)

    def combine(batches):
        held: dict[str, tuple[Any, tuple]] = {}
        last = None
        for b in batches:
            for k, v, *o in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                # Partial results must be folds of neighbours, so a new split starts anew.
                if last is not None and (o[0] != last or len(held) > _FLUSH_KEYS):
                    yield out(held)
                    held = {}
                last = o[0]
                v = read(v)
                held[k] = (f(held[k][0], v), held[k][1]) if k in held else (v, tuple(o))
        yield out(held)

    again = decode if dynamic else (lambda v: v)
    pair = to_arrow_schema(T.StructType(schema.fields[:2]))

    def finish(batches):
        """Rows in order of key and place: one key is held at a time, and a batch of results."""
        key, total = None, None
        for b in batches:
            done = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k == key:
                    total = f(total, again(v))
                else:
                    if key is not None:
                        done.append((key, write(total)))
                    key, total = k, again(v)
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t.type) for i, t in enumerate(pair)], schema=pair)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pair[0].type), pa.array([write(total)], pair[1].type)], schema=pair)

    partial = edge.df.select(key.alias("key"), "value", *edge.order).mapInArrow(combine, schema)
    return partial.repartition("key").sortWithinPartitions("key", *edge.order).mapInArrow(finish, T.StructType(schema.fields[:2]))


_APPLY = {"map": ("map", _map), "filter": ("filter", _filter), "map_to_pair": ("pair-map", _map_to_pair), "map_values": ("value-map", _map_values)}


def compile_lineage(context, target: int, *, source=None, ordered: bool = True) -> Edge:
    """The edge of a validated node; the source is opened here, at the time of an action."""
    spark: SparkSession = context.spark
    nodes: list[Node] = context.lineage.ancestors(target)
    edge: Edge | None = None
    for n in nodes:
        if n.operator == "source":
            df = (source or context.source)(spark, n.path, n.num_partitions)
            order = tuple(c for c in ("ord_major", "ord_minor") if ordered and c in df.columns)
            edge = Edge(df.select("record", *order), False, False, order if len(order) == 2 else ())
            if not edge.order:
                edge = replace(edge, df=df.select("record"))
        elif n.operator == "reduce_by_key":
            edge = _reduce(edge, context.registry.lookup("reduce", n.function), n.num_partitions, context.record_bytes)
        else:
            kind, apply = _APPLY[n.operator]
            edge = apply(edge, context.registry.lookup(kind, n.function))
    return edge


def records(edge: Edge) -> list:
    """All records in order, as Python values."""
    df = edge.df.select(*edge.names, *edge.order)
    rows = (df.orderBy(*edge.order) if edge.order else df).collect()
    read = decode if edge.dynamic else (lambda v: v)
    if edge.pair:
        return [KeyValue(r.key, read(_plain(r.value))) for r in rows]
    return [read(_plain(r.record)) for r in rows]


def _plain(value):
    """Rows as dictionaries, so that results are JSON values."""
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def count_frame(edge: Edge) -> DataFrame:
    """One row n: the number of records.  The hash keeps every column alive, so that functions still run and still fail."""
    df = edge.public()
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns)).alias("_live")).where(F.col("_live").isNotNull() | (F.col("n") == 0)).select("n")
