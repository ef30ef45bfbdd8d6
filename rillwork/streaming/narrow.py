"""Narrow pipelines on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rillwork.errors import PlanError
from rillwork.operators.dataset import Dataset
from rillwork.plans import compiler


def apply_narrow(dataset: Dataset, stream: DataFrame) -> DataFrame:
    """The dataset's map, filter, map_to_pair and map_values steps over a stream with a column ``record``, in place of its source.

    reduce_by_key has no meaning on an unbounded stream without a window and is refused."""
    nodes = dataset.context.lineage.ancestors(dataset.node_id)
    if any(n.operator == "reduce_by_key" for n in nodes):
        raise PlanError("reduce_by_key needs a finite source")
    return compiler.compile_lineage(dataset.context, dataset.node_id, source=lambda *_: stream.select("record"), ordered=False).public()
