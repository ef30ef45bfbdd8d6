"""The lazy API: a context owns a lineage, and a dataset is a handle on one of its nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rillwork import session
from rillwork.errors import PermanentFailure, PlanError
from rillwork.functions.registry import FunctionRegistry
from rillwork.plans import compiler, stages
from rillwork.plans.lineage import Dependency, Lineage, Narrow, Node, Partitioner, Shuffle
from rillwork.sources.text import Source, text_file

TOO_MANY_SHUFFLES = "only narrow or single-shuffle execution is supported"


class Context:
    """Without a Spark session a context builds and explains, and runs nothing.

    max_shuffles   how many shuffles an execution may have (None: any number)
    record_bytes   the size above which a shuffled record fails (None: any)
    """

    def __init__(self, spark: SparkSession | None = None, registry: FunctionRegistry | None = None, source: Source = text_file, *, max_shuffles: int | None = 1, record_bytes: int | None = compiler.RECORD_BYTES):
        self.spark, self.source = spark, source
        self.registry = FunctionRegistry() if registry is None else registry
        self.max_shuffles, self.record_bytes = max_shuffles, record_bytes
        self.lineage = Lineage()

    def text_file(self, path: str, num_partitions: int) -> Dataset:
        return Dataset(self.lineage.add(Node("TextFile", "source", num_partitions, path=path)), self)


@dataclass(frozen=True)
class Dataset:
    node_id: int
    context: Context | None

    def _parent(self, what: str) -> Node:
        if self.context is None:
            raise PlanError(f"{what} RDD {self.node_id}: missing context")
        node = self.context.lineage.get(self.node_id)
        if node is None:
            raise PlanError(f"{what} RDD {self.node_id}: parent does not exist")
        return node

    def _add(self, what: str, node: Node) -> Dataset:
        try:
            return Dataset(self.context.lineage.add(node), self.context)
        except PlanError as e:
            raise PlanError(f"{what} RDD {self.node_id}: {e}") from None

    def _narrow(self, name: str, operator: str, function: str, keep_partitioner: bool) -> Dataset:
        parent = self._parent(name)
        return self._add(name, Node(name, operator, parent.num_partitions, function=function, partitioner=parent.partitioner if keep_partitioner else None, dependencies=(Dependency(self.node_id, "narrow", narrow=Narrow()),)))

    def map(self, function: str) -> Dataset:
        return self._narrow("Map", "map", function, False)

    def filter(self, function: str) -> Dataset:
        return self._narrow("Filter", "filter", function, True)

    def map_to_pair(self, function: str) -> Dataset:
        return self._narrow("MapToPair", "map_to_pair", function, False)

    def map_values(self, function: str) -> Dataset:
        return self._narrow("MapValues", "map_values", function, True)

    def reduce_by_key(self, function: str, partitioner: Partitioner) -> Dataset:
        self._parent("reduce-by-key")
        shuffle = Shuffle(self.context.lineage.new_shuffle_id(), partitioner, function)
        node = Node("ReduceByKey", "reduce_by_key", partitioner.num_partitions, function=function, partitioner=partitioner, dependencies=(Dependency(self.node_id, "shuffle", shuffle=shuffle),))
        return self._add("reduce-by-key", node)

    def explain_lineage(self) -> str:
        if self.context is None:
            raise PlanError(f"explain RDD {self.node_id}: missing context")
        return self.context.lineage.explain(self.node_id)

    def plan_stages(self, action: str, functions: FunctionRegistry | None = None) -> stages.StagePlan:
        if self.context is None:
            raise PlanError(f"plan RDD {self.node_id}: missing context")
        return stages.plan_stages(self.context.lineage, self.node_id, action, functions or self.context.registry)

    def _edge(self, action: str) -> compiler.Edge:
        if self.context is None:
            raise PlanError(f"{action} RDD {self.node_id}: missing context")
        if self.context.spark is None:
            raise PlanError(f"{action} RDD {self.node_id}: action runner is not configured")
        try:
            plan = self.plan_stages(action)
            if self.context.max_shuffles is not None and plan.shuffles > self.context.max_shuffles:
                raise PlanError(TOO_MANY_SHUFFLES)
            session.check(self.context.spark)
            return compiler.compile_lineage(self.context, self.node_id)
        except PermanentFailure as e:
            raise type(e)(f"{action} RDD {self.node_id}: {e}") from e

    def collect(self) -> list:
        """All records: in file order, and after a reduce by partition and then by key."""
        return compiler.records(self._edge("collect"))

    def count(self) -> int:
        return compiler.count_frame(self._edge("count")).first()["n"]

    def to_frame(self) -> DataFrame:
        """The records as a frame (record, or key and value), for further work in Spark."""
        return self._edge("collect").public()

    def count_frame(self) -> DataFrame:
        return compiler.count_frame(self._edge("count"))

    def placed_frame(self, num_partitions: int) -> DataFrame:
        """Pairs dealt to the partitions that the hash partitioner gives them, each sorted by key."""
        from pyspark.sql import functions as F

        from rillwork.functions.partitioner import partition_column

        edge = self._edge("collect")
        if not edge.pair:
            raise PlanError("partition: expected KeyValue")
        return edge.public().repartitionById(num_partitions, partition_column(F.col("key"), num_partitions)).sortWithinPartitions("key")
