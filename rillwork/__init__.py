"""Lazy pipelines over named functions, compiled to Spark DataFrames."""

from rillwork.errors import FailureKind, JobError, PermanentFailure, classify
from rillwork.functions.builtin import default_registry
from rillwork.functions.registry import FunctionRegistry, KeyValue
from rillwork.operators.dataset import Context, Dataset
from rillwork.plans.lineage import Partitioner, hash_partitioner
from rillwork.plans.stages import StagePlan, explain_stage_plan

__all__ = ["Context", "Dataset", "FailureKind", "FunctionRegistry", "JobError", "KeyValue", "Partitioner", "PermanentFailure", "StagePlan", "classify", "default_registry", "explain_stage_plan", "hash_partitioner"]
