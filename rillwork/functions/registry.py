"""Named functions in five kinds.  A job refers to functions by name; they are never part of it."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql.types import DataType

from rillwork.errors import PlanError

KINDS = ("map", "filter", "pair-map", "value-map", "reduce")


class KeyValue(NamedTuple):
    key: str
    value: Any


@dataclass(frozen=True)
class Function:
    """A function as Spark and as Python see it.

    column     builds the Column expression: record -> record (map, value-map), record -> boolean (filter), record -> (key, value)
               (pair-map), (a, b) -> value (reduce: an associative fold in the order of the records)
    aggregate  for a reduce that is associative and commutative: value column -> aggregate column
    python     the same for values that only Python can hold; pair-map returns KeyValue
    returns    Spark type of what the python function returns; without it results are carried as JSON text
    accepts    for column: input types it takes (simpleString); others go to python, or are refused
    """

    id: str
    column: Callable[..., Any] | None = None
    aggregate: Callable[[Column], Column] | None = None
    python: Callable[..., Any] | None = None
    returns: DataType | str | None = None
    accepts: tuple[str, ...] | None = None


class FunctionRegistry:
    """Safe for concurrent use.  Starts empty."""

    def __init__(self):
        self._lock = threading.RLock()
        self._by_kind: dict[str, dict[str, Function]] = {k: {} for k in KINDS}

    def register(self, kind: str, function_id: str, python=None, *, column=None, aggregate=None, returns=None, accepts=None) -> None:
        if kind not in self._by_kind:
            raise PlanError(f'unknown function kind "{kind}"')
        if not function_id:
            raise PlanError(f"{kind} function ID must not be empty")
        if python is None and column is None and aggregate is None:
            raise PlanError(f'{kind} function "{function_id}" must not be nil')
        with self._lock:
            if function_id in self._by_kind[kind]:
                raise PlanError(f'{kind} function "{function_id}" is already registered')
            self._by_kind[kind][function_id] = Function(function_id, column, aggregate, python, returns, accepts)

    def register_map(self, function_id: str, python=None, **how) -> None:
        self.register("map", function_id, python, **how)

    def register_filter(self, function_id: str, python=None, **how) -> None:
        self.register("filter", function_id, python, **how)

    def register_pair_map(self, function_id: str, python=None, **how) -> None:
        self.register("pair-map", function_id, python, **how)

    def register_value_map(self, function_id: str, python=None, **how) -> None:
        self.register("value-map", function_id, python, **how)

    def register_reduce(self, function_id: str, python=None, **how) -> None:
        self.register("reduce", function_id, python, **how)

    def has(self, kind: str, function_id: str) -> bool:
        with self._lock:
            return function_id in self._by_kind.get(kind, {})

    def lookup(self, kind: str, function_id: str) -> Function:
        with self._lock:
            found = self._by_kind[kind].get(function_id)
        if found is None:
            raise PlanError(f'{kind} function "{function_id}" is not registered')
        return found
