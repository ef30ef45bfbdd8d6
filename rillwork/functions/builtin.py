"""The built-in functions: normalize, non_empty, word_pair and sum_int."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.errors import PermanentFailure
from rillwork.functions.registry import FunctionRegistry, KeyValue

# The code points with the Unicode property White_Space.
WHITE_SPACE = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_TRIM = re.compile(rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\Z")
_LONG = re.compile(r"-?(?:0|[1-9][0-9]*)\Z")
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def _text(value, name: str) -> str:
    if not isinstance(value, str):
        raise PermanentFailure(f"{name} requires a string, got {type(value).__name__}")
    return value


def _integer(value) -> int:
    """An exact integer of 64 bits: no booleans, no other numbers, no text.  JSON numbers arrive as their text in a JsonNumber."""
    text = getattr(value, "json_text", None)
    if text is not None:
        if not _LONG.match(text):
            raise PermanentFailure(f"sum_int requires an integer, got {text}")
        value = int(text)
    if isinstance(value, bool) or not isinstance(value, int):
        raise PermanentFailure(f"sum_int requires an integer, got {type(value).__name__}")
    if not _MIN <= value <= _MAX:
        raise PermanentFailure(f"sum_int: {value} is out of range")
    return value


def normalize(value):
    return _TRIM.sub("", _text(value, "normalize"))


def non_empty(value) -> bool:
    return _text(value, "non_empty") != ""


def word_pair(value) -> KeyValue:
    return KeyValue(_text(value, "word_pair"), 1)


def sum_int(a, b) -> int:
    total = _integer(a) + _integer(b)
    if not _MIN <= total <= _MAX:
        raise PermanentFailure("sum_int: integer overflow")
    return total


#: The same code points as text; trimming by characters costs a fraction of a pattern, and keeps bytes that aren't UTF-8.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c))


def trim_column(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def sum_column(v: Column) -> Column:
    """A checked sum.  A null passes through alone, and fails next to any other value, as the Python twin does."""
    n, known = F.count(F.lit(1)), F.count(v)
    return F.when((n > 1) & (known < n), F.raise_error(F.lit("sum_int requires an integer, got null"))).otherwise(F.sum(v))


def default_registry() -> FunctionRegistry:
    r = FunctionRegistry()
    r.register_map("normalize", normalize, column=trim_column, accepts=("string",), returns="string")
    r.register_filter("non_empty", non_empty, column=lambda c: F.when(c.isNull(), F.raise_error(F.lit("non_empty requires a string, got null")).cast("boolean")).otherwise(c != ""), accepts=("string",))
    r.register_pair_map("word_pair", word_pair, column=lambda c: (c, F.lit(1).cast("long")), accepts=("string",), returns="long")
    r.register_reduce("sum_int", sum_int, aggregate=sum_column, accepts=("bigint", "int", "smallint", "tinyint"), returns="long")
    return r
