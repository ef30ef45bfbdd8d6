"""The hash partitioner: FNV-1a of 64 bits over the key's UTF-8 bytes, modulo the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillwork.errors import PermanentFailure

# Fixed values of the published hash.
_OFFSET = 0xCBF29CE484222325
_PRIME = 0x100000001B3


def fnv1a(data: bytes) -> int:
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME % (1 << 64)
    return h


def partition_for(key: str | bytes, n: int) -> int:
    if n <= 0:
        raise PermanentFailure(f"invalid partition count {n}")
    try:
        data = key.decode("utf-8").encode() if isinstance(key, bytes) else key.encode("utf-8")
    except UnicodeError:
        raise PermanentFailure("key is not valid UTF-8") from None
    return fnv1a(data) % n


def partition_column(key: Column, n: int) -> Column:
    """The same as a column expression.

    ANSI arithmetic has no wrapping product, so the hash is held in two halves of 32 bits; the prime is 2^40 + 435, so that each half
    times 435 stays far below 2^63 and the shift by 40 moves the low half into the high one."""
    if n <= 0:
        raise PermanentFailure(f"invalid partition count {n}")
    half = F.lit((1 << 32) - 1)
    digits = F.hex(F.encode(key, "UTF-8"))
    count = F.octet_length(key)

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digits, (i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
        low = h["low"].bitwiseXOR(byte)
        product = low * 435
        high = h["high"] * 435 + F.shiftright(product, 32) + low * 256
        return F.struct(high.bitwiseAND(half).alias("high"), product.bitwiseAND(half).alias("low"))

    start = F.struct(F.lit(_OFFSET >> 32).cast("long").alias("high"), F.lit(_OFFSET & 0xFFFFFFFF).cast("long").alias("low"))
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda h: ((h["high"] % n) * ((1 << 32) % n) + h["low"]) % n).cast("int")
