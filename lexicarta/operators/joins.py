"""Join helpers: broadcast a side only behind a checked size bound."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a small side may have before it is shuffled instead.
MAX_BROADCAST_BYTES = 64 << 20
#: What a value of unknown length is taken for.
_STRING_BYTES, _ELEMENTS = 64, 64


def row_bytes(kind: T.DataType, elements: int = _ELEMENTS) -> int:
    """Estimated bytes of a value of this type; arrays and maps are taken to
    hold ``elements`` entries."""
    if isinstance(kind, T.StructType):
        return 16 + sum(8 + row_bytes(f.dataType, elements) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 24 + elements * row_bytes(kind.elementType, elements)
    if isinstance(kind, T.MapType):
        return 48 + elements * (row_bytes(kind.keyType, elements) + row_bytes(kind.valueType, elements))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return _STRING_BYTES
    return 4 if isinstance(kind, (T.FloatType, T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)) else 16 if isinstance(kind, T.DecimalType) else 8


def fits_broadcast(small: DataFrame, rows: int, elements: int = _ELEMENTS) -> bool:
    return rows * row_bytes(small.schema, elements) <= MAX_BROADCAST_BYTES


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
               known_rows: int | None = None, elements: int = _ELEMENTS) -> DataFrame:
    """Join ``big`` to a side that is usually small (per-stratum, per-class,
    vocabulary tables).  It is broadcast only if its rows times their
    estimated bytes stay under ``MAX_BROADCAST_BYTES``; otherwise, as without
    ``known_rows`` and a hint, Spark plans the join from the sizes it knows.
    Pass ``known_rows`` where the number is at hand: nothing is counted here."""
    if known_rows is not None and fits_broadcast(small, known_rows, elements):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
