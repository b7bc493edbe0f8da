"""Typed columns as keys and values, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(column: Column) -> Column:
    return F.encode(column.cast("string"), "utf-8")


def decode(column: Column) -> Column:
    return F.decode(column, "utf-8")


def padded(column: Column, width: int = 20) -> Column:
    """Order-preserving key of a non-negative integer."""
    return F.encode(F.lpad(column.cast("string"), width, "0"), "utf-8")


def prefix_length(a: str, b: str) -> Column:
    """Bytes that two binary columns, named in SQL, share at their begin."""
    n = f"least(octet_length({a}), octet_length({b}))"
    differs = f"array_position(transform(sequence(1, greatest({n}, 1)), i -> substring({a}, i, 1) = substring({b}, i, 1)), false)"
    return F.expr(f"cast(case when {n} = 0 then 0 when {differs} = 0 then {n} else {differs} - 1 end as int)")
