"""Open, closed and unbounded key bounds as Column predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """``kind`` is included, excluded or unbounded."""

    kind: str
    key: bytes | str | None = None

    @staticmethod
    def included(key: bytes | str) -> Bound:
        return Bound("included", key)

    @staticmethod
    def excluded(key: bytes | str) -> Bound:
        return Bound("excluded", key)

    @staticmethod
    def unbounded() -> Bound:
        return Bound("unbounded")

    @property
    def literal(self) -> Column:
        return F.lit(self.key.encode() if isinstance(self.key, str) else self.key)


def in_range(key: Column, lower: Bound, upper: Bound) -> Column:
    """Keys within both bounds; a plain comparison, so that it reaches the Parquet reader."""
    out = F.lit(True)
    if lower.kind != "unbounded":
        out = key >= lower.literal if lower.kind == "included" else key > lower.literal
    if upper.kind != "unbounded":
        high = key <= upper.literal if upper.kind == "included" else key < upper.literal
        out = high if lower.kind == "unbounded" else out & high
    return out


def overlaps(first: Column, last: Column, lower: Bound, upper: Bound) -> Column:
    """Whether a run from ``first`` to ``last`` (both inclusive) can hold a key within the bounds."""
    out = F.lit(True)
    if lower.kind != "unbounded":
        out = out & (last >= lower.literal if lower.kind == "included" else last > lower.literal)
    if upper.kind != "unbounded":
        out = out & (first <= upper.literal if upper.kind == "included" else first < upper.literal)
    return out
