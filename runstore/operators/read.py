"""Point and batch lookups, range scans, and scans of all versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runstore.functions.bounds import Bound, in_range
from runstore.sources import scratch

FREE = Bound.unbounded()
PART_BITS = 33  # of the row numbers within a part in Spark's increasing ids


def latest(rows: DataFrame, lower: Bound = FREE, upper: Bound = FREE, by: str = "seq") -> DataFrame:
    """``key, value`` of the live keys within the bounds: newest version, deleted keys absent."""
    newest = rows.where(in_range(F.col("key"), lower, upper)).groupBy("key").agg(F.max_by("value", by).alias("value"))
    return newest.where("octet_length(value) > 0")


def get(rows: DataFrame, key: bytes | str) -> DataFrame:
    """One row, or none if the key is absent or deleted."""
    at = Bound.included(key)
    return latest(rows, at, at)


def multi_get(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, value`` for each row of ``keys`` (key); the value is null where the key is absent.

    Only the asked keys are looked up: one join on the key, whose partitioning the aggregate takes over.
    """
    asked = keys.groupBy("key").agg(F.count("*").cast("int").alias("times"))
    found = asked.join(rows.select("key", "value", "seq"), "key", "left").groupBy("key").agg(F.first("times").alias("times"), F.max_by("value", "seq").alias("value"))
    live = F.when(F.octet_length("value") > 0, F.col("value"))
    return found.select("key", live.alias("value"), F.explode(F.sequence(F.lit(1), "times")).alias("n")).drop("n")


def scan(rows: DataFrame, lower: Bound = FREE, upper: Bound = FREE) -> DataFrame:
    """The live keys within the bounds, in key order."""
    return latest(rows, lower, upper).orderBy("key")


def scan_versions(run_rows: DataFrame, lower: Bound = FREE, upper: Bound = FREE) -> DataFrame:
    """Every run's version within the bounds, delete markers included, by key and value."""
    return run_rows.where(in_range(F.col("key"), lower, upper)).select("key", "value").orderBy("key", "value")


def as_of(rows: DataFrame, seq: int) -> DataFrame:
    """The live keys as they were after the mutation ``seq``."""
    return latest(rows.where(F.col("seq") <= seq))


def merge(*runs: DataFrame) -> DataFrame:
    """All rows of sorted runs as one sorted sequence; nothing is removed."""
    out = runs[0].select("key", "value")
    for run in runs[1:]:
        out = out.unionByName(run.select("key", "value"))
    return out.orderBy("key", "value")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``pos``: the place of each row in the given order, from 1. Rows that are equal in it are not told apart.

    Ranges are sorted side by side. They are kept as a table, since a second run could cut them
    elsewhere; to a row's place in its range come the rows of the ranges before it.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = scratch.keep(ranges, "ordered").withColumn("_range", F.shiftright("_at", PART_BITS)).withColumn("_before", F.lit(0))
    if len(kept.inputFiles()) > 1:  # one range, of a small table, has none before it
        sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
        before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
        kept = kept.drop("_before").join(F.broadcast(before), "_range")
    pos = F.col("_before") + F.col("_at").bitwiseAND((1 << PART_BITS) - 1) + 1
    return kept.withColumn("pos", pos.cast("int")).select(*rows.columns, "pos")
