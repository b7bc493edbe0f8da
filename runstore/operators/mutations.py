"""The log of puts and checked deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runstore.functions import codec
from runstore.schema import PAIR_LIMIT


def log(df: DataFrame, seq: Column, key: Column, value: Column, deleted: Column) -> DataFrame:
    """A log from any table: a row is a delete where ``deleted`` holds, else a put."""
    none = F.lit(b"")
    return df.select(seq.cast("long").alias("seq"), F.when(deleted, "delete").otherwise("put").alias("op"), key.alias("key"), F.when(deleted, none).otherwise(value).alias("value"))


def fill(spark: SparkSession, lower: int, upper: int, first_seq: int = 0) -> DataFrame:
    """Puts of ``i`` = ``value@i`` for lower to upper inclusive; none if reversed."""
    ids = spark.range(lower, max(lower, upper + 1))
    return ids.select((F.col("id") - lower + first_seq).alias("seq"), F.lit("put").alias("op"), codec.text(F.col("id")).alias("key"), codec.text(F.concat(F.lit("value@"), F.col("id"))).alias("value"))


def sizes(mutations: DataFrame) -> DataFrame:
    return mutations.withColumn("size", (F.octet_length("key") + F.octet_length("value")).cast("long"))


def judged(mutations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``accepted`` for each mutation: a delete needs a live key just before it.

    Refused deletes leave no trace, so the key's previous operation alone decides: the key is
    dead if there was none or if it left an empty value. ``stored`` holds what was written before
    (seq, key, value, all seqs lower): of the keys that the log deletes, its newest versions come first.
    """
    if stored is None:
        return mutations.withColumn("accepted", ~((F.col("op") == "delete") & _dead()))
    deleted = mutations.where("op = 'delete'").select("key").distinct()
    newest = stored.join(deleted, "key", "left_semi").groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    both = mutations.select("seq", "op", "key", "value").unionByName(newest.select("seq", F.lit("stored").alias("op"), "key", "value"))
    return both.withColumn("accepted", ~((F.col("op") == "delete") & _dead())).where("op <> 'stored'")


def _dead() -> Column:
    before = F.lag("value").over(Window.partitionBy("key").orderBy("seq"))
    return F.octet_length(F.coalesce(before, F.lit(b""))) == 0


def accept(mutations: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    return judged(mutations, stored).where("accepted").drop("accepted")


def oversize(mutations: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Pairs that strict limits refuse."""
    return sizes(mutations).where(F.col("size") > limit)
