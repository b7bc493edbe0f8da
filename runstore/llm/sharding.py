"""Extendible hashing into byte-limited shards, with DataFrame operations only.

A document's address is 60 bits of the MD5 of its id (of its text where the id is null). The
directory starts as one bucket; a bucket above the limit splits on the next address bit, and
only such buckets do, until every shard fits. A bucket that holds one single address (one
document, or repeats of one id) cannot split and stays as it is, marked ``oversized``.

Levels are made ``STEP`` bits at a time: the slim table of addresses and sizes is summed to the
buckets ``STEP`` bits below those that are still too large, and the levels between come from
these sums. Documents find their shard by an equi-join on (depth, prefix).

Nulls and odd input: a null text has 0 bytes. Equal ids share a shard. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep

BITS, STEP = 60, 12


def _prefix(h: str, depth: str) -> str:
    return f"shiftright({h}, cast({BITS} - {depth} as int))"


def shard_directory(slim: DataFrame, limit_bytes: int) -> DataFrame:
    """The shards (depth, prefix, shard_bytes, oversized) of a table (h, n_bytes)."""
    leaves, still, base = None, None, 0
    while True:
        rows = slim if still is None else slim.join(still.select(F.col("prefix").alias("p")), F.expr(f"{_prefix('h', str(base))} = p"))
        step = min(STEP, BITS - base)
        fine = rows.groupBy(F.expr(_prefix("h", str(base + step))).alias("f")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        level = fine.select(F.explode(F.sequence(F.lit(base), F.lit(base + step))).alias("depth"), "f", "b", "lo", "hi")
        level = level.groupBy("depth", F.expr(f"shiftright(f, cast({base + step} - depth as int))").alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        level = keep(level.withColumn("split", F.expr(f"shard_bytes > {int(limit_bytes)} and lo <> hi")), "level")
        parent = level.where("split").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        done = level.where("not split").withColumn("up", F.expr("shiftright(prefix, 1)")).join(parent, ["depth", "up"], "left_semi")
        if base == 0:
            done = done.unionByName(level.where("not split and depth = 0").withColumn("up", F.lit(0).cast("long")))
        done = done.select("depth", "prefix", "shard_bytes", F.expr(f"shard_bytes > {int(limit_bytes)}").alias("oversized"))
        leaves = done if leaves is None else leaves.unionByName(done)
        base += step
        still = level.where(f"split and depth = {base}").select("prefix")
        if base >= BITS or still.isEmpty():
            return keep(leaves, "directory")


def shard(docs: DataFrame, limit_bytes: int) -> DataFrame:
    """``doc_id, n_bytes, shard_depth, shard_prefix, shard_bytes, oversized`` for every row."""
    text = F.col("text").cast("string")
    address = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit("")).cast("binary")), 1, BITS // 4)
    slim = keep(docs.select("doc_id", F.conv(address, 16, 10).cast("long").alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")), "addresses")
    directory = shard_directory(slim.select("h", "n_bytes"), limit_bytes)
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())
    tried = slim.select("doc_id", "n_bytes", "h", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")).alias("depth"))
    tried = tried.withColumn("prefix", F.expr(_prefix("h", "depth")))
    return tried.join(directory, ["depth", "prefix"]).select("doc_id", "n_bytes", F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), "shard_bytes", "oversized")
