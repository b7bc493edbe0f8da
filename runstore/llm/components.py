"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partial minimum per node and an equi-join on that node, so a hub of any degree
is pre-aggregated and its join side can be split. Nothing but a row count and a hash total
reaches the driver; the edges of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    # Written first, so that the join shuffles both sides itself and a hub's rows can be split.
    least = keep(near.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.col("k")).alias("m")), "least")
    joined = near.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node of an edge; root is the smallest node it is connected to.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    now = keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]) or not state["n"]:
            break
        before = (state["n"], state["h"])
        now = keep(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
