"""Connected components by alternating large-star and small-star steps, each a grouping and a join.

Steps needed grow with the logarithm of a component's size; after ROUNDS of them the result would not be settled, which
is an error and never a wrong answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import freed, staged

ROUNDS = 60


def connected(edges: DataFrame) -> DataFrame:
    """doc_id, component (the smallest id reachable) of every id in edges (a, b). No edges: no rows."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(ROUNDS):
        # large star: a node's larger neighbours go to its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("v"), F.least("u", "low").alias("low"))
        # each edge (u, v), u > v, is in v's star as a larger neighbour of v
        large = staged(now.join(low, "v").select("u", F.col("low").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        across = large.join(low, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = staged(across.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        freed(large)
        differ = _differ(now, after)
        freed(now)
        now = after
        if not differ:
            break
    else:
        raise RuntimeError(f"components are not settled after {ROUNDS} rounds")
    roots = now.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct()
    out = staged(now.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(roots).distinct())
    freed(now)
    return out


def _differ(x: DataFrame, y: DataFrame) -> bool:
    total = [df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first() for df in (x, y)]
    return tuple(total[0]) != tuple(total[1])
