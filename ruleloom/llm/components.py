"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of a table (a, b) of undirected edges; ids without edge are absent.

    Alternates large-star and small-star steps until nothing moves; each step aggregates with partial minima, so a
    vertex with very many neighbours is never gathered in one place, and each step's table is written to shared storage.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now, seen = written(now, "edges", large=False), None
    while True:
        # large star: neighbours above a vertex move to the smallest of its neighbourhood
        both = now.union(now.select("v", "u"))
        low = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        large = both.join(low, both.u == low.w).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: a vertex and its smaller neighbours move to the smallest of those
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.w).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("w", "m")).filter("u <> v").distinct()
        now = written(small, "edges", large=False)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).union(
        now.select("v", "v").distinct()
    ).groupBy("id").agg(F.min("component").alias("component"))
