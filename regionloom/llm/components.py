"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.session import checkpointed


def _min_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that each node of an edge can reach.

    Edges may repeat, point either way or be loops; nulls are dropped. Each round joins the edges
    with one row per node, so no neighbourhood is ever gathered; minima are combined before the
    shuffle, and adaptive execution splits the rows of a hub. Rounds run until nothing changes,
    about the logarithm of the longest path. Every round is checkpointed.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    cur = checkpointed(cur)
    while True:
        # large star: larger neighbours of u hang below the smallest neighbour of u
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_of(both)
        large = (both.join(low, "u").select("u", "v", F.least("u", "m").alias("m"))
                 .filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours hang below the smallest of them
        low = _min_of(large)
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        new = checkpointed(small.filter("u <> v").distinct())
        # stable when every node hangs below one root and no root hangs below another
        hangs = new.groupBy(F.col("u").alias("w")).agg(F.count("*").alias("n"))
        loose = hangs.filter("n > 1").limit(1).count() or new.join(hangs, F.col("v") == F.col("w"), "left_semi").limit(1).count()
        cur = new
        if not loose:
            break
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
