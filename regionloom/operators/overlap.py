"""Overlap and nearest joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.coords import slop
from regionloom.plans.bins import (
    BIN_WIDTH, KEY, nearest_first, nearest_k, overlap_counts, overlap_left, overlap_pairs, overlap_semi,
)


def repeat_per_hit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row of ``a`` once per overlapping ``b`` row; hits are counted, then rows repeated, without pairs."""
    step = 4096  # a row is repeated in parts, so that a pile-up needs no long array
    counted = a.join(overlap_counts(a, b, out="n_"), KEY)
    parts = counted.withColumn("p_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / step))))
    here = F.least(F.lit(step).cast("long"), F.col("n_") - F.col("p_") * step)
    return parts.select(*a.columns, F.explode(F.sequence(F.lit(1).cast("long"), here)).alias("p_")).select(*a.columns)


def left_with_slop(a: DataFrame, b: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Left overlap join after growing ``b`` by ``n``."""
    return overlap_left(a, slop(b, sizes, n)).drop("overlap")


def count_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Number of overlapping ``b`` rows, 0 kept, and a 0/1 flag."""
    out = a.join(overlap_counts(a, b), KEY, "left").fillna(0, ["n"])
    return out.withColumn("hit", (F.col("n") > 0).cast("int"))


def k_nearest(regions: DataFrame, targets: DataFrame, k: int = 3, max_dist: int = 25000) -> DataFrame:
    """Every region with its k nearest targets closer than ``max_dist``."""
    return regions.join(nearest_k(regions, targets, k, max_dist), KEY)


def nearest_signed(a: DataFrame, b: DataFrame, payload: list[str]) -> DataFrame:
    """Nearest ``b``; the distance is negative when ``b`` lies upstream on the strand of ``a``."""
    near = nearest_first(a, b, payload)
    lower = F.col("b_stop") <= F.col("start")
    upstream = F.when(F.col("strand") == "-", ~lower & (F.col("distance") > 0)).otherwise(lower)
    return near.withColumn("distance", F.when(upstream, -F.col("distance")).otherwise(F.col("distance")))


def nearest_within(a: DataFrame, b: DataFrame, payload: list[str], limit: int) -> DataFrame:
    """Nearest ``b`` no farther than ``limit``, else nulls."""
    near = nearest_first(a, b, payload)
    ok = F.col("distance") <= limit
    cols = ["b_start", "b_stop", *[f"b_{c}" for c in payload], "distance"]
    return near.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def neighbourhood(a: DataFrame, b: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Rows of ``b`` within ``n`` bases of ``a``; bins are as wide as the search, so a window is copied twice or so."""
    return overlap_semi(b, slop(a, sizes, n), max(BIN_WIDTH, 2 * n))


def marked_downstream(tss: DataFrame, marks: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """TSS points with a mark on the point or up to ``n`` bases downstream, still as points."""
    point = F.struct("start", "stop")
    grown = slop(tss.withColumn("point_", point), sizes, 0, n, stranded=True)
    kept = overlap_semi(grown, marks)
    return kept.withColumns({"start": F.col("point_.start"), "stop": F.col("point_.stop")}).select(*tss.columns)


def reciprocal_pairs(a: DataFrame, b: DataFrame, share: float = 0.33) -> DataFrame:
    """Pairs that share more than ``share`` of both intervals."""
    pairs = overlap_pairs(a, b)
    return pairs.filter(
        (F.col("overlap") > share * (F.col("stop") - F.col("start")))
        & (F.col("overlap") > share * (F.col("b_stop") - F.col("b_start")))
    )
