"""Set operations on intervals and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.coords import slop
from regionloom.plans.bins import KEY, gaps, merge_intervals, overlap_anti, subtract


def subtract_merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """What ``b`` leaves of ``a``, merged."""
    return merge_intervals(subtract(a.select(*KEY), b))


def complement(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """O02."""
    return gaps(regions, sizes)


def union_regions(parts: list[DataFrame]) -> DataFrame:
    """Union of many interval tables, merged."""
    return merge_intervals(reduce(DataFrame.unionByName, [p.select(*KEY) for p in parts]))


def away_from(a: DataFrame, b: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Rows of ``a`` that touch no ``b`` grown by ``n``."""
    return overlap_anti(a, slop(b, sizes, n))


def ids_minus(a: DataFrame, *others: DataFrame, key: str = "id") -> DataFrame:
    """Running difference of id sets."""
    return reduce(lambda left, right: left.join(right.select(key).distinct(), key, "left_anti"), others, a)


def set_overlap(a: DataFrame, b: DataFrame, key: str = "gene_id") -> DataFrame:
    """Sizes of two id sets, of their intersection, and the shared part of ``a``."""
    tagged = (
        a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    )
    return tagged.agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"),
    ).withColumn("share_of_a", F.try_divide("n_both", "n_a"))


def outer_union(a: DataFrame, b: DataFrame, key: str = "gene_id") -> DataFrame:
    """Full outer join of two id tables."""
    return a.join(b, key, "full")


def significant_union(contrasts: DataFrame, fdr: float) -> DataFrame:
    """Ids significant in any contrast."""
    return contrasts.filter(F.col("padj") < fdr).select("id").distinct()


def mirrored(links: DataFrame) -> DataFrame:
    """Every link in both directions, once; the gene id and score stay columns."""
    swap = {"src_start": "dst_start", "dst_start": "src_start", "src_stop": "dst_stop", "dst_stop": "src_stop",
            "src_id": "dst_id", "dst_id": "src_id", "src_chrom": "dst_chrom", "dst_chrom": "src_chrom"}
    turned = links.select(*[F.col(swap.get(c, c)).alias(c) for c in links.columns])
    return links.unionByName(turned).distinct()


def membership(a: DataFrame, b: DataFrame, key: str, flag: str) -> DataFrame:
    """Per key, whether any row is flagged in each of two tables."""
    one = lambda df, out: df.groupBy(key).agg(F.bool_or(flag).alias(out))
    both = one(a, "in_a").join(one(b, "in_b"), key, "full")
    return both.fillna(False, ["in_a", "in_b"])


def gene_states(tss: DataFrame, expressed: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Label each TSS dynamic, stable (expressed, not dynamic) or off."""
    e = expressed.select("gene_id").distinct().withColumn("e_", F.lit(True))
    d = dynamic.select("gene_id").distinct().withColumn("d_", F.lit(True))
    state = F.when(F.col("d_"), "dynamic").when(F.col("e_"), "stable").otherwise("off")
    return tss.join(e, "gene_id", "left").join(d, "gene_id", "left").withColumn("state", state).drop("e_", "d_")


def background(group_regions: DataFrame, stable: DataFrame) -> DataFrame:
    """All group regions plus stable regions, not merged."""
    return group_regions.select(*KEY).unionByName(stable.select(*KEY))
