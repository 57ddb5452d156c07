"""Variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.coords import slop
from regionloom.functions.text import metadata_field
from regionloom.plans.bins import overlap_pairs


def in_lookup(variants: DataFrame, lookup: DataFrame, key: str = "id") -> DataFrame:
    """Variants with a row in a lookup table; Spark broadcasts the lookup when its size allows it."""
    return variants.join(lookup, key)


def merge_same_id(variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per variant id, INFO texts joined with ``|`` in file order, and the conflict counts.

    ``variants`` carries chrom, pos, id, ref, alt, info; equal rows count once. A row whose id is
    ``.`` goes by the ``gtex_id`` of its INFO, so unnamed variants never meet in one group. The
    first row by (chrom, pos, ref, alt, info) gives the coordinates.
    """
    cols = ["chrom", "pos", "ref", "alt", "info"]
    named = F.when(F.col("id") == ".", metadata_field(F.col("info"), "gtex_id")).otherwise(F.col("id"))
    rows = variants.select(named.alias("id"), *cols).distinct()
    infos = F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda s: s["info"])
    merged = rows.groupBy("id").agg(
        F.min(F.struct(*cols)).alias("f_"), F.concat_ws("|", infos).alias("info"), F.count("*").alias("n_rows"),
        *[F.count_distinct(c).alias(f"n_{c}") for c in ("chrom", "pos", "ref", "alt")])
    out = merged.select("id", *[F.col(f"f_.{c}").alias(c) for c in ("chrom", "pos", "ref", "alt")], "info", "n_rows")
    conflicts = merged.agg(
        F.sum(F.col("n_rows") - 1).alias("overlaps"),
        *[F.count_if(F.col(f"n_{c}") > 1).alias(f"{c}_conflicts") for c in ("chrom", "pos", "ref", "alt")])
    return out, conflicts


def in_windows(windows: DataFrame, variants: DataFrame, sizes: DataFrame, margin: int = 20) -> DataFrame:
    """Variants inside example windows shrunk by ``margin`` on both sides, with their offset in the full window."""
    full = windows.withColumn("window_start", F.col("start"))
    points = variants.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), "id")
    pairs = overlap_pairs(slop(full, sizes, -margin), points)
    return pairs.withColumn("offset", F.col("b_start") - F.col("window_start"))


def replicate_effects(a: DataFrame, b: DataFrame, snps: DataFrame) -> DataFrame:
    """Effects of two replicates side by side, gaps 0, with the SNP table."""
    both = a.withColumnRenamed("beta", "beta1").join(b.withColumnRenamed("beta", "beta2"), "id", "full").fillna(0.0, ["beta1", "beta2"])
    return both.join(snps, "id", "left")


def strongest_effect(effects: DataFrame, q_max: float = 0.1) -> DataFrame:
    """Per variant, significance in any sample (0 < q < limit) and the effect farthest from zero."""
    sig = (F.col("q") > 0) & (F.col("q") < q_max)
    far = F.max(F.struct(F.abs("beta").alias("a"), F.col("beta").alias("b"))).getField("b")
    return effects.groupBy("id").agg(F.bool_or(sig).alias("significant"), far.alias("beta"))


def mean_effects(effects: DataFrame, significance: DataFrame) -> DataFrame:
    """Mean effect per variant, joined to its significance."""
    return effects.groupBy("id").agg(F.avg("beta").alias("mean_beta")).join(significance, "id")


def to_points(vcf: DataFrame) -> DataFrame:
    """Variants as one-base intervals, ``chr`` in front of the chromosome."""
    return vcf.select(F.concat(F.lit("chr"), "chrom").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"), "id")


