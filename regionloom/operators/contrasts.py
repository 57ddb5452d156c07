"""Contrast tables (A40, A41, A69, S17-S19 shapes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regionloom.plans.small import small_grid


def timepoint_pairs(points: DataFrame, col: str) -> DataFrame:
    """All ordered timepoint pairs; ``sequential`` marks neighbours. The timepoints are checked to be few."""
    numbered = points.withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(col)))
    a, b = numbered.select(F.col(col).alias("first"), F.col("i").alias("i1")), numbered.select(F.col(col).alias("second"), F.col("i").alias("i2"))
    return small_grid(a, b).filter(F.col("i1") < F.col("i2")).select("first", "second", (F.col("i2") == F.col("i1") + 1).alias("sequential"))


def significant_ids(contrasts: DataFrame, fdr: float) -> DataFrame:
    """Significant ids with their direction."""
    return contrasts.filter((F.col("padj") < fdr) & (F.col("log2_fold_change") != 0)).withColumn(
        "direction", F.when(F.col("log2_fold_change") > 0, "up").otherwise("down"))


def significant_counts(contrasts: DataFrame, fdr: float) -> DataFrame:
    """Up and down counts per contrast."""
    sig = F.col("padj") < fdr
    return contrasts.groupBy("contrast").agg(
        F.count_if(sig & (F.col("log2_fold_change") > 0)).alias("up"), F.count_if(sig & (F.col("log2_fold_change") < 0)).alias("down"))


def best_of_two(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Best value per key in two sources side by side, 0 where a source has none."""
    best = lambda df, out: df.groupBy(key).agg(F.max(value).alias(out))
    return best(a, f"{value}_a").join(best(b, f"{value}_b"), key, "full").fillna(0.0, [f"{value}_a", f"{value}_b"])


def gene_sets_by_direction(results: DataFrame, p_max: float, lfc_min: float) -> DataFrame:
    """Up and down gene sets of each contrast as (set_name, gene_id) rows."""
    lfc = F.col("log2_fold_change")
    kept = results.filter((F.col("padj") < p_max) & (F.abs(lfc) > lfc_min))
    return kept.select(F.concat_ws("_", "contrast", F.when(lfc > 0, "up").otherwise("down")).alias("set_name"), "gene_id").distinct()


def ranked_list(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """Symbol and log2 fold change of every mapped gene."""
    return results.join(mapping.withColumnRenamed("ensembl_gene_id", "id"), "id").select("hgnc_symbol", "contrast", "log2_fold_change")
