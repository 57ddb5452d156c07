"""Reads per region, replicate handling and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.coords import cut_site, region_id
from regionloom.plans.bins import KEY, merge_intervals, overlap_counts, overlap_semi

GENOME_BP = 3095693983  # fixed value: size of the human genome used for covered shares


def count_reads(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads per region, zero kept."""
    n = overlap_counts(regions, reads)
    return regions.join(n, KEY, "left").fillna(0, ["n"])


def count_long(regions: DataFrame, reads: DataFrame, by: list[str], adjust=cut_site) -> DataFrame:
    """Adjusted reads per region and sample in long form; regions without reads keep a null sample."""
    n = overlap_counts(regions, adjust(reads), by=by)
    return regions.select(*KEY).distinct().join(n, KEY, "left").withColumn("id", region_id())


def sample_matrix(long: DataFrame, samples: list[str], sample: str = "sample", value: str = "n",
                  key: str = "id") -> DataFrame:
    """A05 tail / R02: one column per sample, zero where nothing was counted."""
    wide = long.groupBy(key).pivot(sample, samples).agg(F.sum(value))
    return wide.fillna(0)


def count_matrix(regions: DataFrame, reads: DataFrame, samples: list[str], adjust=cut_site) -> DataFrame:
    """Region by sample matrix in one job; ``reads`` carry ``timepoint`` and ``rep``."""
    tagged = reads.withColumn("sample", F.concat_ws("_", "timepoint", "rep"))
    return sample_matrix(count_long(regions, tagged, ["sample"], adjust), samples)


def pool_replicates(long: DataFrame, value: str = "n") -> DataFrame:
    """Sum of the replicates of a timepoint, as a whole number; both must be present."""
    return (
        long.groupBy("id", "timepoint")
        .agg(F.sum(value).cast("long").alias("pooled"), F.count_distinct("rep").alias("reps_"))
        .filter(F.col("reps_") == 2).drop("reps_")
    )


def split_by_replicate(long: DataFrame, value: str = "n") -> DataFrame:
    """Columns rep1, rep2 and pooled for each id and timepoint, missing counts 0."""
    one = lambda r: F.coalesce(F.sum(F.when(F.col("rep") == r, F.col(value))), F.lit(0))
    return long.groupBy("id", "timepoint").agg(
        one("b1").alias("rep1"), one("b2").alias("rep2")
    ).withColumn("pooled", F.col("rep1") + F.col("rep2"))


def drop_silent(long: DataFrame, threshold: float, value: str, key: str = "id") -> DataFrame:
    """Ids whose every value is below the threshold are dropped."""
    keep = long.groupBy(key).agg(F.max(value).alias("m_")).filter(F.col("m_") >= threshold)
    return long.join(keep, key, "left_semi")


def present_regions(master: DataFrame, peaks: DataFrame, sample: str = "timepoint") -> DataFrame:
    """How many master regions each sample's peaks touch."""
    n = overlap_counts(master, peaks, by=[sample])
    return n.groupBy(sample).agg(F.count("*").alias("n_regions"))


def coverage_summary(peaks: DataFrame, sample: str = "timepoint", genome_bp: int = GENOME_BP) -> DataFrame:
    """Merged regions, covered bases and share of the genome for each sample."""
    keyed = peaks.select(F.concat_ws("\t", sample, "chrom").alias("chrom"), "start", "stop")
    merged = merge_intervals(keyed).withColumn(sample, F.split_part("chrom", F.lit("\t"), F.lit(1)))
    return merged.groupBy(sample).agg(
        F.count("*").alias("n_regions"), F.sum(F.col("stop") - F.col("start")).alias("covered_bp"),
    ).withColumn("genome_share", F.col("covered_bp") / F.lit(genome_bp))


def master_regions(peaks: DataFrame) -> DataFrame:
    """O03 with A01: the union of all peak files, merged."""
    return merge_intervals(peaks).select(*KEY)


def keep_touching(a: DataFrame, b: DataFrame) -> DataFrame:
    """J01."""
    return overlap_semi(a, b)
