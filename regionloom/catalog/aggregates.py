"""Interval merging, counting and coverage: A01-A11."""

from __future__ import annotations

from regionloom.catalog import query
from regionloom.catalog.sqlparts import ID, REGION_COUNTS, SAMPLES, merged
from regionloom.catalog.views import r6
from regionloom.functions.coords import slop
from regionloom.operators import counting, reporter
from regionloom.plans.bins import KEY, merge_intervals


@query("a01_merge", f"SELECT * FROM {merged('v_peaks')}")
def a01(t):
    return merge_intervals(t.peaks)


@query("a02_merge_min_overlap",
       f"WITH d AS (SELECT DISTINCT chrom, start, stop FROM v_peaks) SELECT chrom, start, stop FROM {merged('d', 200)}")
def a02(t):
    return merge_intervals(t.peaks, min_overlap=200).select(*KEY)


@query("a03_build_domains", f"""
WITH g AS (SELECT p.chrom, greatest(0, start - 1500) AS start, least(size, stop + 1500) AS stop
           FROM v_peaks p JOIN v_chromsizes s ON p.chrom = s.chrom),
m AS (SELECT * FROM {merged('g')})
SELECT m.chrom, greatest(0, start + 1500) AS start, least(size, stop - 1500) AS stop
FROM m JOIN v_chromsizes s ON m.chrom = s.chrom WHERE greatest(0, start + 1500) < least(size, stop - 1500)""")
def a03(t):
    grown = slop(t.peaks.select(*KEY), t.chromsizes, 1500)
    return slop(merge_intervals(grown).select(*KEY), t.chromsizes, -1500)


@query("a04_count_reads", f"""
WITH m AS (SELECT * FROM {merged('v_peaks')})
SELECT m.chrom, m.start, m.stop, count(r.start) AS n FROM m LEFT JOIN v_reads r
ON m.chrom = r.chrom AND r.start < m.stop AND m.start < r.stop GROUP BY ALL""")
def a04(t):
    return counting.count_reads(counting.master_regions(t.peaks), t.reads)


@query("a05_count_matrix", f"""
WITH {REGION_COUNTS},
x AS (SELECT m.*, concat(timepoint, '_', rep) AS sample, n FROM m LEFT JOIN c USING (chrom, start, stop))
SELECT {ID} AS id, {', '.join(f"CAST(coalesce(sum(n) FILTER (sample = '{s}'), 0) AS BIGINT) AS {s}" for s in SAMPLES)}
FROM x GROUP BY chrom, start, stop""")
def a05(t):
    return counting.count_matrix(counting.master_regions(t.peaks), t.reads, SAMPLES)


def region_counts(t):
    return counting.count_long(counting.master_regions(t.peaks), t.reads, ["timepoint", "rep"])


@query("a06_pool_replicates", f"""
WITH {REGION_COUNTS}
SELECT {ID} AS id, timepoint, CAST(sum(n) AS BIGINT) AS pooled FROM c
GROUP BY chrom, start, stop, timepoint HAVING count(DISTINCT rep) = 2
QUALIFY max(sum(n)) OVER (PARTITION BY chrom, start, stop) >= 2""")
def a06(t):
    return counting.drop_silent(counting.pool_replicates(region_counts(t)), 2, "pooled")


@query("a07_split_by_replicate", f"""
WITH {REGION_COUNTS}
SELECT {ID} AS id, timepoint, CAST(coalesce(sum(n) FILTER (rep = 'b1'), 0) AS BIGINT) AS rep1,
 CAST(coalesce(sum(n) FILTER (rep = 'b2'), 0) AS BIGINT) AS rep2, CAST(sum(n) AS BIGINT) AS pooled
FROM c GROUP BY chrom, start, stop, timepoint""")
def a07(t):
    return counting.split_by_replicate(region_counts(t).filter("timepoint is not null"))


@query("a08_present_regions", f"""
WITH m AS (SELECT * FROM {merged('v_peaks')})
SELECT timepoint, count(*) AS n_regions FROM (SELECT DISTINCT m.chrom, m.start, m.stop, timepoint
FROM m JOIN v_peaks p ON m.chrom = p.chrom AND p.start < m.stop AND m.start < p.stop) GROUP BY timepoint""")
def a08(t):
    return counting.present_regions(counting.master_regions(t.peaks), t.peaks)


@query("a09_coverage_summary", f"""
WITH k AS (SELECT concat(timepoint, ' ', chrom) AS chrom, start, stop FROM v_peaks), m AS (SELECT * FROM {merged('k')})
SELECT split_part(chrom, ' ', 1) AS timepoint, count(*) AS n_regions, CAST(sum(stop - start) AS BIGINT) AS covered_bp,
 round(sum(stop - start) / 3095693983.0, 6) + 0.0 AS genome_share FROM m GROUP BY 1""")
def a09(t):
    return counting.coverage_summary(t.peaks).withColumn("genome_share", r6("genome_share"))


@query("a10_umi_counts", "SELECT barcode, count(DISTINCT umi) AS n_umi FROM v_umi GROUP BY barcode")
def a10(t):
    return reporter.umi_counts(t.umi)
