"""Interval and id sets: O01-O12."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.sqlparts import merged
from regionloom.catalog.views import r6
from regionloom.operators import sets
from regionloom.plans.bins import KEY

GAPS = """(SELECT chrom, start, stop FROM (
   SELECT b.chrom, coalesce(lag(stop) OVER (PARTITION BY b.chrom ORDER BY start), 0) AS start, start AS stop
   FROM {b} b WHERE b.chrom IN (SELECT chrom FROM {sizes})
   UNION ALL SELECT s.chrom, coalesce(max(stop), 0), max(size) FROM {sizes} s LEFT JOIN {b} b ON s.chrom = b.chrom
   GROUP BY s.chrom) WHERE stop > start)"""


@query("o01_subtract", f"""
WITH bm AS (SELECT * FROM {merged('v_reads')}), ends AS (SELECT chrom, max(stop) AS size FROM v_peaks GROUP BY chrom),
free AS {GAPS.format(b='bm', sizes='ends')},
cut AS (SELECT a.chrom, greatest(a.start, f.start) AS start, least(a.stop, f.stop) AS stop
        FROM v_peaks a JOIN free f ON a.chrom = f.chrom AND a.start < f.stop AND f.start < a.stop)
SELECT * FROM {merged('cut')}""")
def o01(t):
    return sets.subtract_merged(t.peaks, t.reads)


@query("o02_complement", f"""
WITH bm AS (SELECT * FROM {merged('v_peaks')}) SELECT * FROM {GAPS.format(b='bm', sizes='v_chromsizes')}""")
def o02(t):
    return sets.complement(t.peaks, t.chromsizes)


@query("o03_union_regions", f"""
WITH u AS (SELECT chrom, start, stop FROM v_peaks UNION ALL SELECT chrom, start, stop FROM v_reads
  UNION ALL SELECT chrom, start, stop FROM v_tss) SELECT * FROM {merged('u')}""")
def o03(t):
    return sets.union_regions([t.peaks, t.reads, t.tss])


@query("o04_regions_away", """
SELECT chrom, start, stop, name FROM v_peaks p WHERE NOT EXISTS (
 SELECT 1 FROM v_tss t WHERE t.chrom = p.chrom AND greatest(0, t.start - 2000) < p.stop
 AND p.start < least(4000000, t.stop + 2000))""")
def o04(t):
    return sets.away_from(t.peaks, t.tss, t.chromsizes, 2000).select(*KEY, "name")


@query("o05_ids_minus", """
SELECT id, cluster FROM v_clusters WHERE id NOT IN (SELECT id FROM v_signal WHERE value > 400 AND rep = 'b1')
 AND id NOT IN (SELECT id FROM v_signal WHERE value > 400 AND rep = 'b2')""")
def o05(t):
    high = t.signal.filter("value > 400")
    return sets.ids_minus(t.clusters, high.filter("rep = 'b1'"), high.filter("rep = 'b2'"))


@query("o06_set_overlap", """
WITH a AS (SELECT DISTINCT id AS gene_id FROM v_contrasts WHERE padj < 0.01), b AS (SELECT DISTINCT gene_id FROM v_tss)
SELECT CAST((SELECT count(*) FROM a) AS BIGINT) AS n_a, (SELECT count(*) FROM b) AS n_b,
 (SELECT count(*) FROM a JOIN b USING (gene_id)) AS n_both,
 round((SELECT count(*) FROM a JOIN b USING (gene_id)) / (SELECT count(*) FROM a), 6) AS share_of_a""")
def o06(t):
    a = t.contrasts.filter("padj < 0.01").select(F.col("id").alias("gene_id"))
    return sets.set_overlap(a, t.tss).withColumn("share_of_a", r6("share_of_a"))


@query("o07_outer_union", """
SELECT gene_id, strand, set_name FROM v_tss FULL JOIN v_gene_sets USING (gene_id)""")
def o07(t):
    return sets.outer_union(t.tss.select("gene_id", "strand"), t.gene_sets)


@query("o08_significant_union", "SELECT DISTINCT id FROM v_contrasts WHERE padj < 0.05")
def o08(t):
    return sets.significant_union(t.contrasts, 0.05)


@query("o09_mirror_links", """
WITH l AS (SELECT chrom, src_start, src_stop, dst_start, dst_stop, round(score, 7) AS score, timepoint FROM v_links)
SELECT * FROM l UNION SELECT chrom, dst_start, dst_stop, src_start, src_stop, score, timepoint FROM l""")
def o09(t):
    return sets.mirrored(t.links.withColumn("score", F.round("score", 7)))


@query("o10_membership", """
SELECT id, coalesce(a, false) AS in_a, coalesce(b, false) AS in_b FROM
 (SELECT id, bool_or(padj < 0.02) AS a FROM v_contrasts WHERE contrast = 'd3_over_d0' GROUP BY id) FULL JOIN
 (SELECT id, bool_or(padj < 0.02) AS b FROM v_contrasts WHERE contrast = 'd6_over_d0' GROUP BY id) USING (id)""")
def o10(t):
    flagged = t.contrasts.withColumn("sig", F.col("padj") < 0.02)
    return sets.membership(flagged.filter("contrast = 'd3_over_d0'"), flagged.filter("contrast = 'd6_over_d0'"), "id", "sig")


@query("o11_gene_states", """
SELECT gene_id, chrom, start, CASE WHEN gene_id IN (SELECT id FROM v_contrasts WHERE padj < 0.005) THEN 'dynamic'
 WHEN gene_id IN (SELECT id FROM v_contrasts WHERE base_mean > 48000) THEN 'stable' ELSE 'off' END AS state FROM v_tss""")
def o11(t):
    genes = t.contrasts.withColumnRenamed("id", "gene_id")
    out = sets.gene_states(t.tss, genes.filter("base_mean > 48000"), genes.filter("padj < 0.005"))
    return out.select("gene_id", "chrom", "start", "state")


@query("o12_background", """
SELECT chrom, start, stop FROM v_peaks WHERE timepoint <> 'd60' UNION ALL SELECT chrom, start, stop FROM v_tss""")
def o12(t):
    return sets.background(t.peaks.filter("timepoint <> 'd60'"), t.tss)
