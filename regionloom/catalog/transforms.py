"""Projections, filters and row transforms: P01-P49."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.sqlparts import ID
from regionloom.catalog.views import r6
from regionloom.functions import coords, text, vectors as v
from regionloom.operators import transforms as x
from regionloom.plans.bins import KEY

VEC = """e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def vec(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


def long(df, key="vec_id", col="a", out="value"):
    return df.select(key, F.posexplode(col).alias("pos", out)).select(key, (F.col("pos") + 1).cast("long").alias("pos"), r6(out))


RAW_IDS = f"""CASE CAST(q_value AS INT) WHEN 0 THEN 'region' WHEN 1 THEN '' WHEN 2 THEN concat({ID}, '(+)') ELSE {ID} END"""


@query("p01_ids_to_intervals", f"""
SELECT chrom, start, stop FROM v_peaks WHERE q_value NOT IN (0, 1)""")
def p01(t):
    ids = t.peaks.select(F.expr(RAW_IDS.replace("VARCHAR", "STRING")).alias("id"))
    return x.ids_to_intervals(ids).select(*KEY)


@query("p02_intervals_to_ids", f"SELECT name, {ID} AS id FROM v_peaks")
def p02(t):
    return t.peaks.select("name", coords.region_id().alias("id"))


@query("p03_cut_sites", """
SELECT chrom, CASE WHEN strand = '-' THEN stop - 1 ELSE start END AS start,
 CASE WHEN strand = '+' THEN start + 1 ELSE stop END AS stop, strand FROM v_reads""")
def p03(t):
    return coords.cut_site(t.reads).select(*KEY, "strand")


@query("p04_fragment_midpoints", """
WITH m AS (SELECT *, CASE strand1 WHEN '+' THEN start1 + CAST(trunc((stop2 - start1) / 2) AS BIGINT)
 WHEN '-' THEN start2 + CAST(trunc((stop1 - start2) / 2) AS BIGINT) END AS mid FROM v_pairs)
SELECT chrom1 AS chrom, coalesce(mid, start1) AS start, coalesce(mid + 1, stop1) AS stop, strand1 AS strand FROM m""")
def p04(t):
    return coords.fragment_midpoint(t.pairs)


@query("p05_slop", """
SELECT chrom, greatest(0, start - CASE WHEN strand = '-' THEN 1000 ELSE 0 END) AS start,
 least(4000000, stop + CASE WHEN strand = '-' THEN 0 ELSE 1000 END) AS stop, 'stranded' AS form FROM v_reads
UNION ALL SELECT chrom, greatest(0, start - 2000), least(4000000, stop + 2000), 'both' FROM v_reads
UNION ALL SELECT chrom, start + 100, stop - 100, 'shrunk' FROM v_peaks WHERE start + 100 < stop - 100""")
def p05(t):
    reads = t.reads.select(*KEY, "strand")
    tag = lambda df, form: df.select(*KEY, F.lit(form).alias("form"))
    return x.stack([
        tag(coords.slop(reads, t.chromsizes, 0, 1000, stranded=True), "stranded"),
        tag(coords.slop(reads, t.chromsizes, 2000), "both"),
        tag(coords.slop(t.peaks.select(*KEY), t.chromsizes, -100), "shrunk"),
    ])


@query("p06_tss_points", """
SELECT chrom, CASE WHEN strand = '+' THEN start - 2 ELSE stop END AS start,
 CASE WHEN strand = '+' THEN start - 1 ELSE stop + 1 END AS stop, strand, split_part(gene_id, '.', 1) AS gene_id FROM v_genes""")
def p06(t):
    return coords.tss_point(t.genes)


@query("p07_midpoint_extend", """
SELECT name, chrom, greatest(0, start + (stop - start) // 2 - 500) AS start,
 least(4000000, start + (stop - start) // 2 + 500) AS stop FROM v_peaks""")
def p07(t):
    return coords.midpoint_extend(t.peaks.select("name", *KEY), t.chromsizes, 500)


@query("p08_strip_version", "SELECT gene_id, regexp_replace(gene_id, '\\..*$', '') AS stripped FROM v_genes")
def p08(t):
    return t.genes.select("gene_id", coords.strip_version(F.col("gene_id")).alias("stripped"))


LINK_TEXT = """SELECT CASE WHEN src_start % 11 = 0 THEN 'scaffold1' ELSE chrom END AS chrom, chrom AS dst_chrom,
 CASE WHEN src_start % 13 = 0 THEN 'x' WHEN src_start % 2 = 0 THEN CAST(src_stop AS STRING) ELSE CAST(src_start AS STRING) END AS src_start,
 CASE WHEN src_start % 2 = 0 THEN CAST(src_start AS STRING) ELSE CAST(src_stop AS STRING) END AS src_stop,
 CAST(dst_stop AS STRING) AS dst_start, CAST(dst_start AS STRING) AS dst_stop FROM {links}"""


@query("p09_repair_links", """
SELECT chrom, src_start, src_stop, dst_start, dst_stop FROM v_links WHERE src_start % 11 <> 0 AND src_start % 13 <> 0""")
def p09(t):
    raw = t.spark.sql(LINK_TEXT, links=t.links)
    return coords.repair_link(raw).drop("dst_chrom")


@query("p10_distance_decay", """
SELECT src_start, dst_start, round(exp(-abs(dst_start - src_start) * ln(2) / 25000), 6) AS weight FROM v_links""")
def p10(t):
    d = F.abs(F.col("dst_start") - F.col("src_start"))
    return t.links.select("src_start", "dst_start", r6(coords.distance_decay(d), "weight"))


@query("p11_baseline_subtract", f"""
WITH {VEC} SELECT vec_id, pos, round(x - first_value(x) OVER (PARTITION BY vec_id ORDER BY pos), 6) + 0.0 AS value FROM e""")
def p11(t):
    return long(vec(t).withColumn("a", v.vbaseline(F.col("a"))))


@query("p12_row_zscore", f"""
WITH {VEC} SELECT vec_id, pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) + 0.0 AS value FROM e
WINDOW w AS (PARTITION BY vec_id)""")
def p12(t):
    return long(vec(t).withColumn("a", v.vzscore(F.col("a"))))


@query("p13_row_zscore_sample_sd", f"""
WITH {VEC} SELECT vec_id, pos, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0 AS value FROM e
WINDOW w AS (PARTITION BY vec_id)""")
def p13(t):
    return long(vec(t).withColumn("a", v.vzscore(F.col("a"), ddof=1)))


@query("p14_mean_centre", f"""
WITH {VEC}, n AS (SELECT vec_id, pos, CASE WHEN x > -0.2 THEN x END AS x FROM e)
SELECT vec_id, pos, round(x - avg(x) OVER (PARTITION BY vec_id), 6) + 0.0 AS value FROM n""")
def p14(t):
    holes = F.transform("a", lambda e: F.when(e > -0.2, e))
    return long(vec(t).withColumn("a", v.vcenter(holes)))


@query("p15_drop_timepoints", "SELECT id, timepoint, n FROM (SELECT id, concat('t', t) AS timepoint, n FROM v_signal) WHERE timepoint NOT IN ('t1', 't3')")
def p15(t):
    long_ = t.signal.select("id", F.concat(F.lit("t"), F.col("t")).alias("timepoint"), "n")
    return x.drop_timepoints(long_, ["t1", "t3"])


@query("p16_drop_samples", """
SELECT id, t, value FROM v_signal WHERE rep <> 'b2' AND id IN (SELECT id FROM v_signal WHERE rep <> 'b2' GROUP BY id HAVING max(abs(value)) > 0)""")
def p16(t):
    return x.drop_samples(t.signal, F.col("rep"), ["b2"], "value").select("id", "t", "value")


@query("p17_one_replicate", "SELECT id, t, n, value FROM v_signal WHERE rep = 'b1'")
def p17(t):
    return x.one_replicate(t.signal, "b1").drop("rep")


@query("p18_keep_ids", """
SELECT id, t, rep, CAST(trunc(value) AS BIGINT) AS value, 'in' AS side FROM v_signal WHERE id IN (SELECT id FROM v_clusters WHERE cluster = 2)
UNION ALL SELECT id, t, rep, CAST(trunc(value) AS BIGINT), 'out' FROM v_signal WHERE id NOT IN (SELECT id FROM v_clusters WHERE cluster = 2)""")
def p18(t):
    ids = t.clusters.filter("cluster = 2")
    whole = t.signal.select("id", "t", "rep", F.col("value").cast("long").alias("value"))
    return x.keep_ids(whole, ids).withColumn("side", F.lit("in")).unionByName(
        x.keep_ids(whole, ids, opposite=True).withColumn("side", F.lit("out")))


@query("p19_drop_silent", """
SELECT id, t, rep, value FROM v_signal WHERE id IN (SELECT id FROM v_signal GROUP BY id HAVING max(value) >= 450)""")
def p19(t):
    from regionloom.operators.counting import drop_silent
    return drop_silent(t.signal, 450, "value").select("id", "t", "rep", "value")


@query("p20_drop_constant", """
WITH r AS (SELECT l_orderkey AS id, l_linenumber AS t, l_tax AS value FROM lineitem)
SELECT id, t, value FROM r WHERE id IN (SELECT id FROM r GROUP BY id HAVING max(value) > min(value))""")
def p20(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("t"), F.col("l_tax").alias("value"))
    return x.drop_constant(rows)


@query("p21_keep_moving", """
SELECT id, t, rep, round(log2(value), 6) AS value FROM v_signal WHERE value > 0 AND id IN
 (SELECT id FROM v_signal WHERE value > 0 GROUP BY id HAVING max(log2(value)) - min(log2(value)) > 4)""")
def p21(t):
    logged = t.signal.filter("value > 0").select("id", "t", "rep", F.log2("value").alias("value"))
    return x.keep_moving(logged, 4.0).withColumn("value", r6("value"))


@query("p22_row_ranges", "SELECT id, max(value) AS max, min(value) AS min, round(max(value) - min(value), 6) AS max_diff FROM v_signal GROUP BY id")
def p22(t):
    return x.row_ranges(t.signal).withColumn("max_diff", r6("max_diff"))


@query("p23_clean_signal", """
WITH m AS (SELECT example_id, combos, barcode, day, rep, CASE WHEN value >= 9.5 AND value <> 0 THEN value END AS value FROM v_reporter)
SELECT example_id, combos, barcode, day, rep, round(value, 6) AS value FROM m
WHERE (example_id, combos) IN (SELECT (example_id, combos) FROM m GROUP BY example_id, combos HAVING max(value) > 0)""")
def p23(t):
    return x.clean_signal(t.reporter, 9.5, ["example_id", "combos"]).withColumn("value", r6("value"))


@query("p24_log2_cpm", """
SELECT id, t, rep, round(greatest(log2(n / sum(n) OVER (PARTITION BY t, rep) * 1000000), 0), 6) AS log2_cpm FROM v_signal""")
def p24(t):
    return x.log2_cpm(t.signal, ["t", "rep"]).select("id", "t", "rep", r6("log2_cpm"))


# words chosen for the given tables; a user passes their own lists
DROP, KEEP, EXACT = ["small", "gadget"], ["ring", "widget", "red"], ["promo"]
_like = lambda words: " OR ".join(f"term_name LIKE '%{w}%'" for w in words)


@query("p25_filter_terms", f"""
SELECT term_id, term_name, round(-log10(p_value), 6) AS neg_log10_p FROM v_terms WHERE domain = 'BP'
 AND NOT ({_like(DROP)}) AND ({_like(KEEP)}) AND NOT ({_like(EXACT)})""")
def p25(t):
    return x.filter_terms(t.terms, DROP, KEEP, EXACT).select("term_id", "term_name", r6("neg_log10_p"))


@query("p26_is_enriched", f"""
SELECT motif_group, count(*) FILTER (domain = 'BP' AND NOT ({_like(['i', 'small'])}) AND term_name NOT IN ('large nut promo')) > 0 AS enriched
FROM v_terms GROUP BY motif_group""")
def p26(t):
    return x.is_enriched(t.terms, "motif_group", ["i", "small"], ["large nut promo"])


@query("p27_motif_names", "SELECT p_partkey, p_brand AS motif FROM part")
def p27(t):
    raw = F.concat(F.lit("HCLUST-"), F.col("p_size"), F.lit("_"), F.col("p_brand"), F.lit(".UNK.0.A"))
    return t.part.select("p_partkey", text.motif_name(raw).alias("motif"))


@query("p28_rule_ids", "SELECT example_id, split_part(example_id, '.', 1) AS rule FROM v_reporter")
def p28(t):
    return t.reporter.select("example_id", text.rule_id(F.col("example_id")).alias("rule"))


@query("p29_joined_max", """
SELECT l_orderkey, l_linenumber, CAST(greatest(l_linenumber, CAST(l_quantity AS INT), l_partkey % 60) AS INT) AS max_value FROM lineitem
WHERE greatest(l_linenumber, CAST(l_quantity AS INT), l_partkey % 60) <> 0""")
def p29(t):
    joined = F.concat_ws(",", "l_linenumber", F.col("l_quantity").cast("int"), F.col("l_partkey") % 60)
    return x.synergy_rows(t.lineitem.select("l_orderkey", "l_linenumber", joined.alias("list")), "list").drop("list")


@query("p30_day_numbers", """
SELECT name, CAST(substr(timepoint, 2) AS DOUBLE) / 10 AS day, timepoint AS label FROM v_peaks""")
def p30(t):
    day = text.day_of(F.col("timepoint"))
    return t.peaks.select("name", day.alias("day"), text.label_of(day).alias("label"))


@query("p31_snps_only", """
SELECT line, chrom, pos, ref, CASE WHEN alt LIKE '%,%' THEN substr(alt, 1, 1) ELSE alt END AS alt FROM v_variants WHERE alt <> 'AT'""")
def p31(t):
    return x.snps_only(t.variants).select("line", "chrom", "pos", "ref", "alt")


@query("p32_clean_alignments", """
SELECT name, mapq, md FROM v_sam WHERE mapq >= 40 AND cigar = '36M' AND md IN ('MD:Z:36', 'MD:Z:20C15')""")
def p32(t):
    return x.clean_alignments(t.sam).select("name", "mapq", "md")


@query("p33_allele_counts", """
WITH c AS (SELECT * FROM v_pileup WHERE NOT regexp_matches(bases, '[+<>*-]') QUALIFY count(*) OVER (PARTITION BY chrom, pos) = 1)
SELECT chrom, pos, ref, alt, CAST(length(regexp_replace(bases, '[^.,]', '', 'g')) AS INT) AS n_ref,
 CAST(length(bases) - length(replace(bases, alt, '')) AS INT) AS n_alt,
 CAST(length(replace(regexp_replace(bases, '[.,]', '', 'g'), alt, '')) AS INT) AS n_err FROM c""")
def p33(t):
    return x.allele_counts(t.pileup)


@query("p34_percentile_clip", """
WITH q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, q""")
def p34(t):
    return x.percentile_clip(t.events.select("event_id", "value"), "value", 0.05, 0.95).withColumn("value", r6("value"))


@query("p35_fixed_clip", "SELECT event_id, greatest(-100.0, least(100.0, value - 80)) AS value FROM events")
def p35(t):
    return x.fixed_clip(t.events.select("event_id", (F.col("value") - 80).alias("value")), "value", 100.0)


@query("p36_row_minmax", f"""
WITH {VEC}, m AS (SELECT vec_id, max(x) AS hi, min(x) AS lo FROM e GROUP BY vec_id)
SELECT vec_id, pos, round((x - lo) / (hi - lo), 6) + 0.0 AS value, round(hi / (SELECT max(hi) FROM m) / 2 + 0.5, 6) AS unit_max
FROM e JOIN m USING (vec_id)""")
def p36(t):
    rows = x.unit_max(vec(t), F.array_max("a"))
    scaled = rows.select("vec_id", r6("unit_max"), F.posexplode(v.vminmax(F.col("a"))).alias("p", "s"))
    return scaled.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), r6("s", "value"), "unit_max")


@query("p37_strand_flip", f"""
WITH {VEC} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN pos ELSE (pos - 1) // 16 * 16 + 16 - (pos - 1) % 16 END AS pos,
 round(CASE WHEN x * 100 > 1 THEN log10(x * 100) ELSE 0 END, 6) AS value FROM e""")
def p37(t):
    strand = F.when(F.col("vec_id") % 2 == 0, "+").otherwise("-")
    scaled = F.transform("a", lambda e: e * 100)
    return long(vec(t).withColumn("a", v.vlog10_floor(v.vflip_blocks(scaled, strand, 16, 4))))


@query("p38_place_in_frame", f"""
WITH {VEC}, f AS (SELECT DISTINCT vec_id, unnest(range(1, 101)) AS pos FROM e)
SELECT f.vec_id, f.pos, round(coalesce(x, -1), 6) AS value FROM f LEFT JOIN e ON e.vec_id = f.vec_id AND e.pos = f.pos - f.vec_id % 50""")
def p38(t):
    return long(vec(t).withColumn("a", v.vframe(F.col("a"), F.col("vec_id") % 50, 100, -1.0)))


@query("p39_flank_normalise", f"""
WITH {VEC}, b AS (SELECT vec_id, avg(x + 1) FILTER (pos <= 10 OR pos > 54) AS flank FROM e GROUP BY vec_id)
SELECT vec_id, pos, round((x + 1) / flank, 6) AS value FROM e JOIN b USING (vec_id)""")
def p39(t):
    return long(vec(t).withColumn("a", v.vflank_normalise(F.transform("a", lambda e: e + 1))))


@query("p40_orient_pairs", f"""
WITH {VEC}, m AS (SELECT f.vec_id, f.pos, CASE WHEN f.x >= r.x THEN f.x ELSE 0 END AS f, CASE WHEN r.x >= f.x THEN r.x ELSE 0 END AS r
  FROM e f JOIN e r ON f.vec_id = r.vec_id AND r.pos = f.pos + 32 WHERE f.pos <= 32),
s AS (SELECT vec_id, sum(greatest(f, 0)) FILTER (pos <= 16) AS fu, sum(greatest(f, 0)) FILTER (pos > 16) AS fd,
  sum(greatest(r, 0)) FILTER (pos <= 16) AS ru, sum(greatest(r, 0)) FILTER (pos > 16) AS rd FROM m GROUP BY vec_id),
d AS (SELECT vec_id, CASE WHEN greatest(fu, fd) > greatest(ru, rd) THEN fu <= fd ELSE ru > rd END AS flipped FROM s)
SELECT vec_id, CASE WHEN flipped THEN 33 - pos ELSE pos END AS pos, round(CASE WHEN flipped THEN r ELSE f END, 6) + 0.0 AS fwd,
 round(CASE WHEN flipped THEN f ELSE r END, 6) + 0.0 AS rev, flipped FROM m JOIN d USING (vec_id)""")
def p40(t):
    f, r, flip = v.oriented_pair(F.slice("a", 1, 32), F.slice("a", 33, 32), 16)
    rows = vec(t).select("vec_id", f.alias("f"), r.alias("r"), flip.alias("flipped"))
    both = rows.select("vec_id", "flipped", F.posexplode(F.arrays_zip("f", "r")).alias("p", "z"))
    return both.select("vec_id", (F.col("p") + 1).cast("long").alias("pos"), r6("z.f", "fwd"), r6("z.r", "rev"), "flipped")


@query("p41_trim_reads", """
SELECT doc_id, concat('@', CAST(doc_id AS VARCHAR), ':', substr(text, 1, 16)) AS name, substr(text, 17) AS bases FROM documents""")
def p41(t):
    from regionloom.operators.reporter import trim_with_umi
    reads = t.documents.select("doc_id", F.concat(F.lit("@"), F.col("doc_id")).alias("name"), F.col("text").alias("bases"))
    return trim_with_umi(reads, 16)


SUMMARY = """SELECT p_partkey AS id, p_size % 4 - 1 AS atac_cluster, CASE p_partkey % 4 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'stable'
 WHEN 2 THEN 'nonexpr' ELSE 'other' END AS rna_pattern, p_partkey % 10 AS H3K27ac, p_size % 10 AS H3K4me1, (p_partkey + p_size) % 10 AS H3K27me3 FROM {part}"""


@query("p42_presence_codes", f"""
WITH d AS ({SUMMARY.format(part='part')})
SELECT id, CASE WHEN atac_cluster > 0 THEN 8 WHEN atac_cluster = 0 THEN 7 ELSE 0 END AS atac_dynamic,
 CASE rna_pattern WHEN 'dynamic' THEN 6 WHEN 'stable' THEN 5 WHEN 'nonexpr' THEN 4 ELSE 0 END AS rna_present,
 CASE WHEN H3K27ac <> 9 THEN 3 ELSE 0 END AS H3K27ac_present, CASE WHEN H3K4me1 <> 9 THEN 2 ELSE 0 END AS H3K4me1_present,
 CASE WHEN H3K27me3 <> 9 THEN 1 ELSE 0 END AS H3K27me3_present FROM d""")
def p42(t):
    d = x.presence_codes(t.spark.sql(SUMMARY, part=t.part))
    return d.select("id", "atac_dynamic", "rna_present", "H3K27ac_present", "H3K4me1_present", "H3K27me3_present")


@query("p43_log_additive", """
WITH l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings)
SELECT vec_id, round(a - d, 6) AS observed, round(b + c - 2 * d, 6) AS expected FROM l
WHERE a >= greatest(b, c, d) AND d <= least(a, b, c) AND a - d >= b + c - 2 * d""")
def p43(t):
    return x.log_additive(vec(t), F.slice("a", 1, 4)).select("vec_id", r6("observed"), r6("expected"))


@query("p44_farthest_from_zero", f"""
WITH {VEC}, f AS (SELECT vec_id, arg_max(x, abs(x)) AS far FROM e GROUP BY vec_id)
SELECT f.vec_id, round(far, 6) AS far, CAST(sign(far) AS INT) AS sign, sign(far) <> sign(embedding[1]) AS flips
FROM f JOIN embeddings m USING (vec_id)""")
def p44(t):
    far = v.vfarthest(F.col("a"))
    flips = F.signum(far) != F.signum(F.element_at("a", 1))
    return vec(t).select("vec_id", r6(far, "far"), F.signum(far).cast("int").alias("sign"), flips.alias("flips"))


@query("p45_metadata_interval", """
SELECT event_id, regexp_extract(metadata, 'active=([^:]+):', 1) AS chrom, CAST(regexp_extract(metadata, 'active=[^:]+:(\\d+)-', 1) AS BIGINT) AS start,
 CAST(regexp_extract(metadata, 'active=[^:]+:\\d+-(\\d+)', 1) AS BIGINT) AS stop FROM v_metadata""")
def p45(t):
    field = text.metadata_field(F.col("metadata"), "active")
    return t.metadata.select("event_id", *[c.alias(n) for n, c in coords.parse_region(field).items()])


@query("p46_reporter_groups", """
SELECT l_orderkey, l_linenumber, concat('ex', CAST(l_partkey AS VARCHAR), '.', l_returnflag) AS grp FROM lineitem""")
def p46(t):
    raw = F.concat(F.lit("ex"), "l_partkey", F.lit(".combo-"), "l_linenumber", F.lit(".barcode-"), "l_orderkey", F.lit("."), "l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.reporter_group(raw).alias("grp"))


@query("p47_pick_tasks", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS d0, round(CAST(embedding[7] AS DOUBLE), 6) AS d3, round(CAST(embedding[13] AS DOUBLE), 6) AS d6 FROM embeddings""")
def p47(t):
    picked = vec(t).select("vec_id", v.vpick(F.col("a"), [0, 6, 12]).alias("p"))
    return picked.select("vec_id", *[r6(F.element_at("p", i + 1), d) for i, d in enumerate(["d0", "d3", "d6"])])


@query("p48_constant_cluster", "SELECT 0 AS cluster, id FROM (SELECT DISTINCT id FROM v_signal)")
def p48(t):
    return x.constant_cluster(t.signal.select("id").distinct())


@query("p49_named_sets", """
SELECT set_name, contrast, padj AS fdr, CAST(padj < 0.02 AS INT) AS significant FROM v_gene_sets JOIN v_contrasts ON gene_id = id
WHERE set_name IN ('Brand#2', 'Brand#5')""")
def p49(t):
    rows = t.gene_sets.join(t.contrasts, F.col("gene_id") == F.col("id")).select("set_name", "contrast", F.col("padj").alias("fdr"))
    return x.named_sets(rows, ["Brand#2", "Brand#5"], 0.02)
