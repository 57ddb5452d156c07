"""Sources and sinks: S01-S36. Each query writes its files from the given tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.link_joins import RULES, UNION_REC
from regionloom.catalog.motifs import pwms
from regionloom.catalog.transforms import DROP, EXACT, KEEP, _like
from regionloom.catalog.views import r6
from regionloom.operators import contrasts as ct, links as lk, transforms as x, variants
from regionloom.plans.bins import KEY, overlap_pairs
from regionloom.sources import readers as rd, schemas as sc, writers as wr


def roundtrip(t, df, name, schema):
    return rd.read_tsv(t.spark, wr.write_tsv(df, t.scratch(name)), schema)


@query("s01_bed_scan", "SELECT chrom, start, stop, name FROM v_peaks")
def s01(t):
    return roundtrip(t, t.peaks.select(*KEY, "name"), "bed", sc.BED4)


@query("s02_bed_sink", "SELECT chrom, start, stop, name FROM v_peaks")
def s02(t):
    return rd.read_tsv(t.spark, wr.write_bed(t.peaks.select(*KEY, "name"), t.scratch("sorted-bed")), sc.BED4)


@query("s03_read_scan", "SELECT chrom, start, stop, strand, count(*) AS n FROM v_reads GROUP BY ALL")
def s03(t):
    rows = t.reads.select(*KEY, F.lit("N").alias("name"), F.lit(1000.0).alias("score"), "strand")
    return roundtrip(t, rows, "tagalign", sc.BED6).groupBy(*KEY, "strand").agg(F.count("*").alias("n"))


@query("s04_read_pair_scan", "SELECT chrom1, start1, stop1, start2, stop2, strand1 FROM v_pairs")
def s04(t):
    rows = t.pairs.select("chrom1", "start1", "stop1", "chrom2", "start2", "stop2", F.lit("N").alias("name"), F.lit(0.0).alias("score"),
                          "strand1", F.lit("-").alias("strand2"))
    return roundtrip(t, rows, "bedpe", sc.BEDPE).select("chrom1", "start1", "stop1", "start2", "stop2", "strand1")


def peak_files(t):
    rows = t.peaks.select(*KEY, "name", F.lit(0.0).alias("score"), F.lit(".").alias("strand"), "signal_value", F.lit(1.0).alias("p_value"),
                          "q_value", "summit_offset", "timepoint")
    return wr.write_tsv(rows, t.scratch("narrowpeak"), partition_by=["timepoint"])


@query("s05_peak_files", "SELECT name, timepoint AS file, signal_value, summit_offset FROM v_peaks")
def s05(t):
    rows = rd.read_labelled(t.spark, peak_files(t) + "/*", sc.NARROW_PEAK, r"timepoint=([^/]+)/", "file")
    return rows.select("name", "file", "signal_value", "summit_offset")


@query("s06_count_files", """
SELECT id, coalesce(max(n) FILTER (rep = 'b1'), 0) AS b1, coalesce(max(n) FILTER (rep = 'b2'), 0) AS b2 FROM (SELECT concat(id, '_', CAST(t AS VARCHAR)) AS id, rep, n FROM v_signal) GROUP BY id""")
def s06(t):
    files = wr.write_tsv(t.signal.select(F.concat_ws("_", "id", "t").alias("id"), "n", "rep"), t.scratch("counts"), partition_by=["rep"])
    long = rd.read_labelled(t.spark, files + "/*", "id string, n bigint", r"rep=(b\d)/", "sample")
    return long.groupBy("id").pivot("sample", ["b1", "b2"]).agg(F.sum("n")).fillna(0)


@query("s07_rsem_matrix", """
SELECT concat('GENE', CAST(l_partkey AS VARCHAR)) AS gene_id, CAST(floor(coalesce(sum(l_quantity * 1.5) FILTER (l_returnflag = 'A'), 0)) AS INT) AS A,
 CAST(floor(coalesce(sum(l_quantity * 1.5) FILTER (l_returnflag = 'N'), 0)) AS INT) AS N, CAST(floor(coalesce(sum(l_quantity * 1.5) FILTER (l_returnflag = 'R'), 0)) AS INT) AS R FROM lineitem GROUP BY l_partkey""")
def s07(t):
    rows = t.lineitem.groupBy("l_partkey", "l_returnflag").agg((F.sum("l_quantity") * 1.5).alias("expected_count")).select(
        F.concat(F.lit("GENE"), "l_partkey", F.lit(".3")).alias("gene_id"), "expected_count", F.lit(1.0).alias("TPM"), "l_returnflag")
    files = wr.write_tsv(rows, t.scratch("rsem"), header=True, partition_by=["l_returnflag"])
    quants = rd.read_labelled(t.spark, files + "/*", sc.RSEM, r"l_returnflag=(\w)/", "sample", header=True)
    return rd.rsem_matrix(quants, ["A", "N", "R"], "expected_count")


def gtf(t):
    return roundtrip(t, t.gtf, "gtf", sc.GTF)


@query("s08_coding_genes", "SELECT DISTINCT split_part(gene_id, '.', 1) AS gene_id FROM v_genes WHERE start % 4 <> 0")
def s08(t):
    return rd.coding_genes(gtf(t))


@query("s09_coding_tss", """
SELECT chrom, CASE WHEN strand = '+' THEN start - 2 ELSE stop END AS start, CASE WHEN strand = '+' THEN start - 1 ELSE stop + 1 END AS stop,
 split_part(gene_id, '.', 1) AS gene_id, strand FROM v_genes WHERE start % 4 <> 0 AND start % 5 <> 0 AND start % 3 <> 2""")
def s09(t):
    return rd.coding_tss(gtf(t))


GENE_LIST = "SELECT split_part(gene_id, '.', 1) AS gene_id, start % 1009 AS position FROM v_genes WHERE start % 2 = 0"


def gene_list(t):
    return t.genes.filter("start % 2 = 0").select(F.split_part("gene_id", F.lit("."), F.lit(1)).alias("gene_id"), (F.col("start") % 1009).alias("position"))


@query("s10_gene_bodies", f"""
SELECT g.chrom, g.start - 1 AS start, g.stop, l.gene_id, g.strand, l.position FROM v_genes g JOIN ({GENE_LIST}) l ON l.gene_id = split_part(g.gene_id, '.', 1) WHERE g.start % 5 <> 0""")
def s10(t):
    return rd.gene_bodies(gtf(t), gene_list(t))


@query("s11_grouped_gene_bodies", f"""
SELECT g.chrom, g.start - 1 AS start, g.stop, l.gene_id, CAST(l.position % 4 AS INT) AS cluster FROM v_genes g JOIN ({GENE_LIST}) l ON l.gene_id = split_part(g.gene_id, '.', 1) WHERE g.start % 5 <> 0""")
def s11(t):
    bodies = rd.gene_bodies(gtf(t), gene_list(t)).withColumn("cluster", F.col("position") % 4).select(*KEY, "gene_id", "cluster")
    files = wr.write_tsv(bodies, t.scratch("grouped"), partition_by=["cluster"])
    rows = rd.read_labelled(t.spark, files + "/*", f"{sc.BED3}, gene_id string", r"cluster=(\d+)/", "cluster")
    return rows.withColumn("cluster", F.col("cluster").cast("int"))


def interaction_files(t):
    far = F.concat("chrom", F.lit(":"), "dst_start", F.lit("-"), "dst_stop")
    rows = t.links.select("chrom", F.col("src_start").alias("start"), F.col("src_stop").alias("stop"),
                          F.concat_ws(",", far, F.round("score", 7).cast("string"), F.when(F.col("src_start") % 2 == 0, "G1")).alias("name"),
                          F.col("src_start").alias("unique_id"), F.lit(".").alias("strand"))
    return roundtrip(t, rows, "links", sc.INTERACTION)


@query("s12_interaction_scan", """
SELECT chrom, src_start AS start, src_stop AS stop, chrom AS dst_chrom, dst_start, dst_stop, round(score, 7) AS score, CASE WHEN src_start % 2 = 0 THEN 'G1' END AS gene_id FROM v_links""")
def s12(t):
    return interaction_files(t).select(*KEY, *[c.alias(n) for n, c in rd.split_interaction(F.col("name")).items()])


@query("s13_interaction_coords", """
SELECT concat(chrom, ':', CAST(src_start AS VARCHAR), '-', CAST(src_stop AS VARCHAR)) AS start_id, concat(chrom, ':', CAST(dst_start AS VARCHAR), '-', CAST(dst_stop AS VARCHAR)) AS end_id, round(score, 7) AS score FROM v_links""")
def s13(t):
    return rd.interaction_coords(interaction_files(t))


@query("s14_interaction_sink", f"""
WITH {UNION_REC}, w AS (SELECT src_id, dst_id, max(score) AS m FROM rec GROUP BY src_id, dst_id)
SELECT split_part(src_id, ':', 1) AS chrom, CAST(split_part(split_part(src_id, ':', 2), '-', 1) AS BIGINT) AS start, CAST(split_part(src_id, '-', 2) AS BIGINT) AS stop, dst_id, round(m, 7) AS score FROM w""")
def s14(t):
    wide = lk.score_matrix(lk.reconcile(t.links), "timepoint", ["d0", "d3", "d6"], False)
    back = roundtrip(t, wr.interaction_rows(wide, "max"), "interactions", sc.BED4)
    return back.select(*KEY, F.split_part("name", F.lit(","), F.lit(1)).alias("dst_id"),
                       F.round(F.split_part("name", F.lit(","), F.lit(2)).cast("double"), 7).alias("score"))


@query("s15_cluster_files", "SELECT id, cluster FROM v_clusters")
def s15(t):
    files = wr.write_tsv(t.clusters.select("id", "cluster"), t.scratch("clusters"), partition_by=["cluster"])
    return rd.read_labelled(t.spark, files + "/*", "id string", r"cluster=(\d+)/", "cluster").withColumn("cluster", F.col("cluster").cast("int"))


@query("s16_tss_per_cluster", "SELECT chrom, start, stop, gene_id, CAST(p_size % 6 AS INT) AS cluster FROM v_tss JOIN part ON gene_id = concat('GENE', CAST(p_partkey AS VARCHAR))")
def s16(t):
    c = t.part.select(F.concat(F.lit("GENE"), "p_partkey").alias("gene_id"), (F.col("p_size") % 6).alias("cluster"))
    files = wr.write_tsv(t.tss.join(c, "gene_id").select(*KEY, "gene_id", "cluster"), t.scratch("tss"), partition_by=["cluster"])
    return rd.read_labelled(t.spark, files + "/*", f"{sc.BED3}, gene_id string", r"cluster=(\d+)/", "cluster").withColumn("cluster", F.col("cluster").cast("int"))


def directed_sets(t):
    return ct.gene_sets_by_direction(t.contrasts.withColumnRenamed("id", "gene_id"), 0.05, 0.15)


@query("s17_gene_set_sink", """
SELECT concat(contrast, '_', CASE WHEN log2_fold_change > 0 THEN 'up' ELSE 'down' END, ' ', string_agg(DISTINCT id, ' ' ORDER BY id)) AS value
FROM v_contrasts WHERE padj < 0.05 AND abs(log2_fold_change) > 0.15 GROUP BY contrast, log2_fold_change > 0""")
def s17(t):
    path = t.scratch("gmt")
    wr.gmt_lines(directed_sets(t)).write.text(path)
    return t.spark.read.text(path).select(F.replace("value", F.lit("\t"), F.lit(" ")).alias("value"))


@query("s18_concatenate_sets", """
SELECT DISTINCT concat(contrast, '_', CASE WHEN log2_fold_change > 0 THEN 'up' ELSE 'down' END) AS set_name, id AS gene_id FROM v_contrasts WHERE padj < 0.05 AND abs(log2_fold_change) > 0.15
UNION ALL SELECT set_name, gene_id FROM v_gene_sets""")
def s18(t):
    return x.stack([directed_sets(t), t.gene_sets.select("set_name", "gene_id")])


@query("s19_ranked_list", "SELECT hgnc_symbol, contrast, round(log2_fold_change, 6) + 0.0 AS log2_fold_change FROM v_contrasts JOIN v_mapping ON id = ensembl_gene_id")
def s19(t):
    rows = ct.ranked_list(t.contrasts, t.mapping)
    return roundtrip(t, rows, "ranks", "hgnc_symbol string, contrast string, log2_fold_change double").withColumn("log2_fold_change", r6("log2_fold_change"))


VID = "concat(replace(chrom, 'chr', ''), '_', CAST(pos AS VARCHAR), '_', ref, '_', alt)"


def vid():
    return F.concat_ws("_", F.replace("chrom", F.lit("chr"), F.lit("")), "pos", "ref", "alt")


@query("s20_eqtl_vcf", f"""
WITH v AS (SELECT {VID} AS variant_id, max(concat('GENE', CAST(line % 90 AS VARCHAR))) AS gene FROM v_variants WHERE length(alt) = 1 GROUP BY 1),
l AS (SELECT {VID} AS variant_id, * FROM v_variants)
SELECT replace(chrom, 'chr', '') AS chrom, pos, id, ref, alt, concat('gtex_id=', variant_id, ';study=GTEx;study_type=eQTL;eGene=', gene) AS info FROM l JOIN v USING (variant_id)""")
def s20(t):
    files = t.variants.select(vid().alias("variant_id"), F.concat(F.lit("GENE"), F.col("line") % 90, F.lit(".4")).alias("gene"))
    lookup = t.variants.select(F.replace("chrom", F.lit("chr"), F.lit("")).alias("chrom"), "pos", "id", "ref", "alt", vid().alias("variant_id"))
    return wr.eqtl_rows(files, lookup)


@query("s21_gwas_vcf", """
SELECT concat(replace(chrom, 'chr', ''), ' ', CAST(pos AS VARCHAR), ' ', id, ' ', ref, ' ', substr(alt, 1, 1), ' 1 1 lead_snp=', id, ';study=s', CAST(line % 7 AS VARCHAR), ';study_type=GWAS;reported_gene=GENE1;disease=', lower(replace(source, ' ', '_'))) AS value
FROM v_variants WHERE alt <> 'AT'""")
def s21(t):
    table = t.variants.select("chrom", "pos", "id", "ref", "alt", F.col("id").alias("lead_snp"), F.concat(F.lit("s"), F.col("line") % 7).alias("study"),
                              F.lit("GENE 1").alias("gene"), F.col("source").alias("disease"))
    path = t.scratch("vcf")
    wr.gwas_rows(table).select(*wr.vcf_line()).write.text(path)
    return t.spark.read.text(path).select(F.replace("value", F.lit("\t"), F.lit(" ")).alias("value"))


@query("s22_vcf_points", "SELECT chrom, pos AS start, pos + 1 AS stop, id FROM v_variants")
def s22(t):
    rows = t.variants.select(F.replace("chrom", F.lit("chr"), F.lit("")).alias("chrom"), "pos", "id", "ref", "alt", F.lit("1").alias("q"), F.lit("1").alias("f"), "info")
    return variants.to_points(roundtrip(t, rows, "vcf", sc.VCF))


BASES = "translate(regexp_replace(text, '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def bases(col):
    return F.translate(F.regexp_replace(col, "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


@query("s23_fastq_pairs", f"""
WITH b AS (SELECT doc_id, {BASES} AS bases FROM documents)
SELECT concat('@r', CAST(doc_id AS VARCHAR), ':', substr(reverse(bases), 1, 15)) AS name, substr(bases, 18) AS bases FROM b""")
def s23(t):
    rows = t.documents.select("doc_id", bases("text").alias("b"))
    paths = []
    for mate, seq in (("1", F.reverse("b")), ("2", F.col("b"))):
        record = F.concat(F.lit("@r"), "doc_id", F.lit(f" {mate}\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("b")))
        path = t.scratch(f"fastq{mate}")
        # one ordered file per lane, as a sequencer writes them
        lanes = rows.select("doc_id", (F.col("doc_id") % 16).alias("lane"), record.alias("value")).repartition("lane")
        lanes.sortWithinPartitions("lane", "doc_id").select("value", "lane").write.partitionBy("lane").option("compression", "gzip").text(path)
        paths.append(path + "/*")
    first, second = (rd.read_fastq(t.spark, p, r"lane=(\d+)/") for p in paths)
    out = rd.umi_reads(first, second)
    return out.select("name", "bases")


@query("s24_sam_umi_counts", "SELECT barcode, count(DISTINCT umi) AS n_umi FROM v_umi GROUP BY barcode")
def s24(t):
    from regionloom.operators.reporter import umi_counts
    line = F.concat_ws("\t", F.concat(F.lit("read"), "read_id", F.lit(":"), "umi"), F.lit("0"), "barcode", F.lit("1"))
    path = t.scratch("sam")
    t.umi.select(line.alias("value")).unionByName(t.clusters.select(F.concat(F.lit("@SQ\t"), "id").alias("value"))).write.text(path)
    return umi_counts(rd.read_sam(t.spark, path))


@query("s25_profile_matrix", """
SELECT concat('v', CAST(vec_id AS VARCHAR)) AS gene_id, round(list_sum(embedding), 5) AS total FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS embedding FROM embeddings)""")
def s25(t):
    a = F.col("embedding").cast("array<double>")
    line = F.concat_ws("\t", F.lit("chr1"), F.col("vec_id"), F.col("vec_id") + 1, F.concat(F.lit("v"), "vec_id"), F.lit("0"), F.lit("+"),
                       *[F.element_at(a, i + 1).cast("string") for i in range(64)])
    path = t.scratch("matrix")
    head = t.region.select(F.concat(F.lit('@{"r":"'), "r_name", F.lit('"}')).alias("value"))
    t.embeddings.select(line.alias("value")).unionByName(head).write.option("compression", "gzip").text(path)
    rows = rd.read_profile_matrix(t.spark, path, 64)
    return rows.select("gene_id", F.round(F.aggregate("profile", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("s26_qc_metrics", """
SELECT s_nationkey AS nation, CAST(max(s_suppkey) AS DOUBLE) AS num_input_reads, round(max(s_acctbal), 2) AS num_unique, 2 * count(*) AS n_lines FROM supplier GROUP BY s_nationkey""")
def s26(t):
    lines = F.array(F.concat(F.lit("Number of input reads |\t"), "s_suppkey"), F.concat(F.lit("Uniquely mapped reads number |\t"), F.col("s_acctbal").cast("decimal(12,2)")))
    path = t.scratch("logs")
    t.supplier.select(F.explode(lines).alias("value"), F.col("s_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    out = rd.qc_metrics(t.spark, path + "/*", {"num_input_reads": "Number of input reads", "num_unique": "Uniquely mapped reads number"}, r"nation=(\d+)/")
    return out.select(F.col("file").cast("int").alias("nation"), "num_input_reads", F.round("num_unique", 2).alias("num_unique"), "n_lines")


@query("s26_flagstat", """
SELECT s_nationkey AS nation, CAST(max(s_suppkey) AS DOUBLE) AS total, 2 * count(*) AS n_lines FROM supplier GROUP BY s_nationkey""")
def s26_flagstat(t):
    lines = F.array(F.concat("s_suppkey", F.lit(" + 0 in total (QC-passed reads + QC-failed reads)")), F.concat("s_suppkey", F.lit(" + 0 mapped")))
    path = t.scratch("flagstat")
    t.supplier.select(F.explode(lines).alias("value"), F.col("s_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    return rd.qc_metrics(t.spark, path + "/*", {"total": "in total"}, r"nation=(\d+)/").select(F.col("file").cast("int").alias("nation"), "total", "n_lines")


@query("s26_last_line", """
SELECT s_nationkey AS nation, CAST(arg_max(s_suppkey * 3, s_suppkey) AS DOUBLE) AS nrf, CAST(arg_max(s_suppkey + 1, s_suppkey) AS DOUBLE) AS pbc1 FROM supplier GROUP BY s_nationkey""")
def s26_last(t):
    line = F.concat_ws("\t", F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"), F.col("s_suppkey") * 3, F.col("s_suppkey") + 1)
    path = t.scratch("lastline")
    rows = t.supplier.select(line.alias("value"), F.col("s_nationkey").alias("nation"), "s_suppkey").repartition("nation").sortWithinPartitions("nation", "s_suppkey")
    rows.drop("s_suppkey").write.partitionBy("nation").text(path)
    return rd.last_line_fields(t.spark, path + "/*", {"nrf": 5, "pbc1": 6}, r"nation=(\d+)/").select(F.col("file").cast("int").alias("nation"), "nrf", "pbc1")


@query("s27_manifest")
def s27(t):
    return rd.manifest(t.spark, peak_files(t))


@query("s28_motif_scan", """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) + 0.5 AS x FROM embeddings)
SELECT vec_id AS motif, CAST(p % 16 AS INT) AS pos, CAST(p // 16 AS INT) AS base, round(log2(x / 0.25), 6) + 0.0 AS weight FROM e WHERE x > 0""")
def s28(t):
    shifted = t.embeddings.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.5))
    a = F.col("embedding")
    motifs = shifted.select(F.concat(F.lit("m"), "vec_id").alias("motif"), F.array(*[F.slice(a, i * 16 + 1, 16) for i in range(4)]).alias("weights"))
    path = t.scratch("motifs")
    wr.homer_lines(motifs).write.text(path)
    back = rd.read_motifs(t.spark, path, probabilities=True)
    flat = back.select("motif", F.posexplode("weights").alias("base", "w")).select("motif", "base", F.posexplode("w").alias("pos", "weight"))
    return flat.filter(F.col("weight").isNotNull() & ~F.isnan("weight")).select(
        F.expr("substring(motif, 2)").cast("long").alias("motif"), "pos", "base", r6("weight"))


@query("s29_transfac_sink", "SELECT vec_id, 5 + 16 AS n_lines FROM embeddings")
def s29(t):
    path = t.scratch("transfac")
    wr.transfac_lines(pwms(t)).write.text(path)
    rows = t.spark.read.option("lineSep", "//\n").text(path).filter(F.contains("value", F.lit("ID ")))
    return rows.select(F.regexp_extract("value", r"ID (\d+)", 1).cast("long").alias("vec_id"),
                       (F.size(F.filter(F.split("value", "\n"), lambda l: l != "")) + 1).alias("n_lines"))


KNOWN = "SELECT p_name AS motif_name, p_size % 16 AS cluster, min(p_partkey % 100) / CAST(100 AS DOUBLE) AS q_value FROM {part} GROUP BY 1, 2"


@query("s30_homer_table", f"""
WITH k AS ({KNOWN.format(part='part')}), g AS (SELECT * FROM (SELECT DISTINCT p_name AS motif_name FROM part), (SELECT CAST(unnest(range(15)) AS INT) AS cluster))
SELECT motif_name, g.cluster, coalesce(q_value, 1) AS q_value, CAST(coalesce(q_value, 1) < 0.1 AS INT) AS significant FROM g LEFT JOIN (SELECT * FROM k WHERE q_value < 0.1) k USING (motif_name, cluster)""")
def s30(t):
    known = t.spark.sql(KNOWN, part=t.part).select("motif_name", F.lit("N").alias("consensus"), F.lit(0.01).alias("p_value"), F.lit(-1.0).alias("log_p"), "q_value", "cluster")
    files = wr.write_tsv(known, t.scratch("homer"), header=True, partition_by=["cluster"])
    results = rd.read_labelled(t.spark, files + "/*", sc.HOMER_KNOWN, r"cluster=(\d+)/", "cluster", header=True)
    return rd.homer_table(results.withColumn("cluster", F.col("cluster").cast("int")), t.part.select(F.col("p_name").alias("motif")), list(range(16)))


@query("s31_enrichment_files", f"""
SELECT term_id, term_name, motif_group AS motif, round(-log10(p_value), 6) AS neg_log10_p FROM v_terms WHERE domain = 'BP' AND NOT ({_like(DROP)}) AND ({_like(KEEP)}) AND NOT ({_like(EXACT)})""")
def s31(t):
    files = wr.write_tsv(t.terms.select("domain", "term_id", "term_name", "p_value", "motif_group"), t.scratch("terms"), header=True, partition_by=["motif_group"])
    rows = rd.read_labelled(t.spark, files + "/*", sc.TERMS, r"motif_group=([^/]+)/", "motif", header=True)
    named = rows.withColumn("motif", F.url_decode("motif"))
    # a path from the file system is escaped twice where the folder name itself has an escape
    named = named.withColumn("motif", F.url_decode("motif"))
    return x.filter_terms(named, DROP, KEEP, EXACT).select("term_id", "term_name", "motif", r6("neg_log10_p"))


@query("s32_contrast_files", "SELECT id, split_part(contrast, '_over_', 1) AS late, split_part(contrast, '_over_', 2) AS early, padj FROM v_contrasts")
def s32(t):
    files = wr.write_tsv(t.contrasts.select("id", "base_mean", "log2_fold_change", "padj", "contrast"), t.scratch("contrasts"), partition_by=["contrast"])
    rows = rd.read_labelled(t.spark, files + "/*", sc.CONTRAST, r"contrast=([^/]+)/", "prefix")
    return rows.select("id", F.split_part("prefix", F.lit("_over_"), F.lit(1)).alias("late"), F.split_part("prefix", F.lit("_over_"), F.lit(2)).alias("early"), "padj")


@query("s33_fold_metrics", """
WITH m AS (SELECT l_linenumber AS fold, l_returnflag AS training, round(avg(l_discount), 6) AS auroc, round(avg(l_tax), 6) AS auprc FROM lineitem GROUP BY 1, 2)
SELECT fold, training, metric, value FROM (UNPIVOT m ON auroc, auprc INTO NAME metric VALUE value)""")
def s33(t):
    rows = t.lineitem.groupBy("l_linenumber", "l_returnflag").agg(r6(F.avg("l_discount"), "auroc"), r6(F.avg("l_tax"), "auprc"))
    files = wr.write_tsv(rows.select("auroc", "auprc", F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("training")), t.scratch("folds"), partition_by=["training", "fold"])
    back = rd.read_labelled(t.spark, files + "/*/*", "auroc double, auprc double", r"training=([^/]+/fold=\d+)/", "label")
    back = back.select(F.regexp_extract("label", r"fold=(\d+)", 1).cast("int").alias("fold"), F.split_part("label", F.lit("/"), F.lit(1)).alias("training"), "auroc", "auprc")
    return back.unpivot(["fold", "training"], ["auroc", "auprc"], "metric", "value")


LOCI = [("chr1", 100000, 400000, "locus_a"), ("chr2", 1000000, 1500000, "locus_b"), ("chr5", 3000000, 3900000, "locus_c")]


@query("s34_literal_loci", f"""
WITH l(chrom, start, stop, locus) AS (VALUES {', '.join(map(str, LOCI))}) SELECT p.name, locus FROM v_peaks p JOIN l ON p.chrom = l.chrom AND p.start < l.stop AND l.start < p.stop""")
def s34(t):
    return overlap_pairs(t.peaks.select(*KEY, "name"), rd.literal_loci(t.spark, LOCI)).select("name", F.col("b_name").alias("locus"))


@query("s35_motif_slices", """
SELECT vec_id AS example_id, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 5) AS total FROM embeddings WHERE label = 3 AND vec_id % 3 <> 2""")
def s35(t):
    path = t.scratch("tensor")
    rows = t.embeddings.select(F.col("vec_id").alias("example_id"), F.concat(F.lit("m"), "label").alias("pwm"), F.concat(F.lit("task"), F.col("vec_id") % 3).alias("task"),
                               F.col("embedding").cast("array<double>").alias("scores"))
    rows.repartitionByRange("pwm").sortWithinPartitions("pwm", "task").write.parquet(path)
    got = rd.motif_slices(t.spark, path, "m3", ["task0", "task1"])
    return got.select("example_id", F.round(F.aggregate("scores", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


@query("s36_track_entries", f"""
WITH r AS ({RULES.format(orders='orders')})
SELECT rule, concat('{{"type":"bed","url":"https://example.org/tracks/', CAST(rule AS VARCHAR), '.', pwm1, '_x_', pwm2, '.bed.gz","name":"', pwm1, '_x_', pwm2, '","mode":"full"}}') AS value FROM r WHERE interaction NOT LIKE '%FAILED%'""")
def s36(t):
    return wr.track_entries(t.spark.sql(RULES, orders=t.orders), "https://example.org/tracks")


