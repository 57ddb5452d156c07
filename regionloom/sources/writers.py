"""Sinks (S02, S11, S14-S22, S29, S36)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from regionloom.functions.coords import parse_region
from regionloom.operators.transforms import snps_only


def write_tsv(df: DataFrame, path: str, header: bool = False, partition_by: list[str] | None = None, gzip: bool = True) -> str:
    """Tab-separated text; ``partition_by`` gives one folder per value."""
    writer = df.write.option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "")
    if gzip:
        writer = writer.option("compression", "gzip")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def write_bed(df: DataFrame, path: str) -> str:
    """BED sorted by chromosome and start; the part files follow the order."""
    return write_tsv(df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start"), path)


def interaction_rows(matrix: DataFrame, score: str) -> DataFrame:
    """Link matrix (src_id, dst_id, one column per replicate) to interaction rows.

    ``score``: ``pooled`` column, ``max`` of the columns, or ``reps`` for ``rep1;rep2``. Pairs are
    made distinct before they are written.
    """
    values = [c for c in matrix.columns if c not in ("src_id", "dst_id")]
    text = {"pooled": lambda: F.col("pooled").cast("string"), "max": lambda: F.greatest(*values).cast("string"),
            "reps": lambda: F.concat_ws(";", *[F.col(c).cast("string") for c in values if c != "pooled"])}[score]()
    rows = matrix.select("src_id", "dst_id", text.alias("score")).dropDuplicates()

    at = parse_region(F.col("src_id"))
    return rows.select(*[c.alias(n) for n, c in at.items()], F.concat_ws(",", "dst_id", "score").alias("name"))


def gmt_lines(sets: DataFrame) -> DataFrame:
    """One line per gene set: name, then its genes; a line is as long as its set."""
    return sets.groupBy("set_name").agg(F.sort_array(F.collect_list("gene_id")).alias("g")).select(
        F.concat_ws("\t", "set_name", F.col("g")).alias("value"))


def vcf_line() -> list:
    return [F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.lit("1"), F.lit("1"), "info").alias("value")]


def eqtl_rows(variants: DataFrame, lookup: DataFrame) -> DataFrame:
    """VCF rows of eQTL variants found in the lookup table.

    ``variants``: variant_id (chrom_pos_ref_alt) and gene; indels drop out. A variant with
    several genes keeps the last in text order.
    """
    part = lambda i: F.split_part("variant_id", F.lit("_"), F.lit(i))
    snp = variants.filter((F.length(part(3)) == 1) & (F.length(part(4)) == 1))
    genes = snp.groupBy("variant_id").agg(F.max(F.split_part("gene", F.lit("."), F.lit(1))).alias("gene"))
    info = F.concat(F.lit("gtex_id="), "variant_id", F.lit(";study=GTEx;study_type=eQTL;eGene="), "gene")
    return lookup.join(genes, "variant_id").select("chrom", "pos", "id", "ref", "alt", info.alias("info"))


def gwas_rows(table: DataFrame) -> DataFrame:
    """VCF rows of a GWAS table after allele clean-up."""
    disease = F.lower(F.replace(F.replace("disease", F.lit(" "), F.lit("_")), F.lit("'"), F.lit("")))
    info = F.concat(F.lit("lead_snp="), "lead_snp", F.lit(";study="), "study", F.lit(";study_type=GWAS;reported_gene="),
                    F.replace("gene", F.lit(" "), F.lit("")), F.lit(";disease="), disease)
    return snps_only(table).select(F.replace("chrom", F.lit("chr"), F.lit("")).alias("chrom"), "pos", "id", "ref", "alt", info.alias("info"))


def homer_lines(motifs: DataFrame) -> DataFrame:
    """HOMER text, one record (several lines) per motif."""
    rows = F.transform(F.arrays_zip(*[F.col("weights")[k].alias(f"w{k}") for k in range(4)]), lambda z: F.concat_ws(
        "\t", *[z[f"w{k}"].cast("string") for k in range(4)]))
    return motifs.select(F.concat(F.lit(">"), "motif", F.lit("\n"), F.array_join(rows, "\n")).alias("value"))


def transfac_lines(motifs: DataFrame, pseudo_counts: int = 500) -> DataFrame:
    """TRANSFAC text with counts from the softmax of each position."""
    def line(z, i):
        e = [F.exp(z[f"w{k}"]) for k in range(4)]
        total = e[0] + e[1] + e[2] + e[3]
        return F.concat_ws("\t", F.lpad((i + 1).cast("string"), 2, "0"), *[(F.lit(pseudo_counts) * x / total).cast("string") for x in e])
    rows = F.transform(F.arrays_zip(*[F.col("weights")[k].alias(f"w{k}") for k in range(4)]), line)
    head = F.concat(F.lit("ID "), "motif", F.lit("\nBF Homo_sapiens\nP0\tA\tC\tG\tT\n"))
    return motifs.select(F.concat(head, F.array_join(rows, "\n"), F.lit("\nXX\n//")).alias("value"))


def track_entries(rules: DataFrame, url: str) -> DataFrame:
    """Browser track entry of every rule that did not fail, as JSON text."""
    live = rules.filter(~F.contains("interaction", F.lit("FAILED")))
    file = F.concat("rule", F.lit("."), "pwm1", F.lit("_x_"), "pwm2", F.lit(".bed.gz"))
    entry = F.struct(F.lit("bed").alias("type"), F.concat(F.lit(url + "/"), file).alias("url"),
                     F.concat("pwm1", F.lit("_x_"), "pwm2").alias("name"), F.lit("full").alias("mode"))
    return live.select("rule", F.to_json(entry).alias("value"))


