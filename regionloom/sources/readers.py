"""Scans (S01, S03-S09, S12, S13, S23-S28, S30-S35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from regionloom.functions.coords import parse_region, region_id, strip_version, tss_point
from regionloom.sources import schemas


def read_tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False, comment: str | None = None) -> DataFrame:
    """Tab-separated text, plain or gzip, by a stated schema."""
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "").option("mode", "FAILFAST")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def from_path(pattern: str, group: int = 1) -> Column:
    """A label taken from the path of the file a row came from."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def read_labelled(spark: SparkSession, path: str, schema: str, pattern: str, label: str, header: bool = False) -> DataFrame:
    """Many files as one table, each row with the label in its file's path."""
    base = read_tsv(spark, path, schema, header)
    return base.select("*", from_path(pattern).alias(label))


def rsem_matrix(quants: DataFrame, samples: list[str], value: str) -> DataFrame:
    """Gene by sample matrix of ``expected_count`` (whole numbers) or ``TPM``, versions cut off."""
    cell = F.sum(value)
    wide = quants.withColumn("gene_id", strip_version(F.col("gene_id"))).groupBy("gene_id").pivot("sample", samples).agg(cell)
    wide = wide.fillna(0.0, samples)
    return wide.select("gene_id", *[F.col(s).cast("int") for s in samples]) if value == "expected_count" else wide


def gtf_attribute(name: str) -> Column:
    return F.regexp_extract("attributes", rf'{name} "?([^";]+)"?', 1)


def coding_genes(gtf: DataFrame) -> DataFrame:
    """Distinct protein-coding gene ids without version."""
    kept = gtf.filter(F.contains("attributes", F.lit("protein_coding")))
    return kept.select(strip_version(gtf_attribute("gene_id")).alias("gene_id")).distinct()


def coding_tss(gtf: DataFrame) -> DataFrame:
    """TSS points of protein-coding genes; level 3 annotation is left out."""
    kept = gtf.filter((F.col("feature") == "gene") & F.contains("attributes", F.lit("protein_coding")) & ~F.contains("attributes", F.lit("level 3")))
    return tss_point(kept.select("chrom", "start", "stop", gtf_attribute("gene_id").alias("gene_id"), "strand"))


def gene_bodies(gtf: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene intervals of a list (gene_id, position), in list order."""
    bodies = gtf.filter(F.col("feature") == "gene").select(
        "chrom", (F.col("start") - 1).alias("start"), "stop", strip_version(gtf_attribute("gene_id")).alias("gene_id"), "strand")
    return bodies.join(genes, "gene_id").orderBy("position")


def split_interaction(name: Column) -> dict[str, Column]:
    """Far end, score and optional gene of a link name ``chrom:start-stop,score[,gene]``."""
    end = parse_region(F.split_part(name, F.lit(","), F.lit(1)))
    gene = F.split_part(name, F.lit(","), F.lit(3))
    return {"dst_chrom": end["chrom"], "dst_start": end["start"], "dst_stop": end["stop"],
            "score": F.split_part(name, F.lit(","), F.lit(2)).try_cast("double"), "gene_id": F.nullif(gene, F.lit(""))}


def interaction_coords(links: DataFrame) -> DataFrame:
    """(start_id, end_id, score) of an interaction table."""
    parts = split_interaction(F.col("name"))
    return links.select(region_id().alias("start_id"), F.split_part("name", F.lit(","), F.lit(1)).alias("end_id"), parts["score"].alias("score"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their 0-based number in the file, without leaving the JVM.

    A row's number inside its file block plus the lines of the earlier blocks; the block table
    has one row per file block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("i"))
    blocks = lines.groupBy("file", "block").agg(F.min("i").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "first_", before.alias("before_"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("before_") + F.col("i") - F.col("first_")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, lane: str = r"([^/]+)$") -> DataFrame:
    """Records of four lines: lane (from the file path), record number in the file, name, bases, quality."""
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    lines = numbered_lines(spark, path).withColumn("lane", F.regexp_extract("file", lane, 1))
    return lines.groupBy("lane", F.floor(F.col("line") / 4).alias("record")).agg(
        part(0).alias("name"), part(1).alias("bases"), part(3).alias("quality"))


def umi_reads(first: DataFrame, second: DataFrame, umi: int = 15, trim: int = 17) -> DataFrame:
    """S23 with P41: read 2 cut by ``trim`` bases, the first ``umi`` bases of read 1 in its name."""
    tags = first.select("lane", "record", F.substring("bases", 1, umi).alias("umi"))
    return second.join(tags, ["lane", "record"]).select(
        "lane", "record", F.concat(F.split_part("name", F.lit(" "), F.lit(1)), F.lit(":"), "umi").alias("name"),
        F.expr(f"substring(bases, {trim + 1})").alias("bases"), F.expr(f"substring(quality, {trim + 1})").alias("quality"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines of SAM text with barcode (reference name) and molecule tag (last part of the read name)."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("@")))
    return rows.select(f[0].alias("name"), f[2].alias("barcode"), F.element_at(F.split(f[0], ":"), -1).alias("umi"))


def read_profile_matrix(spark: SparkSession, path: str, bins: int) -> DataFrame:
    """Matrix text with an ``@`` line, six coordinate columns and one column per bin."""
    schema = f"{schemas.BED6}, " + ", ".join(f"b{i} double" for i in range(bins))
    wide = read_tsv(spark, path, schema, comment="@")
    return wide.select("chrom", "start", "stop", F.col("name").alias("gene_id"), F.array(*[f"b{i}" for i in range(bins)]).alias("profile"))


def qc_metrics(spark: SparkSession, path: str, labels: dict[str, str], pattern: str) -> DataFrame:
    """``text | number`` and ``number + number text`` lines of log files as one row per file; ``labels`` maps column to line text."""
    rows = spark.read.text(path).select("value", from_path(pattern).alias("file"))
    after, before = F.split_part("value", F.lit("|"), F.lit(2)), F.split_part("value", F.lit("+"), F.lit(1))
    number = F.coalesce(F.trim(after).try_cast("double"), F.trim(before).try_cast("double"))
    return rows.groupBy("file").agg(
        *[F.max(F.when(F.contains("value", F.lit(text)), number)).alias(c) for c, text in labels.items()], F.count("*").alias("n_lines"))


def last_line_fields(spark: SparkSession, path: str, fields: dict[str, int], pattern: str) -> DataFrame:
    """Fields (1-based, by white space) of the last line of each log file; a log is read as one text."""
    rows = spark.read.text(path, wholetext=True).select("value", from_path(pattern).alias("file"))
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    cells = F.split(F.trim(F.try_element_at(lines, F.lit(-1))), r"\s+")
    return rows.select("file", *[F.try_element_at(cells, F.lit(n)).try_cast("double").alias(c) for c, n in fields.items()])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """File name, size and checksum, sorted by name. One file is one row, up to Spark's 2 GB limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.md5("content").alias("md5")).orderBy("name")


def read_motifs(spark: SparkSession, path: str, probabilities: bool = False) -> DataFrame:
    """Motif text to (motif, weights as four rows); probabilities become log2(p / 0.25)."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    rows = spark.read.option("lineSep", ">").text(path).select(lines.alias("l")).filter(F.size("l") > 1)
    cells = F.transform(F.slice(F.col("l"), F.lit(2), F.size("l")), lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double")))
    change = (lambda v: F.log2(v / 0.25)) if probabilities else (lambda v: v)
    column = lambda k: F.transform("c", lambda row: change(row[k]))
    return rows.select(F.trim(F.col("l")[0]).alias("motif"), cells.alias("c")).select("motif", F.array(*[column(k) for k in range(4)]).alias("weights"))


def homer_table(results: DataFrame, motifs: DataFrame, clusters: list[int], q_max: float = 0.10) -> DataFrame:
    """Q-value of every motif in every cluster, 1 where it is not significant; cluster 15 is left out."""
    kept = results.filter((F.col("cluster") != 15) & (F.col("q_value") < q_max)).groupBy("motif_name", "cluster").agg(F.max("q_value").alias("q_value"))
    grid = motifs.select(F.col("motif").alias("motif_name")).distinct().withColumn("cluster", F.explode(F.array(*[F.lit(c) for c in clusters if c != 15])))
    out = grid.join(kept, ["motif_name", "cluster"], "left").fillna(1.0, ["q_value"])
    return out.withColumn("significant", (F.col("q_value") < q_max).cast("int"))


def literal_loci(spark: SparkSession, rows: list[tuple[str, int, int, str]]) -> DataFrame:
    """A handful of named loci given in the call."""
    return spark.createDataFrame(rows, schemas.BED4)


def motif_slices(spark: SparkSession, path: str, pwm: str, tasks: list[str]) -> DataFrame:
    """Score arrays of one motif and some tasks; both conditions reach the Parquet scan."""
    return spark.read.parquet(path).filter((F.col("pwm") == pwm) & F.col("task").isin(tasks))
