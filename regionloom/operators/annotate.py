"""Id tables, gene lists, cluster and mark annotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.functions.coords import region_id
from regionloom.functions.vectors import vargmax
from regionloom.operators.overlap import nearest_within
from regionloom.plans.bins import KEY, overlap_anti, overlap_left, overlap_semi


def merge_memberships(files: list[DataFrame]) -> DataFrame:
    """J17 with A13: cluster of each id in each file (0 when missing) and the decimal code of all of them."""
    tagged = [f.select("id", *[(F.col("cluster") if i == j else F.lit(None).cast("int")).alias(f"c{j}") for j in range(len(files))])
              for i, f in enumerate(files)]
    names = [f"c{j}" for j in range(len(files))]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in names])
    return merged.withColumn("code", decimal_code([F.col(c) for c in names]))


def decimal_code(parts: list[Column]) -> Column:
    """Sum of 10^i times the i-th part."""
    return reduce(lambda s, ip: s + ip[1].cast("long") * 10 ** ip[0], enumerate(parts), F.lit(0).cast("long"))


def matching_matrix(primary: DataFrame, secondary: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Second matrix on the ids of the first, gaps 0, ids converted through ``mapping`` (id, other) if given."""
    if mapping is not None:
        secondary = secondary.join(mapping, secondary["id"] == mapping["other"]).drop("other", secondary["id"])
    numbers = [c for c in secondary.columns if c != "id"]
    return primary.select("id").distinct().join(secondary, "id", "left").fillna(0, numbers)


def symbols_to_rows(matrix: DataFrame, symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of a matrix whose gene has a listed symbol."""
    ids = symbols_to_ids(symbols, mapping)
    return matrix.join(ids.withColumnRenamed("ensembl_gene_id", "id"), "id")


def symbols_to_ids(symbols: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct (gene id, symbol) pairs of a symbol list."""
    return mapping.join(symbols.select("hgnc_symbol").distinct(), "hgnc_symbol", "left_semi").select(
        "ensembl_gene_id", "hgnc_symbol").distinct()


def annotate(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Mapping columns next to every row."""
    return df.join(mapping.withColumnRenamed("ensembl_gene_id", key), key, "left")


def genes_to_tss(genes: DataFrame, tss: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TSS rows of a gene list, and the genes that have none."""
    listed = genes.select("gene_id").distinct()
    return tss.join(listed, "gene_id", "left_semi"), listed.join(tss, "gene_id", "left_anti")


def name_with_cluster(tss: DataFrame, clusters: DataFrame) -> DataFrame:
    """Trajectory number in the TSS name, -1 without one."""
    c = clusters.select(F.col("id").alias("gene_id"), "cluster")
    named = tss.join(c, "gene_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return named.withColumn("name", F.format_string("gene_id=%s;traj=%d", "gene_id", F.col("cluster").cast("int")))


def tss_regions(ids: DataFrame, tss: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions that overlap the TSS of listed genes."""
    return overlap_semi(regions, tss.join(ids.select("gene_id").distinct(), "gene_id", "left_semi"))


def symbols_containing(clusters: DataFrame, mapping: DataFrame, words: list[str]) -> DataFrame:
    """Cluster rows whose symbol holds one of the words, one row per match."""
    named = clusters.join(mapping.withColumnRenamed("ensembl_gene_id", "id"), "id")
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("hgnc_symbol", w))
    return named.withColumn("match", F.explode(hits))


def promoter_table(tss: DataFrame, atac: DataFrame, signal: DataFrame, rna_clusters: DataFrame, atac_clusters: DataFrame,
                   limit: int = 500) -> DataFrame:
    """Each TSS with its nearest open region, signal and cluster numbers.

    Missing clusters become 12 (RNA) and 16 (ATAC), missing signal 0; the TSS moves to the
    region's midpoint when there is one.
    """
    near = nearest_within(tss, atac.select(*KEY), [], limit)
    found = F.col("b_start").isNotNull()
    mid = F.col("b_start") + F.floor((F.col("b_stop") - F.col("b_start")) / 2)
    rows = near.withColumns({
        "atac_id": F.when(found, region_id("chrom", "b_start", "b_stop")),
        "start": F.when(found, mid).otherwise(F.col("start")), "stop": F.when(found, mid + 1).otherwise(F.col("stop")),
    }).drop("b_start", "b_stop", "distance")
    values = [c for c in signal.columns if c != "id"]
    rows = rows.join(signal.withColumnRenamed("id", "atac_id"), "atac_id", "left").fillna(0, values)
    rows = rows.withColumn("atac_not_present", (F.least(*[F.col(c) for c in values]) == 0).cast("int"))
    rna = rna_clusters.select(F.col("id").alias("gene_id"), F.col("cluster").alias("rna_cluster"))
    atc = atac_clusters.select(F.col("id").alias("atac_id"), F.col("cluster").alias("atac_cluster"))
    return rows.join(rna, "gene_id", "left").join(atc, "atac_id", "left").fillna(12, ["rna_cluster"]).fillna(16, ["atac_cluster"])


def respelled_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two matrices after ``:`` and ``-`` in the ids of ``a`` become ``_``."""
    return a.withColumn("id", F.translate("id", ":-", "__")).join(b, "id")


def expressed_genes(motifs: DataFrame, expressed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per motif the listed genes that are expressed, with their symbols, in list order.

    A motif's list is one text field, so the ordered lists stay as short as that field.
    """
    items = motifs.select("motif", F.posexplode(F.split("gene_ids", ";")).alias("pos", "gene_id"))
    live = items.join(expressed.select("gene_id").distinct(), "gene_id", "left_semi")
    named = live.join(mapping.select(F.col("ensembl_gene_id").alias("gene_id"), "hgnc_symbol"), "gene_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "gene_id", "hgnc_symbol")))
    lists = named.groupBy("motif").agg(ordered.alias("o_")).select(
        "motif", F.concat_ws(";", F.col("o_.gene_id")).alias("expressed"), F.concat_ws(";", F.col("o_.hgnc_symbol")).alias("expressed_hgnc"))
    return motifs.join(lists, "motif", "left")


def rename_motifs(motifs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gene id by entrez id, else by symbol, else ``UNK``."""
    by_entrez = mapping.groupBy(F.col("entrezgene_id").alias("entrez")).agg(F.min("ensembl_gene_id").alias("by_entrez"))
    by_symbol = mapping.groupBy(F.col("hgnc_symbol").alias("symbol")).agg(F.min("ensembl_gene_id").alias("by_symbol"))
    out = motifs.join(by_entrez, "entrez", "left").join(by_symbol, "symbol", "left")
    return out.withColumn("ensembl", F.coalesce("by_entrez", "by_symbol", F.lit("UNK"))).drop("by_entrez", "by_symbol")


def transfer(names: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Metadata over two hops: name to alias, alias to payload."""
    return names.join(first, "name").join(second, "alias")


def motifs_to_factors(motifs: DataFrame, table: DataFrame) -> DataFrame:
    """Ordered motif list to the ordered factors present in a table."""
    items = motifs.select("pos", F.posexplode(F.split("factors", ";")).alias("sub_pos", "gene_id"))
    return items.join(table.select("gene_id").distinct(), "gene_id", "left_semi").orderBy("pos", "sub_pos")


def rule_edges(rules: DataFrame, motifs: DataFrame, expression: DataFrame) -> DataFrame:
    """Rule table with both motifs' factors and the index of their peak expression; failed rules drop out."""
    zipped = F.arrays_zip(F.split("expressed", ";").alias("gene_id"), F.split("expressed_hgnc", ";").alias("symbol"))
    items = motifs.select("motif", F.posexplode(zipped).alias("pos", "z")).select("motif", "pos", "z.gene_id", "z.symbol")
    peaked = items.join(expression.select("gene_id", (vargmax(F.col("vector")) - 1).alias("peak")), "gene_id")
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol", "peak"))), lambda s: F.concat_ws(";", s["symbol"], s["peak"].cast("string")))
    lists = peaked.groupBy("motif").agg(F.concat_ws(";", text).alias("tf"))
    live = rules.filter(~F.contains("interaction", F.lit("FAILED")))
    for i in ("1", "2"):
        live = live.join(lists.select(F.col("motif").alias(f"pwm{i}"), F.col("tf").alias(f"tf{i}")), f"pwm{i}", "left")
    return live.fillna("", ["tf1", "tf2"])


def summit_windows(examples: DataFrame, summits: DataFrame) -> DataFrame:
    """Examples whose window holds the summit of their region, with the offset inside the window."""
    inside = (F.col("summit") >= F.col("start")) & (F.col("summit") < F.col("stop"))
    return examples.join(summits, "region_id").filter(inside).withColumn("offset", F.col("summit") - F.col("start"))


def region_summary(regions: DataFrame, atac_clusters: DataFrame, tss: DataFrame, rna: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per region: ATAC cluster, nearby gene's pattern and cluster, marks; regions without a TSS kept.

    What belongs to a region or a gene is joined to it before the two meet, so the pairs are not moved again.
    """
    known = regions.withColumn("id", region_id()).join(atac_clusters.withColumnRenamed("cluster", "atac_cluster"), "id", "left").join(marks, "id", "left")
    known = known.fillna(9, [c for c in marks.columns if c != "id"])
    genes = tss.select(*KEY, "gene_id").join(rna, "gene_id", "left")
    out = overlap_left(known, genes).withColumnsRenamed({f"b_{c}": c for c in ("gene_id", *rna.columns)})
    return out.drop("b_start", "b_stop", "overlap")


def tss_subsets(tss: DataFrame, summary: DataFrame) -> DataFrame:
    """TSS rows with the summary columns, labelled by subset.

    The TSS of a task's genes are hashed there, so the summary, which has a row per region and gene, is not sorted.
    """
    joined = tss.hint("shuffle_hash").join(summary, "gene_id", "left")
    subset = F.when(F.col("rna_cluster").isNotNull() & (F.col("atac_cluster") > 0), "rna_dynamic.atac_dynamic").when(
        F.col("rna_cluster").isNotNull(), "rna_dynamic.atac_stable").otherwise("rna_stable")
    return joined.withColumn("subset", subset)


def distal_groups(regions: DataFrame, tss: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Regions away from any TSS, labelled by cluster range."""
    group = F.coalesce(*[F.when(F.col("cluster").between(lo, hi), F.lit(i + 1)) for i, (lo, hi) in enumerate(ranges)])
    return overlap_anti(regions, tss).withColumn("group", group).filter(F.col("group").isNotNull())


def interaction_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Calls of a second source on the pairs of the first, both sources stacked."""
    cols = ["pwm1", "pwm2"]
    matched = a.select(*cols).join(b, cols, "left").select(*cols, "interaction", F.lit("b").alias("source"))
    return a.select(*cols, "interaction", F.lit("a").alias("source")).unionByName(matched)


