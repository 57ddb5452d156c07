"""Links between regions: reconciliation, consistency, regions to genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from regionloom.functions.coords import region_id, slop
from regionloom.functions.vectors import vpearson
from regionloom.operators.sets import mirrored
from regionloom.plans.bins import KEY, merge_intervals, overlap_pairs, overlap_semi
from regionloom.plans.hops import far_levels, longest_items, near_counts, place_sums, reached, reached_pairs
from regionloom.plans.ranked import largest_overlap
from regionloom.plans.small import small_grid

END = {"src": ["src_start", "src_stop"], "dst": ["dst_start", "dst_stop"]}


def link_ends(links: DataFrame) -> DataFrame:
    """Both ends of every link as distinct intervals."""
    one = lambda e: links.select("chrom", F.col(f"{e}_start").alias("start"), F.col(f"{e}_stop").alias("stop"))
    return one("src").unionByName(one("dst")).distinct()


def most_overlapping(a: DataFrame, master: DataFrame) -> DataFrame:
    """Per distinct ``a`` interval the master with the largest overlap (smallest start wins a tie).

    Intervals without a master keep their own coordinates. Adds m_start, m_stop.
    """
    best = largest_overlap(a, master)
    return a.select(*KEY).distinct().join(best, KEY, "left").select(
        *KEY, F.coalesce("b_start", "start").alias("m_start"), F.coalesce("b_stop", "stop").alias("m_stop"))


def reconcile(links: DataFrame, master: DataFrame | None = None, min_overlap: int = 200) -> DataFrame:
    """Rename both ends of every link to master regions.

    ``master`` None builds the union master: all ends merged where they share ``min_overlap``
    bases. Adds src_id and dst_id.
    """
    ends = link_ends(links)
    names = most_overlapping(ends, merge_intervals(ends, min_overlap) if master is None else master)
    for e, (s, p) in END.items():
        side = names.select("chrom", F.col("start").alias(s), F.col("stop").alias(p),
                            region_id("chrom", "m_start", "m_stop").alias(f"{e}_id"))
        links = links.join(side, ["chrom", s, p])
    return links


def score_matrix(links: DataFrame, sample: str, samples: list[str], need_all: bool) -> DataFrame:
    """J15 (``need_all``) and J16: one score column per sample for each (src_id, dst_id), gaps 0.

    Several links of a sample that fall on one pair count with their largest score.
    """
    wide = links.groupBy("src_id", "dst_id").pivot(sample, samples).agg(F.max("score"))
    return wide.dropna(subset=samples) if need_all else wide.fillna(0.0, samples)


def best_direction(pairs: DataFrame, score: Column) -> DataFrame:
    """Per unordered pair keep the direction with the highest score, the smaller src_id first in a tie."""
    low, high = F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")
    cols = [c for c in pairs.columns if c not in ("src_id", "dst_id")]
    best = pairs.groupBy(low.alias("p_"), high.alias("q_")).agg(
        F.min(F.struct((-score).alias("s_"), "src_id", "dst_id", *cols)).alias("b_"))
    return best.select("b_.src_id", "b_.dst_id", *[F.col(f"b_.{c}").alias(c) for c in cols])


def canonical_pairs(links: DataFrame, order: Column) -> DataFrame:
    """Of a pair seen in both directions keep the one that comes first in ``order``."""
    low, high = F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")
    first = links.groupBy(low.alias("p_"), high.alias("q_")).agg(F.min(F.struct(order.alias("o_"), "src_id", "dst_id")).alias("b_"))
    return first.select("b_.src_id", "b_.dst_id")


def restore_directions(kept: DataFrame, links: DataFrame) -> DataFrame:
    """W15 tail: all links whose pair was kept, in either direction."""
    both = mirrored(kept.select("src_id", "dst_id"))
    return links.join(both, ["src_id", "dst_id"], "left_semi")


def replicate_consistent(links: DataFrame, pooled: DataFrame, samples: list[str]) -> DataFrame:
    """Links found in pooled and every replicate, on pooled coordinates, one row per pair, best pooled score."""
    both = links.withColumn("sample", F.col("rep")).unionByName(pooled.withColumn("sample", F.lit("pooled")), allowMissingColumns=True)
    named = reconcile(both, master=link_ends(pooled))
    return best_direction(mirrored(score_matrix(named, "sample", ["pooled", *samples], True)), F.col("pooled"))


def timepoint_consistent(links: DataFrame, timepoints: list[str]) -> DataFrame:
    """Links of all timepoints on union coordinates, quantile-normalised, best direction per pair."""
    from regionloom.operators.matrix import quantile_normalise
    wide = score_matrix(reconcile(links), "timepoint", timepoints, False)
    long = wide.unpivot(["src_id", "dst_id"], timepoints, "sample", "value")
    normal = quantile_normalise(long, timepoints).groupBy("src_id", "dst_id").pivot("sample", timepoints).agg(F.max("normalised"))
    return best_direction(mirrored(normal), F.greatest(*timepoints))


def union_signal(links: DataFrame, samples: list[str], sample: str) -> DataFrame:
    """Quantile-normalised scores over the union links, constant rows dropped."""
    from regionloom.operators.matrix import quantile_normalise
    wide = score_matrix(reconcile(links), sample, samples, False)
    long = wide.unpivot(["src_id", "dst_id"], samples, "sample", "value")
    normal = quantile_normalise(long, samples).groupBy("src_id", "dst_id").pivot("sample", samples).agg(F.max("normalised"))
    values = F.array(*samples)
    return normal.filter(F.array_min(values) < F.array_max(values))


def correlate_ends(links: DataFrame, regions: DataFrame, genes: DataFrame, threshold: float, absolute: bool = False) -> DataFrame:
    """Pearson r of the two ends' vectors; links below the threshold or without vectors drop out."""
    a = regions.select(F.col("id").alias("src_id"), F.col("vector").alias("a_"))
    b = genes.select(F.col("id").alias("dst_id"), F.col("vector").alias("b_"))
    scored = links.join(a, "src_id").join(b, "dst_id").withColumn("r", vpearson(F.col("a_"), F.col("b_"))).drop("a_", "b_")
    return scored.filter((F.abs("r") if absolute else F.col("r")) >= threshold)


def linked_genes(regions: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, extend: int = 0,
                 by: list[str] | None = None) -> DataFrame:
    """Region to gene rows: overlap a link's near end, hop to its far end, overlap a TSS.

    Link scores are summed per far end and region first. ``by`` names columns of ``regions``
    (such as the cluster) that travel along, so all clusters run in one job.
    """
    by = by or []
    near = links.select("chrom", F.col("src_start").alias("start"), F.col("src_stop").alias("stop"),
                        "dst_start", "dst_stop", "score")
    hops = overlap_pairs(regions.select(*KEY, *by).withColumn("region_id", region_id()), near)
    ends = hops.groupBy("chrom", F.col("b_dst_start").alias("start"), F.col("b_dst_stop").alias("stop"), "region_id", *by).agg(
        F.sum("b_score").alias("score"), F.count("*").alias("n_links"))
    grown = slop(ends, sizes, extend) if extend else ends
    hits = overlap_pairs(grown, tss.select(*KEY, "gene_id"))
    return hits.groupBy(*by, F.col("b_gene_id").alias("gene_id"), "region_id").agg(
        F.sum("score").alias("score"), F.sum("n_links").alias("n_links"))


def linked_gene_scores(regions: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, extend: int = 0,
                       by: list[str] | None = None) -> DataFrame:
    """Score per gene (and ``by``) of ``linked_genes`` with ``gene_scores``, without its region to gene rows.

    A link's score counts once for each region at its near end, so regions are counted per near end first, all values of
    ``by`` in one array, and the scores added up per TSS position without pairs; pairs with links are made for TSS longer than a base.
    """
    by = by or []
    named = regions.select(*KEY, *by) if by else regions.select(*KEY).withColumn("all_", F.lit(0))
    keys = by or ["all_"]
    folded = named.filter((F.col("stop") > F.col("start")) & F.col("chrom").isNotNull()).groupBy(*KEY, *keys).agg(F.count("*").alias("copies"))
    values = named.groupBy(*keys).agg(longest_items().alias("longest_")).collect()
    reach = [max((v for v in level if v is not None), default=None) for level in zip(*[r["longest_"] for r in values])] or [None]
    numbers = T.StructType([T.StructField("code", T.IntegerType()), *[T.StructField(f"{c}_", named.schema[c].dataType) for c in keys]])
    codes = F.broadcast(regions.sparkSession.createDataFrame([(n, *v[:-1]) for n, v in enumerate(values)], numbers))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]
    far = _far_ends(links.select("chrom", "src_start", "src_stop", "dst_start", "dst_stop", "score"), sizes, extend)
    hop = far.select("chrom", F.col("src_start").alias("start"), F.col("src_stop").alias("stop"),
                     F.col("start").alias("far_start"), F.col("stop").alias("far_stop"), "score")
    ends = near_counts(folded.join(codes, same).select(*KEY, "code", "copies"), hop, len(values), F.array(*[F.lit(v).cast("long") for v in reach]))
    full = tss.filter((F.col("stop") > F.col("start")) & F.col("chrom").isNotNull()).select(*KEY, "gene_id")
    spots = full.filter(F.col("stop") == F.col("start") + 1).select("chrom", F.col("start").alias("place"), "gene_id")
    sums = place_sums(ends, spots, far_levels(hop), len(values)).join(spots, ["chrom", "place"])
    rows = sums.select("gene_id", F.explode(F.arrays_zip("codes", "scores")).alias("x_")).select("gene_id", F.col("x_.codes").alias("code"), F.col("x_.scores").alias("score"))
    long = full.filter(F.col("stop") > F.col("start") + 1)
    if not long.isEmpty():
        pairs = overlap_pairs(ends.withColumnsRenamed({"far_start": "start", "far_stop": "stop"}), long)
        pairs = pairs.select(F.col("b_gene_id").alias("gene_id"), "score", F.posexplode("counts").alias("code", "n_")).filter("n_ > 0")
        rows = rows.unionByName(pairs.select("gene_id", "code", (F.col("score") * F.col("n_")).alias("score")))
    found = rows.groupBy("code", "gene_id").agg(F.sum("score").alias("score"))
    return found.join(codes, "code").select(*[F.col(f"{c}_").alias(c) for c in by], "gene_id", "score")


def _far_ends(links: DataFrame, sizes: DataFrame, extend: int) -> DataFrame:
    """Links with the far end as start and stop, grown by ``extend``; the near end and the score travel along."""
    far = links.select("*", F.col("dst_start").alias("start"), F.col("dst_stop").alias("stop"))
    return slop(far, sizes, extend) if extend else far


def _hop_tables(links: DataFrame, tss: DataFrame, sizes: DataFrame, extend: int) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Links as ``plans.hops`` takes them; genes with one TSS position on a chromosome and its copies; the
    TSS rows of all other genes, None without any; and the links that reach one of these.
    """
    far = _far_ends(links, sizes, extend)
    hop = far.select("chrom", F.col("src_start").alias("start"), F.col("src_stop").alias("stop"),
                     F.col("start").alias("far_start"), F.col("stop").alias("far_stop"), "score")
    full = tss.filter((F.col("stop") > F.col("start")) & F.col("chrom").isNotNull())
    spots = full.groupBy("chrom", "gene_id").agg(F.min("start").alias("place"), F.max("stop").alias("end_"), F.count("*").alias("copies"))
    single = spots.filter(F.col("end_") == F.col("place") + 1).drop("end_")
    several = spots.filter(F.col("end_") > F.col("place") + 1).select("chrom", F.col("gene_id").alias("g_")).distinct()
    if several.isEmpty():
        return hop, single, None, links
    # a null gene is a gene of its own
    rest = full.join(several.withColumnRenamed("chrom", "c_"), (F.col("chrom") == F.col("c_")) & F.col("gene_id").eqNullSafe(F.col("g_")), "left_semi")
    near = overlap_semi(far, rest).select(*links.columns)
    return hop, single, rest, near


def linked_gene_counts(regions: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, extend: int = 0, by: list[str] | None = None,
                       genes: DataFrame | None = None, min_score: float | None = None) -> DataFrame:
    """``gene_scores`` of ``linked_genes``, without the region to gene rows.

    Genes with several TSS positions on a chromosome (or a TSS longer than a base) share regions among them, which
    only the rows tell; these genes alone are listed.
    """
    by = by or []
    if genes is not None:
        tss = tss.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    hop, single, rest, near = _hop_tables(links.select("chrom", "src_start", "src_stop", "dst_start", "dst_stop", "score"), tss, sizes, extend)
    found = reached(regions.select(*KEY, *by), hop, single, by).join(single, ["chrom", "place"])
    rows = found.select(*by, "gene_id", (F.col("score") * F.col("copies")).alias("score"), F.col("n_items").alias("n_regions"))
    if rest is not None:
        rows = rows.unionByName(gene_scores(linked_genes(regions, near, rest, sizes, extend, by), by))
    out = rows.groupBy(*by, "gene_id").agg(F.sum("score").alias("score"), F.sum("n_regions").alias("n_regions"))
    return out if min_score is None else out.filter(F.col("score") > min_score)


def linked_pairs(regions: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, extend: int = 0) -> DataFrame:
    """The gene_id and region_id of ``linked_genes``, each pair once, made at the end without another shuffle."""
    hop, single, rest, near = _hop_tables(links.select("chrom", "src_start", "src_stop", "dst_start", "dst_stop", "score"), tss, sizes, extend)
    out = reached_pairs(regions, hop, single, "gene_id").select("gene_id", region_id().alias("region_id"))
    if rest is None:
        return out
    return out.unionByName(linked_genes(regions, near, rest, sizes, extend).select("gene_id", "region_id"))


def gene_scores(linked: DataFrame, by: list[str] | None = None, genes: DataFrame | None = None,
                min_score: float | None = None) -> DataFrame:
    """Score and number of linked regions per gene, optionally limited to listed genes and a score above a cut.

    A region that reaches a far end through two links counts twice in the score.
    """
    out = linked.groupBy(*(by or []), "gene_id").agg(F.sum("score").alias("score"), F.count("*").alias("n_regions"))
    if genes is not None:
        out = out.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    return out if min_score is None else out.filter(F.col("score") > min_score)


def correlated_genes(genes: DataFrame, gene_vectors: DataFrame, mean_vector: DataFrame, r_min: float, r_sig: float,
                     positive: bool = True, by: list[str] | None = None) -> DataFrame:
    """Keep genes whose vector follows (or opposes) the mean region vector.

    ``r_sig`` is the smallest significant |r| for this vector length; ``mean_vector`` has one
    row per ``by`` group, and goes to all rows, which stay where their gene is.
    """
    rows = genes.join(gene_vectors, "gene_id")
    if by:
        rows = rows.join(F.broadcast(mean_vector), by)
    else:
        single = F.when(F.count("*") > 1, F.raise_error(F.lit("more than one mean vector; name the groups in by"))).otherwise(F.first("mean_vector"))
        rows = rows.join(F.broadcast(mean_vector.agg(single.alias("mean_vector"))))
    rows = rows.withColumn("r", vpearson(F.col("vector"), F.col("mean_vector"))).drop("vector", "mean_vector")
    side = (F.col("r") > r_min) if positive else (F.col("r") < r_min)
    return rows.filter(side & (F.abs("r") >= r_sig))


def cluster_confusion(a: DataFrame, b: DataFrame, universe: int | None = None) -> DataFrame:
    """For each cluster pair the 2x2 table of gene membership and its odds ratio.

    Pair counts come from a join on the gene and are combined before the shuffle; only the
    small grid of cluster pairs is crossed. A zero cell b*c gives a null ratio.
    """
    both = a.select("gene_id", F.col("cluster").alias("a_cluster")).distinct().join(
        b.select("gene_id", F.col("cluster").alias("b_cluster")).distinct(), "gene_id")
    n_both = both.groupBy("a_cluster", "b_cluster").agg(F.count("*").alias("n11"))
    n_a = a.select("gene_id", "cluster").distinct().groupBy(F.col("cluster").alias("a_cluster")).agg(F.count("*").alias("na"))
    n_b = b.select("gene_id", "cluster").distinct().groupBy(F.col("cluster").alias("b_cluster")).agg(F.count("*").alias("nb"))
    total = a.select("gene_id").unionByName(b.select("gene_id")).distinct().agg(F.count("*").alias("n"))
    grid = small_grid(n_a, n_b).join(F.broadcast(total)).join(n_both, ["a_cluster", "b_cluster"], "left").fillna(0, ["n11"])
    n10, n01 = F.col("na") - F.col("n11"), F.col("nb") - F.col("n11")
    n00 = F.col("n") - F.col("na") - F.col("nb") + F.col("n11")
    return grid.select("a_cluster", "b_cluster", "n11", n10.alias("n10"), n01.alias("n01"), n00.alias("n00")).withColumn(
        "odds_ratio", F.try_divide(F.col("n11") * F.col("n00").cast("double"), F.nullif(F.col("n10") * F.col("n01"), F.lit(0))))


def normalised_confusion(confusion: DataFrame) -> DataFrame:
    """A24 tail, W14: rows divided by their sum, then columns by theirs."""
    rows = confusion.groupBy("a_cluster").agg(F.sum("odds_ratio").alias("t_"))
    shared = confusion.join(rows, "a_cluster").withColumn("share", F.col("odds_ratio") / F.col("t_")).drop("t_")
    cols = shared.groupBy("b_cluster").agg(F.sum("share").alias("t_"))
    return shared.join(cols, "b_cluster").withColumn("share", F.col("share") / F.col("t_")).drop("t_")


def undirected_counts(links: DataFrame) -> DataFrame:
    """Links per timepoint, both directions counted once."""
    return links.groupBy("timepoint").agg((F.count("*") / 2).alias("n_links"))


