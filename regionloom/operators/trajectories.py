"""Trajectories: codes, cluster statistics and consistent assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regionloom.functions.tails import chi2_pdf, mvn_density, r_critical, whitening
from regionloom.functions.vectors import vargmax, vpearson, vspearman, vzscore
from regionloom.operators.matrix import vectors
from regionloom.plans.small import small_grid


def ternary_code(contrasts: DataFrame, order: list[str], fdr: float) -> DataFrame:
    """One number per id from its up, flat or down state in each contrast.

    Digit 0 is up, 1 flat, 2 down; the first contrast is the most significant digit.
    """
    state = F.when(F.col("padj") < fdr, F.signum("log2_fold_change").cast("long")).otherwise(0)
    parts = [F.coalesce(F.max(F.when(F.col("contrast") == c, state)), F.lit(0)) for c in order]
    n = len(order)
    code = sum(((1 - p) * 3 ** (n - 1 - i) for i, p in enumerate(parts)), F.lit(0).cast("long"))
    return contrasts.groupBy("id").agg(code.alias("code"))


def align_replicates(signal: DataFrame, points: list) -> DataFrame:
    """The vectors of both replicates and their sum, ids present in both."""
    one = lambda r: vectors(signal.filter(F.col("rep") == r), "id", "t", points, out=f"rep{r[-1]}")
    return one("b1").join(one("b2"), "id").withColumn("pooled", F.zip_with("rep1", "rep2", lambda x, y: x + y))


def cluster_means(rows: DataFrame, n: int, vector: str = "vector") -> DataFrame:
    """Mean vector of each cluster, as an aggregate over the elements."""
    return rows.groupBy("cluster").agg(F.array(*[F.avg(F.element_at(vector, i + 1)) for i in range(n)]).alias("mean"))


def cluster_mean_zscores(rows: DataFrame, n: int) -> DataFrame:
    """Cluster means, z-scored."""
    return cluster_means(rows, n).withColumn("z", vzscore(F.col("mean")))


def cluster_correlation(a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """Pearson r of every pair of cluster mean vectors of two assays."""
    other = cluster_means(b, n).select(F.col("cluster").alias("b_cluster"), F.col("mean").alias("b_mean"))
    pairs = small_grid(cluster_means(a, n).withColumnRenamed("cluster", "a_cluster"), other)
    return pairs.select("a_cluster", "b_cluster", vpearson(F.col("mean"), F.col("b_mean")).alias("r"))


def cluster_stats(rows: DataFrame, n: int, vector: str = "vector") -> DataFrame:
    """Mean vector, covariance (n-1, flattened) and size of each cluster over z-scored rows.

    One aggregate per matrix cell, so the rows are combined before the shuffle.
    """
    z = rows.withColumn("z_", vzscore(F.col(vector))).filter(F.element_at("z_", 1).isNotNull())
    flat = z.select("cluster", *[F.element_at("z_", i + 1).alias(f"z{i}") for i in range(n)])
    cells = {(i, j): F.covar_samp(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)}
    agg = flat.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(f"z{i}").alias(f"m{i}") for i in range(n)], *cells.values())
    cov = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)])
    return agg.select("cluster", "size", F.array(*[F.col(f"m{i}") for i in range(n)]).alias("mean"), cov.alias("cov"))


def drop_null_clusters(stats: DataFrame, n: int, share: float, ci: float) -> DataFrame:
    """Drop small clusters and those whose density at the zero vector is too high; number the rest 1..n."""
    total = stats.agg(F.sum("size").alias("total_"))
    zero = F.array(*[F.lit(0.0)] * n)
    dens = stats.join(F.broadcast(total)).withColumn("white_", whitening("mean", "cov")).withColumn("at_zero", mvn_density(zero, F.col("white_")))
    kept = dens.filter((F.col("size") > share * F.col("total_")) & (F.col("at_zero") <= chi2_pdf(1 - ci, n)))
    # one row per cluster: a small table, so its window is small too
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("cluster"))
    return kept.withColumn("number", number).drop("total_", "at_zero", "white_")


def compare_to_clusters(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Every row next to every cluster's mean."""
    return small_grid(rows, stats.select("cluster", "mean"))


def consistent_clusters(aligned: DataFrame, stats: DataFrame, n: int, density_cut: float, alpha: float = 0.05,
                        epsilon: float = 0.10) -> DataFrame:
    """Soft and hard cluster of each id.

    A cluster is consistent when rep1, rep2 and pooled all pass the density cut and correlate
    significantly by value and by rank. The hard cluster has the best pooled density; soft
    clusters lie within ``epsilon`` of it. Correlations run first, so only pairs that pass them
    meet the cluster's whitening axes.
    """
    names = ["rep1", "rep2", "pooled"]
    z = aligned.select("id", *[vzscore(F.col(c)).alias(c) for c in names])
    pairs = compare_to_clusters(z, stats)
    need = r_critical(n, alpha)
    for c in names:
        pairs = pairs.filter((F.abs(vpearson(F.col(c), F.col("mean"))) >= need) & (F.abs(vspearman(F.col(c), F.col("mean"))) >= need))
    axes = stats.select("cluster", whitening("mean", "cov").alias("white_"))
    pairs = pairs.join(axes, "cluster").select(*pairs.columns, *[mvn_density(F.col(c), F.col("white_")).alias(f"d_{c}") for c in names])
    ok = pairs.filter(F.least(*[F.col(f"d_{c}") for c in names]) >= density_cut)
    per_id = W.partitionBy("id")  # at most one row per cluster
    best = ok.withColumns({
        "best": F.max("d_pooled").over(per_id),
        "hard": F.row_number().over(per_id.orderBy(F.col("d_pooled").desc(), "cluster")) == 1,
    })
    soft = (F.col("best") - F.col("d_pooled")) < epsilon * F.col("best")
    return best.filter(soft | F.col("hard")).select("id", "cluster", F.col("d_pooled").alias("density"), "hard")


def trajectory_job(signal: DataFrame, clusters: DataFrame, points: list, share: float, ci: float, density_cut: float,
                   alpha: float) -> DataFrame:
    """Drop null and small clusters, then assign every id, as one graph."""
    n = len(points)
    aligned = align_replicates(signal, points)
    members = aligned.select("id", F.col("pooled").alias("vector")).join(clusters, "id")
    kept = drop_null_clusters(cluster_stats(members, n), n, share, ci)
    renumbered = kept.select(F.col("number").alias("cluster"), "mean", "cov")
    return consistent_clusters(aligned, renumbered, n, density_cut, alpha)


def cluster_bands(long: DataFrame) -> DataFrame:
    """Mean and the band of two standard deviations per cluster and timepoint."""
    m, s = F.avg("value"), F.stddev_samp("value")
    return long.groupBy("cluster", "t").agg(m.alias("mean"), (m + 2 * s).alias("ci_top"), (m - 2 * s).alias("ci_bottom"))


def order_by_peak(rows: DataFrame, n: int) -> DataFrame:
    """New cluster numbers by the time of the mean trajectory's maximum."""
    peaks = cluster_means(rows, n).withColumn("peak", vargmax(F.col("mean")))
    return peaks.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("peak", "cluster"))).select("cluster", "peak", "number")


