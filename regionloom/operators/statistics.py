"""Group statistics and tests (A58, A59, A63, A66-A68, A76-A81, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.functions.tails import fisher_bounds, fisher_greater, normal_two_sided, student_two_sided
from regionloom.plans.scan import PART, Running, carried, carried_all, numbered, ordered_parts, running_all, value_ranks, with_avg_rank
from regionloom.session import checkpointed


def precision_recall(df: DataFrame, score: str, label: str, group: list[str] | None = None) -> DataFrame:
    """Precision and recall at every distinct score, from high to low.

    Each row also carries the trapezoid below the curve back to the previous score, which is
    known from the row's own counts, so no row has to look at its neighbour.
    """
    group = group or []
    counts = df.groupBy(*group, score).agg(F.sum(label).cast("long").alias("pos_"), F.count("*").alias("n_"))
    pos = F.col("pos_")
    cum = running_all(counts, group, [f"-{score}"], [
        Running(pos, "sum", "tp"), Running(F.col("n_"), "sum", "n_upto"), Running(pos, "total", "total_")])
    prev_tp, prev_n = F.col("tp") - F.col("pos_"), F.col("n_upto") - F.col("n_")
    all_pos = F.nullif(F.col("total_"), F.lit(0))
    before = F.when(prev_n == 0, F.lit(1.0)).otherwise(prev_tp / F.nullif(prev_n, F.lit(0)))
    return cum.select(
        *group, score, (F.col("tp") / F.col("n_upto")).alias("precision"), (F.col("tp") / all_pos).alias("recall"),
        (F.col("pos_") / all_pos * (F.col("tp") / F.col("n_upto") + before) / 2).alias("area"))


def area_under_curve(curve: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Area under the precision-recall curve."""
    return curve.groupBy(*(group or [])).agg(F.sum("area").alias("auc"))


def rank_capture(df: DataFrame, scores: list[str], tie: str, label: str, step: int = 100, top: int = 20000) -> DataFrame:
    """Labels captured in the first r rows of each score's ranking, every ``step`` ranks up to ``top``."""
    long = df.unpivot([tie, label], scores, "score_name", "score")
    ranked = running_all(long, ["score_name"], ["-score", tie], [
        Running(F.lit(1).cast("long"), "sum", "rank"), Running(F.col(label).cast("long"), "sum", "captured")])
    return ranked.filter((F.col("rank") % step == 0) & (F.col("rank") <= top)).select("score_name", "rank", "captured")


def benjamini_hochberg(df: DataFrame, p: str, group: list[str] | None = None, out: str = "q") -> DataFrame:
    """Adjusted p-values: p*n/rank, then the running minimum from the largest p down.

    The rows themselves are put in order, so none is joined back by its value. Among ties the last
    has the smallest p*n/rank, and all of them see it. Rows without a p-value are not ranked and stay, without
    an adjusted one.
    """
    group, one = group or [], F.lit(1).cast("long")
    rows = df.filter(F.col(p).isNotNull()).withColumn("h_", F.xxhash64(*df.columns))
    parts = ordered_parts(rows, [*group, p, "h_"])
    ranked = carried_all(parts, group, PART, [p, "h_"], [Running(one, "sum", "k_"), Running(one, "total", "n_")])
    raw = F.least(F.lit(1.0), F.col(p) * F.col("n_") / F.col("k_"))
    found = carried(ranked, group, PART, ["k_"], raw, "min", out, reverse=True).select(*df.columns, out)
    return found.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def significance_class(q: Column) -> Column:
    """A68 tail: category of a q-value."""
    return F.when(q < 0.01, "strong").when(q < 0.05, "moderate").when(q < 0.1, "weak").otherwise("none")


def over_representation(genes: DataFrame, background: DataFrame, sets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Overlap of gene lists with gene sets inside a background, hypergeometric p and BH-adjusted p.

    ``genes`` may hold many lists, keyed by ``by``.
    """
    by = by or []
    universe = background.select("gene_id").distinct()
    members = sets.join(universe, "gene_id", "left_semi").select("set_name", "gene_id").distinct()
    listed = genes.select(*by, "gene_id").distinct().join(universe, "gene_id", "left_semi")
    # a row per gene and set, and one per gene for the list itself, counted in one pass and kept, as the lists are the large part
    marked = members.withColumn("own_", F.lit(1)).unionByName(universe.withColumn("own_", F.lit(0)), allowMissingColumns=True)
    counted = checkpointed(listed.join(marked, "gene_id").groupBy(*by, "own_", "set_name").agg(F.count("*").alias("n_")))
    hits = counted.filter("own_ = 1").select(*by, "set_name", F.col("n_").alias("n_both"))
    set_size = members.groupBy("set_name").agg(F.count("*").alias("n_set"))
    list_size = counted.filter("own_ = 0").select(*by, F.col("n_").alias("n_list"))
    total = universe.agg(F.count("*").alias("n_total"))
    rows = hits.join(set_size, "set_name")
    rows = (rows.join(list_size, by) if by else rows.join(F.broadcast(list_size))).join(F.broadcast(total))
    tested = rows.withColumn("p_value", fisher_greater(
        "n_both", F.col("n_list") - F.col("n_both"), F.col("n_set") - F.col("n_both"),
        F.col("n_total") - F.col("n_list") - F.col("n_set") + F.col("n_both")))
    return benjamini_hochberg(tested, "p_value", by, "q_value")


def ordered_over_representation(genes: DataFrame, background: DataFrame, sets: DataFrame) -> DataFrame:
    """A66, ordered query: for each set the prefix of the ranked list with the smallest p.

    Only prefixes that end at a member of the set can be best; a set's members are as many
    rows as the set has genes. Bounds of each prefix's p come first, and the p itself, a sum that is longer for
    larger sets, only where its lower bound is not above the smallest upper bound of the set.
    """
    universe = background.select("gene_id").distinct()
    members = sets.join(universe, "gene_id", "left_semi").select("set_name", "gene_id").distinct()
    ranked = numbered(genes.join(universe, "gene_id", "left_semi").select("gene_id", "position"), [], ["position", "gene_id"], "rank")
    per_set = W.partitionBy("set_name").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    hits = ranked.join(members, "gene_id").withColumn("n_both", F.count("*").over(per_set))
    set_size = members.groupBy("set_name").agg(F.count("*").alias("n_set"))
    total = universe.agg(F.count("*").alias("n_total"))
    table = ("n_both", F.col("rank") - F.col("n_both"), F.col("n_set") - F.col("n_both"),
             F.col("n_total") - F.col("rank") - F.col("n_set") + F.col("n_both"))
    rows = hits.join(set_size, "set_name").join(F.broadcast(total)).withColumn("in_", fisher_bounds(*table))
    least = F.min("in_.high").over(W.partitionBy("set_name"))
    rows = rows.withColumn("least_", least).filter(F.col("in_").isNull() | (F.col("in_.low") <= F.col("least_")))
    rows = rows.withColumn("p_value", fisher_greater(*table))
    return rows.groupBy("set_name").agg(F.min("p_value").alias("p_value"), F.min(F.struct("p_value", "rank")).getField("rank").alias("prefix"))


def enrichment_score(ranked: DataFrame, sets: DataFrame, group: str, score: str, low: int = 15, high: int = 1000) -> DataFrame:
    """Classic pre-ranked enrichment score per gene set and contrast, stacked over contrasts.

    The running sum peaks at a member or just before one, so only member ranks are needed;
    sets are limited to ``low``..``high`` ranked members first.
    """
    ranks = numbered(ranked.select(group, "gene_id", score), [group], [F.col(score).desc(), F.col("gene_id")], "rank")
    n_all = ranks.groupBy(group).agg(F.count("*").alias("n_all"))
    hits = ranks.select(group, "gene_id", "rank").join(sets.select("set_name", "gene_id").distinct(), "gene_id")
    sizes = hits.groupBy(group, "set_name").agg(F.count("*").alias("n_hit")).filter(F.col("n_hit").between(low, high))
    kept = hits.join(sizes, [group, "set_name"]).join(n_all, group)
    j = F.row_number().over(W.partitionBy(group, "set_name").orderBy("rank"))  # at most ``high`` rows
    steps = kept.withColumn("j", j)
    miss = (F.col("rank") - F.col("j")) / (F.col("n_all") - F.col("n_hit"))
    after, before = F.col("j") / F.col("n_hit") - miss, (F.col("j") - 1) / F.col("n_hit") - miss
    far = F.max(F.greatest(after, before)), F.min(F.least(after, before))
    out = steps.groupBy(group, "set_name").agg(far[0].alias("hi"), far[1].alias("lo"), F.first("n_hit").alias("n_hit"))
    return out.select(group, "set_name", "n_hit", F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("es"))


def signed_rank(df: DataFrame, group: list[str], diff: str) -> DataFrame:
    """Wilcoxon signed-rank of the differences per group (zeros left out), normal approximation with tie correction."""
    rows = df.filter((F.col(diff) != 0)).select(*group, F.abs(F.col(diff)).alias("a_"), (F.col(diff) > 0).alias("up_"))
    # a rank times the rows that share it, by sign: no row is joined back to its rank
    ranks = value_ranks(rows.dropna(subset=group) if group else rows, group, "a_", also=[F.count_if("up_").alias("n_up")])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = ranks.groupBy(*group).agg(
        total("n_ties").alias("n"), F.sum(F.col("avg_rank") * F.col("n_up")).alias("w_up"),
        F.sum(F.col("avg_rank") * (F.col("n_ties") - F.col("n_up"))).alias("w_down"),
        F.sum(F.pow("n_ties", F.lit(3)) - F.col("n_ties")).alias("t_"))
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("t_") / 2) / 24)
    return sums.withColumn("z", (F.least("w_up", "w_down") - n * (n + 1) / 4) / F.nullif(se, F.lit(0.0))).drop("t_")


def rank_sum(df: DataFrame, group: list[str], side: str, value: str) -> DataFrame:
    """Rank-sum statistic of side True against side False per group."""
    ranked = with_avg_rank(df.filter(F.col(value).isNotNull()), group, value, "r_")
    sums = ranked.groupBy(*group).agg(
        F.count_if(F.col(side)).cast("double").alias("n1"), F.count_if(~F.col(side)).cast("double").alias("n2"),
        F.sum(F.when(F.col(side), F.col("r_")).otherwise(0.0)).alias("s_"))
    n1, n2 = F.col("n1"), F.col("n2")
    return sums.withColumn("z", (F.col("s_") - n1 * (n1 + n2 + 1) / 2) / F.nullif(F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), F.lit(0.0))).drop("s_")


def one_sample_t(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """T statistic of the mean against 0 per group."""
    out = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("t", F.col("mean") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0)))


def with_p_values(tests: DataFrame, kind: str) -> DataFrame:
    """Two-sided p next to a z or t statistic."""
    return tests.withColumn("p_value", normal_two_sided("z") if kind == "z" else student_two_sided("t", (F.col("n") - 1).cast("double")))


def replicate_quality(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Totals, Pearson and Spearman of two replicates per timepoint."""
    ranked = with_avg_rank(with_avg_rank(df, [group], x, "rx_"), [group], y, "ry_")
    return ranked.groupBy(group).agg(
        F.sum(x).alias("total_1"), F.sum(y).alias("total_2"), F.corr(x, y).alias("pearson"), F.corr("rx_", "ry_").alias("spearman"))


def mean_and_error(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean and standard error per group."""
    return df.groupBy(*group).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n"))


def sample_pca(long: DataFrame, key: str, sample: str, samples: list[str], value: str, cv_share: float = 0.66) -> DataFrame:
    """Principal components of samples over the most variable features.

    Features above the ``cv_share`` percentile of the coefficient of variation are scaled; the
    sample by sample Gram matrix is summed by Spark, and only that small matrix is decomposed.
    """
    import numpy as np
    from regionloom.operators.transforms import exact_percentiles
    spread = long.groupBy(key).agg(F.avg(value).alias("m_"), F.stddev_samp(value).alias("s_"), F.count("*").alias("n_"))
    spread = spread.filter((F.col("n_") == len(samples)) & (F.col("s_") > 0) & (F.col("m_") != 0)).withColumn("cv_", F.col("s_") / F.col("m_"))
    cut = exact_percentiles(spread, [], "cv_", {"cut_": cv_share})
    kept = spread.join(F.broadcast(cut)).filter(F.col("cv_") > F.col("cut_"))
    scaled = long.join(kept, key).select(key, sample, ((F.col(value) - F.col("m_")) / F.col("s_")).alias("x"))
    wide = scaled.groupBy(key).pivot(sample, samples).agg(F.max("x"))
    cells = [(i, j) for i in range(len(samples)) for j in range(i, len(samples))]
    row = wide.agg(*[F.sum(F.col(f"`{samples[i]}`") * F.col(f"`{samples[j]}`")).alias(f"g{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((len(samples), len(samples)))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"] or 0.0
    values, axes = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, axes = np.clip(values[order], 0, None), axes[:, order]
    share = values / values.sum()
    rows = [(s, k + 1, float(axes[i, k] * np.sqrt(values[k])), float(share[k])) for i, s in enumerate(samples) for k in range(min(3, len(samples)))]
    return long.sparkSession.createDataFrame(rows, "sample string, component int, position double, variance_share double")


def classify(df: DataFrame, key: str, features: list[str], label: str, folds: int = 5, test_fold: int = 0) -> DataFrame:
    """Logistic classifier on all folds but one; label, fold and score of that fold's rows.

    A row's fold is a hash of its key, so it stays the same for every model and rerun. A null feature is an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rows = VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="error").transform(df)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int"))
    model = LogisticRegression(featuresCol="features_", labelCol=label).fit(rows.filter(F.col("fold") != test_fold))
    scored = model.transform(rows.filter(F.col("fold") == test_fold))
    return scored.select(*df.columns, "fold", vector_to_array("probability")[1].alias("score"))


def classifier_curves(df: DataFrame, key: str, models: dict[str, list[str]], label: str, steps: int = 100) -> DataFrame:
    """Precision and recall of several feature sets (the model and its baseline) on one held-out fold.

    Curves are thinned to at most ``steps`` points per model: the last point of each equal stretch.
    """
    scored = None
    for name, features in models.items():
        part = classify(df, key, features, label).select(F.lit(name).alias("model"), "fold", F.col(label).alias("label"), "score")
        scored = part if scored is None else scored.unionByName(part)
    group = ["model", "fold"]
    curve = numbered(precision_recall(scored, "score", "label", group), group, [F.col("score").desc()], "place_")
    sizes = curve.groupBy(*group).agg(F.count("*").alias("n_"))
    upto = lambda place: F.floor(place * steps / F.greatest(F.col("n_"), F.lit(steps)))
    kept = curve.join(sizes, group).filter(upto(F.col("place_")) > upto(F.col("place_") - 1))
    return kept.select(*group, "score", "precision", "recall")


def _moments(rows: DataFrame, columns: list[str], fold: Column, shift: list[float]) -> dict:
    """Per fold the number of rows and the sums and products of the columns, counted from ``shift``."""
    import numpy as np
    size, x = len(columns), [F.col(c) - s for c, s in zip(columns, shift)]
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(c) for c in x] + [F.sum(x[i] * x[j]) for i, j in cells]
    out = {}
    for row in rows.groupBy(fold.alias("fold_")).agg(F.count("*").alias("n_"), *sums).collect():
        total = np.zeros((size + 1, size + 1))
        total[size, size] = row["n_"]
        total[size, :size] = total[:size, size] = row[2:2 + size]
        for (i, j), v in zip(cells, row[2 + size:]):
            total[i, j] = total[j, i] = v
        out[row["fold_"]] = total
    return out


def _lasso(total, penalty: float):
    """Coefficients that minimise half the mean squared error plus the penalty on those of scaled columns; the last is the intercept.

    ``total`` holds sums of products of the features, the target and 1. Coordinate descent on the small matrix.
    """
    import numpy as np
    k, n = len(total) - 2, total[-1, -1]
    mean = total[-1, :-1] / n
    cov = total[:-1, :-1] / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(cov)[:k], 0, None))
    beta = np.zeros(k)
    for _ in range(10_000):
        before = beta.copy()
        for j in np.flatnonzero(scale):
            pull = cov[j, k] - cov[j, :k] @ beta + cov[j, j] * beta[j]
            beta[j] = np.sign(pull) * max(abs(pull) - penalty * scale[j], 0.0) / cov[j, j]
        if np.abs((beta - before) * scale).max(initial=0.0) <= 1e-12 * np.sqrt(max(cov[k, k], 0.0)):
            break
    return np.append(beta, mean[k] - mean[:k] @ beta)


def _r2(total, fitted) -> float:
    """R squared of coefficients on rows known by their moments."""
    import numpy as np
    k, n = len(total) - 2, total[-1, -1]
    error = np.concatenate([-fitted[:k], [1.0], -fitted[k:]])
    return float(1 - error @ total @ error / (total[k, k] - total[-1, k] ** 2 / n))


def lasso_r2(df: DataFrame, features: list[str], target: str, seed: int = 42, folds: int = 5) -> DataFrame:
    """Cross-validated lasso; R squared on the held-out fifth. A null or NaN is an error.

    The fits of all folds and penalties and their errors follow from sums of products, for which the training rows are
    read once; only the model with the best penalty is fitted and judged on the rows themselves.
    """
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    columns = [*features, target]
    valid = df.select(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"null or NaN in {c}")))
                        .otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
    shift = [float(v or 0.0) for v in valid.agg(*[F.avg(c) for c in columns]).first()]
    train, test = valid.randomSplit([0.8, 0.2], seed)
    fold = F.lit(0)
    for i in range(1, folds):
        fold = F.when(F.col("u_") >= i * (1.0 / folds), i).otherwise(fold)
    parts = _moments(train.withColumn("u_", F.rand(seed)), columns, fold, shift)
    whole = sum(parts.values())
    score = lambda penalty: sum(_r2(parts[f], _lasso(whole - parts[f], penalty)) for f in parts) / len(parts)
    best = max([0.001, 0.01, 0.1], key=score)
    vectors = VectorAssembler(inputCols=features, outputCol="features_", handleInvalid="error")
    model = LinearRegression(featuresCol="features_", labelCol=target, elasticNetParam=1.0, regParam=best).fit(vectors.transform(train))
    r2 = RegressionEvaluator(labelCol=target, metricName="r2").evaluate(model.transform(vectors.transform(test)))
    return df.sparkSession.createDataFrame([(float(r2), best)], "r2 double, reg_param double")
