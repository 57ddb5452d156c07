"""Group statistics and tests: A30-A32, A39-A42, A58, A59, A63, A66-A69, A74, A76-A80, A88, U05, S-free tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.link_joins import SIG, vecs
from regionloom.catalog.sqlparts import MEMBERS, fisher_sql
from regionloom.catalog.views import r6
from regionloom.functions.vectors import vpearson
from regionloom.operators import contrasts as ct, matrix, statistics as ss


@query("a30_pearson_rows", f"""
WITH {SIG} SELECT a.id, round(corr(a.value, b.value), 6) + 0.0 AS r FROM sig a JOIN sig b ON a.id = b.id AND a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2' GROUP BY a.id""")
def a30(t):
    b = vecs(t, "b2").withColumnRenamed("vector", "other")
    return vecs(t, "b1").join(b, "id").select("id", r6(vpearson(F.col("vector"), F.col("other")), "r"))


@query("a31_spearman", """
WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rx,
 rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2 AS ry FROM events)
SELECT event_type, round(corr(rx, ry), 6) + 0.0 AS rho FROM r GROUP BY event_type""")
def a31(t):
    return matrix.spearman(t.events.select("event_type", "value", "user_id"), ["event_type"], "value", "user_id").withColumn("rho", r6("rho"))


@query("a32_quantile_normalise", """
WITH l AS (SELECT l_orderkey, l_linenumber, 'q' AS sample, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'p', CASE WHEN l_linenumber < 6 THEN l_extendedprice / 1000 END FROM lineitem
 UNION ALL SELECT l_orderkey, l_linenumber, 'x', CASE WHEN l_suppkey % 9 > 0 THEN l_tax END FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY sample ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY sample) - 1 AS n FROM l WHERE value IS NOT NULL),
v AS (SELECT sample, list(value ORDER BY value) AS vs, max(n) AS n FROM r GROUP BY sample), g AS (SELECT unnest(range(0, (SELECT max(n) + 1 FROM v))) AS g),
x AS (SELECT g, avg(vs[f + 1] + (g * n - f * t) / t * coalesce(vs[f + 2] - vs[f + 1], 0)) AS m FROM (SELECT g, vs, n, t, CAST((g * n) // t AS BIGINT) AS f FROM g, v, (SELECT max(n) AS t FROM v)) GROUP BY g),
ms AS (SELECT list(m ORDER BY g) AS ms, max(g) AS t FROM x), y AS (SELECT l_orderkey, l_linenumber, sample, k * t / n AS place, ms FROM r, ms),
z AS (SELECT l_orderkey, l_linenumber, sample, ms[CAST(floor(place) AS BIGINT) + 1] AS a, ms[CAST(floor(place) AS BIGINT) + 2] AS b, place - floor(place) AS w FROM y)
SELECT l_orderkey, l_linenumber, sample, round(a + w * coalesce(b - a, 0), 6) + 0.0 AS normalised FROM z UNION ALL SELECT l_orderkey, l_linenumber, sample, NULL FROM l WHERE value IS NULL""")
def a32(t):
    price, tax = F.when(F.col("l_linenumber") < 6, F.col("l_extendedprice") / 1000), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_tax"))
    wide = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), price.alias("p"), tax.alias("x"))
    long = wide.unpivot(["l_orderkey", "l_linenumber"], ["q", "p", "x"], "sample", "value")
    return matrix.quantile_normalise(long, ["q", "p", "x"]).select("l_orderkey", "l_linenumber", "sample", r6("normalised"))


@query("a39_expressed_counts", "SELECT t AS timepoint, count(*) FILTER (value > 200) AS n_expressed FROM v_signal GROUP BY t")
def a39(t):
    return matrix.expressed_counts(t.signal.withColumnRenamed("t", "timepoint"), 200)


@query("a40_contrast_pairs", """
WITH p AS (SELECT DISTINCT t, dense_rank() OVER (ORDER BY t) AS i FROM v_signal)
SELECT a.t AS first, b.t AS second, b.i = a.i + 1 AS sequential FROM p a JOIN p b ON a.i < b.i""")
def a40(t):
    return ct.timepoint_pairs(t.signal.select("t").distinct(), "t")


@query("a41_significant_counts", """
SELECT contrast, count(*) FILTER (padj < 0.02 AND log2_fold_change > 0) AS up, count(*) FILTER (padj < 0.02 AND log2_fold_change < 0) AS down FROM v_contrasts GROUP BY contrast""")
def a41(t):
    return ct.significant_counts(t.contrasts, 0.02)


@query("a42_size_factors", """
WITH c AS (SELECT l_partkey AS id, l_linenumber AS sample, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
g AS (SELECT id, avg(ln(n)) AS m FROM c WHERE n > 0 GROUP BY id HAVING count(*) = 7),
f AS (SELECT sample, exp(quantile_cont(ln(n) - m, 0.5)) AS size_factor FROM c JOIN g USING (id) WHERE n > 0 GROUP BY sample)
SELECT id, sample, round(size_factor, 6) AS size_factor, round(log2(n / size_factor + 1), 6) AS log2_signal FROM c JOIN f USING (sample)""")
def a42(t):
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("sample")).agg(F.sum("l_quantity").cast("long").alias("n"))
    out = matrix.log2_normalised(counts, matrix.size_factors(counts, "id", "sample", "n", 7), "sample", "n")
    return out.select("id", "sample", r6("size_factor"), r6("log2_signal"))


PR = """c AS (SELECT score_a, sum(label) AS p, count(*) AS n FROM v_scores GROUP BY 1),
 u AS (SELECT *, sum(p) OVER (ORDER BY score_a DESC) AS tp, sum(n) OVER (ORDER BY score_a DESC) AS nn, sum(p) OVER () AS total FROM c),
 v AS (SELECT *, coalesce(lag(tp / nn) OVER (ORDER BY score_a DESC), 1) AS pp, coalesce(lag(tp / total) OVER (ORDER BY score_a DESC), 0) AS pr FROM u)"""


@query("a58_precision_recall", f"WITH {PR} SELECT score_a, round(tp / nn, 6) AS precision, round(tp / total, 6) AS recall FROM v")
def a58(t):
    out = ss.precision_recall(t.scores, "score_a", "label")
    return out.select("score_a", r6("precision"), r6("recall"))


@query("a58_area_under_curve", f"WITH {PR} SELECT round(sum((tp / total - pr) * (tp / nn + pp) / 2), 6) AS auc FROM v")
def a58_auc(t):
    return ss.area_under_curve(ss.precision_recall(t.scores, "score_a", "label")).select(r6("auc"))


@query("a59_rank_capture", """
WITH l AS (SELECT doc_id, label, 'score_a' AS score_name, score_a AS s FROM v_scores UNION ALL SELECT doc_id, label, 'score_b', score_b FROM v_scores),
r AS (SELECT score_name, row_number() OVER w AS rank, CAST(sum(label) OVER (PARTITION BY score_name ORDER BY s DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS captured FROM l WINDOW w AS (PARTITION BY score_name ORDER BY s DESC, doc_id))
SELECT * FROM r WHERE rank % 10 = 0 AND rank <= 20000""")
def a59(t):
    return ss.rank_capture(t.scores, ["score_a", "score_b"], "doc_id", "label", step=10)


@query("a63_signed_rank", """
WITH d AS (SELECT l_returnflag AS g, l_linenumber AS d2, round(l_quantity - 24, 2) AS d FROM lineitem WHERE l_quantity <> 24),
r AS (SELECT *, rank() OVER (PARTITION BY g, d2 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, d2, abs(d)) - 1) / 2 AS rk FROM d),
t AS (SELECT g, d2, sum(pow(c, 3) - c) AS t FROM (SELECT g, d2, abs(d), count(*) AS c FROM d GROUP BY ALL) GROUP BY ALL),
s AS (SELECT g, d2, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_up, coalesce(sum(rk) FILTER (d < 0), 0) AS w_down FROM r GROUP BY ALL)
SELECT s.g, s.d2, n, w_up, w_down, round((least(w_up, w_down) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1.0) - t / 2) / 24), 6) + 0.0 AS z FROM s JOIN t ON s.g = t.g AND s.d2 = t.d2""")
def a63(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("d2"), (F.col("l_quantity") - 24).alias("d"))
    return ss.signed_rank(rows, ["g", "d2"], "d").withColumn("z", r6("z"))


@query("a63_rank_sum", """
WITH r AS (SELECT event_type, user_id % 2 = 0 AS side, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2 AS rk FROM events),
s AS (SELECT event_type, CAST(count(*) FILTER (side) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT side) AS DOUBLE) AS n2, sum(rk) FILTER (side) AS s FROM r GROUP BY event_type)
SELECT event_type, n1, n2, round((s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) + 0.0 AS z FROM s""")
def a63_rank_sum(t):
    rows = t.events.select("event_type", "value", (F.col("user_id") % 2 == 0).alias("side"))
    return ss.rank_sum(rows, ["event_type"], "side", "value").withColumn("z", r6("z"))


@query("a63_one_sample_t", """
SELECT event_type, count(*) AS n, round(avg(value - 80), 6) + 0.0 AS mean, round(avg(value - 80) / (stddev_samp(value - 80) / sqrt(count(*))), 6) + 0.0 AS t FROM events GROUP BY event_type""")
def a63_t(t):
    out = ss.one_sample_t(t.events.select("event_type", (F.col("value") - 80).alias("v")), ["event_type"], "v")
    return out.select("event_type", "n", r6("mean"), r6("t"))


#: Two-sided tails by series over gamma functions. Normal: of 1/2 - Q; t: of the incomplete beta at t^2 / (df + t^2).
NORMAL_P = "1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(z) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) for k in range(0, 400)])"
STUDENT_P = """1 - exp(0.5 * ln(y) + df / 2 * ln(1 - y) + lgamma(df / 2 + 0.5) - lgamma(df / 2) - lgamma(0.5)) / 0.5
 * list_sum([exp(lgamma(df / 2 + 0.5 + k) - lgamma(df / 2 + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(y)) for k in range(0, 600)])"""


@query("u05_test_p_values", f"""
WITH d AS (SELECT event_type AS g, value - 80 AS d FROM events), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0),
t AS (SELECT g, sum(pow(c, 3) - c) AS t FROM (SELECT g, abs(d), count(*) AS c FROM d WHERE d <> 0 GROUP BY ALL) GROUP BY g),
s AS (SELECT g, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS up, coalesce(sum(rk) FILTER (d < 0), 0) AS down FROM r GROUP BY g),
z AS (SELECT s.g, abs((least(up, down) - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1.0) - t / 2) / 24)) AS z FROM s JOIN t ON s.g = t.g),
o AS (SELECT g, count(*) - 1 AS df, pow(avg(d) / (stddev_samp(d) / sqrt(count(*))), 2) AS t2 FROM d GROUP BY g), y AS (SELECT g, df, t2 / (df + t2) AS y FROM o)
SELECT g AS event_type, 'signed_rank' AS test, round(CASE WHEN z > 8 THEN 0 ELSE {NORMAL_P} END, 6) + 0.0 AS p_value FROM z UNION ALL SELECT g, 't', round({STUDENT_P}, 6) + 0.0 FROM y""")
def u05(t):
    rows = t.events.select("event_type", (F.col("value") - 80).alias("v"))
    z = ss.with_p_values(ss.signed_rank(rows, ["event_type"], "v"), "z").select("event_type", F.lit("signed_rank").alias("test"), "p_value")
    p = ss.with_p_values(ss.one_sample_t(rows, ["event_type"], "v"), "t").select("event_type", F.lit("t").alias("test"), "p_value")
    return z.unionByName(p).withColumn("p_value", r6("p_value"))


LISTED = "SELECT DISTINCT id AS gene_id FROM v_contrasts WHERE padj < 0.01 AND contrast = 'd6_over_d0'"


@query("a66_set_overlaps", f"""
WITH l AS ({LISTED}), u AS (SELECT gene_id FROM v_tss), m AS (SELECT set_name, gene_id FROM v_gene_sets WHERE gene_id IN (SELECT gene_id FROM u)), lu AS (SELECT gene_id FROM l WHERE gene_id IN (SELECT gene_id FROM u))
SELECT set_name, count(*) FILTER (gene_id IN (SELECT gene_id FROM lu)) AS n_both, count(*) AS n_set, (SELECT count(*) FROM lu) AS n_list, (SELECT count(*) FROM u) AS n_total
FROM m GROUP BY set_name HAVING n_both > 0""")
def a66(t):
    genes = t.contrasts.filter("padj < 0.01 and contrast = 'd6_over_d0'").select(F.col("id").alias("gene_id"))
    return ss.over_representation(genes, t.tss, t.gene_sets).select("set_name", "n_both", "n_set", "n_list", "n_total")


@query("a66_over_representation", f"""
WITH {MEMBERS}, l AS (SELECT DISTINCT contrast, id AS gene_id FROM v_contrasts WHERE padj < 0.01 AND id IN (SELECT gene_id FROM u)),
h AS (SELECT contrast, set_name, count(*) AS n_both FROM l JOIN m USING (gene_id) GROUP BY ALL),
n AS (SELECT contrast, set_name, n_both, s.n_set, k.n_list, (SELECT count(*) FROM u) AS n_total FROM h JOIN (SELECT set_name, count(*) AS n_set FROM m GROUP BY ALL) s USING (set_name)
 JOIN (SELECT contrast, count(*) AS n_list FROM l GROUP BY ALL) k USING (contrast)),
p AS (SELECT *, {fisher_sql('n_both', 'n_list', 'n_set', 'n_total')} AS p_value FROM n), r AS (SELECT *, count(*) OVER (PARTITION BY contrast ORDER BY p_value) AS k, count(*) OVER (PARTITION BY contrast) AS c FROM p)
SELECT contrast, set_name, n_both, n_set, n_list, n_total, round(p_value, 6) + 0.0 AS p_value, round(min(least(1, p_value * c / k)) OVER (PARTITION BY contrast ORDER BY p_value DESC), 5) AS q_value FROM r""")
def a66_p(t):
    genes = t.contrasts.filter("padj < 0.01").select(F.col("id").alias("gene_id"), "contrast")
    out = ss.over_representation(genes, t.tss, t.gene_sets, ["contrast"])
    return out.withColumns({"p_value": r6("p_value"), "q_value": F.round("q_value", 5)})


@query("a66_ordered_query", f"""
WITH {MEMBERS}, l AS (SELECT id AS gene_id, row_number() OVER (ORDER BY padj, id) AS rank FROM v_contrasts WHERE contrast = 'd6_over_d0' AND id IN (SELECT gene_id FROM u)),
h AS (SELECT set_name, rank, row_number() OVER (PARTITION BY set_name ORDER BY rank) AS n_both FROM l JOIN m USING (gene_id)), s AS (SELECT set_name, count(*) AS n_set FROM m GROUP BY ALL),
n AS (SELECT *, (SELECT count(*) FROM u) AS n_total FROM h JOIN s USING (set_name)),
p AS (SELECT set_name, rank, {fisher_sql('n_both', 'rank', 'n_set', 'n_total')} AS p FROM n)
SELECT set_name, round(min(p), 6) + 0.0 AS p_value, arg_min(rank, p) AS prefix FROM p GROUP BY set_name""")
def a66_ordered(t):
    genes = t.contrasts.filter("contrast = 'd6_over_d0'").select(F.col("id").alias("gene_id"), F.col("padj").alias("position"))
    return ss.ordered_over_representation(genes, t.tss, t.gene_sets).withColumn("p_value", r6("p_value"))


@query("a67_enrichment_score", """
WITH r AS (SELECT contrast, id AS gene_id, row_number() OVER (PARTITION BY contrast ORDER BY log2_fold_change DESC, id) AS rk, count(*) OVER (PARTITION BY contrast) AS n FROM v_contrasts),
h AS (SELECT contrast, set_name, rk, n, row_number() OVER (PARTITION BY contrast, set_name ORDER BY rk) AS j, count(*) OVER (PARTITION BY contrast, set_name) AS nh FROM r JOIN v_gene_sets USING (gene_id)),
s AS (SELECT contrast, set_name, nh, j / nh - (rk - j) / (n - nh) AS a, (j - 1) / nh - (rk - j) / (n - nh) AS b FROM h WHERE nh BETWEEN 15 AND 1000),
e AS (SELECT contrast, set_name, any_value(nh) AS n_hit, max(greatest(a, b)) AS hi, min(least(a, b)) AS lo FROM s GROUP BY ALL)
SELECT contrast, set_name, n_hit, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es FROM e""")
def a67(t):
    genes = t.contrasts.withColumnRenamed("id", "gene_id")
    return ss.enrichment_score(genes, t.gene_sets, "contrast", "log2_fold_change").withColumn("es", r6("es"))


@query("a68_benjamini_hochberg", """
WITH p AS (SELECT id, contrast, padj + 0.001 AS p FROM v_contrasts), r AS (SELECT *, count(*) OVER (PARTITION BY contrast ORDER BY p) AS k, count(*) OVER (PARTITION BY contrast) AS n FROM p)
SELECT id, contrast, round(min(least(1, p * n / k)) OVER (PARTITION BY contrast ORDER BY p DESC), 6) AS q FROM r""")
def a68(t):
    rows = t.contrasts.select("id", "contrast", (F.col("padj") + 0.001).alias("p"))
    return ss.benjamini_hochberg(rows, "p", ["contrast"]).select("id", "contrast", r6("q"))


@query("a69_best_correlations", f"""
WITH {SIG}, r AS (SELECT cluster, a.id, abs(corr(a.value, b.value)) AS r FROM sig a JOIN sig b ON a.id = b.id AND a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2' JOIN v_clusters c ON c.id = a.id GROUP BY ALL),
x AS (SELECT cluster, max(r) AS r FROM r WHERE cluster < 5 GROUP BY 1), y AS (SELECT cluster, max(r) AS r FROM r WHERE cluster > 1 AND r < 0.5 GROUP BY 1)
SELECT cluster, round(coalesce(x.r, 0), 6) AS r_a, round(coalesce(y.r, 0), 6) AS r_b FROM x FULL JOIN y USING (cluster)""")
def a69(t):
    b = vecs(t, "b2").withColumnRenamed("vector", "other")
    r = vecs(t, "b1").join(b, "id").join(t.clusters, "id").select("cluster", F.abs(vpearson(F.col("vector"), F.col("other"))).alias("r"))
    out = ct.best_of_two(r.filter("cluster < 5"), r.filter("cluster > 1 and r < 0.5"), "cluster", "r")
    return out.select("cluster", r6("r_a"), r6("r_b"))


SAMPLES = [f"t{i}_{r}" for i in range(10) for r in ("b1", "b2")]


def sample_rows(t):
    return t.signal.select("id", F.concat(F.lit("t"), "t", F.lit("_"), "rep").alias("sample"), "value")


@query("a74_sample_correlation", """
WITH s AS (SELECT id, concat('t', CAST(t AS VARCHAR), '_', rep) AS sample, value FROM v_signal)
SELECT x.sample AS a, y.sample AS b, round(corr(x.value, y.value), 6) + 0.0 AS r, round(corr(x.value, y.value) * corr(x.value, y.value), 6) AS r2 FROM s x JOIN s y ON x.id = y.id AND x.sample <= y.sample GROUP BY ALL""")
def a74(t):
    out = matrix.correlation_matrix(sample_rows(t), "id", "sample", SAMPLES, "value")
    return out.select("a", "b", r6("r"), r6("r2"))


@query("a76_replicate_quality", f"""
WITH {SIG}, p AS (SELECT a.t, a.value AS x, b.value AS y FROM sig a JOIN sig b ON a.id = b.id AND a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2'),
r AS (SELECT *, rank() OVER (PARTITION BY t ORDER BY x) + (count(*) OVER (PARTITION BY t, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY t ORDER BY y) + (count(*) OVER (PARTITION BY t, y) - 1) / 2 AS ry FROM p)
SELECT CAST(t AS INT) AS t, round(sum(x), 4) AS total_1, round(sum(y), 4) AS total_2, round(corr(x, y), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman FROM r GROUP BY t""")
def a76(t):
    both = vecs(t, "b1").join(vecs(t, "b2").withColumnRenamed("vector", "other"), "id")
    long = both.select(F.posexplode(F.arrays_zip("vector", "other")).alias("t", "z")).select("t", F.col("z.vector").alias("x"), F.col("z.other").alias("y"))
    out = ss.replicate_quality(long, "t", "x", "y")
    return out.select("t", F.round("total_1", 4).alias("total_1"), F.round("total_2", 4).alias("total_2"), r6("pearson"), r6("spearman"))


@query("a77_sample_pca")
def a77(t):
    return ss.sample_pca(sample_rows(t).groupBy("id", "sample").agg(F.sum("value").alias("value")), "id", "sample", SAMPLES, "value", 0.3)


@query("a78_classifier_curve")
def a78(t):
    share = lambda chars: F.length(F.regexp_replace("text", f"[^{chars}]", "")) / F.greatest(F.length("text"), F.lit(1))
    features = {"length": F.log1p(F.length("text").cast("double")), "capitals": share(r"\p{Lu}"), "symbols": share(r"!*$#&%|"), "spaces": share(r"\s")}
    rows = t.documents.join(t.labels, "doc_id").select(
        "doc_id", F.col("quality").cast("double").alias("label"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in features.items()])
    return ss.classifier_curves(rows, "doc_id", {"features": list(features), "baseline": ["length"]}, "label")


@query("a79_lasso_r2")
def a79(t):
    rows = t.lineitem.select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("target"))
    return ss.lasso_r2(rows, ["l_quantity", "l_discount", "l_tax"], "target")


@query("a80_mean_and_error", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS se, count(value) AS n FROM events GROUP BY event_type""")
def a80(t):
    return ss.mean_and_error(t.events, ["event_type"], "value").select("event_type", r6("mean"), r6("se"), "n")


@query("a88_feature_shares", """
WITH s AS (SELECT id, t, rep, n / sum(n) OVER (PARTITION BY t, rep) AS share FROM v_signal)
SELECT id, t, rep, round(share, 6) AS share, round((share - avg(share) OVER (PARTITION BY id)) / stddev_samp(share) OVER (PARTITION BY id), 6) + 0.0 AS scaled FROM s""")
def a88(t):
    rows = t.signal.withColumn("sample", F.concat_ws("_", "t", "rep"))
    return matrix.feature_shares(rows, "id", "sample", "n").select("id", "t", "rep", r6("share"), r6("scaled"))
