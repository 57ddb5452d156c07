"""Windows, sorts, limits and reshaping: W03-W16, L01-L08, R01-R05."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.link_joins import POOLED, SIG, pooled_vecs
from regionloom.catalog.views import r6
from regionloom.operators import matrix, ordering as od
from regionloom.plans.bins import KEY
from regionloom.plans.scan import carried, with_avg_rank


@query("w03_row_of_max", """
SELECT timepoint, name, signal_value, chrom FROM v_peaks QUALIFY row_number() OVER (PARTITION BY timepoint, chrom ORDER BY signal_value DESC, name) = 1""")
def w03(t):
    return od.row_of_max(t.peaks.select("timepoint", "chrom", "name", "signal_value"), ["timepoint", "chrom"], "signal_value", ["name"])


@query("w04_running_reach", """
WITH d AS (SELECT chrom, start, max(stop) AS stop FROM v_peaks GROUP BY chrom, start)
SELECT chrom, start, max(stop) OVER (PARTITION BY chrom ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d""")
def w04(t):
    heads = t.peaks.groupBy("chrom", "start").agg(F.max("stop").alias("stop")).withColumn("bin_", F.shiftright("start", 16))
    out = carried(heads, ["chrom"], "bin_", ["start"], F.col("stop"), "max", "reach", inclusive=False)
    return out.select("chrom", "start", "reach")


@query("w05_top_percent", """
WITH m AS (SELECT id, max(base_mean) AS max FROM v_contrasts GROUP BY id)
SELECT id, round(max, 6) AS max FROM m QUALIFY row_number() OVER (ORDER BY max DESC, id) <= CAST(floor(0.1 * (SELECT count(*) FROM m)) AS BIGINT)""")
def w05(t):
    return matrix.top_percent(t.contrasts, "id", "base_mean", 90).withColumn("max", r6("max"))


@query("w06_above_nth", """
WITH n AS (SELECT o_totalprice AS x FROM orders ORDER BY x DESC LIMIT 1 OFFSET 2999) SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > coalesce((SELECT x FROM n), -1)""")
def w06(t):
    return matrix.above_nth(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 3000)


@query("w07_every_kth", """
SELECT chrom, start, name FROM v_peaks QUALIFY (row_number() OVER (ORDER BY chrom, start, name) - 1) % CAST(ceil((SELECT count(*) FROM v_peaks) / 700.0) AS BIGINT) = 0""")
def w07(t):
    return matrix.every_kth(t.peaks.select("chrom", "start", "name"), ["chrom", "start", "name"], 700)


@query("w08_key_changes", """
WITH r AS (SELECT chrom, row_number() OVER (ORDER BY chrom, start, name) - 1 AS rn FROM v_peaks)
SELECT min(rn) AS row_sep FROM r GROUP BY chrom UNION ALL SELECT count(*) FROM r""")
def w08(t):
    return matrix.key_changes(t.peaks.select("chrom", "start", "name"), "chrom", ["start", "name"])


@query("w09_renumber", """
WITH f AS (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1), n AS (SELECT o_custkey, row_number() OVER (ORDER BY f) AS number FROM f)
SELECT o_orderkey, o_custkey, number FROM orders JOIN n USING (o_custkey)""")
def w09(t):
    return matrix.renumber(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", F.col("o_orderkey"))


@query("w10_sequential_ids", "SELECT chrom, start, name, row_number() OVER (ORDER BY chrom, start, name) - 1 AS unique_id FROM v_peaks")
def w10(t):
    return od.sequential_ids(t.peaks.select("chrom", "start", "name"), ["chrom", "start", "name"])


@query("w11_average_rank", """
SELECT event_id, rank() OVER w + (count(*) OVER (PARTITION BY event_type, floor(value)) - 1) / 2 AS avg_rank
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(value))""")
def w11(t):
    rows = t.events.select("event_id", "event_type", F.floor("value").alias("v"))
    return with_avg_rank(rows, ["event_type"], "v", "avg_rank").select("event_id", "avg_rank")


@query("w12_cumulative_labels", """
SELECT doc_id, row_number() OVER w AS rank, CAST(sum(label) OVER (ORDER BY score_a DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS captured
FROM v_scores WINDOW w AS (ORDER BY score_a DESC, doc_id)""")
def w12(t):
    return od.cumulative_labels(t.scores, "score_a", "doc_id", "label").select("doc_id", "rank", "captured")


@query("w13_trim_extremes", """
SELECT id, contrast, padj FROM (SELECT *, dense_rank() OVER (PARTITION BY contrast ORDER BY base_mean) AS lo, dense_rank() OVER (PARTITION BY contrast ORDER BY base_mean DESC) AS hi FROM v_contrasts) WHERE lo > 2 AND hi > 2""")
def w13(t):
    return od.trim_extremes(t.contrasts, ["contrast"], "base_mean").select("id", "contrast", "padj")


@query("w14_shares", "SELECT id, t, rep, round(value / sum(value) OVER (PARTITION BY t, rep), 6) AS share FROM v_signal")
def w14(t):
    return od.shares(t.signal, ["t", "rep"], "value").select("id", "t", "rep", r6("share"))


@query("w16_best_task", """
SELECT id, t, rep, first_value(t) OVER (PARTITION BY id ORDER BY value DESC, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best_task FROM v_signal""")
def w16(t):
    return od.best_task(t.signal, ["id"], "t", "value").select("id", "t", "rep", "best_task")


@query("l01_genome_sorted", "SELECT chrom, start, stop, name FROM v_peaks ORDER BY chrom, start")
def l01(t):
    return od.genome_sorted(t.peaks.select(*KEY, "name"))


@query("l02_shuffled_by_clusters", "SELECT cluster, id FROM v_clusters ORDER BY cluster")
def l02(t):
    return od.shuffled_by_clusters(t.clusters.select("cluster", "id"), ["cluster"], "id", 7)


@query("l03_score_sorted", "SELECT name, signal_value FROM v_peaks ORDER BY signal_value DESC")
def l03(t):
    return od.score_sorted(t.peaks.select("name", "signal_value"), "signal_value")


@query("l04_top_ranked", "SELECT name, signal_value FROM v_peaks ORDER BY signal_value DESC, name LIMIT 1000")
def l04(t):
    return od.top_ranked(t.peaks.select("name", "signal_value"), [F.col("signal_value").desc(), F.col("name")])


@query("l05_flag_sorted", "SELECT DISTINCT cluster, h3k27ac, h3k4me1, h3k27me3 FROM v_marks ORDER BY ALL")
def l05(t):
    cols = ["cluster", "h3k27ac", "h3k4me1", "h3k27me3"]
    return od.flag_sorted(t.marks.select(*cols), cols)


@query("l06_peak_sorted", f"""
WITH {SIG}, {POOLED} SELECT id, t + 1 AS peak FROM pooled QUALIFY row_number() OVER (PARTITION BY id ORDER BY value DESC, t) = 1""")
def l06(t):
    return od.peak_sorted(pooled_vecs(t), "vector", "id").select("id", "peak")


@query("l07_random_subset", "SELECT name, chrom FROM v_peaks ORDER BY md5(concat('42:', name)), name LIMIT 5000")
def l07(t):
    return od.random_subset(t.peaks.select("name", "chrom"), "name", 5000)


@query("l08_ordered_joint_label", """
WITH j AS (SELECT name AS id, CAST(q_value AS INT) % 5 AS cluster, state AS mark FROM v_peaks JOIN v_marks ON name = v_marks.id)
SELECT id, concat(CAST(cluster AS VARCHAR), '.', CAST(mark AS VARCHAR)) AS label FROM j
QUALIFY (row_number() OVER (ORDER BY cluster, mark, id) - 1) % CAST(ceil((SELECT count(*) FROM j) / 750.0) AS BIGINT) = 0""")
def l08(t):
    a = t.peaks.select(F.col("name").alias("id"), (F.col("q_value").cast("int") % 5).alias("cluster"))
    return od.ordered_joint_label(a, t.marks.select("id", F.col("state").alias("mark")), 750).select("id", "label")


@query("r01_melt", "SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value)")
def r01(t):
    return od.melt(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("r02_widen", "SELECT id, rep, " + ", ".join(f'max(value) FILTER (t = {i}) AS t{i}' for i in range(10)) + " FROM v_signal GROUP BY id, rep")
def r02(t):
    rows = t.signal.select("id", "rep", F.concat(F.lit("t"), "t").alias("name"), "value")
    return od.widen(rows, ["id", "rep"], "name", [f"t{i}" for i in range(10)], "value")


@query("r03_explode_list", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents")
def r03(t):
    return od.explode_list(t.documents.select("doc_id", "text"), "text", " ", "word").select("doc_id", "word")


@query("r04_transpose", """
WITH c AS (SELECT rep, avg(n) AS mean_n, CAST(sum(value) AS DOUBLE) AS total FROM v_signal GROUP BY rep), u AS (UNPIVOT c ON mean_n, total INTO NAME name VALUE value)
SELECT name, round(max(value) FILTER (rep = 'b1'), 6) AS b1, round(max(value) FILTER (rep = 'b2'), 6) AS b2 FROM u GROUP BY name""")
def r04(t):
    small = t.signal.groupBy("rep").agg(F.avg("n").alias("mean_n"), F.sum("value").alias("total"))
    return od.transpose(small, "rep", ["b1", "b2"], ["mean_n", "total"]).select("name", r6("b1"), r6("b2"))


@query("r05_signed_long", """
WITH c AS (SELECT contrast, count(*) FILTER (log2_fold_change > 0) AS u, count(*) FILTER (log2_fold_change < 0) AS d FROM v_contrasts GROUP BY contrast)
SELECT contrast, 'up' AS direction, u AS n FROM c UNION ALL SELECT contrast, 'down', -d FROM c""")
def r05(t):
    counts = t.contrasts.groupBy("contrast").agg(F.count_if(F.col("log2_fold_change") > 0).alias("u"), F.count_if(F.col("log2_fold_change") < 0).alias("d"))
    return od.signed_long(counts, "contrast", "u", "d")


