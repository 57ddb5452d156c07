"""Reporter assays: A11, A60-A65, A72, A73, A75."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.views import r6
from regionloom.functions.text import rule_id
from regionloom.operators import reporter as rp
from regionloom.session import checkpointed

LIB = """SELECT l_partkey AS barcode, CASE l_linenumber WHEN 1 THEN 'plasmid' WHEN 2 THEN 'd0' WHEN 3 THEN 'd3' ELSE 'd6' END AS sample,
 CAST(sum(l_quantity) AS BIGINT) AS n FROM {lineitem} GROUP BY 1, 2"""


@query("a11_library_normalise", f"""
WITH c AS ({LIB.format(lineitem='lineitem')}), s AS (SELECT *, n / sum(n) OVER (PARTITION BY sample) AS share, sum(n) OVER (PARTITION BY sample) AS total FROM c),
m AS (SELECT a.barcode, a.sample, a.total, a.share * coalesce(p.share, 0) AS x FROM s a LEFT JOIN s p ON a.barcode = p.barcode AND p.sample = 'plasmid' WHERE a.sample <> 'plasmid'),
z AS (SELECT *, x / sum(x) OVER (PARTITION BY sample) AS sh FROM m)
SELECT barcode, sample, round(sh * total, 6) AS normalised, round(CASE WHEN sh * 1000000 > 1 THEN log2(sh * 1000000) ELSE 0 END, 6) AS log2_signal FROM z""")
def a11(t):
    out = rp.library_normalise(t.spark.sql(LIB, lineitem=t.lineitem))
    return out.select("barcode", "sample", r6("normalised"), r6("log2_signal"))


# the assay rows with an effect of combination and day, so that rules are called differently
ASSAY = """SELECT split_part(example_id, '.', 1) AS rule, example_id, combos, barcode, day, rep, CASE WHEN value = 0 THEN value ELSE
 value + CASE WHEN combos = '0,0' AND length(split_part(example_id, '.', 1)) = 6 THEN CASE day WHEN 'd6' THEN CAST(4 AS DOUBLE) WHEN 'd3' THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE CAST(0 AS DOUBLE) END END AS value
 FROM {reporter}"""


def assay(t):
    return t.spark.sql(ASSAY, reporter=t.reporter)


AVG = f"""a AS ({ASSAY.format(reporter='v_reporter')}), p AS (SELECT rule, example_id, combos, day, rep, avg(value) AS value FROM a WHERE value >= 9 AND value <> 0 GROUP BY ALL),
 v AS (SELECT rule, example_id, combos, day, avg(value) AS value FROM p GROUP BY ALL)"""


@query("a60_average_signal", f"WITH {AVG} SELECT rule, example_id, combos, day, round(value, 6) AS value FROM v")
def a60(t):
    return rp.average_signal(assay(t), 9).withColumn("value", r6("value"))


TRAJ = f"""{AVG}, c AS (SELECT rule, example_id, combos, day, value - avg(value) OVER (PARTITION BY rule, example_id, combos) AS value FROM v)"""


@query("a61_trajectory_signal", f"""
WITH {TRAJ}, m AS (SELECT rule, combos, quantile_cont(value, 0.5) AS m FROM c WHERE day = 'd0' GROUP BY ALL), e AS (SELECT rule, quantile_cont(value, 0.5) AS m FROM c WHERE day = 'd0' AND combos = '0,0' GROUP BY ALL)
SELECT c.rule, example_id, c.combos, day, round(value - m.m, 6) + 0.0 AS own, round(value - e.m, 6) + 0.0 AS endog FROM c LEFT JOIN m ON c.rule = m.rule AND c.combos = m.combos LEFT JOIN e ON c.rule = e.rule""")
def a61(t):
    avg = checkpointed(rp.average_signal(assay(t), 9))
    out = rp.trajectory_signals(avg, {"own": "d0_norm", "endog": "d0_endog_norm"}).filter("day is not null")
    return out.select("rule", "example_id", "combos", "day", r6("own"), r6("endog"))


@query("a62_background_subtracted", f"""
WITH {AVG} SELECT v.rule, v.example_id, v.combos, v.day, round(v.value - b.value, 6) + 0.0 AS value FROM v JOIN v b ON v.rule = b.rule AND v.example_id = b.example_id AND v.day = b.day AND b.combos = '1,1'""")
def a62(t):
    return rp.background_subtracted(rp.average_signal(assay(t), 9)).withColumn("value", r6("value"))


def rule_days(t):
    day = F.when(F.col("rule").isin("rule0", "rule1"), "d0").when(F.length("rule") == 6, "d3").otherwise("d6")
    return t.reporter.select(rule_id(F.col("example_id")).alias("rule")).distinct().withColumn("day", day)


@query("a64_rule_calls")
def a64(t):
    return rp.call_rules(assay(t), rule_days(t), threshold=0.5)


@query("a65_example_check", f"""
WITH a AS ({ASSAY.format(reporter='v_reporter')}), b AS (SELECT rule, example_id, rep, barcode, coalesce(max(value) FILTER (day = 'd0'), 0) AS d0, coalesce(max(value) FILTER (day = 'd3'), 0) AS d3, coalesce(max(value) FILTER (day = 'd6'), 0) AS d6 FROM a GROUP BY ALL),
r AS (SELECT rule, example_id, rep, avg(d0) AS d0, avg(d3) AS d3, avg(d6) AS d6 FROM b WHERE d0 + d3 + d6 <> 0 GROUP BY ALL), e AS (SELECT rule, example_id, count(*) AS n_reps, avg(d0) AS d0, avg(d3) AS d3, avg(d6) AS d6 FROM r GROUP BY ALL)
SELECT rule, example_id, n_reps, n_reps = 4 AND CASE WHEN rule IN ('rule0', 'rule1') THEN d0 = greatest(d0, d3, d6) ELSE d0 <> greatest(d0, d3, d6) END AS passed FROM e""")
def a65(t):
    return rp.example_check(assay(t), rule_days(t).filter("day = 'd0'"))


CONSTRUCTS = """SELECT example_id AS construct, split_part(example_id, '.', 1) AS example, day, value, CAST(barcode % 100 AS DOUBLE) AS signal FROM {reporter}"""


def constructs(t):
    return t.spark.sql(CONSTRUCTS, reporter=t.reporter)


VS = f"""c AS ({CONSTRUCTS.format(reporter='v_reporter')}), s AS (SELECT construct, day, max(signal) AS signal FROM c GROUP BY ALL), p AS (SELECT construct, example, day, quantile_cont(value, 0.5) AS assay FROM c GROUP BY ALL),
 q AS (SELECT example, day, quantile_cont(assay, 0.5) AS assay, quantile_cont(signal, 0.5) AS signal FROM p JOIN s USING (construct, day) GROUP BY ALL)"""


@query("a72_assay_vs_signal", f"""
WITH {VS} SELECT a.example, a.day, round(a.assay, 6) AS assay, a.signal AS signal_a, coalesce(b.signal, 0) AS signal_b, a.signal + coalesce(b.signal, 0) AS signal FROM q a LEFT JOIN (SELECT * FROM q WHERE day <> 'd0') b ON a.example = b.example AND a.day = b.day""")
def a72(t):
    c = constructs(t)
    one = rp.assay_vs_signal(c.drop("signal"), c.groupBy("construct", "day").agg(F.max("signal").alias("signal")))
    return rp.summed_signals(one, one.filter("day <> 'd0'")).withColumn("assay", r6("assay"))


@query("a73_construct_correlation", f"""
WITH c AS ({CONSTRUCTS.format(reporter='v_reporter')}), m AS (SELECT construct, day, avg(value) AS assay, avg(signal) AS signal FROM c GROUP BY ALL)
SELECT day, round(corr(assay, signal), 6) + 0.0 AS r, count(*) AS n FROM m GROUP BY day""")
def a73(t):
    return rp.construct_correlation(constructs(t)).withColumn("r", r6("r"))


@query("a75_library_quality", """
WITH r AS (SELECT l_returnflag AS sample, l_partkey AS sequence, l_orderkey AS barcode, CAST(l_quantity AS BIGINT) AS n FROM lineitem), b AS (SELECT sample, sequence, count(DISTINCT barcode) AS b FROM r WHERE n > 0 GROUP BY ALL)
SELECT sample, CAST(sum(n) AS BIGINT) AS reads, count(DISTINCT sequence) AS sequences, round(sum(n) / count(DISTINCT sequence), 6) AS uniform_reads,
 (SELECT round(avg(b), 6) FROM b WHERE b.sample = r.sample) AS mean_barcodes, (SELECT max(b) FROM b WHERE b.sample = r.sample) AS max_barcodes FROM r GROUP BY sample""")
def a75(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("sequence"), F.col("l_orderkey").alias("barcode"), F.col("l_quantity").cast("long").alias("n"))
    return rp.library_quality(rows).withColumns({"mean_barcodes": r6("mean_barcodes"), "uniform_reads": r6("uniform_reads")})


@query("a75_sequence_presence", """
SELECT l_partkey AS sequence, count(DISTINCT l_orderkey) FILTER (CAST(l_quantity AS BIGINT) > 9) AS barcodes, count(DISTINCT l_returnflag) FILTER (CAST(l_quantity AS BIGINT) > 9) AS samples FROM lineitem GROUP BY l_partkey""")
def a75_presence(t):
    n = F.when(F.col("l_quantity").cast("long") > 9, F.col("l_quantity").cast("long")).otherwise(0)
    return rp.sequence_presence(t.lineitem.select(F.col("l_returnflag").alias("sample"), F.col("l_partkey").alias("sequence"), F.col("l_orderkey").alias("barcode"), n.alias("n")))


@query("a75_category_means", "SELECT rep AS category, day, round(avg(value), 6) AS mean, count(*) AS n FROM v_reporter GROUP BY rep, day")
def a75_category(t):
    return rp.category_means(t.reporter.withColumnRenamed("rep", "category"), "category").withColumn("mean", r6("mean"))
