"""Marks, states, profiles, trajectories: A12-A23, A26-A29, A33-A38, A81, A87, A90, J27, U01, U03."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.link_joins import POOLED, SIG, pooled_vecs, vecs
from regionloom.catalog.sqlparts import merged
from regionloom.catalog.views import r6
from regionloom.functions.tails import chi2_pdf, log_density, r_critical, whitening
from regionloom.functions.vectors import vzscore
from regionloom.operators import counting, states as st, trajectories as tr
from regionloom.operators.annotate import decimal_code
from regionloom.plans.bins import KEY, merge_intervals

MARKS = ["h3k27ac", "h3k4me1", "h3k27me3"]




@query("a12_ternary_code", """
WITH s AS (SELECT id, contrast, CASE WHEN padj < 0.02 THEN CAST(sign(log2_fold_change) AS BIGINT) ELSE 0 END AS s FROM v_contrasts)
SELECT id, CAST(9 * (1 - coalesce(max(s) FILTER (contrast = 'd3_over_d0'), 0)) + 3 * (1 - coalesce(max(s) FILTER (contrast = 'd6_over_d3'), 0))
 + (1 - coalesce(max(s) FILTER (contrast = 'd6_over_d0'), 0)) AS BIGINT) AS code FROM s GROUP BY id""")
def a12(t):
    return tr.ternary_code(t.contrasts, ["d3_over_d0", "d6_over_d3", "d6_over_d0"], 0.02)


@query("a13_decimal_code", "SELECT id, h3k27me3 + 10 * h3k4me1 + 100 * h3k27ac AS code FROM v_marks")
def a13(t):
    return t.marks.select("id", decimal_code([F.col(m) for m in reversed(MARKS)]).alias("code"))


OVER = """s AS (SELECT chrom, greatest(0, start - 500) AS start, least(4000000, stop + 500) AS stop, code, mark FROM v_histones),
 k AS (SELECT DISTINCT chrom, start, stop FROM v_peaks),
 o AS (SELECT k.*, s.start AS bs, s.stop AS be, code, mark FROM k JOIN s ON k.chrom = s.chrom AND s.start < k.stop AND k.start < s.stop)"""
WIDTH_ORDER = "(be - bs) - (stop - start), bs DESC, be DESC, code DESC"


@query("a14_nearest_mark", f"""
WITH {OVER}, w AS (SELECT chrom, start, stop, code FROM o QUALIFY row_number() OVER (PARTITION BY chrom, start, stop ORDER BY {WIDTH_ORDER}) = 1),
d AS (SELECT chrom, start, stop, code FROM o QUALIFY row_number() OVER (PARTITION BY chrom, start, stop
  ORDER BY CASE WHEN abs(code - 4) > 4 THEN 0 ELSE abs(code - 4) END DESC, bs, be, code) = 1)
SELECT chrom, start, stop, coalesce(w.code, 9) AS width_code, coalesce(d.code, 9) AS diff_code FROM k LEFT JOIN w USING (chrom, start, stop) LEFT JOIN d USING (chrom, start, stop)""")
def a14(t):
    a = st.nearest_mark(t.peaks, t.histones, t.chromsizes, 500, "width").withColumnRenamed("code", "width_code")
    b = st.nearest_mark(t.peaks, t.histones, t.chromsizes, 500, "most_diff").withColumnRenamed("code", "diff_code")
    return a.join(b, KEY)


@query("a15_histone_overlaps", f"""
WITH {OVER}, w AS (SELECT chrom, start, stop, mark, code FROM o QUALIFY row_number() OVER (PARTITION BY chrom, start, stop, mark ORDER BY {WIDTH_ORDER}) = 1),
p AS (SELECT k.chrom, k.start, k.stop, {', '.join(f"coalesce(max(code) FILTER (mark = '{m}'), 9) AS {m}" for m in MARKS)} FROM k LEFT JOIN w USING (chrom, start, stop) GROUP BY ALL)
SELECT concat(chrom, ':', CAST(start AS VARCHAR), '-', CAST(stop AS VARCHAR)) AS id, h3k27ac, h3k4me1, h3k27me3, 100 * h3k27ac + 10 * h3k4me1 + h3k27me3 AS state FROM p""")
def a15(t):
    return st.histone_overlaps(t.peaks, t.histones, t.chromsizes, MARKS, 500, "width").drop(*KEY)


GROUPS = """rows AS (SELECT id, cluster, 'h3k27ac' AS kind, h3k27ac AS level FROM v_marks WHERE h3k27ac <> 9 UNION ALL
  SELECT id, cluster, 'h3k4me1', h3k4me1 FROM v_marks WHERE h3k4me1 <> 9 UNION ALL SELECT id, cluster, 'h3k27me3', h3k27me3 FROM v_marks WHERE h3k27me3 <> 9
  UNION ALL SELECT id, cluster, 'state', state FROM v_marks WHERE state NOT IN (99, 999)),
 grp AS (SELECT cluster, kind, level, id, count(*) OVER (PARTITION BY cluster, kind, level) AS size FROM rows QUALIFY size > 100)"""


@query("a16_mark_groups", f"WITH {GROUPS} SELECT cluster, kind, level, id, size FROM grp")
def a16(t):
    return st.mark_groups(t.marks, MARKS, 100)


@query("a17_split_by_dynamics", """
WITH m AS (SELECT *, h3k27ac IN (4, 9) AND h3k4me1 IN (4, 9) AND h3k27me3 IN (4, 9) AS still FROM v_marks WHERE state <> 999),
d AS (SELECT *, count(*) OVER (PARTITION BY state) AS n FROM m WHERE NOT still AND NOT (h3k27me3 <> 9 AND h3k27ac <> 9 AND h3k4me1 <> 9))
SELECT id, state, 'dynamic' AS kind FROM d WHERE n > 300 UNION ALL SELECT id, state, 'stable' FROM m WHERE still""")
def a17(t):
    return st.split_by_dynamics(t.marks, 300).select("id", "state", "kind")


SET_SIGNAL = """ps AS (SELECT name AS id, CASE WHEN timepoint = 'd00' THEN round(signal_value * 100) ELSE 0 END AS t0, CASE WHEN timepoint <> 'd00' THEN round(signal_value * 100) ELSE 0 END AS t1 FROM v_peaks)"""


def peak_signal(t):
    """Whole-numbered signal: its sums are exact, so means compare without rounding."""
    first, whole = F.col("timepoint") == "d00", F.round(F.col("signal_value") * 100)
    return t.peaks.select(F.col("name").alias("id"), F.when(first, whole).otherwise(0.0).alias("t0"),
                          F.when(~first, whole).otherwise(0.0).alias("t1"))


@query("a18_set_signal", f"""
WITH {SET_SIGNAL} SELECT cluster, state, count(*) AS num_regions, sum(t0) / count(*) AS t0, sum(t1) / count(*) AS t1,
 greatest(sum(t0), sum(t1)) / count(*) AS max FROM v_marks JOIN ps USING (id) GROUP BY cluster, state""")
def a18(t):
    out = st.set_signal(t.marks, peak_signal(t), ["cluster", "state"])
    return out.select("cluster", "state", "num_regions", "t0", "t1", "max")


@query("a19_chromatin_states", f"""
WITH {GROUPS}, s AS (SELECT cluster, concat(kind, '-', CAST(level AS VARCHAR)) AS grp, id FROM grp WHERE kind = 'state' AND size > 400),
l AS (SELECT id, cluster FROM v_marks WHERE (cluster, id) NOT IN (SELECT (cluster, id) FROM s)),
lb AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM l QUALIFY n >= 150),
m AS (SELECT g.cluster, concat(kind, '-', CAST(level AS VARCHAR)) AS grp, g.id FROM grp g JOIN lb USING (cluster, id) WHERE kind <> 'state' AND size > 400),
u AS (SELECT *, count(*) OVER (PARTITION BY cluster, grp) AS n FROM m QUALIFY n >= 150),
r AS (SELECT id, cluster FROM l WHERE (cluster, id) NOT IN (SELECT (cluster, id) FROM u)),
n AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM r QUALIFY n >= 150),
a AS (SELECT cluster, grp, id FROM s UNION ALL SELECT cluster, grp, id FROM u UNION ALL SELECT cluster, 'Null', id FROM n), {SET_SIGNAL}
SELECT cluster, grp AS "group", count(*) AS num_regions, sum(t0) / count(*) AS t0, sum(t1) / count(*) AS t1 FROM a JOIN ps USING (id) GROUP BY cluster, grp""")
def a19(t):
    members = st.state_membership(t.marks, MARKS, min_group=400, min_left=150)
    out = st.set_signal(members, peak_signal(t), ["cluster", "group"])
    return out.select("cluster", "group", "num_regions", "t0", "t1")


@query("a19_stable_states", """
WITH f AS (SELECT id, 'a-active' AS grp FROM v_marks WHERE h3k27ac <> 9 UNION ALL SELECT id, 'b-primed' FROM v_marks WHERE h3k4me1 <> 9 UNION ALL SELECT id, 'c-silent' FROM v_marks WHERE h3k27me3 <> 9),
m AS (SELECT DISTINCT grp, id FROM f JOIN v_marks v USING (id) WHERE v.cluster = 3)
SELECT grp AS "group", id, grp = min(grp) OVER (PARTITION BY id) AS fresh FROM m""")
def a19_stable(t):
    return st.stable_states(stable_files(t), t.marks.filter("cluster = 3"))


def stable_files(t):
    names = [("a-active", "h3k27ac"), ("b-primed", "h3k4me1"), ("c-silent", "h3k27me3")]
    states = F.array_compact(F.array(*[F.when(F.col(c) != 9, F.lit(n)) for n, c in names]))
    return t.marks.select("id", F.explode(states).alias("state"))


@query("a19_state_table", f"""
WITH {SET_SIGNAL}, a AS (SELECT cluster, CAST(state AS VARCHAR) AS grp, id FROM v_marks WHERE cluster < 3),
f AS (SELECT id, 'a-active' AS grp FROM v_marks WHERE h3k27ac <> 9 UNION ALL SELECT id, 'b-primed' FROM v_marks WHERE h3k4me1 <> 9 UNION ALL SELECT id, 'c-silent' FROM v_marks WHERE h3k27me3 <> 9),
m AS (SELECT DISTINCT grp, id FROM f JOIN v_marks v USING (id) WHERE v.cluster = 3),
w AS (SELECT cluster, grp, id FROM a UNION ALL SELECT NULL, grp, id FROM m),
s AS (SELECT cluster, grp, count(*) AS num_regions, sum(t0) / count(*) AS t0, sum(t1) / count(*) AS t1, greatest(sum(t0), sum(t1)) / count(*) AS max FROM w JOIN ps USING (id) GROUP BY cluster, grp)
SELECT cluster, grp AS "group", num_regions, t0, t1, max, coalesce(CAST(cluster = 1 AS INT), 0) AS traj_1, coalesce(CAST(cluster = 2 AS INT), 0) AS traj_2,
 row_number() OVER (ORDER BY coalesce(CAST(cluster = 1 AS INT), 0) DESC, coalesce(CAST(cluster = 2 AS INT), 0) DESC, max DESC, t1 DESC, grp) AS position FROM s""")
def a19_table(t):
    signal = peak_signal(t)
    dynamic = st.set_signal(t.marks.filter("cluster < 3").select("cluster", F.col("state").cast("string").alias("group"), "id"), signal, ["cluster", "group"])
    stable = st.set_signal(st.stable_states(stable_files(t), t.marks.filter("cluster = 3")), signal, ["group"])
    return st.state_table(dynamic, stable, 2, ["max", "t1"])


@query("a20_relative_signal", f"""
WITH {SET_SIGNAL} SELECT id, CAST(0 AS DOUBLE) AS t0, round(t1 - t0, 6) + 0.0 AS t1 FROM ps WHERE id IN
 (SELECT concat('peak', CAST(CAST(substr(id, 5) AS BIGINT) + 1 AS VARCHAR)) FROM v_marks WHERE h3k27ac = 9)""")
def a20(t):
    mapping = t.marks.select(F.col("id").alias("in_id"), F.concat(F.lit("peak"), (F.expr("substring(id, 5)").cast("long") + 1).cast("string")).alias("out_id"))
    out = st.relative_signal(t.marks.filter("h3k27ac = 9"), mapping, peak_signal(t))
    return out.select("id", r6("t0"), r6("t1"))


PROF = """win AS (SELECT gene_id, chrom, start AS mid, greatest(0, start - 2000) AS ws, least(4000000, start + 2000) AS we FROM v_tss),
 cnt AS (SELECT gene_id, timepoint, (r.start - mid + 2000) // 400 AS bin, count(*) AS n FROM win JOIN v_reads r ON win.chrom = r.chrom AND r.start >= ws AND r.start < we GROUP BY ALL),
 prof AS (SELECT g.gene_id, tp.timepoint, b.bin, coalesce(n, 0) AS n FROM v_tss g CROSS JOIN (SELECT unnest(['d00', 'd30', 'd60']) AS timepoint) tp
  CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN cnt ON cnt.gene_id = g.gene_id AND cnt.timepoint = tp.timepoint AND cnt.bin = b.bin)"""


def tss_profiles(t):
    return st.profiles(t.tss, t.reads, t.chromsizes, "timepoint", ["d00", "d30", "d60"], 2000, 10)


@query("a21_profile_summary", f"""
WITH {PROF}, f AS (SELECT *, avg(n) FILTER (bin < 2 OR bin > 7) OVER (PARTITION BY gene_id, timepoint) AS flank FROM prof), x AS (SELECT timepoint, bin, n / flank AS x FROM f WHERE flank > 0)
SELECT timepoint, CAST(bin AS INT) AS bin, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_pop(x), 6) AS sd FROM x GROUP BY timepoint, bin""")
def a21(t):
    out = st.profile_summary(tss_profiles(t), "timepoint", 2)
    return out.select("timepoint", "bin", r6("median"), r6("sd"))


@query("a22_mean_profile", f"""
WITH {PROF} SELECT 'atac' AS assay, timepoint, CAST(bin AS INT) AS bin, round(avg(n), 6) AS mean FROM prof GROUP BY timepoint, bin""")
def a22(t):
    rows = tss_profiles(t).withColumn("assay", F.lit("atac"))
    return st.mean_profile(rows, ["assay", "timepoint"]).withColumn("mean", r6("mean"))


@query("a23_pooled_fold_change", """
SELECT contrast, CASE WHEN log2_fold_change > 0 THEN 'up' ELSE 'down' END AS direction,
 round(log2(sum(base_mean * pow(2, log2_fold_change)) / sum(base_mean)), 6) AS log2_fold_change, count(*) AS n FROM v_contrasts WHERE log2_fold_change <> 0 GROUP BY 1, 2""")
def a23(t):
    return st.pooled_fold_change(t.contrasts).withColumn("log2_fold_change", r6("log2_fold_change"))


@query("a26_cluster_means", f"""
WITH {SIG}, {POOLED}, m AS (SELECT cluster, t, avg(value) AS x FROM pooled JOIN v_clusters USING (id) GROUP BY ALL)
SELECT cluster, CAST(t AS INT) AS pos, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS z FROM m WINDOW w AS (PARTITION BY cluster)""")
def a26(t):
    out = tr.cluster_mean_zscores(pooled_vecs(t).join(t.clusters, "id"), 10)
    return out.select("cluster", F.posexplode("z").alias("pos", "z")).select("cluster", "pos", r6("z"))


ZS = f"""{SIG}, {POOLED}, z AS (SELECT id, t, (value - avg(value) OVER (PARTITION BY id)) / stddev_pop(value) OVER (PARTITION BY id) AS z FROM pooled),
 zc AS (SELECT cluster, id, t, z FROM z JOIN v_clusters USING (id))"""


def stats(t):
    return tr.cluster_stats(pooled_vecs(t).join(t.clusters, "id"), 10)


@query("a27_cluster_stats", f"""
WITH {ZS}, m AS (SELECT cluster, t, avg(z) AS mean, count(*) AS size FROM zc GROUP BY ALL),
c AS (SELECT a.cluster, a.t AS i, b.t AS j, covar_samp(a.z, b.z) AS cov FROM zc a JOIN zc b ON a.id = b.id GROUP BY ALL)
SELECT c.cluster, CAST(i * 10 + j AS INT) AS cell, round(cov, 6) + 0.0 AS cov, round(mean, 6) + 0.0 AS mean, size FROM c JOIN m ON m.cluster = c.cluster AND m.t = i""")
def a27(t):
    rows = stats(t).select("cluster", "size", "mean", F.posexplode("cov").alias("cell", "cov"))
    return rows.select("cluster", "cell", r6("cov"), r6(F.element_at("mean", (F.floor(F.col("cell") / 10) + 1).cast("int")), "mean"), "size")


def trends(t):
    """The signal on top of a time course per cluster; cluster 5 stays without one."""
    course = F.when(F.col("cluster") < 5, 40 * F.abs((F.col("t") + 2 * F.col("cluster")) % 10 - 5)).otherwise(0)
    return t.signal.join(t.clusters, "id").withColumn("value", F.col("value") / 10 + course)


def trend_stats(t):
    members = tr.align_replicates(trends(t), list(range(10))).select("id", F.col("pooled").alias("vector"))
    return tr.cluster_stats(members.join(t.clusters, "id"), 10)


#: Mean vector and covariance cells of each cluster over the z-scored rows of ``zc`` (cluster, id, t, z).
MOMENTS = """m AS (SELECT cluster, t, avg(z) AS mean, count(*) AS size FROM zc GROUP BY ALL),
c AS (SELECT a.cluster, a.t AS i, b.t AS j, covar_samp(a.z, b.z) AS cov FROM zc a JOIN zc b ON a.id = b.id AND a.cluster = b.cluster GROUP BY ALL)"""

#: Inverse and log determinant by ten sweeps. Scaled rows add up to zero, so 1/10 in every cell turns the one
#: eigenvalue that is zero into one and changes no distance between them.
INVERSE = """sw AS (SELECT 0 AS k, cluster, i, j, cov + 0.1 AS v, CAST(0 AS DOUBLE) AS ld FROM c UNION ALL
 SELECT k + 1, cluster, i, j, CASE WHEN i = k AND j = k THEN -1 / d WHEN i = k OR j = k THEN v / d ELSE v - a * b / d END, ld + ln(d)
 FROM (SELECT *, max(v) FILTER (i = k AND j = k) OVER (PARTITION BY cluster) AS d, max(v) FILTER (j = k) OVER (PARTITION BY cluster, i) AS a,
  max(v) FILTER (i = k) OVER (PARTITION BY cluster, j) AS b FROM sw WHERE k < 10)),
inv AS (SELECT cluster, i, j, -v AS v, ld FROM sw WHERE k = 10)"""
LOG_DENSITY = "-0.5 * (9 * ln(2 * pi()) + any_value(ld) + sum(x.dz * inv.v * y.dz))"

TRENDS = f"""tv AS (SELECT s.id, rep, t, value / 10 + CASE WHEN cluster < 5 THEN 40 * abs((t + 2 * cluster) % 10 - 5) ELSE 0 END AS value FROM v_signal s JOIN v_clusters USING (id)),
{SIG.replace('v_signal', 'tv')},
r3 AS (SELECT id, 'rep1' AS rep, t, value FROM sig WHERE rep = 'b1' UNION ALL SELECT id, 'rep2', t, value FROM sig WHERE rep = 'b2'
 UNION ALL SELECT id, 'pooled', t, a.value + b.value FROM (SELECT * FROM sig WHERE rep = 'b1') a JOIN (SELECT * FROM sig WHERE rep = 'b2') b USING (id, t)),
z3 AS (SELECT id, rep, t, (value - avg(value) OVER (PARTITION BY id, rep)) / nullif(stddev_pop(value) OVER (PARTITION BY id, rep), 0) AS z FROM r3
 WHERE id IN (SELECT id FROM r3 WHERE rep = 'pooled')),
zc AS (SELECT cluster, id, t, z FROM z3 JOIN v_clusters USING (id) WHERE rep = 'pooled' AND z IS NOT NULL), {MOMENTS}, {INVERSE},
zero AS (SELECT cluster, exp({LOG_DENSITY}) AS at_zero FROM inv JOIN (SELECT cluster, t, -mean AS dz FROM m) x USING (cluster) JOIN (SELECT cluster, t, -mean AS dz FROM m) y USING (cluster)
 WHERE x.t = i AND y.t = j GROUP BY cluster),
kept AS (SELECT cluster, CAST(row_number() OVER (ORDER BY cluster) AS INT) AS number, size FROM (SELECT DISTINCT cluster, size FROM m) JOIN zero USING (cluster)
 WHERE size > 0.05 * (SELECT sum(size) FROM m WHERE t = 0) AND at_zero <= {chi2_pdf(1 - 0.999, 10)!r})"""


def assigned(clusters: str) -> str:
    """SQL of the soft and hard clusters over the relation ``clusters`` (cluster, number)."""
    return f"""dz AS (SELECT id, rep, k.number, k.cluster, z3.t, z - mean AS dz, z, mean FROM z3 CROSS JOIN ({clusters}) k JOIN m ON m.cluster = k.cluster AND m.t = z3.t),
rk AS (SELECT *, rank() OVER (PARTITION BY id, rep, number ORDER BY z) + (count(*) OVER (PARTITION BY id, rep, number, z) - 1) / 2 AS rz,
 rank() OVER (PARTITION BY id, rep, number ORDER BY mean) + (count(*) OVER (PARTITION BY id, rep, number, mean) - 1) / 2 AS rm FROM dz),
fine AS (SELECT id, number FROM (SELECT id, rep, number, abs(corr(z, mean)) AS r, abs(corr(rz, rm)) AS s FROM rk GROUP BY ALL) GROUP BY id, number
 HAVING min(r) >= {r_critical(10, 0.05)!r} AND min(s) >= {r_critical(10, 0.05)!r} AND count(r) = 3),
dn AS (SELECT x.id, x.rep, x.number, {LOG_DENSITY} AS ln_d FROM dz x JOIN fine f ON f.id = x.id AND f.number = x.number JOIN inv ON inv.cluster = x.cluster AND inv.i = x.t
 JOIN dz y ON y.id = x.id AND y.rep = x.rep AND y.number = x.number AND y.t = inv.j GROUP BY ALL),
ok AS (SELECT id, number, max(ln_d) FILTER (rep = 'pooled') AS ln_d FROM dn GROUP BY id, number HAVING min(ln_d) >= ln(1e-12)),
b AS (SELECT *, max(ln_d) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id ORDER BY ln_d DESC, number) = 1 AS hard FROM ok)
SELECT id, number AS cluster, round(ln_d, 4) + 0.0 AS log_density, hard FROM b WHERE hard OR exp(top) - exp(ln_d) < 0.1 * exp(top)"""


def with_log_density(out):
    return out.select("id", "cluster", (F.round(F.ln("density"), 4) + 0.0).alias("log_density"), "hard")


@query("a28_drop_null_clusters", f"WITH RECURSIVE {TRENDS} SELECT * FROM kept")
def a28(t):
    out = tr.drop_null_clusters(trend_stats(t), 10, 0.05, 0.999)
    return out.select("cluster", "number", "size")


@query("u01_normal_density", f"""
WITH RECURSIVE {ZS}, {MOMENTS}, {INVERSE}, dz AS (SELECT id, cluster, t, z - mean AS dz FROM zc JOIN m USING (cluster, t))
SELECT x.id, x.cluster, round({LOG_DENSITY}, 4) + 0.0 AS log_density FROM dz x JOIN inv ON inv.cluster = x.cluster AND inv.i = x.t JOIN dz y ON y.id = x.id AND y.cluster = x.cluster AND y.t = inv.j GROUP BY x.id, x.cluster""")
def u01(t):
    z = pooled_vecs(t).select("id", vzscore(F.col("vector")).alias("z"))
    rows = z.join(t.clusters, "id").join(stats(t).select("cluster", whitening("mean", "cov").alias("white")), "cluster")
    return rows.select("id", "cluster", (F.round(log_density(F.col("z"), F.col("white")), 4) + 0.0).alias("log_density"))


@query("u03_significant_r", f"""
WITH {SIG}, r AS (SELECT a.id, corr(a.value, b.value) AS r FROM sig a JOIN sig b ON a.id = b.id AND a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2' GROUP BY a.id)
SELECT id, round(r, 6) AS r, abs(r) >= 0.4973 AS significant FROM r""")
def u03(t):
    from regionloom.functions.vectors import vpearson
    rows = tr.align_replicates(t.signal, list(range(10))).withColumn("r", vpearson(F.col("rep1"), F.col("rep2")))
    # 0.4973 is the tabled critical r for 10 points at p = 0.1436; the constant comes from r_critical
    return rows.select("id", r6("r"), (F.abs("r") >= r_critical(10, 0.14361)).alias("significant"))


@query("j27_compare_to_clusters", f"""
WITH {ZS}, m AS (SELECT cluster, t, avg(z) AS mean FROM zc GROUP BY ALL)
SELECT id, m.cluster, round(corr(z, mean), 6) + 0.0 AS r FROM z JOIN m USING (t) GROUP BY id, m.cluster""")
def j27(t):
    from regionloom.functions.vectors import vpearson
    rows = pooled_vecs(t).select("id", vzscore(F.col("vector")).alias("z"))
    return tr.compare_to_clusters(rows, stats(t)).select("id", "cluster", r6(vpearson(F.col("z"), F.col("mean")), "r"))


@query("a29_consistent_clusters", f"WITH RECURSIVE {TRENDS}, {assigned('SELECT DISTINCT cluster, cluster AS number FROM m')}")
def a29(t):
    return with_log_density(tr.consistent_clusters(tr.align_replicates(trends(t), list(range(10))), trend_stats(t), 10, 1e-12))


@query("a90_trajectory_job", f"WITH RECURSIVE {TRENDS}, {assigned('SELECT cluster, number FROM kept')}")
def a90(t):
    return with_log_density(tr.trajectory_job(trends(t), t.clusters, list(range(10)), 0.05, 0.999, 1e-12, 0.05))


@query("a81_cluster_bands", """
SELECT cluster, t, round(avg(value), 6) AS mean, round(avg(value) + 2 * stddev_samp(value), 6) AS ci_top, round(avg(value) - 2 * stddev_samp(value), 6) + 0.0 AS ci_bottom
FROM v_signal JOIN v_clusters USING (id) GROUP BY cluster, t""")
def a81(t):
    out = tr.cluster_bands(t.signal.join(t.clusters, "id"))
    return out.select("cluster", "t", r6("mean"), r6("ci_top"), r6("ci_bottom"))


@query("a87_order_by_peak", f"""
WITH {SIG}, {POOLED}, m AS (SELECT cluster, t, avg(value) AS x FROM pooled JOIN v_clusters USING (id) GROUP BY ALL),
p AS (SELECT cluster, t + 1 AS peak FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY x DESC, t) = 1)
SELECT cluster, peak, CAST(row_number() OVER (ORDER BY peak, cluster) AS INT) AS number FROM p""")
def a87(t):
    return tr.order_by_peak(pooled_vecs(t).join(t.clusters, "id"), 10)


MASTER = f"m AS (SELECT * FROM {merged('v_peaks')})"
PEAK_IN = "m JOIN v_peaks p ON m.chrom = p.chrom AND p.start < m.stop AND m.start < p.stop"


@query("a33_consensus_summits", f"""
WITH {MASTER}, f AS (SELECT m.*, timepoint, p.start + summit_offset AS summit FROM {PEAK_IN}
 QUALIFY row_number() OVER (PARTITION BY m.chrom, m.start, m.stop, timepoint ORDER BY signal_value DESC, p.start, p.stop) = 1)
SELECT chrom, start, stop, CAST(floor(avg(summit)) AS BIGINT) AS summit FROM f GROUP BY ALL""")
def a33(t):
    return st.consensus_summits(counting.master_regions(t.peaks), t.peaks, "timepoint")


@query("a34_best_summits", f"""
WITH {MASTER} SELECT m.chrom, m.start, m.stop, p.start + summit_offset AS summit FROM m LEFT JOIN v_peaks p
 ON m.chrom = p.chrom AND p.start < m.stop AND m.start < p.stop QUALIFY row_number() OVER (PARTITION BY m.chrom, m.start, m.stop ORDER BY q_value DESC, p.start, p.stop) = 1""")
def a34(t):
    return st.best_summits(counting.master_regions(t.peaks), t.peaks)


DOMS = f"""g AS (SELECT chrom, greatest(0, start - 1500) AS start, least(4000000, stop + 1500) AS stop FROM v_peaks), d AS (SELECT * FROM {merged('g')})"""


def domains(t):
    from regionloom.functions.coords import slop
    return merge_intervals(slop(t.peaks.select(*KEY), t.chromsizes, 1500))


@query("a35_rich_domains", f"""
WITH {DOMS} SELECT d.chrom, d.start, d.stop, count(*) AS n FROM d JOIN v_peaks p ON d.chrom = p.chrom AND p.start < d.stop AND d.start < p.stop GROUP BY ALL HAVING count(*) >= 3""")
def a35(t):
    return st.rich_domains(domains(t), t.peaks)


@query("a36_spread_genes", f"""
WITH {DOMS}, s AS (SELECT d.chrom, d.start, d.stop, p.start AS ins, p.stop AS ine, signal_value AS score FROM d JOIN v_peaks p ON d.chrom = p.chrom AND p.start < d.stop AND d.start < p.stop
  WHERE timepoint = 'd00' AND (p.start - d.start) + (d.stop - p.stop) > 5000),
r AS (SELECT DISTINCT s.chrom, h.start, h.stop, ins, ine, score FROM s JOIN v_histones h ON s.chrom = h.chrom AND h.start < s.stop AND s.start < h.stop WHERE code < 4),
x AS (SELECT t.gene_id, t.chrom, t.start, t.strand, ins, ine, score FROM v_tss t JOIN r ON t.chrom = r.chrom AND t.start < least(4000000, r.stop + 500) AND greatest(0, r.start - 500) < t.stop)
SELECT gene_id, chrom, start, strand, score, CASE WHEN strand = '-' THEN ins + (ine - ins) // 2 - start ELSE start - (ins + (ine - ins) // 2) END AS init_to_tss
FROM x QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY score DESC, ins, ine) = 1""")
def a36(t):
    first = t.peaks.filter("timepoint = 'd00'").select(*KEY, F.col("signal_value").alias("score"))
    return st.spread_genes(domains(t), first, t.histones, t.tss, t.chromsizes, 5000, 500)


@query("a37_flag_counts", """
WITH c AS (SELECT h3k27ac, h3k4me1, h3k27me3, count(*) AS n FROM v_marks GROUP BY ALL)
SELECT 'h3k27ac' AS name, h3k27ac AS fill, n AS count FROM c UNION ALL SELECT 'h3k4me1', h3k4me1, n FROM c UNION ALL SELECT 'h3k27me3', h3k27me3, n FROM c""")
def a37(t):
    return st.flag_counts(t.marks.select(*[F.col(m).cast("long").alias(m) for m in MARKS]), MARKS)


@query("a38_fold_change_groups", """
WITH r AS (SELECT chrom, start, stop, name, round(signal_value / 1000, 6) AS foldchange FROM v_peaks)
SELECT DISTINCT name, foldchange, t.strand AS "group" FROM r JOIN v_tss t ON r.chrom = t.chrom AND t.start < r.stop AND r.start < t.stop
UNION ALL SELECT name, foldchange, 'distal' FROM r WHERE NOT EXISTS (SELECT 1 FROM v_tss t WHERE r.chrom = t.chrom AND t.start < r.stop AND r.start < t.stop)""")
def a38(t):
    r = t.peaks.select(*KEY, "name", r6(F.col("signal_value") / 1000, "foldchange"))
    return st.fold_change_groups(r, t.tss.withColumnRenamed("strand", "group")).select("name", "foldchange", "group")


