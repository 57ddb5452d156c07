"""Motif hits and motif tables: A43-A57, A82-A86, J28, U02."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.link_joins import GENE_SIG, HOPS, SIG, gene_vectors, vecs
from regionloom.catalog.sqlparts import MEMBERS, fisher_sql, merged
from regionloom.catalog.views import r6
from regionloom.operators import links as lk, motifs as mo
from regionloom.plans.bins import KEY, nearest_first

CUT = 0.15
HITS = f"""e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS raw FROM embeddings),
 h AS (SELECT vec_id, label, pos, CASE WHEN raw > {CUT} THEN raw ELSE 0 END AS x FROM e)"""


def rows(t):
    """One score vector per row; scores below the cut are no hits."""
    a = F.col("embedding").cast("array<double>")
    scores = F.transform(a, lambda x: F.when(x > CUT, x).otherwise(0.0))
    return t.embeddings.select(F.col("vec_id").alias("row_id"), "label", scores.alias("scores"), a.alias("raw"))


REGION = "concat('chr', CAST(vec_id % 8 + 1 AS VARCHAR), ':', CAST(vec_id % 200 * 1000 AS VARCHAR), '-', CAST(vec_id % 200 * 1000 + 500 AS VARCHAR))"


def region(c="vec_id"):
    v = F.col(c)
    return F.concat(F.lit("chr"), v % 8 + 1, F.lit(":"), v % 200 * 1000, F.lit("-"), v % 200 * 1000 + 500)


@query("a43_motif_regions", f"""
WITH {HITS}, b AS (SELECT {REGION} AS region_id, max(x) AS score FROM h GROUP BY 1), n AS (SELECT score FROM b ORDER BY score DESC LIMIT 1 OFFSET 149)
SELECT region_id, round(score, 6) AS score, split_part(region_id, ':', 1) AS chrom, CAST(split_part(split_part(region_id, ':', 2), '-', 1) AS BIGINT) AS start,
 CAST(split_part(region_id, '-', 2) AS BIGINT) AS stop FROM b WHERE score > coalesce((SELECT score FROM n), -1)""")
def a43(t):
    hits = rows(t).select(region("row_id").alias("region_id"), F.explode("scores").alias("score"))
    return mo.motif_regions(hits, 150).withColumn("score", r6("score"))


@query("a44_regions_with_all", f"""
WITH {HITS}, s AS (SELECT f.vec_id, f.pos, f.x + r.x AS s FROM h f JOIN h r ON f.vec_id = r.vec_id AND r.pos = f.pos + 32 WHERE f.pos <= 2),
x AS (SELECT vec_id, max(s) AS score FROM s GROUP BY vec_id HAVING bool_and(s <> 0))
SELECT {REGION} AS region_id, round(max(score), 6) AS score FROM x GROUP BY 1""")
def a44(t):
    long = rows(t).select(F.col("row_id").alias("example_id"), region("row_id").alias("region_id"),
                          F.posexplode(F.arrays_zip(F.slice("scores", 1, 32).alias("fwd"), F.slice("scores", 33, 32).alias("rev"))).alias("pos", "z"))
    long = long.select("example_id", "region_id", F.concat(F.lit("m"), F.col("pos") + 1).alias("motif"), "z.fwd", "z.rev")
    return mo.regions_with_all(long, ["m1", "m2"]).withColumn("score", r6("score"))


@query("a45_homotypic_rows", f"""
WITH {HITS}, s AS (SELECT vec_id, count(*) FILTER (x > 0) AS n, avg(x) FILTER (x > 0) AS m, bool_or(x > 0 AND pos BETWEEN 33 - 4 AND 32 + 4) AS near FROM h GROUP BY vec_id),
c AS (SELECT quantile_cont(x, 0.2) AS cut FROM h WHERE x > 0 AND vec_id IN (SELECT vec_id FROM s WHERE n = 2))
SELECT vec_id FROM s, c WHERE m > cut AND near""")
def a45(t):
    return mo.homotypic_rows(rows(t), 4).select(F.col("row_id").alias("vec_id"))


DIST = f"""{HITS}, hh AS (SELECT vec_id, pos - 1 AS pos, x, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS o FROM h WHERE x <> 0 AND pos > 1),
 d AS (SELECT b.vec_id, CASE WHEN b.o = a.o + 1 THEN a.x ELSE b.x END AS start_score, CASE WHEN b.o = a.o + 1 THEN b.x ELSE a.x END AS stop_score, b.pos - a.pos AS distance
  FROM hh a JOIN hh b ON a.vec_id = b.vec_id AND b.o > a.o)"""


@query("a46_hit_distances", f"WITH {DIST} SELECT vec_id, round(start_score, 6) AS start_score, round(stop_score, 6) AS stop_score, CAST(distance AS INT) AS distance FROM d")
def a46(t):
    out = mo.hit_distances(rows(t))
    return out.select(F.col("row_id").alias("vec_id"), r6("start_score"), r6("stop_score"), "distance")


@query("a47_distance_histograms", f"""
WITH {DIST}, a AS (SELECT distance, sum(start_score) AS s FROM d WHERE distance > 4 AND vec_id % 2 = 0 GROUP BY 1), b AS (SELECT distance, sum(start_score) AS s FROM d WHERE distance > 4 AND vec_id % 2 = 1 GROUP BY 1),
f AS (SELECT distance, coalesce(a.s / (SELECT sum(s) FROM a), 0) AS x, coalesce(b.s / (SELECT sum(s) FROM b), 0) AS y FROM a FULL JOIN b USING (distance))
SELECT CAST(distance AS INT) AS distance, round(x, 6) AS share_a, round(y, 6) AS share_b, round(x - y, 6) + 0.0 AS difference FROM f""")
def a47(t):
    d = mo.hit_distances(rows(t))
    out = mo.distance_histograms(d.filter("row_id % 2 = 0"), d.filter("row_id % 2 = 1"))
    return out.select("distance", r6("share_a"), r6("share_b"), r6("difference"))


@query("a48_hits_and_means", f"WITH {HITS} SELECT vec_id, CAST(count(*) FILTER (x > 0) AS INT) AS n_hits, round(avg(x) FILTER (x > 0), 6) AS mean_score FROM h GROUP BY vec_id")
def a48(t):
    return mo.hits_and_means(rows(t)).select(F.col("row_id").alias("vec_id"), "n_hits", r6("mean_score"))


@query("a49_position_means", f"""
WITH {HITS}, c AS (SELECT *, count(*) FILTER (x > 0) OVER (PARTITION BY vec_id) AS n_hits FROM h)
SELECT CAST(n_hits AS INT) AS n_hits, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS mean_score, count(*) AS n_rows FROM c GROUP BY ALL HAVING count(*) > 30
UNION ALL SELECT NULL, CAST(pos - 1 AS INT), round(avg(x), 6), count(*) FROM c GROUP BY ALL""")
def a49(t):
    return mo.position_means(rows(t), 30).select("n_hits", "pos", r6("mean_score"), "n_rows")


@query("a50_spacing_distribution", f"""
WITH {HITS}, m AS (SELECT vec_id, min(pos) AS anc FROM h JOIN (SELECT vec_id, max(x) AS x FROM h GROUP BY 1) USING (vec_id, x) GROUP BY vec_id),
s AS (SELECT vec_id, first(raw ORDER BY pos) AS signal FROM e GROUP BY vec_id),
f AS (SELECT pos - anc AS position, x, signal FROM h JOIN m USING (vec_id) JOIN s USING (vec_id) WHERE abs(pos - anc) <= 30),
g AS (SELECT position, CASE WHEN position = 0 THEN 0 ELSE coalesce(avg(x) FILTER (x <> 0), 0) END AS m, count(*) FILTER (x <> 0) AS h, avg(signal) FILTER (x > 0) AS sg FROM f GROUP BY position)
SELECT CAST(position AS INT) AS position, round(m / (SELECT sum(m) FROM g), 6) AS share, round(h / (SELECT count(*) FROM embeddings), 6) AS frequency, round(sg, 6) + 0.0 AS mean_signal FROM g""")
def a50(t):
    out = mo.spacing_distribution(rows(t).withColumn("signal", F.element_at("raw", 1)), 30)
    return out.select("position", r6("share"), r6("frequency"), r6("mean_signal"))


@query("a51_activity_by_count", f"""
WITH {HITS}, c AS (SELECT vec_id, label AS motif, count(*) FILTER (x > 0) AS cnt FROM h GROUP BY ALL),
a AS (SELECT motif, cnt, CAST(embedding[1] AS DOUBLE) AS d0, CAST(embedding[2] AS DOUBLE) AS d3, CAST(embedding[3] AS DOUBLE) AS d6 FROM c JOIN embeddings USING (vec_id) WHERE cnt BETWEEN 1 AND 6),
l AS (SELECT motif, cnt, task, x FROM (UNPIVOT (SELECT * FROM a WHERE greatest(d0, d3, d6) > 0) ON d0, d3, d6 INTO NAME task VALUE x)),
m AS (SELECT motif, cnt, task, quantile_cont(x, 0.5) AS md FROM l GROUP BY ALL),
g AS (SELECT mt.motif, n.cnt, tk.task FROM (SELECT DISTINCT motif FROM c) mt, (SELECT unnest(range(1, 7)) AS cnt) n, (SELECT unnest(['d0', 'd3', 'd6']) AS task) tk),
f AS (SELECT g.*, coalesce(md, 0) AS md FROM g LEFT JOIN m USING (motif, cnt, task)), q AS (SELECT quantile_cont(md, 0.9) AS cut FROM f)
SELECT motif, CAST(cnt AS INT) AS count, task, round(md, 6) + 0.0 AS median, bool_or(md >= cut) OVER (PARTITION BY motif) AS keep FROM f, q""")
def a51(t):
    n = F.size(F.filter("scores", lambda x: x > 0))
    tasks = [F.element_at("raw", i + 1).alias(d) for i, d in enumerate(["d0", "d3", "d6"])]
    out = mo.activity_by_count(rows(t).select(F.col("label").alias("motif"), n.alias("count"), *tasks), ["d0", "d3", "d6"])
    return out.select("motif", "count", "task", r6("median"), "keep")


SIM = """SELECT concat(l_returnflag, l_linestatus) AS motif, l_orderkey AS sample, l_linenumber - 1 AS dose, l_extendedprice / CAST(10000 AS DOUBLE) AS prediction FROM {lineitem}"""
DOSE = """s AS ({sim}), b AS (SELECT motif, sample, min(prediction) AS b FROM s WHERE dose = 0 GROUP BY ALL),
 g AS (SELECT s.*, prediction - b AS gain FROM s JOIN b USING (motif, sample) WHERE dose > 0), k AS (SELECT * FROM g QUALIFY avg(gain) OVER (PARTITION BY motif, sample) > 0),
 m AS (SELECT motif, dose, quantile_cont(gain, 0.5) AS median FROM k GROUP BY ALL)""".replace("{sim}", SIM.format(lineitem="lineitem"))


@query("a52_dose_response", f"WITH {DOSE} SELECT motif, dose AS count, round(median, 6) AS median FROM m QUALIFY max(median) OVER (PARTITION BY motif) >= 2.5")
def a52(t):
    sim = t.spark.sql(SIM, lineitem=t.lineitem).withColumnRenamed("dose", "count")
    return mo.dose_response(sim, "count", 2.5).withColumn("median", r6("median"))


@query("a53_distance_response", f"WITH {DOSE} SELECT motif, dose * 10 AS distance, round(median, 6) AS median FROM m QUALIFY max(median) OVER (PARTITION BY motif) >= 1")
def a53(t):
    sim = t.spark.sql(SIM, lineitem=t.lineitem).withColumn("distance", F.col("dose") * 10).drop("dose")
    return mo.dose_response(sim, "distance", 1.0).withColumn("median", r6("median"))


def motif_hits(t):
    return t.peaks.select(*KEY, (F.col("start") % 4).alias("motif"), (F.col("start") % 6).alias("hits"))


@query("a54_multiplicity_sets", """
WITH m AS (SELECT chrom, start, stop, start % 4 AS motif, n FROM v_peaks JOIN (SELECT unnest(range(1, 6)) AS n) ON start % 6 >= n)
SELECT chrom, start, stop, motif, CAST(n AS INT) AS n FROM m QUALIFY count(*) OVER (PARTITION BY motif, n) >= 700""")
def a54_sets(t):
    return mo.multiplicity_sets(motif_hits(t), min_regions=700).select(*KEY, "motif", "n")


def with_vectors(t, regions):
    return regions.withColumn("id", F.concat(F.lit("R"), F.col("start") % 150)).join(vecs(t, "b1"), "id").drop("id")


REGION_SETS = """rs AS (SELECT chrom, start, stop, motif, n, motif * 10 + n AS cluster FROM (SELECT chrom, start, stop, start % 4 AS motif, start % 6 AS hits FROM v_peaks) JOIN (SELECT unnest(range(1, 6)) AS n) ON hits >= n
 QUALIFY count(*) OVER (PARTITION BY motif, n) >= 50)"""
SET_HOPS = HOPS.replace("(SELECT chrom, start, stop, start % 5 + 1 AS cluster FROM v_peaks)", "rs")


@query("a54_nested_means", f"""
WITH {SIG}, {REGION_SETS} SELECT motif, CAST(n AS INT) AS n, CAST(t AS INT) AS pos, round(avg(value), 6) AS mean FROM rs JOIN sig ON rep = 'b1' AND id = concat('R', CAST(start % 150 AS VARCHAR)) GROUP BY motif, n, t""")
def a54_means(t):
    out = mo.nested_means(with_vectors(t, motif_hits(t)), "vector", 10)
    return out.select("motif", "n", F.posexplode("mean_vector").alias("pos", "mean")).withColumn("mean", r6("mean"))


@query("a54_multiplicity_enrichment", f"""
WITH {SIG}, {GENE_SIG}, {REGION_SETS}, {SET_HOPS}, mv AS (SELECT cluster, t, avg(value) AS m FROM rs JOIN sig ON rep = 'b1' AND id = concat('R', CAST(start % 150 AS VARCHAR)) GROUP BY ALL),
sc AS (SELECT cluster, gene_id FROM g GROUP BY ALL HAVING sum(score) > 0.5),
l AS (SELECT sc.cluster, sc.gene_id FROM sc JOIN gs ON gs.gene_id = sc.gene_id JOIN mv ON mv.cluster = sc.cluster AND mv.t = gs.t GROUP BY ALL HAVING corr(value, m) > 0),
{MEMBERS}, hb AS (SELECT cluster, set_name, count(*) AS n_both FROM l JOIN m USING (gene_id) GROUP BY ALL), k AS (SELECT cluster, count(*) AS n_list FROM l WHERE gene_id IN (SELECT gene_id FROM u) GROUP BY cluster),
n AS (SELECT hb.*, n_list, n_set, (SELECT count(*) FROM u) AS n_total FROM hb JOIN k USING (cluster) JOIN (SELECT set_name, count(*) AS n_set FROM m GROUP BY set_name) USING (set_name))
SELECT cluster // 10 AS motif, CAST(max(cluster % 10) AS INT) AS max_enriched FROM n WHERE {fisher_sql('n_both', 'n_list', 'n_set', 'n_total')} < 0.2 GROUP BY 1""")
def a54(t):
    return mo.multiplicity_enrichment(with_vectors(t, motif_hits(t)), t.links, t.tss, t.chromsizes, t.tss, t.gene_sets, 0.2, gene_vectors(t), 10, extend=300)


PAIRS = """SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'FWD_FWD' WHEN 1 THEN 'FWD_REV' WHEN 2 THEN 'REV_FWD' ELSE 'REV_REV' END AS orientation,
 l_suppkey % 21 - 10 AS distance, l_quantity AS score FROM {lineitem}"""
_classes = ", ".join(f"('{c}', '{o}', '{s}')" for c, o, s in mo.SYNTAX_CLASSES)


@query("a55_syntax_classes", f"""
WITH p AS ({PAIRS.format(lineitem='lineitem')}), k(class, orientation, side) AS (VALUES {_classes}),
j AS (SELECT class, score FROM p JOIN k USING (orientation) WHERE side = '.' OR (side = '+' AND distance > 0) OR (side = '-' AND distance < 0))
SELECT class, count(*) AS n, round(avg(score), 6) AS mean_score, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q75 FROM j GROUP BY class HAVING count(*) >= 100""")
def a55(t):
    out = mo.syntax_summary(t.spark.sql(PAIRS, lineitem=t.lineitem), 100)
    return out.withColumn("mean_score", r6("mean_score"))


VECTOR_PAIRS = "CASE vec_id % 4 WHEN 0 THEN 'FWD_FWD' WHEN 1 THEN 'FWD_REV' WHEN 2 THEN 'REV_FWD' ELSE 'REV_REV' END AS orientation, vec_id % 21 - 10 AS distance"


@query("a55_syntax_profile", f"""
WITH p AS (SELECT vec_id, {VECTOR_PAIRS}, generate_subscripts(embedding, 1) - 33 AS position, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), k(class, orientation, side) AS (VALUES {_classes}),
j AS (SELECT class, position, avg(abs(x)) AS m, count(*) AS n FROM p JOIN k USING (orientation) WHERE side = '.' OR (side = '+' AND distance > 0) OR (side = '-' AND distance < 0) GROUP BY ALL),
z AS (SELECT class, position, n, CASE WHEN position = 0 THEN 0 ELSE m END AS m FROM j)
SELECT class, CAST(position AS INT) AS position, round(m / sum(m) OVER (PARTITION BY class), 6) AS active, n FROM z""")
def a55_profile(t):
    pairs = t.embeddings.select("vec_id", F.expr(VECTOR_PAIRS.split(" AS orientation")[0]).alias("orientation"), (F.col("vec_id") % 21 - 10).alias("distance"),
                                F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("scores"))
    return mo.syntax_profile(pairs, "scores", 32).withColumn("active", r6("active"))


PEAK_PAIRS = "CASE start % 4 WHEN 0 THEN 'FWD_FWD' WHEN 1 THEN 'FWD_REV' WHEN 2 THEN 'REV_FWD' ELSE 'REV_REV' END AS orientation, start % 21 - 10 AS distance"


@query("a55_syntax_enrichment", f"""
WITH p AS (SELECT chrom, start, stop, {PEAK_PAIRS} FROM v_peaks), k(class, orientation, side) AS (VALUES {_classes}),
j AS (SELECT class, chrom, start, stop FROM p JOIN k USING (orientation) WHERE side = '.' OR (side = '+' AND distance > 0) OR (side = '-' AND distance < 0)),
rs AS (SELECT DISTINCT class AS cluster, chrom, start, stop FROM (SELECT * FROM j QUALIFY count(*) OVER (PARTITION BY class) >= 1500)), {SET_HOPS},
{MEMBERS}, l AS (SELECT cluster, gene_id FROM g WHERE gene_id IN (SELECT gene_id FROM u) GROUP BY ALL HAVING sum(score) > 0.5), hb AS (SELECT cluster, set_name, count(*) AS n_both FROM l JOIN m USING (gene_id) GROUP BY ALL),
n AS (SELECT hb.*, n_list, n_set, (SELECT count(*) FROM u) AS n_total FROM hb JOIN (SELECT cluster, count(*) AS n_list FROM l GROUP BY cluster) USING (cluster) JOIN (SELECT set_name, count(*) AS n_set FROM m GROUP BY set_name) USING (set_name)),
q AS (SELECT *, {fisher_sql('n_both', 'n_list', 'n_set', 'n_total')} AS p FROM n), r AS (SELECT *, count(*) OVER (PARTITION BY cluster ORDER BY p) AS k, count(*) OVER (PARTITION BY cluster) AS c FROM q)
SELECT cluster AS class, set_name, n_both, n_set, n_list, round(p, 6) + 0.0 AS p_value, round(min(least(1, p * c / k)) OVER (PARTITION BY cluster ORDER BY p DESC), 5) AS q_value FROM r""")
def a55_enrichment(t):
    pairs = t.peaks.select(*KEY, F.expr(PEAK_PAIRS.split(" AS orientation")[0]).alias("orientation"), (F.col("start") % 21 - 10).alias("distance"))
    out = mo.syntax_enrichment(pairs, t.links, t.tss, t.chromsizes, t.tss, t.gene_sets, 1500, extend=300)
    return out.select("class", "set_name", "n_both", "n_set", "n_list", r6("p_value"), F.round("q_value", 5).alias("q_value"))


@query("a56_distance_ranges", f"""
WITH {HITS}, r(lo, hi) AS (VALUES (2, 5), (4, 9), (8, 20)), x AS (SELECT DISTINCT vec_id, lo, hi FROM h, r WHERE x > 0 AND ((pos - 33 >= lo AND pos - 33 < hi) OR (pos - 33 >= -hi AND pos - 33 < -lo)))
SELECT vec_id, lo, hi, count(*) OVER (PARTITION BY lo, hi) AS n_rows FROM x QUALIFY n_rows > 100""")
def a56(t):
    out = mo.distance_ranges(rows(t), [(2, 5), (4, 9), (8, 20)], 100)
    return out.select(F.col("row_id").alias("vec_id"), "lo", "hi", "n_rows")


@query("a57_solo_rows", f"""
WITH {HITS}, p AS (SELECT a.vec_id, a.pos, count(b.pos) AS c FROM h a JOIN e b ON a.vec_id = b.vec_id AND b.raw > 0.05 AND b.pos >= a.pos - 8 AND b.pos < a.pos + 8 WHERE a.x > 0 GROUP BY ALL),
s AS (SELECT vec_id, sum(c) AS c FROM p GROUP BY vec_id), n AS (SELECT vec_id, count(*) FILTER (raw > 0.05) AS total, count(*) FILTER (raw > {CUT}) AS n_hits FROM e GROUP BY vec_id)
SELECT vec_id, CAST(n_hits AS INT) AS n_hits, round(coalesce(c, 0) / total, 6) AS share FROM n LEFT JOIN s USING (vec_id) WHERE coalesce(c, 0) / total >= 0.9""")
def a57(t):
    imp = F.transform("raw", lambda x: F.when(x > 0.05, x).otherwise(0.0))
    return mo.solo_rows(rows(t).withColumn("importance", imp), 16).select(F.col("row_id").alias("vec_id"), "n_hits", r6("share"))


@query("a82_footprint_depth", """
WITH e AS (SELECT label AS track, generate_subscripts(embedding, 1) - 32 AS position, CAST(unnest(embedding) AS DOUBLE) + 2 AS x FROM embeddings),
p AS (SELECT track, position, avg(x) AS value FROM e GROUP BY ALL), n AS (SELECT track, position, value / avg(value) FILTER (abs(position) BETWEEN 25 AND 31) OVER (PARTITION BY track) AS v FROM p),
b AS (SELECT track, position, v - avg(v) FILTER (abs(position) BETWEEN 15 AND 24) OVER (PARTITION BY track) AS v FROM n)
SELECT track, round(avg(v) - max(v), 6) AS depth FROM b WHERE position BETWEEN -8 AND 8 GROUP BY track""")
def a82(t):
    flat = t.embeddings.select(F.col("label").alias("track"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    profile = flat.groupBy("track", (F.col("p") - 31).alias("position")).agg((F.avg(F.col("x") + 2)).alias("value"))
    return mo.footprint_depth(profile, (25, 31), (15, 24), (-8, 8)).withColumn("depth", r6("depth"))


RULE_DAYS = "SELECT concat('M', CAST(o_custkey % 40 AS STRING)) AS pwm1, concat('M', CAST(o_orderkey % 6 AS STRING)) AS pwm2, CAST(o_orderkey % 3 * 3 AS DOUBLE) AS day FROM {orders}"


@query("a83_motif_order", f"""
WITH r AS ({RULE_DAYS.format(orders='orders')}) SELECT motif, round(avg(day), 6) AS mean_day FROM (SELECT pwm1 AS motif, day FROM r UNION ALL SELECT pwm2, day FROM r) GROUP BY motif""")
def a83(t):
    return mo.motif_order(t.spark.sql(RULE_DAYS, orders=t.orders)).withColumn("mean_day", r6("mean_day"))


@query("a83_adjacency", f"""
WITH r AS ({RULE_DAYS.format(orders='orders')}) SELECT pwm1, {', '.join(f"count(*) FILTER (pwm2 = 'M{i}') AS M{i}" for i in range(6))} FROM r GROUP BY pwm1""")
def a83_adj(t):
    return mo.adjacency(t.spark.sql(RULE_DAYS, orders=t.orders), [f"M{i}" for i in range(6)])


@query("a84_distance_summary", """
WITH n AS (SELECT name, min(CASE WHEN a.start < b.stop AND b.start < a.stop THEN 0 WHEN b.stop <= a.start THEN a.start - b.stop + 1 ELSE b.start - a.stop + 1 END) AS d
  FROM v_peaks a JOIN v_tss b ON a.chrom = b.chrom GROUP BY name)
SELECT d // 50 * 50 AS bin, count(*) AS n, round((SELECT avg(CAST(d <= 10000 AS INT)) FROM n), 6) AS share_within FROM n GROUP BY 1""")
def a84(t):
    near = nearest_first(t.peaks.select(*KEY, "name"), t.tss, [])
    return mo.distance_summary(near, limit=10000).withColumn("share_within", r6("share_within"))


@query("a85_rule_regions_genes", f"""
WITH a AS (SELECT regexp_extract(metadata, 'active=([^:]+):', 1) AS chrom, CAST(regexp_extract(metadata, 'active=[^:]+:(\\d+)-', 1) AS BIGINT) AS start,
  CAST(regexp_extract(metadata, 'active=[^:]+:\\d+-(\\d+)', 1) AS BIGINT) AS stop FROM v_metadata), m AS (SELECT * FROM {merged('a')}),
{HOPS.replace("(SELECT chrom, start, stop, start % 5 + 1 AS cluster FROM v_peaks)", "(SELECT chrom, start, stop, 1 AS cluster FROM m)")}
SELECT gene_id, round(sum(score), 6) AS score, count(DISTINCT region_id) AS n_regions FROM g GROUP BY gene_id""")
def a85(t):
    return lk.linked_gene_counts(mo.rule_regions(t.metadata), t.links, t.tss, t.chromsizes, 300).withColumn("score", r6("score"))


def pwms(t):
    a = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 15)
    return t.embeddings.select(F.col("vec_id").alias("motif"), F.array(*[F.slice(a, i * 16 + 1, 16) for i in range(4)]).alias("weights"))


@query("j28_compare_motifs")
def j28(t):
    return mo.compare_motifs(pwms(t), 0.6, 0.4)


@query("u02_motif_correlation")
def u02(t):
    first = pwms(t).withColumn("next", F.col("motif") + 1)
    pairs = first.join(pwms(t).select(F.col("motif").alias("next"), F.col("weights").alias("other")), "next")
    return pairs.withColumn("s", mo.motif_correlation("weights", "other")).select("motif", "next", "s.cor", "s.ncor")


EDGES = "SELECT o_custkey AS src, (o_orderkey * 7 + o_custkey) % 1501 AS dst FROM {orders}"


def label_rounds(n):
    """SQL of n rounds of smallest labels over neighbours, enough for paths of n edges."""
    step = ("l{k} AS (SELECT l.id, least(l.label, coalesce(min(m.label), l.label)) AS label FROM l{j} l "
            "LEFT JOIN b ON b.src = l.id LEFT JOIN l{j} m ON m.id = b.dst GROUP BY l.id, l.label)")
    return ", ".join(step.format(k=k + 1, j=k) for k in range(n))


@query("a86_redundancy_groups", f"""
WITH ed AS MATERIALIZED ({EDGES.format(orders='orders')}), b AS MATERIALIZED (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed),
l0 AS (SELECT src AS id, src AS label FROM b GROUP BY src), {label_rounds(10)}
SELECT label, concat('M', CAST(id AS VARCHAR)) AS name, count(*) OVER (PARTITION BY label) AS size FROM l10""")
def a86(t):
    edges = t.spark.sql(EDGES, orders=t.orders)
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    labels = mo.connected_groups(nodes, edges)
    return mo.group_members(labels, nodes.withColumn("name", F.concat(F.lit("M"), "id")))
