"""Links, gene lists, annotations and variants: J12-J51, J54-J56, W15, A24, A25, A89."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionloom.catalog import query
from regionloom.catalog.sqlparts import merged, fisher_sql
from regionloom.catalog.views import r6
from regionloom.functions.coords import region_id
from regionloom.functions.tails import fisher_greater, r_critical
from regionloom.functions.text import unique_prefix
from regionloom.operators import annotate, links as lk, matrix, trajectories, variants
from regionloom.operators.sets import mirrored
from regionloom.plans.bins import KEY

IDOF = "concat({c}, ':', CAST({s} AS VARCHAR), '-', CAST({e} AS VARCHAR))"
ENDS = """ends AS (SELECT chrom, src_start AS start, src_stop AS stop FROM {src} UNION SELECT chrom, dst_start, dst_stop FROM {src})"""


def most_overlap(a: str, master: str) -> str:
    return f"""(SELECT a.chrom, a.start, a.stop, coalesce(m.start, a.start) AS m_start, coalesce(m.stop, a.stop) AS m_stop
    FROM {a} a LEFT JOIN {master} m ON a.chrom = m.chrom AND a.start < m.stop AND m.start < a.stop
    QUALIFY row_number() OVER (PARTITION BY a.chrom, a.start, a.stop
      ORDER BY least(a.stop, m.stop) - greatest(a.start, m.start) DESC, m.start, m.stop) = 1)"""


def rec(links: str, master_sql: str, src: str | None = None) -> str:
    sid, did = IDOF.format(c="l.chrom", s="s.m_start", e="s.m_stop"), IDOF.format(c="l.chrom", s="d.m_start", e="d.m_stop")
    return f"""{ENDS.format(src=src or links)}, master AS {master_sql}, nm AS {most_overlap('ends', 'master')},
 rec AS (SELECT l.*, {sid} AS src_id, {did} AS dst_id FROM {links} l
  JOIN nm s ON l.chrom = s.chrom AND l.src_start = s.start AND l.src_stop = s.stop
  JOIN nm d ON l.chrom = d.chrom AND l.dst_start = d.start AND l.dst_stop = d.stop)"""


@query("j12_most_overlapping", f"""
WITH a AS (SELECT DISTINCT chrom, start, stop FROM v_reads), m AS (SELECT DISTINCT chrom, start, stop FROM v_peaks)
SELECT * FROM {most_overlap('a', 'm')}""")
def j12(t):
    return lk.most_overlapping(t.reads, t.peaks)


UNION_REC = rec("v_links", merged("ends", 200))


@query("j13_reconcile_union", f"WITH {UNION_REC} SELECT src_id, dst_id, timepoint, round(score, 7) AS score FROM rec")
def j13(t):
    return lk.reconcile(t.links).select("src_id", "dst_id", "timepoint", F.round("score", 7).alias("score"))


SIG = """grid AS (SELECT id, rep, p.t FROM (SELECT DISTINCT id, rep FROM v_signal) CROSS JOIN (SELECT unnest(range(10)) AS t) p),
 sig AS (SELECT g.id, g.rep, g.t, coalesce(s.value, 0) AS value FROM grid g LEFT JOIN v_signal s ON g.id = s.id AND g.rep = s.rep AND g.t = s.t)"""


#: Both replicates added up, as the trajectories are clustered.
POOLED = "pooled AS (SELECT id, t, sum(value) AS value FROM sig GROUP BY id, t)"


def pooled_vecs(t):
    return matrix.vectors(t.signal.groupBy("id", "t").agg(F.sum("value").alias("value")), "id", "t", list(range(10)))


def vecs(t, rep):
    return matrix.vectors(t.signal.filter(F.col("rep") == rep), "id", "t", list(range(10)))


@query("j14_correlate_ends", f"""
WITH {SIG}, r AS (SELECT a.id AS src_id, b.id AS dst_id, corr(a.value, b.value) AS r FROM sig a JOIN sig b ON a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2' GROUP BY ALL)
SELECT src_start, dst_start, src_id, dst_id, round(r, 6) AS r FROM
 (SELECT src_start, dst_start, concat('R', CAST(src_start % 150 AS VARCHAR)) AS src_id, concat('R', CAST(dst_start % 150 AS VARCHAR)) AS dst_id FROM v_links)
JOIN r USING (src_id, dst_id) WHERE abs(r) >= 0.3""")
def j14(t):
    sid = lambda c: F.concat(F.lit("R"), F.col(c) % 150)
    links = t.links.select("src_start", "dst_start", sid("src_start").alias("src_id"), sid("dst_start").alias("dst_id"))
    out = lk.correlate_ends(links, vecs(t, "b1"), vecs(t, "b2"), 0.3, absolute=True)
    return out.select("src_start", "dst_start", "src_id", "dst_id", r6("r"))


TP = ["d0", "d3", "d6"]
WIDE = ", ".join(f"coalesce(max(score) FILTER (timepoint = '{d}'), 0) AS {d}" for d in TP)


@query("j15_inner_scores", f"""
WITH {rec('v_replinks', merged('ends', 200))}
SELECT src_id, dst_id, round(max(score) FILTER (rep = 'b1'), 10) AS b1, round(max(score) FILTER (rep = 'b2'), 10) AS b2
FROM rec GROUP BY src_id, dst_id HAVING count(DISTINCT rep) = 2""")
def j15(t):
    out = lk.score_matrix(lk.reconcile(t.replinks), "rep", ["b1", "b2"], need_all=True)
    return out.select("src_id", "dst_id", F.round("b1", 10).alias("b1"), F.round("b2", 10).alias("b2"))


@query("j16_outer_scores", f"WITH {UNION_REC} SELECT src_id, dst_id, {WIDE} FROM rec GROUP BY src_id, dst_id")
def j16(t):
    return lk.score_matrix(lk.reconcile(t.links), "timepoint", TP, need_all=False)


QN = """wide AS (SELECT src_id, dst_id, {wide} FROM rec GROUP BY src_id, dst_id),
 lng AS (UNPIVOT wide ON {cols} INTO NAME sample VALUE value),
 rk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY value) AS rn, count(*) OVER (PARTITION BY sample ORDER BY value) AS k FROM lng),
 mn AS (SELECT rn, avg(value) AS normalised FROM rk GROUP BY rn),
 qn AS (SELECT src_id, dst_id, sample, normalised FROM rk JOIN mn ON rk.k = mn.rn)"""
QWIDE = ", ".join(f"max(normalised) FILTER (sample = '{d}') AS {d}" for d in TP)


@query("j54_replicate_consistent", f"""
WITH allr AS (SELECT *, rep AS sample FROM v_replinks UNION ALL SELECT chrom, src_start, src_stop, dst_start, dst_stop, score, NULL, 'pooled' FROM v_links),
pe AS (SELECT chrom, src_start AS start, src_stop AS stop FROM v_links UNION SELECT chrom, dst_start, dst_stop FROM v_links),
{rec('allr', '(SELECT * FROM pe)')},
w AS (SELECT src_id, dst_id, max(score) FILTER (sample = 'pooled') AS pooled, max(score) FILTER (sample = 'b1') AS b1,
  max(score) FILTER (sample = 'b2') AS b2 FROM rec GROUP BY src_id, dst_id HAVING count(DISTINCT sample) = 3),
m AS (SELECT * FROM w UNION SELECT dst_id, src_id, pooled, b1, b2 FROM w)
SELECT src_id, dst_id, round(pooled, 10) AS pooled, round(b1, 10) AS b1, round(b2, 10) AS b2 FROM m
QUALIFY row_number() OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id) ORDER BY pooled DESC, src_id, dst_id, b1, b2) = 1""")
def j54(t):
    out = lk.replicate_consistent(t.replinks, t.links.drop("timepoint"), ["b1", "b2"])
    return out.select("src_id", "dst_id", *[F.round(c, 10).alias(c) for c in ("pooled", "b1", "b2")])


@query("j55_timepoint_consistent", f"""
WITH {UNION_REC}, {QN.format(wide=WIDE, cols=', '.join(TP))},
w AS (SELECT src_id, dst_id, {QWIDE} FROM qn GROUP BY src_id, dst_id), m AS (SELECT * FROM w UNION SELECT dst_id, src_id, d0, d3, d6 FROM w)
SELECT src_id, dst_id, round(d0, 10) AS d0, round(d3, 10) AS d3, round(d6, 10) AS d6 FROM m
QUALIFY row_number() OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id) ORDER BY greatest(d0, d3, d6) DESC, src_id, dst_id, d0, d3, d6) = 1""")
def j55(t):
    out = lk.timepoint_consistent(t.links, TP)
    return out.select("src_id", "dst_id", *[F.round(c, 10).alias(c) for c in TP])


@query("j56_union_signal", f"""
WITH {UNION_REC}, {QN.format(wide=WIDE, cols=', '.join(TP))}, w AS (SELECT src_id, dst_id, {QWIDE} FROM qn GROUP BY src_id, dst_id)
SELECT src_id, dst_id, round(d0, 10) AS d0, round(d3, 10) AS d3, round(d6, 10) AS d6 FROM w WHERE least(d0, d3, d6) < greatest(d0, d3, d6)""")
def j56(t):
    out = lk.union_signal(t.links, TP, "timepoint")
    return out.select("src_id", "dst_id", *[F.round(c, 10).alias(c) for c in TP])


PAIR_IDS = "SELECT concat('R', CAST(src_start % 200 AS STRING)) AS src_id, concat('R', CAST(dst_start % 200 AS STRING)) AS dst_id, src_start AS pos, score FROM {links}"


@query("w15_canonical_pairs", f"""
WITH p AS ({PAIR_IDS.format(links='v_links')})
SELECT src_id, dst_id FROM p QUALIFY row_number() OVER (PARTITION BY least(src_id, dst_id), greatest(src_id, dst_id) ORDER BY pos, src_id, dst_id) = 1""")
def w15(t):
    return lk.canonical_pairs(t.spark.sql(PAIR_IDS, links=t.links), F.col("pos"))


@query("w01_group_max", f"""
WITH p AS ({PAIR_IDS.format(links='v_links')})
SELECT src_id, dst_id, pos FROM p QUALIFY max(score) OVER (PARTITION BY src_id) = score""")
def w01(t):
    from regionloom.operators.ordering import rows_at_max
    return rows_at_max(t.spark.sql(PAIR_IDS, links=t.links), ["src_id"], "score").drop("score")


@query("w02_first_per_key", f"""
WITH p AS ({PAIR_IDS.format(links='v_links')})
SELECT src_id, dst_id, pos FROM p QUALIFY row_number() OVER (PARTITION BY src_id, dst_id ORDER BY pos) = 1""")
def w02(t):
    from regionloom.operators.transforms import first_per_key
    return first_per_key(t.spark.sql(PAIR_IDS, links=t.links), ["src_id", "dst_id"], [F.col("pos")]).drop("score")


HOPS = """h AS (SELECT l.chrom, dst_start, dst_stop, l.score, r.start, r.stop, r.cluster FROM v_links l
  JOIN (SELECT chrom, start, stop, start % 5 + 1 AS cluster FROM v_peaks) r ON l.chrom = r.chrom AND l.src_start < r.stop AND r.start < l.src_stop),
 g AS (SELECT h.*, t.gene_id, concat(h.chrom, ':', CAST(h.start AS VARCHAR), '-', CAST(h.stop AS VARCHAR)) AS region_id FROM h JOIN v_tss t ON h.chrom = t.chrom
  AND t.start < least(4000000, dst_stop + 300) AND greatest(0, dst_start - 300) < t.stop)"""


def linked(t):
    return t.peaks.select(*KEY, (F.col("start") % 5 + 1).alias("cluster")), t.links, t.tss, t.chromsizes, 300


@query("j30_regions_to_genes", f"""
WITH {HOPS} SELECT gene_id, round(sum(score), 6) AS score, count(DISTINCT region_id) AS n_regions FROM g
WHERE gene_id IN (SELECT id FROM v_contrasts WHERE padj < 0.02) GROUP BY gene_id HAVING sum(score) > 10""")
def j30(t):
    listed = t.contrasts.filter("padj < 0.02").select(F.col("id").alias("gene_id"))
    return lk.linked_gene_counts(*linked(t), genes=listed, min_score=10.0).withColumn("score", r6("score"))


GENE_SIG = """gs AS (SELECT gene_id, s.t, s.value FROM v_tss JOIN sig s ON s.rep = 'b2' AND s.id = concat('R', CAST(start % 150 AS VARCHAR)))"""


def gene_vectors(t):
    ids = t.tss.select("gene_id", F.concat(F.lit("R"), F.col("start") % 150).alias("id"))
    return ids.join(vecs(t, "b2"), "id").drop("id")


def mean_vectors(t, by=None):
    rows = t.peaks.select((F.col("start") % 5 + 1).alias("cluster"), F.concat(F.lit("R"), F.col("start") % 150).alias("id"))
    long = rows.join(vecs(t, "b1"), "id").select("cluster", F.posexplode("vector").alias("t", "value"))
    means = long.groupBy(*(by or []), "t").agg(F.avg("value").alias("value"))
    key = by[0] if by else "all_"
    means = means if by else means.withColumn("all_", F.lit(0))
    out = matrix.vectors(means, key, "t", list(range(10)), out="mean_vector")
    return out if by else out.drop("all_")


@query("j31_correlated_genes", f"""
WITH {HOPS}, {SIG}, {GENE_SIG}, mv AS (SELECT s.t, avg(s.value) AS m FROM v_peaks p JOIN sig s ON s.rep = 'b1' AND s.id = concat('R', CAST(p.start % 150 AS VARCHAR)) GROUP BY s.t),
c AS (SELECT gene_id, corr(value, m) AS r FROM gs JOIN mv USING (t) GROUP BY gene_id),
k AS (SELECT gene_id FROM c WHERE r > 0 AND abs(r) >= {r_critical(10, 0.5)!r})
SELECT DISTINCT gene_id, region_id FROM g WHERE gene_id IN (SELECT gene_id FROM k)""")
def j31(t):
    regions, links, tss, *rest = linked(t)
    kept = lk.correlated_genes(tss.select("gene_id").distinct(), gene_vectors(t), mean_vectors(t), 0.0, r_critical(10, 0.5))
    return lk.linked_pairs(regions, links, tss.join(kept, "gene_id", "left_semi"), *rest)


@query("j32_clusters_to_genes", f"""
WITH {HOPS}, {SIG}, {GENE_SIG}, mv AS (SELECT p.start % 5 + 1 AS cluster, s.t, avg(s.value) AS m FROM v_peaks p
  JOIN sig s ON s.rep = 'b1' AND s.id = concat('R', CAST(p.start % 150 AS VARCHAR)) GROUP BY 1, 2),
c AS (SELECT cluster, gene_id, corr(value, m) AS r FROM gs JOIN mv USING (t) GROUP BY ALL)
SELECT cluster, gene_id, round(sum(score), 6) AS score, count(DISTINCT region_id) AS n_regions, round(any_value(r), 6) AS r
FROM g JOIN c USING (cluster, gene_id) WHERE r > 0.1 GROUP BY cluster, gene_id""")
def j32(t):
    genes = lk.linked_gene_counts(*linked(t), ["cluster"])
    out = lk.correlated_genes(genes, gene_vectors(t), mean_vectors(t, ["cluster"]), 0.1, 0.0, by=["cluster"])
    return out.select("cluster", "gene_id", r6("score"), "n_regions", r6("r"))


CONF = """a AS (SELECT DISTINCT gene_id, start % 5 + 1 AS cluster FROM v_tss), b AS (SELECT DISTINCT gene_id, CAST(substr(set_name, 7) AS BIGINT) AS cluster FROM v_gene_sets),
 u AS (SELECT count(*) AS n FROM (SELECT gene_id FROM a UNION SELECT gene_id FROM b)),
 t AS (SELECT ca.cluster AS a_cluster, cb.cluster AS b_cluster, ca.na, cb.nb, u.n,
  (SELECT count(*) FROM a JOIN b USING (gene_id) WHERE a.cluster = ca.cluster AND b.cluster = cb.cluster) AS n11
  FROM (SELECT cluster, count(*) AS na FROM a GROUP BY 1) ca, (SELECT cluster, count(*) AS nb FROM b GROUP BY 1) cb, u),
 f AS (SELECT a_cluster, b_cluster, n11, na - n11 AS n10, nb - n11 AS n01, n - na - nb + n11 AS n00 FROM t),
 o AS (SELECT *, CASE WHEN n10 * n01 <> 0 THEN n11 * n00 / (n10 * n01) END AS odds_ratio FROM f)"""


def confusion(t):
    a = t.tss.select("gene_id", (F.col("start") % 5 + 1).alias("cluster"))
    b = t.gene_sets.select("gene_id", F.substring("set_name", 7, 5).cast("long").alias("cluster"))
    return lk.cluster_confusion(a, b)


@query("j29_cluster_memberships", f"WITH {CONF} SELECT a_cluster, b_cluster, n11, n10, n01, n00 FROM f")
def j29(t):
    return confusion(t).drop("odds_ratio")


@query("a24_confusion_matrix", f"""
WITH {CONF}, r AS (SELECT *, odds_ratio / sum(odds_ratio) OVER (PARTITION BY a_cluster) AS s FROM o)
SELECT a_cluster, b_cluster, round(odds_ratio, 6) AS odds_ratio, round(s / sum(s) OVER (PARTITION BY b_cluster), 6) AS share FROM r""")
def a24(t):
    out = lk.normalised_confusion(confusion(t))
    return out.select("a_cluster", "b_cluster", r6("odds_ratio"), r6("share"))


@query("u04_fisher_greater", f"""
WITH {CONF} SELECT a_cluster, b_cluster, n11, n10, n01, n00, odds_ratio, round({fisher_sql('n11', '(n11 + n10)', '(n11 + n01)', '(n11 + n10 + n01 + n00)')}, 6) + 0.0 AS p_value FROM o""")
def u04(t):
    return confusion(t).withColumn("p_value", r6(fisher_greater("n11", "n10", "n01", "n00")))


@query("a25_cluster_correlation", f"""
WITH {SIG}, m AS (SELECT cluster, rep, t, avg(value) AS value FROM sig JOIN v_clusters USING (id) GROUP BY ALL)
SELECT a.cluster AS a_cluster, b.cluster AS b_cluster, round(corr(a.value, b.value), 6) AS r FROM m a JOIN m b ON a.t = b.t AND a.rep = 'b1' AND b.rep = 'b2' GROUP BY ALL""")
def a25(t):
    out = trajectories.cluster_correlation(vecs(t, "b1").join(t.clusters, "id"), vecs(t, "b2").join(t.clusters, "id"))
    return out.select("a_cluster", "b_cluster", r6("r"))


@query("a89_undirected_counts", """
WITH m AS (SELECT chrom, src_start, src_stop, dst_start, dst_stop, timepoint FROM v_links UNION SELECT chrom, dst_start, dst_stop, src_start, src_stop, timepoint FROM v_links)
SELECT timepoint, count(*) / 2 AS n_links FROM m GROUP BY timepoint""")
def a89(t):
    return lk.undirected_counts(mirrored(t.links.drop("score")))


# ---- id tables and annotations ----

@query("j17_merge_memberships", """
WITH a AS (SELECT id, cluster FROM v_clusters WHERE cluster < 4), b AS (SELECT DISTINCT id, t % 3 + 1 AS cluster FROM v_signal WHERE t = 1 AND rep = 'b1')
SELECT id, coalesce(a.cluster, 0) AS c0, coalesce(b.cluster, 0) AS c1, CAST(coalesce(a.cluster, 0) + 10 * coalesce(b.cluster, 0) AS BIGINT) AS code FROM a FULL JOIN b USING (id)""")
def j17(t):
    b = t.signal.filter("t = 1 and rep = 'b1'").select("id", (F.col("t") % 3 + 1).cast("int").alias("cluster")).distinct()
    return annotate.merge_memberships([t.clusters.filter("cluster < 4"), b])


@query("j18_matching_matrix", """
WITH s AS (SELECT id, max(n) FILTER (t = 0) AS t0, max(n) FILTER (t = 1) AS t1 FROM v_signal WHERE rep = 'b2' GROUP BY id)
SELECT p.id, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1 FROM (SELECT DISTINCT concat('GENE', CAST(c_custkey AS VARCHAR)) AS id FROM customer) p
LEFT JOIN s ON s.id = replace(p.id, 'GENE', 'R')""")
def j18(t):
    second = t.signal.filter("rep = 'b2'").groupBy("id").agg(*[F.max(F.when(F.col("t") == i, F.col("n"))).alias(f"t{i}") for i in (0, 1)])
    primary = t.tss.select(F.col("gene_id").alias("id"))
    mapping = primary.select("id", F.replace("id", F.lit("GENE"), F.lit("R")).alias("other"))
    renamed = second.withColumnRenamed("id", "other").join(mapping, "other").drop("other")
    return annotate.matching_matrix(primary, renamed)


def symbols(t):
    return t.part.filter("p_size < 5").select(F.upper(F.substring("p_name", 1, 3)).alias("a"), "p_partkey").select(
        F.concat("a", F.col("p_partkey") % 500).alias("hgnc_symbol"))


SYMBOLS = "s AS (SELECT DISTINCT concat(upper(substr(p_name, 1, 3)), CAST(p_partkey % 500 AS VARCHAR)) AS hgnc_symbol FROM part WHERE p_size < 5)"


@query("j19_symbols_to_rows", f"""
WITH {SYMBOLS} SELECT c.id, contrast, padj, hgnc_symbol FROM v_contrasts c JOIN (SELECT DISTINCT ensembl_gene_id, hgnc_symbol FROM v_mapping JOIN s USING (hgnc_symbol)) m ON c.id = m.ensembl_gene_id""")
def j19(t):
    return annotate.symbols_to_rows(t.contrasts.select("id", "contrast", "padj"), symbols(t), t.mapping)


@query("j20_symbols_to_ids", f"WITH {SYMBOLS} SELECT DISTINCT ensembl_gene_id, hgnc_symbol FROM v_mapping JOIN s USING (hgnc_symbol)")
def j20(t):
    return annotate.symbols_to_ids(symbols(t), t.mapping)


@query("j21_annotate", "SELECT gene_id, chrom, hgnc_symbol FROM v_tss LEFT JOIN v_mapping ON gene_id = ensembl_gene_id")
def j21(t):
    return annotate.annotate(t.tss.select("gene_id", "chrom"), t.mapping.drop("entrezgene_id"), "gene_id")


@query("j22_genes_to_tss", """
WITH l AS (SELECT DISTINCT id AS gene_id FROM v_contrasts WHERE padj < 0.01)
SELECT chrom, start, gene_id FROM v_tss WHERE gene_id IN (SELECT gene_id FROM l)
UNION ALL SELECT NULL, NULL, gene_id FROM l WHERE gene_id NOT IN (SELECT gene_id FROM v_tss)""")
def j22(t):
    found, missing = annotate.genes_to_tss(t.contrasts.filter("padj < 0.01").select(F.col("id").alias("gene_id")), t.tss)
    return found.select("chrom", "start", "gene_id").unionByName(missing, allowMissingColumns=True)


GENE_CLUSTERS = "SELECT concat('GENE', CAST(p_partkey AS STRING)) AS id, CAST(p_size % 6 + 1 AS INT) AS cluster FROM {part} WHERE p_size < 40"


@query("j23_name_with_cluster", f"""
WITH c AS ({GENE_CLUSTERS.format(part='part')})
SELECT gene_id, concat('gene_id=', gene_id, ';traj=', CAST(coalesce(cluster, -1) AS VARCHAR)) AS name FROM v_tss LEFT JOIN c ON gene_id = id""")
def j23(t):
    return annotate.name_with_cluster(t.tss, t.spark.sql(GENE_CLUSTERS, part=t.part)).select("gene_id", "name")


@query("j24_tss_regions", """
SELECT chrom, start, stop, name FROM v_peaks a WHERE EXISTS (SELECT 1 FROM v_tss b WHERE a.chrom = b.chrom AND b.start < a.stop AND a.start < b.stop
 AND gene_id IN (SELECT id FROM v_contrasts WHERE padj < 0.06))""")
def j24(t):
    ids = t.contrasts.filter("padj < 0.06").select(F.col("id").alias("gene_id"))
    return annotate.tss_regions(ids, t.tss, t.peaks.select(*KEY, "name"))


@query("j25_symbols_containing", f"""
WITH c AS ({GENE_CLUSTERS.format(part='part')})
SELECT id, cluster, hgnc_symbol, w AS match FROM c JOIN v_mapping ON id = ensembl_gene_id JOIN (SELECT unnest(['RED', '12', 'BL']) AS w) ON contains(hgnc_symbol, w)""")
def j25(t):
    out = annotate.symbols_containing(t.spark.sql(GENE_CLUSTERS, part=t.part), t.mapping, ["RED", "12", "BL"])
    return out.select("id", "cluster", "hgnc_symbol", "match")


PKID = IDOF.format(c="chrom", s="start", e="stop")


@query("j33_promoter_table", f"""
WITH n AS (SELECT a.*, b.start AS bs, b.stop AS be, CASE WHEN a.start < b.stop AND b.start < a.stop THEN 0 WHEN b.stop <= a.start THEN a.start - b.stop + 1 ELSE b.start - a.stop + 1 END AS d
  FROM v_tss a JOIN v_peaks b ON a.chrom = b.chrom QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY d, b.start, b.stop) = 1),
m AS (SELECT gene_id, strand, CASE WHEN d <= 500 THEN bs + (be - bs) // 2 ELSE start END AS start, CASE WHEN d <= 500 THEN {IDOF.format(c='chrom', s='bs', e='be')} END AS atac_id FROM n),
sg AS (SELECT {PKID} AS id, max(signal_value) FILTER (timepoint = 'd00') AS d00, max(signal_value) FILTER (timepoint <> 'd00') AS d30 FROM v_peaks GROUP BY chrom, start, stop),
rc AS ({GENE_CLUSTERS.format(part='part')}), ac AS (SELECT {PKID} AS id, min(start % 9) AS cluster FROM v_peaks GROUP BY chrom, start, stop)
SELECT gene_id, start, coalesce(d00, 0) AS d00, coalesce(d30, 0) AS d30, CAST(coalesce(d00, 0) = 0 OR coalesce(d30, 0) = 0 AS INT) AS atac_not_present,
 coalesce(rc.cluster, 12) AS rna_cluster, coalesce(ac.cluster, 16) AS atac_cluster
FROM m LEFT JOIN sg ON atac_id = sg.id LEFT JOIN rc ON gene_id = rc.id LEFT JOIN ac ON atac_id = ac.id""")
def j33(t):
    p = t.peaks.withColumn("id", region_id())
    signal = p.groupBy("id").agg(F.max(F.when(F.col("timepoint") == "d00", F.col("signal_value"))).alias("d00"),
                                 F.max(F.when(F.col("timepoint") != "d00", F.col("signal_value"))).alias("d30"))
    signal = signal.fillna(0.0, ["d00", "d30"])
    atac = p.groupBy("id").agg(F.min(F.col("start") % 9).alias("cluster"))
    out = annotate.promoter_table(t.tss, t.peaks, signal, t.spark.sql(GENE_CLUSTERS, part=t.part), atac)
    return out.select("gene_id", "start", "d00", "d30", "atac_not_present", "rna_cluster", "atac_cluster")


@query("j39_respelled_join", f"""
SELECT replace(replace({PKID}, ':', '_'), '-', '_') AS id, signal_value, q_value FROM v_peaks WHERE o_ok""".replace("WHERE o_ok", ""))
def j39(t):
    a = t.peaks.select(region_id().alias("id"), "signal_value", "name")
    b = t.peaks.select(F.concat_ws("_", "chrom", "start", "stop").alias("id"), "q_value", F.col("name").alias("b_name"))
    return annotate.respelled_join(a, b).filter("name = b_name").select("id", "signal_value", "q_value")


MOTIFS = """SELECT p_partkey, concat('M', CAST(p_partkey AS STRING)) AS motif,
 concat('GENE', CAST(p_partkey * 3 % 2000 AS STRING), ';GENE', CAST(p_partkey * 7 % 2000 AS STRING), ';GENE', CAST(p_partkey * 11 % 2000 + 1 AS STRING)) AS gene_ids FROM {part}"""


@query("j40_expressed_genes", f"""
WITH m AS ({MOTIFS.format(part='part')}), i AS (SELECT motif, generate_subscripts(string_split(gene_ids, ';'), 1) AS pos, unnest(string_split(gene_ids, ';')) AS gene_id FROM m),
x AS (SELECT i.*, hgnc_symbol FROM i LEFT JOIN v_mapping ON gene_id = ensembl_gene_id WHERE gene_id IN (SELECT id FROM v_contrasts WHERE base_mean > 50000))
SELECT m.motif, string_agg(gene_id, ';' ORDER BY pos) AS expressed, string_agg(hgnc_symbol, ';' ORDER BY pos) AS expressed_hgnc FROM m LEFT JOIN x USING (motif) GROUP BY m.motif""")
def j40(t):
    live = t.contrasts.filter("base_mean > 50000").select(F.col("id").alias("gene_id"))
    return annotate.expressed_genes(t.spark.sql(MOTIFS, part=t.part), live, t.mapping).select("motif", "expressed", "expressed_hgnc")


@query("j41_rename_motifs", """
WITH m AS (SELECT p_partkey, CAST(p_partkey * 2 AS BIGINT) AS entrez, concat(upper(substr(p_name, 1, 3)), CAST(p_partkey % 700 AS VARCHAR)) AS symbol FROM part)
SELECT p_partkey, coalesce((SELECT min(ensembl_gene_id) FROM v_mapping WHERE entrezgene_id = entrez), (SELECT min(ensembl_gene_id) FROM v_mapping WHERE hgnc_symbol = symbol), 'UNK') AS ensembl FROM m""")
def j41(t):
    m = t.part.select("p_partkey", (F.col("p_partkey") * 2).alias("entrez"),
                      F.concat(F.upper(F.substring("p_name", 1, 3)), F.col("p_partkey") % 700).alias("symbol"))
    return annotate.rename_motifs(m, t.mapping).select("p_partkey", "ensembl")


@query("j42_transfer", """
SELECT n.name, n.alias, r.payload FROM (SELECT s_name AS name, s_nationkey AS alias FROM supplier) n JOIN (SELECT n_nationkey AS alias, n_name AS payload FROM nation) r USING (alias)""")
def j42(t):
    names = t.supplier.select(F.col("s_name").alias("name"))
    first = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("alias"))
    return annotate.transfer(names, first, t.nation.select(F.col("n_nationkey").alias("alias"), F.col("n_name").alias("payload")))


@query("j43_motifs_to_factors", f"""
WITH m AS ({MOTIFS.format(part='part')})
SELECT pos, CAST(sub_pos - 1 AS INT) AS sub_pos, gene_id FROM (SELECT p_partkey AS pos, generate_subscripts(string_split(gene_ids, ';'), 1) AS sub_pos, unnest(string_split(gene_ids, ';')) AS gene_id FROM m)
WHERE gene_id IN (SELECT gene_id FROM v_tss)""")
def j43(t):
    m = t.spark.sql(MOTIFS, part=t.part).select(F.col("p_partkey").alias("pos"), F.col("gene_ids").alias("factors"))
    return annotate.motifs_to_factors(m, t.tss)


RULES = """SELECT o_orderkey AS rule, concat('M', CAST(o_orderkey % 2000 AS STRING)) AS pwm1, concat('M', CAST(o_custkey % 2000 AS STRING)) AS pwm2,
 CASE o_orderstatus WHEN 'F' THEN 'FAILED.TRAJ' WHEN 'O' THEN 'SYNERGY' ELSE 'BUFFER' END AS interaction FROM {orders}"""


@query("j44_rule_edges", f"""
WITH r AS ({RULES.format(orders='orders')}), m AS ({MOTIFS.format(part='part')}), {SIG}, {GENE_SIG},
pk AS (SELECT gene_id, arg_max(t, value) AS peak FROM (SELECT * FROM gs ORDER BY t) GROUP BY gene_id),
pk2 AS (SELECT gene_id, min(t) AS peak FROM gs JOIN (SELECT gene_id, max(value) AS value FROM gs GROUP BY 1) USING (gene_id, value) GROUP BY gene_id),
i AS (SELECT motif, generate_subscripts(string_split(gene_ids, ';'), 1) AS pos, unnest(string_split(gene_ids, ';')) AS gene_id FROM m),
l AS (SELECT motif, string_agg(concat(gene_id, '.s;', CAST(peak AS VARCHAR)), ';' ORDER BY pos) AS tf FROM i JOIN pk2 USING (gene_id) GROUP BY motif)
SELECT rule, pwm1, pwm2, interaction, coalesce(a.tf, '') AS tf1, coalesce(b.tf, '') AS tf2 FROM r LEFT JOIN l a ON pwm1 = a.motif LEFT JOIN l b ON pwm2 = b.motif
WHERE interaction NOT LIKE '%FAILED%'""")
def j44(t):
    m = t.spark.sql(MOTIFS, part=t.part).withColumn("expressed", F.col("gene_ids")).withColumn(
        "expressed_hgnc", F.regexp_replace("gene_ids", r"(GENE\d+)", "$1.s"))
    return annotate.rule_edges(t.spark.sql(RULES, orders=t.orders), m, gene_vectors(t))


@query("j45_summit_windows", """
WITH e AS (SELECT name, name AS region_id, start - 100 + start % 200 AS start, start + start % 200 AS stop FROM v_peaks), s AS (SELECT name AS region_id, start + summit_offset AS summit FROM v_peaks)
SELECT name, summit - start AS "offset" FROM e JOIN s USING (region_id) WHERE summit >= start AND summit < stop""")
def j45(t):
    shift = F.col("start") % 200
    ex = t.peaks.select("name", F.col("name").alias("region_id"), (F.col("start") - 100 + shift).alias("start"), (F.col("start") + shift).alias("stop"))
    sm = t.peaks.select(F.col("name").alias("region_id"), (F.col("start") + F.col("summit_offset")).alias("summit"))
    return annotate.summit_windows(ex, sm).select("name", "offset")


@query("j46_demultiplex", """
SELECT event_type AS sample, count(*) AS n_reads FROM (SELECT CASE WHEN u.read_id % 7 <> 0 THEN event_type END AS event_type FROM v_umi u JOIN events e ON u.read_id = e.event_id) GROUP BY 1""")
def j46(t):
    from regionloom.operators.reporter import demultiplex
    index = t.events.filter("event_id % 7 <> 0").select(F.col("event_id").alias("read_id"), F.col("event_type").alias("sample"))
    return demultiplex(t.umi, index).groupBy("sample").agg(F.count("*").alias("n_reads"))


@query("j47_design_metadata", """
SELECT event_id, c_mktsegment, value FROM events e JOIN customer ON c_custkey = user_id""")
def j47(t):
    reads = t.events.select("event_id", F.concat("user_id", F.lit("|bc|"), "event_id").alias("read_name"), "value")
    design = t.customer.select(F.col("c_custkey").cast("string").alias("unique_id"), "c_mktsegment")
    return reads.withColumn("unique_id", unique_prefix(F.col("read_name"))).join(design, "unique_id").select("event_id", "c_mktsegment", "value")


SUMM = f"""ac AS (SELECT {PKID} AS id, min(start % 9) AS atac_cluster FROM v_peaks WHERE start % 4 <> 0 GROUP BY chrom, start, stop),
 mk AS (SELECT {PKID} AS id, min(start % 10) AS h3k27ac FROM v_peaks WHERE start % 5 <> 0 GROUP BY chrom, start, stop),
 rn AS (SELECT id AS gene_id, cluster AS rna_cluster, 'dynamic' AS rna_pattern FROM ({GENE_CLUSTERS.format(part='part')})),
 rg AS (SELECT DISTINCT chrom, start, stop, {PKID} AS id FROM v_peaks),
 sm AS (SELECT rg.id, t.gene_id, atac_cluster, rna_cluster, rna_pattern, coalesce(h3k27ac, 9) AS h3k27ac FROM rg
  LEFT JOIN v_tss t ON t.chrom = rg.chrom AND t.start < rg.stop AND rg.start < t.stop LEFT JOIN ac ON ac.id = rg.id LEFT JOIN rn ON rn.gene_id = t.gene_id LEFT JOIN mk ON mk.id = rg.id)"""


def summary(t):
    p = t.peaks.withColumn("id", region_id())
    ac = p.filter("start % 4 <> 0").groupBy("id").agg(F.min(F.col("start") % 9).alias("cluster"))
    mk = p.filter("start % 5 <> 0").groupBy("id").agg(F.min(F.col("start") % 10).alias("h3k27ac"))
    rna = t.spark.sql(GENE_CLUSTERS, part=t.part).select(F.col("id").alias("gene_id"), F.col("cluster").alias("rna_cluster"), F.lit("dynamic").alias("rna_pattern"))
    out = annotate.region_summary(t.peaks.select(*KEY).distinct(), ac, t.tss, rna, mk)
    return out.select("id", "gene_id", "atac_cluster", "rna_cluster", "rna_pattern", "h3k27ac")


@query("j48_region_summary", f"WITH {SUMM} SELECT * FROM sm")
def j48(t):
    return summary(t)


@query("j49_tss_subsets", f"""
WITH {SUMM} SELECT t.gene_id, chrom, start, id, CASE WHEN rna_cluster IS NOT NULL AND atac_cluster > 0 THEN 'rna_dynamic.atac_dynamic'
 WHEN rna_cluster IS NOT NULL THEN 'rna_dynamic.atac_stable' ELSE 'rna_stable' END AS subset FROM v_tss t LEFT JOIN sm ON t.gene_id = sm.gene_id""")
def j49(t):
    return annotate.tss_subsets(t.tss, summary(t).filter("gene_id is not null")).select("gene_id", "chrom", "start", "id", "subset")


@query("j50_distal_groups", """
SELECT chrom, start, stop, CASE WHEN start % 9 BETWEEN 1 AND 2 THEN 1 WHEN start % 9 BETWEEN 3 AND 5 THEN 2 ELSE 3 END AS "group" FROM v_peaks a
WHERE start % 9 BETWEEN 1 AND 7 AND NOT EXISTS (SELECT 1 FROM v_tss b WHERE a.chrom = b.chrom AND b.start < a.stop AND a.start < b.stop)""")
def j50(t):
    p = t.peaks.select(*KEY, (F.col("start") % 9).alias("cluster"))
    return annotate.distal_groups(p, t.tss, [(1, 2), (3, 5), (6, 7)]).drop("cluster")


@query("j51_interaction_sources", f"""
WITH r AS ({RULES.format(orders='orders')}), a AS (SELECT * FROM r WHERE rule % 2 = 0), b AS (SELECT * FROM r WHERE rule % 2 = 1)
SELECT pwm1, pwm2, interaction, 'a' AS source FROM a UNION ALL SELECT a.pwm1, a.pwm2, b.interaction, 'b' FROM a LEFT JOIN b ON a.pwm1 = b.pwm1 AND a.pwm2 = b.pwm2""")
def j51(t):
    r = t.spark.sql(RULES, orders=t.orders)
    return annotate.interaction_sources(r.filter("rule % 2 = 0"), r.filter("rule % 2 = 1"))


@query("j26_align_replicates", f"""
WITH {SIG} SELECT id, CAST(a.t AS INT) AS pos, round(a.value, 6) AS rep1, round(b.value, 6) AS rep2, round(a.value + b.value, 6) AS pooled FROM (SELECT * FROM sig WHERE rep = 'b1') a JOIN (SELECT * FROM sig WHERE rep = 'b2') b USING (id, t)""")
def j26(t):
    rows = trajectories.align_replicates(t.signal, list(range(10)))
    flat = rows.select("id", F.posexplode(F.arrays_zip("rep1", "rep2", "pooled")).alias("pos", "z"))
    return flat.select("id", F.col("pos").alias("pos"), r6("z.rep1", "rep1"), r6("z.rep2", "rep2"), r6("z.pooled", "pooled"))


# ---- variants ----

@query("j34_in_lookup", "SELECT line, v.id, pos, p_brand FROM v_variants v JOIN (SELECT concat('rs', CAST(p_partkey AS VARCHAR)) AS id, p_brand FROM part) USING (id)")
def j34(t):
    lookup = t.part.select(F.concat(F.lit("rs"), "p_partkey").alias("id"), "p_brand")
    return variants.in_lookup(t.variants.select("line", "id", "pos"), lookup)


@query("j35_merge_same_id", """
WITH r AS (SELECT DISTINCT id, chrom, pos, ref, alt, info FROM v_variants)
SELECT id, arg_min(chrom, (chrom, pos, ref, alt, info)) AS chrom, arg_min(pos, (chrom, pos, ref, alt, info)) AS pos, arg_min(ref, (chrom, pos, ref, alt, info)) AS ref,
 arg_min(alt, (chrom, pos, ref, alt, info)) AS alt, string_agg(info, '|' ORDER BY chrom, pos, ref, alt, info) AS info, count(*) AS n_rows FROM r GROUP BY id""")
def j35(t):
    return variants.merge_same_id(t.variants)[0]


@query("j35_conflicts", """
WITH r AS (SELECT DISTINCT id, chrom, pos, ref, alt, info FROM v_variants),
m AS (SELECT count(*) AS n, count(DISTINCT chrom) AS c, count(DISTINCT pos) AS p, count(DISTINCT ref) AS r, count(DISTINCT alt) AS a FROM r GROUP BY id)
SELECT CAST(sum(n - 1) AS BIGINT) AS overlaps, count(*) FILTER (c > 1) AS chrom_conflicts, count(*) FILTER (p > 1) AS pos_conflicts,
 count(*) FILTER (r > 1) AS ref_conflicts, count(*) FILTER (a > 1) AS alt_conflicts FROM m""")
def j35_conflicts(t):
    return variants.merge_same_id(t.variants)[1]


@query("j36_in_windows", """
SELECT name, id, pos - start AS "offset" FROM v_peaks a JOIN v_variants b ON a.chrom = b.chrom AND pos >= start + 20 AND pos < stop - 20""")
def j36(t):
    out = variants.in_windows(t.peaks.select(*KEY, "name"), t.variants, t.chromsizes)
    return out.select("name", F.col("b_id").alias("id"), "offset")


EFFECTS = "SELECT concat('rs', CAST(l_orderkey AS STRING)) AS id, l_linenumber AS sample, l_discount - CAST(0.05 AS DOUBLE) AS beta, l_tax AS q FROM {lineitem}"


def effects(t):
    return t.spark.sql(EFFECTS, lineitem=t.lineitem)


@query("j37_replicate_effects", f"""
WITH e AS ({EFFECTS.format(lineitem='lineitem')}), a AS (SELECT id, sum(beta) AS beta FROM e WHERE sample = 1 GROUP BY id), b AS (SELECT id, sum(beta) AS beta FROM e WHERE sample = 2 GROUP BY id)
SELECT id, round(coalesce(a.beta, 0), 6) + 0.0 AS beta1, round(coalesce(b.beta, 0), 6) + 0.0 AS beta2, o_orderpriority FROM a FULL JOIN b USING (id)
LEFT JOIN (SELECT concat('rs', CAST(o_orderkey AS VARCHAR)) AS id, o_orderpriority FROM orders) USING (id)""")
def j37(t):
    one = lambda s: effects(t).filter(F.col("sample") == s).groupBy("id").agg(F.sum("beta").alias("beta"))
    snps = t.orders.select(F.concat(F.lit("rs"), "o_orderkey").alias("id"), "o_orderpriority")
    return variants.replicate_effects(one(1), one(2), snps).withColumns({"beta1": r6("beta1"), "beta2": r6("beta2")})


@query("a70_strongest_effect", f"""
WITH e AS ({EFFECTS.format(lineitem='lineitem')})
SELECT id, bool_or(q > 0 AND q < 0.02) AS significant, round(arg_max(beta, (abs(beta), beta)), 6) + 0.0 AS beta FROM e GROUP BY id""")
def a70(t):
    return variants.strongest_effect(effects(t), 0.02).withColumn("beta", r6("beta"))


@query("a71_mean_effects", f"""
WITH e AS ({EFFECTS.format(lineitem='lineitem')}), s AS (SELECT id, bool_or(q > 0 AND q < 0.02) AS significant FROM e GROUP BY id)
SELECT e.id, round(avg(beta), 6) + 0.0 AS mean_beta, any_value(significant) AS significant FROM e JOIN s USING (id) GROUP BY e.id""")
def a71(t):
    sig = variants.strongest_effect(effects(t), 0.02).select("id", "significant")
    return variants.mean_effects(effects(t), sig).withColumn("mean_beta", r6("mean_beta"))


