"""Ordered scans, ranks, percentiles and tests against small reference computations."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from regionloom.functions import tails
from regionloom.functions.vectors import vcenter, vfarthest, vflank_normalise, vpearson, vranks, vspearman, vzscore
from regionloom.operators import matrix, ordering, statistics as ss
from regionloom.operators.trajectories import cluster_stats, consistent_clusters, ternary_code
from regionloom.operators.transforms import exact_percentiles, filter_terms
from regionloom.plans.scan import Running, numbered, running, running_all, value_ranks


def test_running_sum_and_numbers_with_a_hot_key(spark):
    rows = [("hot", i % 7, i) for i in range(300)] + [("cold", i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    out = running(df, ["g"], ["v", "i"], F.col("i"), "sum", "total")
    want, totals = {}, {}
    for g, v, i in sorted(rows):
        totals[g] = totals.get(g, 0) + i
        want[g, i] = totals[g]
    assert {(r.g, r.i): r.total for r in out.collect()} == want
    ranks = numbered(df, [], [F.col("v").desc(), "i", "g"], "rn").collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2], r[0]))
    assert sorted((r.rn, r.g, r.i) for r in ranks) == [(k + 1, g, i) for k, (g, _, i) in enumerate(order)]


def test_value_ranks_with_ties(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (3.0,), (9.0,), (None,)], "x double")
    out = {r.x: (r["rank"], r.avg_rank, r.n_group) for r in value_ranks(df, [], "x").collect()}
    assert out == {1.0: (1, 1.0, 5), 3.0: (2, 3.0, 5), 9.0: (5, 5.0, 5)}


def test_exact_percentiles_equal_numpy(spark):
    r = random.Random(3)
    data = {g: [round(r.gauss(0, 5), 1) for _ in range(n)] for g, n in (("a", 101), ("b", 1), ("c", 40))}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g string, x double")
    out = exact_percentiles(df, ["g"], "x", {"p05": 0.05, "p50": 0.5, "p99": 0.99}).collect()
    for row in out:
        assert np.allclose([row.p05, row.p50, row.p99], np.percentile(data[row.g], [5, 50, 99]))


def test_quantile_normalisation_with_ties(spark):
    r = random.Random(5)
    cols = {s: [float(r.randint(0, 12)) for _ in range(50)] for s in ("s1", "s2", "s3")}
    array = np.array([cols["s1"], cols["s2"], cols["s3"]]).T
    means = np.sort(array, axis=0).mean(axis=1)
    df = spark.createDataFrame([(i, s, xs[i]) for s, xs in cols.items() for i in range(50)], "id int, sample string, value double")
    out = {(x["sample"], x.id): x.normalised for x in matrix.quantile_normalise(df, ["s1", "s2", "s3"]).collect()}
    for j, s in enumerate(("s1", "s2", "s3")):
        top = np.searchsorted(np.sort(array[:, j]), array[:, j], side="right") - 1
        assert np.allclose([out[s, i] for i in range(50)], means[top])


def test_quantile_normalisation_of_uneven_samples_and_nulls(spark):
    r = random.Random(6)
    for sizes in ((3, 2), (30, 17, 5), (9, 1, 4), (6, 6)):
        cols = {f"s{j}": [float(r.randrange(12)) for _ in range(n)] for j, n in enumerate(sizes)}
        rows = [(s, i, x) for s, xs in cols.items() for i, x in enumerate(xs)] + [("s0", 900, None), ("s1", 901, None), ("other", 902, 1.0)]
        df = spark.createDataFrame(rows, "sample string, id int, value double").repartition(3)
        twice = matrix.quantile_normalise(df.drop("id"), list(cols))  # rows that are copies of each other
        assert twice.count() == len(rows) - 1 and twice.distinct().groupBy("sample", "value").count().filter("count > 1").count() == 0
        out = {(x["sample"], x.id): x.normalised for x in matrix.quantile_normalise(df, list(cols)).collect()}
        top = max(sizes) - 1
        means = np.mean([np.interp(np.arange(top + 1) * (len(xs) - 1) / top, np.arange(len(xs)), sorted(xs)) for xs in cols.values()], axis=0)
        want = {("s0", 900): None, ("s1", 901): None}
        for s, xs in cols.items():
            for i, x in enumerate(xs):
                k = sum(y <= x for y in xs) - 1
                want[s, i] = float(np.interp(k * top / (len(xs) - 1) if len(xs) > 1 else top / 2, np.arange(top + 1), means))
        assert out.keys() == want.keys()
        assert all(out[k] is None if v is None else math.isclose(out[k], v, abs_tol=1e-9) for k, v in want.items()), sizes


def test_several_running_values_share_one_range_partition(spark):
    r = random.Random(7)
    rows = [(r.choice("ab") if i % 9 else None, r.randrange(40), i, r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v double").repartition(5)
    out = running_all(df, ["g"], ["-k", "i"], [Running(F.lit(1), "sum", "n"), Running(F.col("v"), "max", "top", False), Running(F.col("v"), "min", "low", True, True)]).collect()
    for g in ("a", "b", None):
        mine = sorted([x for x in rows if x[0] == g], key=lambda x: (-x[1], x[2]))
        got = {x.i: x for x in out if x.g == g}
        for n, row in enumerate(mine):
            x = got[row[2]]
            assert x.n == n + 1 and x.top == max((y[3] for y in mine[:n]), default=None) and x.low == min(y[3] for y in mine[n:])


def test_nulls_keep_their_rows_beside_adjusted_p_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, None), (3, 0.5), (4, 0.01), (5, 0.01)], "i int, p double")
    out = {x.i: x.q for x in ss.benjamini_hochberg(df, "p").collect()}
    assert out[2] is None and math.isclose(out[1], 0.04 / 3) and out[1] == out[4] == out[5] and out[3] == 0.5


def test_benjamini_hochberg_with_repeats(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.9, 0.03]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    out = {r.i: r.q for r in ss.benjamini_hochberg(df, "p").collect()}
    order = sorted(range(6), key=lambda i: p[i])
    q, best = {}, 1.0
    for k in range(5, -1, -1):
        rank = max(j for j in range(6) if p[order[j]] == p[order[k]]) + 1
        best = min(best, p[order[k]] * 6 / rank)
        q[order[k]] = best
    assert all(math.isclose(out[i], q[i]) for i in range(6))


def test_top_share_nth_and_steps(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(40)], "id int, x double")
    assert sorted(r.id for r in matrix.top_percent(df, "id", "x", 90).collect()) == [9, 19, 29, 39]
    assert matrix.above_nth(df, "x", 5).count() == 4
    assert matrix.above_nth(df, "x", 100).count() == 40
    assert sorted(r.id for r in matrix.every_kth(df, ["id"], 10).collect()) == list(range(0, 40, 4))
    assert sorted(r.row_sep for r in matrix.key_changes(df.withColumn("k", F.col("id") % 3), "k", ["id"]).collect()) == [0, 14, 27, 40]
    assert ordering.trim_extremes(df, [], "x").select("x").distinct().count() == 6


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 4.0], [2.0, 1.0, 5.0, 3.0]), ([3.0] * 4, [1.0, 2.0, 3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(vzscore(F.col("a")).alias("z"), vpearson(F.col("a"), F.col("b")).alias("r"), vranks(F.col("a")).alias("k"),
                     vspearman(F.col("a"), F.col("b")).alias("s"), vfarthest(vcenter(F.col("b"))).alias("f")).collect()
    a, b = np.array([1.0, 2, 4, 4]), np.array([2.0, 1, 5, 3])
    assert np.allclose(rows[0].z, (a - a.mean()) / a.std())
    assert math.isclose(rows[0].r, np.corrcoef(a, b)[0, 1])
    assert rows[0].k == [1.0, 2.0, 3.5, 3.5]
    assert math.isclose(rows[0].s, np.corrcoef([1, 2, 3.5, 3.5], [2, 1, 4, 3])[0, 1])
    assert math.isclose(rows[0].f, 2.25)
    assert rows[1].z == [None] * 4 and rows[1].r is None
    flank = spark.createDataFrame([([2.0, 5.0, 4.0],)], "a array<double>").select(vflank_normalise(F.col("a"), 1).alias("v")).first().v
    assert np.allclose(flank, [2 / 3, 5 / 3, 4 / 3])


def test_tails_against_tables():
    assert math.isclose(tails.t_two_sided(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(tails.t_two_sided(12.7062, 1), 0.05, abs_tol=1e-6)
    assert math.isclose(tails.r_critical(10, 0.05), 0.631897, abs_tol=1e-5)
    assert math.isclose(tails.r_critical(10, 0.01), 0.764592, abs_tol=1e-5)
    assert math.isclose(tails.chi2_pdf(2.0, 4), 0.18393972, abs_tol=1e-8)
    for k, n, m, total in [(3, 10, 8, 40), (0, 5, 5, 20), (5, 5, 5, 20), (1, 19, 19, 20), (7, 30, 12, 100)]:
        want = sum(math.comb(m, x) * math.comb(total - m, n - x) for x in range(k, min(n, m) + 1)) / math.comb(total, n)
        assert math.isclose(tails.hypergeometric_tail(k, n, m, total), want, rel_tol=1e-9)


def test_density_of_a_singular_normal(spark):
    cov = np.array([[2.0, 2.0], [2.0, 2.0]])
    df = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0], cov.flatten().tolist()), ([0.5, 0.0], [0.0, 0.0], [1.0, 0.0, 0.0, 4.0])],
                               "x array<double>, m array<double>, c array<double>")
    out = [r.d for r in df.select(tails.mvn_density(F.col("x"), tails.whitening("m", "c")).alias("d")).collect()]
    assert math.isclose(out[0], math.exp(-0.5 * 2 / 4) / math.sqrt(2 * math.pi * 4))
    assert math.isclose(out[1], math.exp(-0.125) / (2 * math.pi * 2))


def test_tails_in_the_jvm(spark):
    r = random.Random(4)
    tables = [(a, b, c, d) for a in range(5) for b in range(4) for c in range(4) for d in (0, 1, 6)]
    tables += [tuple(r.randrange(1, 400) for _ in range(4)) for _ in range(60)] + [(0, 0, 0, 0), (5, 0, 0, 0), (900, 5000, 4000, 90_000), (9_000, 500_000, 40_000, 900_000)]
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(tables)], "a long, b long, c long, d long, i int")
    out = {x.i: x.p for x in df.select("i", tails.fisher_greater("a", "b", "c", "d").alias("p")).collect()}
    for i, (a, b, c, d) in enumerate(tables):
        want = tails.hypergeometric_tail(a, a + b, a + c, a + b + c + d)
        assert math.isclose(out[i], want, rel_tol=1e-8, abs_tol=1e-12), (tables[i], out[i], want)
    zs = [0.0, 0.1, 1.0, 1.959964, 2.9999, 3.0, 5.5, 12.0, -2.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(float("nan"),), (None,)], "z double")
    out = [x.p for x in df.select(tails.normal_two_sided("z").alias("p")).collect()]
    assert all(math.isclose(p, math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-15) for p, z in zip(out, zs)) and out[-2:] == [None, None]
    cases = [(t, float(n)) for t in (0.0, 0.3, -1.7, 2.228139, 6.0, 40.0) for n in (1, 2, 10, 155, 20_000)]
    df = spark.createDataFrame(cases + [(None, 3.0), (1.0, 0.0)], "t double, n double")
    out = [x.p for x in df.select(tails.student_two_sided("t", "n").alias("p")).collect()]
    assert all(math.isclose(p, tails.t_two_sided(t, n), rel_tol=1e-7, abs_tol=1e-14) for p, (t, n) in zip(out, cases)) and out[-2:] == [None, None]


def test_signed_rank_and_rank_sum(spark):
    d = [1.5, -0.5, 2.0, 3.0, -1.5, 0.0, 4.0]
    row = ss.signed_rank(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d").first()
    # ranks of |d| without the zero: 0.5 -> 1, 1.5 twice -> 2.5, 2 -> 4, 3 -> 5, 4 -> 6
    assert (row.n, row.w_up, row.w_down) == (6, 17.5, 3.5)
    assert math.isclose(row.z, (3.5 - 10.5) / math.sqrt((6 * 7 * 13 - (2 ** 3 - 2) / 2) / 24))
    sides = spark.createDataFrame([("g", True, 1.0), ("g", True, 2.0), ("g", False, 2.0), ("g", False, 5.0), ("g", False, None)], "g string, side boolean, v double")
    z = ss.rank_sum(sides, ["g"], "side", "v").first().z
    assert math.isclose(z, (3.5 - 2 * 5 / 2) / math.sqrt(2 * 2 * 5 / 12))
    p = ss.with_p_values(ss.rank_sum(sides, ["g"], "side", "v"), "z").first().p_value
    assert math.isclose(p, math.erfc(abs(z) / math.sqrt(2)))


def test_precision_recall_with_ties_and_without_positives(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    curve = {r.s: (r.precision, r.recall) for r in ss.precision_recall(df, "s", "y").collect()}
    assert curve == {0.9: (1.0, 0.5), 0.8: (2 / 3, 1.0), 0.1: (0.5, 1.0)}
    assert math.isclose(ss.area_under_curve(ss.precision_recall(df, "s", "y")).first().auc, 0.5 + 0.5 * (1 + 2 / 3) / 2)
    none = ss.precision_recall(df.withColumn("y", F.lit(0)), "s", "y").first()
    assert none.recall is None


def test_enrichment_score_matches_the_full_walk(spark):
    r = random.Random(9)
    genes = [(f"G{i}", r.gauss(0, 1)) for i in range(60)]
    member = {g for g, _ in r.sample(genes, 15)}
    walk, best = 0.0, 0.0
    for g, _ in sorted(genes, key=lambda x: (-x[1], x[0])):
        walk += 1 / 15 if g in member else -1 / 45
        best = walk if abs(walk) > abs(best) + 1e-12 else best
    ranked = spark.createDataFrame([("c", g, s) for g, s in genes], "contrast string, gene_id string, score double")
    sets = spark.createDataFrame([("s", g) for g in member], "set_name string, gene_id string")
    assert math.isclose(ss.enrichment_score(ranked, sets, "contrast", "score").first().es, best, abs_tol=1e-9)


def test_ternary_code(spark):
    rows = [("u", "c1", 1.0, 0.01), ("u", "c2", -1.0, 0.01), ("u", "c3", 1.0, 0.9), ("n", "c1", 2.0, 0.5)]
    df = spark.createDataFrame(rows, "id string, contrast string, log2_fold_change double, padj double")
    assert {r.id: r.code for r in ternary_code(df, ["c1", "c2", "c3"], 0.05).collect()} == {"u": 0 * 9 + 2 * 3 + 1, "n": 13}


def test_consistency_needs_all_three_vectors(spark):
    r = random.Random(1)
    up = [float(i) for i in range(8)]
    noisy = lambda v: [x + r.gauss(0, 0.3) for x in v]
    members = spark.createDataFrame([(1, noisy(up)) for _ in range(40)] + [(2, noisy(up[::-1])) for _ in range(40)], "cluster int, vector array<double>")
    stats = cluster_stats(members, 8)
    rows = [("all", noisy(up), noisy(up), noisy(up)), ("two", noisy(up), noisy(up[::-1]), noisy(up)), ("flat", [1.0] * 8, noisy(up), noisy(up))]
    aligned = spark.createDataFrame(rows, "id string, rep1 array<double>, rep2 array<double>, pooled array<double>")
    out = consistent_clusters(aligned, stats, 8, 1e-30).collect()
    assert [(x.id, x.cluster, x.hard) for x in out] == [("all", 1, True)]


def test_terms_match_once(spark):
    df = spark.createDataFrame([("BP", "skin red ring", 0.01), ("BP", "red small", 0.01), ("MF", "red", 0.01)], "domain string, term_name string, p_value double")
    assert [r.term_name for r in filter_terms(df, ["small"], ["red", "ring"], []).collect()] == ["skin red ring"]


def test_pca_keeps_the_trace(spark):
    rows = [(f"g{i}", s, float((i * k * 7) % 13 + i)) for i in range(30) for k, s in enumerate(("a", "b", "c", "d"), 1)]
    df = spark.createDataFrame(rows, "id string, sample string, value double")
    out = ss.sample_pca(df, "id", "sample", ["a", "b", "c", "d"], "value", 0.2).collect()
    assert len(out) == 12 and 0.9 < sum({r.component: r.variance_share for r in out}.values()) <= 1.0 + 1e-9


def test_fisher_bounds_hold_the_tail_between_them(spark):
    from regionloom.functions.tails import fisher_bounds, fisher_greater
    r = random.Random(9)
    rows = []
    for _ in range(600):
        total = r.choice([5, 40, 3000, 200_000])
        marked, drawn = r.randint(0, total), r.randint(0, total)
        mean = drawn * marked / total
        k = min(drawn, marked, max(0, drawn + marked - total, round(r.gauss(mean, 1 + 3 * mean ** 0.5))))
        rows.append((k, drawn - k, marked - k, total - drawn - marked + k))
    table = ["n11", "n10", "n01", "n00"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in table))
    out = df.select("n11", fisher_greater(*table).alias("p"), fisher_bounds(*table).alias("b")).collect()
    assert all(x.b.low <= x.p * (1 + 1e-9) and x.p <= x.b.high * (1 + 1e-9) for x in out)
    close = [x for x in out if 1e-100 < x.p < 0.2]
    assert len(close) > 100 and all(x.b.high < 6 * x.b.low for x in close)


def test_ordered_query_sums_few_tails(spark):
    r = random.Random(4)
    genes = [(f"g{i}", float(r.random())) for i in range(3000)]
    sets = [(s, g) for s in ("a", "b") for g, at in genes if r.random() < (0.5 if s == "a" and at < 0.1 else 0.2)]
    ranked = spark.createDataFrame(genes, "gene_id string, position double")
    out = ss.ordered_over_representation(ranked, ranked.select("gene_id"), spark.createDataFrame(sets, "set_name string, gene_id string"))
    names = [g for g, _ in sorted(genes, key=lambda x: x[1])]
    want = {}
    for s in ("a", "b"):
        mine, n = {g for x, g in sets if x == s}, 0
        for rank, g in enumerate(names, 1):
            if g in mine:
                n += 1
                want[s] = min(want.get(s, (2.0, 0)), (tails.hypergeometric_tail(n, rank, len(mine), 3000), rank))
    got = {x.set_name: (x.p_value, x.prefix) for x in out.collect()}
    assert {s: p[1] for s, p in got.items()} == {s: p[1] for s, p in want.items()}
    assert all(math.isclose(got[s][0], want[s][0], rel_tol=1e-8) for s in want)
    assert "least_" in out._jdf.queryExecution().analyzed().toString()
