"""Steps whose cost must grow no faster than their rows: what the plans and jobs may not do, and the results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.operators import annotate, matrix, motifs as mo, reporter as rp, statistics as ss


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantile_normalise_ranks_without_windows_over_rows(spark):
    rng = random.Random(5)
    data = [(s, i, None if rng.random() < 0.1 else float(rng.choice([0, 0, 0, rng.randrange(40), rng.random()]))) for s, n in (("a", 300), ("b", 171), ("c", 1)) for i in range(n)]
    data += [("d", 0, 1.0), ("a", -1, 3.0)]
    out = matrix.quantile_normalise(spark.createDataFrame(data, "sample string, id int, value double"), ["a", "b", "c"])
    assert "Window" not in plan_of(out)  # rows are ranked by their number in the part and a table of parts
    columns = {s: sorted(v for x, _, v in data if x == s and v is not None) for s in "abc"}
    top = max(map(len, columns.values())) - 1
    at = lambda xs, place: float(np.interp(place, range(len(xs)), xs))
    means = [np.mean([at(xs, g * (len(xs) - 1) / top) if len(xs) > 1 else xs[0] for xs in columns.values() if xs]) for g in range(top + 1)]
    got = {(r["sample"], r["id"]): r.normalised for r in out.collect()}
    assert len(got) == sum(s != "d" for s, _, _ in data)
    for s, i, v in data:
        if s != "d" and v is None:
            assert got[s, i] is None
        elif s != "d":
            xs = columns[s]
            last = sum(x <= v for x in xs) - 1
            assert got[s, i] == pytest.approx(at(means, last * top / (len(xs) - 1) if len(xs) > 1 else top / 2), abs=1e-9)


def test_sample_correlations_are_not_an_aggregate_each(spark):
    rng = random.Random(6)
    cell = lambda i, s: (f"R{i}", s, None if rng.random() < 0.2 else 1e9 + rng.random() * (i % 7))
    data = [cell(i, s) for i in range(400) for s in ("x", "y", "z") if rng.random() < 0.9] + [("R0", "lone", 1.0)]
    df = spark.createDataFrame(data, "id string, sample string, value double").repartition(5)
    out = matrix.correlation_matrix(df, "id", "sample", ["x", "y", "z", "lone", "none"], "value")
    assert "corr(" not in plan_of(out)
    got = {(r.a, r.b): r.r for r in out.collect()}
    assert len(got) == 15 and got["lone", "lone"] is None and got["none", "none"] is None and got["x", "none"] is None
    at = {(i, s): v for i, s, v in data if v is not None}
    for a, b in (("x", "y"), ("x", "z"), ("y", "z"), ("z", "z")):
        both = [(v, at[i, b]) for (i, s), v in at.items() if s == a and (i, b) in at]
        assert got[a, b] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1], abs=1e-6)


def test_sample_correlation_of_nan_is_nan(spark):
    data = [(i, s, math.nan if (i, s) == (1, "x") else float(i * i + len(s))) for i in range(5) for s in ("x", "yy")]
    out = matrix.correlation_matrix(spark.createDataFrame(data, "id int, sample string, value double"), "id", "sample", ["x", "yy"], "value")
    got = {(r.a, r.b): r.r for r in out.collect()}
    assert math.isnan(got["x", "yy"]) and got["yy", "yy"] == pytest.approx(1.0)


def lasso_rows(spark):
    rng = random.Random(7)
    rows = [(rng.random() * 50, rng.random() / 10, rng.random(), float(i % 3)) for i in range(1500)]
    return spark.createDataFrame([(a, b, c, d, 900 * a - 40 * b + d + rng.gauss(0, 300)) for a, b, c, d in rows], "a double, b double, c double, d double, y double").repartition(3, "d")


def test_lasso_reads_the_rows_a_fixed_number_of_times(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    df, names = lasso_rows(spark), ["a", "b", "c", "d"]
    rows = VectorAssembler(inputCols=names, outputCol="f").transform(df)
    train, test = rows.randomSplit([0.8, 0.2], 42)
    lasso = LinearRegression(featuresCol="f", labelCol="y", elasticNetParam=1.0)
    grid = ParamGridBuilder().addGrid(lasso.regParam, [0.001, 0.01, 0.1]).build()
    judge = RegressionEvaluator(labelCol="y", metricName="r2")
    model = CrossValidator(estimator=lasso, estimatorParamMaps=grid, evaluator=judge, numFolds=5, seed=42).fit(train).bestModel

    fits, one = [], LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda *a: fits.append(a) or one(*a))
    out = ss.lasso_r2(df, names, "y").first()
    assert out.r2 == pytest.approx(judge.evaluate(model.transform(test)), rel=1e-9) and out.reg_param == model.getRegParam()
    assert len(fits) == 1  # that of the best penalty


def test_lasso_fit_equals_the_library_where_the_penalty_bites(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df, names = lasso_rows(spark), ["a", "b", "c", "d"]
    model = LinearRegression(featuresCol="f", labelCol="y", elasticNetParam=1.0, regParam=20.0, tol=1e-10, maxIter=500).fit(VectorAssembler(inputCols=names, outputCol="f").transform(df))
    total = ss._moments(df, [*names, "y"], F.lit(0), [0.0] * 5)[0]
    fitted = ss._lasso(total, 20.0)
    assert fitted[:4] == pytest.approx(model.coefficients.toArray(), rel=1e-4, abs=1e-4) and fitted[4] == pytest.approx(model.intercept, rel=1e-4)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_lasso_takes_no_null(spark, bad):
    df = lasso_rows(spark).withColumn("b", F.when(F.col("a") > 1, F.col("b")).otherwise(F.lit(bad)))
    with pytest.raises(Exception, match="null or NaN in b"):
        ss.lasso_r2(df, ["a", "b", "c", "d"], "y")


def test_dose_response_meets_its_background_once(spark, monkeypatch):
    plans, percentiles = [], mo.exact_percentiles
    monkeypatch.setattr(mo, "exact_percentiles", lambda df, *a: plans.append(plan_of(df)) or percentiles(df, *a))
    rng = random.Random(8)
    data = [(m, s, d, float(rng.randrange(7)), ) for m in ("m", "n") for s in range(40) for d in (0, 1, 2, 2) if rng.random() < 0.9]
    data += [("m", None, 0, 0.0), ("m", None, 1, 90.0), ("n", 99, 0, None), ("n", 99, 1, 90.0), ("n", 98, -1, -90.0)]
    out = mo.dose_response(spark.createDataFrame(data, "motif string, sample int, count int, prediction double"), "count", -9.0)
    assert plans[0].count("Join ") == 1  # samples are chosen as they meet their background
    base, gains = {}, {}
    for m, s, d, p in data:
        if d == 0 and s is not None and p is not None:
            base[m, s] = min(p, base.get((m, s), p))
    for m, s, d, p in data:
        if d > 0 and (m, s) in base:
            gains.setdefault((m, s), []).append((d, p - base[m, s]))
    per = {}
    for (m, _), rows in gains.items():
        if sum(g for _, g in rows) > 0:
            for d, g in rows:
                per.setdefault((m, d), []).append(g)
    assert {(r.motif, r["count"]): r.median for r in out.collect()} == {k: pytest.approx(np.median(v)) for k, v in per.items()}


def test_signed_ranks_are_not_joined_back(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), rng.choice([None, 0.0, float(rng.randrange(-5, 7)), rng.random()])) for _ in range(300)] + [(None, 2.0)]
    out = ss.signed_rank(spark.createDataFrame(data, "g string, d double"), ["g"], "d")
    assert plan_of(out).count("Join ") == 1  # the table of parts; neither ranks nor ties meet the rows again
    got = {r.g: (r.n, r.w_up, r.w_down) for r in out.collect()}
    want = {}
    for g in "ab":
        xs = [d for x, d in data if x == g and d]
        rank = lambda v: sum(abs(x) < abs(v) for x in xs) + (sum(abs(x) == abs(v) for x in xs) + 1) / 2
        want[g] = (len(xs), sum(rank(x) for x in xs if x > 0), sum(rank(x) for x in xs if x < 0))
    assert got == want


def test_trajectory_means_need_no_join(spark, monkeypatch):
    plans, stored = [], rp.checkpointed
    monkeypatch.setattr(rp, "checkpointed", lambda df: plans.append(plan_of(df)) or stored(df))
    data = [("r", f"e{i}", c, d, float(i + k)) for i in range(9) for c in ("0,0", None) for k, d in enumerate(("d0", "d3", None))]
    avg = spark.createDataFrame(data, "rule string, example_id string, combos string, day string, value double")
    got = {(r.example_id, r.day): r.value for r in rp.trajectory_signal(avg).collect()}
    assert "Join" not in plans[0]
    assert got == {(f"e{i}", d): pytest.approx(float(k)) for i in range(9) for k, d in enumerate(("d0", "d3", None))}


def test_region_summary_joins_before_the_pairs(spark):
    regions = spark.createDataFrame([("c", 10, 20), ("c", 15, 90), ("c", 500, 510), ("d", 1, 5)], "chrom string, start long, stop long")
    tss = spark.createDataFrame([("c", 16, 17, "g1"), ("c", 18, 19, "g2"), ("c", 80, 81, None), ("d", 900, 901, "g3"), ("d", 2, 3, "g1")], "chrom string, start long, stop long, gene_id string")
    atac = spark.createDataFrame([("c:10-20", 1), ("c:10-20", 0), ("d:1-5", 2)], "id string, cluster int")
    rna = spark.createDataFrame([("g1", 5, "dynamic"), ("g2", 6, "stable"), ("g2", 7, "stable")], "gene_id string, rna_cluster int, rna_pattern string")
    marks = spark.createDataFrame([("c:15-90", 3)], "id string, h3k27ac int")
    out = annotate.region_summary(regions, atac, tss, rna, marks)
    plan = plan_of(out)
    assert plan.index("Union") < plan.index("Join")  # pairs and regions without one are put together last
    cols = ["id", "gene_id", "atac_cluster", "rna_cluster", "rna_pattern", "h3k27ac"]
    one = lambda i, a, m: [(i, "g1", a, 5, "dynamic", m), (i, "g2", a, 6, "stable", m), (i, "g2", a, 7, "stable", m)]
    want = one("c:10-20", 1, 9) + one("c:10-20", 0, 9) + one("c:15-90", None, 3) + [
        ("c:15-90", None, None, None, None, 3), ("c:500-510", None, None, None, None, 9), ("d:1-5", "g1", 2, 5, "dynamic", 9)]
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert rows(out.select(cols)) == sorted(want, key=repr)
    subsets = annotate.tss_subsets(tss, out.select(cols).filter("gene_id is not null"))
    assert "shuffle_hash" in plan_of(subsets)
    label = lambda a, r: "rna_stable" if r is None else f"rna_dynamic.atac_{'dynamic' if a else 'stable'}"
    expect = [(g, s, w[0], label(w[2], w[3])) for _, s, _, g in [tuple(r) for r in tss.collect()] for w in want if g and w[1] == g]
    expect += [(None, 80, None, "rna_stable"), ("g3", 900, None, "rna_stable")]
    assert rows(subsets.select("gene_id", "start", "id", "subset")) == sorted(expect, key=repr)
