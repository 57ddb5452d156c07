"""Motif comparison, groups, hit distances and rule calls against plain loops."""

import math
import random

import numpy as np
import pytest

from regionloom.operators import motifs as mo, reporter as rp
from regionloom.operators.states import nearest_mark
from regionloom.operators.links import cluster_confusion


def scalar_best(a, b, ncor):
    """One pair at a time, written out offset by offset."""
    soft = lambda w: np.exp(w) / np.exp(w).sum(axis=0)
    la, lb = a.shape[1], b.shape[1]
    width, best = la + 2 * (lb - 1), -1.0
    for off in range(la + lb - 1):
        x, y = np.zeros((4, width)), np.zeros((4, width))
        x[:, lb - 1:lb - 1 + la] = a
        y[:, off:off + lb] = b
        m = soft(np.log2((soft(x) + soft(y)) / 0.5))
        ic = 2 + (m * np.log2(m)).sum(axis=0)
        strong = np.where(ic > 0.4)[0]
        if len(strong) == 0:
            continue
        first = strong[0]
        later = strong[strong > 0]
        last = later[-1] if len(later) else width
        px, py = soft(x[:, first:last + 1]).flatten(), soft(y[:, first:last + 1]).flatten()
        if px.std() == 0 or py.std() == 0:
            continue
        r = np.corrcoef(px, py)[0, 1]
        w = min(last + 1, width) - first
        r = r * (la + lb - w) / w if ncor else r
        best = max(best, r)
    return best


def test_motif_correlation_matches_the_scalar_form(spark):
    rng = np.random.default_rng(4)
    motifs = [rng.normal(0, 2.5, (4, n)) for n in (6, 6, 9, 11, 7)]
    motifs.append(motifs[2][:, 1:8].copy())
    df = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(motifs)], "motif int, weights array<array<double>>")
    out = {(r.i, r.j): (r.cor, r.ncor) for r in mo.compare_motifs(df, -2.0, -2.0, blocks=3).collect()}
    assert len(out) == 36
    for i in range(6):
        for j in range(i, 6):
            want = (scalar_best(motifs[i], motifs[j], False), scalar_best(motifs[i], motifs[j], True))
            assert np.allclose(out[i, j], want, atol=1e-9) and out[j, i] == out[i, j]


def test_connected_groups(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randrange(50, 90), r.randrange(50, 90)) for _ in range(25)] + [(95, 95)]
    nodes = sorted({x for e in edges for x in e})
    parent = {n: n for n in nodes}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    out = mo.connected_groups(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {x.id: x.label for x in out.collect()} == {n: find(n) for n in nodes}


def test_hit_distances_follow_the_loop(spark):
    r = random.Random(6)
    rows = [[r.choice([0.0, 0.0, -1.0, 2.0, 3.0]) for _ in range(14)] for _ in range(12)]
    want = []
    for k, v in enumerate(rows):
        v = [0.0 if x == -1 else x for x in v]
        hits = [(i, x) for i, x in enumerate(v) if i > 0 and x != 0]
        want += [(k, a[1], b[1], b[0] - a[0]) for a, b in zip(hits, hits[1:])]
        want += [(k, hits[i][1], hits[j][1], hits[i][0] - hits[j][0]) for i in range(len(hits)) for j in range(len(hits)) if i > j + 1]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "row_id int, scores array<double>")
    assert sorted(tuple(x) for x in mo.hit_distances(df).collect()) == sorted(want)


def test_nearest_mark_modes(spark):
    sizes = spark.createDataFrame([("chr1", 10000)], "chrom string, size bigint")
    regions = spark.createDataFrame([("chr1", 100, 200), ("chr1", 5000, 5100), ("chr1", 9000, 9100)], "chrom string, start bigint, stop bigint")
    marks = spark.createDataFrame([("chr1", 90, 190, 5), ("chr1", 110, 210, 3), ("chr1", 4990, 5200, 9), ("chr1", 5000, 5300, 9)],
                                  "chrom string, start bigint, stop bigint, code int")
    at = lambda mode: {r.start: r.code for r in nearest_mark(regions, marks, sizes, 0, mode).collect()}
    assert at("width") == {100: 3, 5000: 9, 9000: 9}      # same width: the later mark wins
    assert at("most_diff") == {100: 5, 5000: 9, 9000: 9}  # same difference: the first wins


def test_confusion_with_a_zero_cell(spark):
    a = spark.createDataFrame([("g1", 1), ("g2", 1), ("g3", 2)], "gene_id string, cluster int")
    b = spark.createDataFrame([("g1", 1), ("g2", 1), ("g4", 2)], "gene_id string, cluster int")
    out = {(r.a_cluster, r.b_cluster): (r.n11, r.n10, r.n01, r.n00, r.odds_ratio) for r in cluster_confusion(a, b).collect()}
    assert out[1, 1] == (2, 0, 0, 2, None)
    assert out[1, 2] == (0, 2, 1, 1, 0.0)


def test_every_barcode_is_counted(spark):
    rows = spark.createDataFrame([("b1", "u1"), ("b1", "u1"), ("b1", "u2"), ("last", "u9")], "barcode string, umi string")
    assert {r.barcode: r.n_umi for r in rp.umi_counts(rows).collect()} == {"b1": 2, "last": 1}


def assay(rule, effect, n=14, missing_background=False):
    r = random.Random(hash(rule) % 1000)
    base = {"0,0": effect["0,0"], "0,1": effect["0,1"], "1,0": effect["1,0"], "1,1": 2.0}
    rows = []
    for k in range(n):
        for combo, level in base.items():
            if missing_background and combo == "1,1":
                continue
            for day, lift in (("d0", 0.0), ("d3", 0.3), ("d6", 1.5)):
                up = lift if combo == "0,0" else 0.0
                for rep in ("b1", "b2"):
                    rows.append((rule, f"{rule}.{k}", combo, k * 10, day, rep, level + up + r.gauss(0, 0.05)))
    return rows


def test_rule_calls(spark):
    rows = (
        assay("more", {"0,0": 5.0, "0,1": 2.5, "1,0": 2.5})
        + assay("less", {"0,0": 3.0, "0,1": 4.0, "1,0": 4.0})
        + assay("bare", {"0,0": 5.0, "0,1": 2.5, "1,0": 2.5}, missing_background=True)
        + assay("low", {"0,0": 0.6, "0,1": 0.6, "1,0": 0.6})
        + assay("early", {"0,0": 5.0, "0,1": 2.5, "1,0": 2.5})
    )
    df = spark.createDataFrame(rows, "rule string, example_id string, combos string, barcode int, day string, rep string, value double")
    low = df.filter("rule = 'low' and combos <> '0,0'").withColumn("value", df.value + 4)
    df = df.filter("not (rule = 'low' and combos <> '0,0')").unionByName(low)
    days = spark.createDataFrame([("more", "d6"), ("less", "d3"), ("bare", "d6"), ("low", "d6"), ("early", "d0")], "rule string, day string")
    out = {r.rule: r for r in rp.call_rules(df, days).collect()}
    assert {k: v.interaction for k, v in out.items()} == {
        "more": "SYNERGY", "less": "BUFFER", "bare": "FAILED.CANT_TEST", "low": "FAILED.NEGATIVE_ENDOG", "early": "FAILED.TRAJ_PATTERN"}
    assert out["less"].day_used == "d6"  # day 3 and day 6 may stand for each other
    assert out["more"].actual > out["more"].expected and out["bare"].p_value == 1.0


def test_averages_skip_missing_replicates(spark):
    rows = [("r", "r.1", "0,0", "d0", "b1", 4.0), ("r", "r.1", "0,0", "d0", "b1", 6.0), ("r", "r.1", "0,0", "d0", "b2", 9.0), ("r", "r.1", "0,0", "d3", "b1", 0.1)]
    df = spark.createDataFrame(rows, "rule string, example_id string, combos string, day string, rep string, value double")
    out = rp.average_signal(df, 0.5).collect()
    assert [(x.day, x.value) for x in out] == [("d0", 7.0)]
    assert rp.background_subtracted(rp.average_signal(df, 0.5)).count() == 0
    assert math.isclose(rp.trajectory_signal(rp.average_signal(df, 0.5)).first().value, 0.0)


@pytest.mark.parametrize("lengths", [(16, 16), (7, 12), (3, 2), (1, 6)])
def test_blocks_of_motifs_pass_as_their_pairs_do(lengths):
    r = np.random.default_rng(3)
    a, b = (r.normal(0, 1.5, (40, 4, n)) for n in lengths)
    a[20:30] *= 0.05  # motifs without a strong column
    b[20:32] *= 0.05
    b[:10, :, :min(lengths)] = a[:10, :, :min(lengths)]
    i, j = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    cor, ncor = mo._best_offsets(a[i], b[j], 0.4)
    for cuts in ((0.6, 0.4), (0.2, 0.0)):
        found = set(zip(*(x.tolist() for x in mo._passing(a, b, 0.4, *cuts))))
        passing = (cor >= cuts[0]) & (ncor >= cuts[1])
        assert passing.any() and {(x, y) for x, y in zip(i[passing].tolist(), j[passing].tolist())} <= found
        assert min(lengths) == 1 or len(found) == passing.sum()


def test_compared_motifs_are_each_pair_once_and_mirrored(spark):
    r = np.random.default_rng(5)
    rows = [(f"m{k % 38}", r.normal(0, 1.5, (4, 5 + k % 3)).tolist()) for k in range(40)]  # two names stand twice
    df = spark.createDataFrame(rows, "motif string, weights array<array<double>>")
    out = sorted((x.i, x.j, round(x.cor, 9), round(x.ncor, 9)) for x in mo.compare_motifs(df, 0.5, 0.3, blocks=4).collect())
    pairs = df.selectExpr("motif i", "weights wi").crossJoin(df.selectExpr("motif j", "weights wj")).filter("i <= j")
    scored = pairs.select("i", "j", mo.motif_correlation("wi", "wj").alias("s")).select("i", "j", "s.*").filter("cor >= 0.5 and ncor >= 0.3").collect()
    want = [(x.i, x.j, round(x.cor, 9), round(x.ncor, 9)) for x in scored]
    assert out == sorted(want + [(j, i, c, n) for i, j, c, n in want if i < j]) and len(out) > 60
    assert "ArrowEvalPython" not in mo.compare_motifs(df, 0.5, 0.3, blocks=4)._jdf.queryExecution().executedPlan().toString()


def test_trajectory_signals_store_the_rows_once(spark):
    df = spark.createDataFrame(assay("more", {"0,0": 5.0, "0,1": 2.5, "1,0": 2.5}) + assay("bare", {"0,0": 5.0, "0,1": 2.5, "1,0": 2.5}, missing_background=True),
                               "rule string, example_id string, combos string, barcode int, day string, rep string, value double")
    avg, keys = rp.average_signal(df, 0.5), ["rule", "example_id", "combos", "day"]
    methods = {"own": "d0_norm", "endog": "d0_endog_norm", "double": "d0_double_mut_norm"}
    both = rp.trajectory_signals(avg, methods)
    got = {tuple(r[k] for k in keys): r for r in both.collect()}
    for name, method in methods.items():
        one = {tuple(r[k] for k in keys): r["value"] for r in rp.trajectory_signal(avg, method).collect()}
        assert one.keys() == got.keys() and all(got[k][name] == v for k, v in one.items())
    assert any(r["double"] is None for r in got.values()) and "rep" not in both._jdf.queryExecution().analyzed().toString()
