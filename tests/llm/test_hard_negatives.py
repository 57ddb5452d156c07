"""Hard negatives against scoring all pairs in Python numbers, and the bounds against exact scores."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from regionloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    part = []
    for i, (vid, e, label) in enumerate(rows):
        if e is None or label is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        if all(abs(x) < 2 ** 31 / math.sqrt(max(len(v), 1)) for x in v):
            part.append((i, vid, v, label))
    out = Counter()
    for ai, aid, a, al in part:
        if aid is None or aid % every:
            continue
        key = lambda t: (-t[0], t[1] is None, t[1] or 0, t[2])
        scored = [(sum(x * y for x, y in zip(a, v)), vid, i, label) for i, vid, v, label in part if i != ai and len(v) == len(a)]
        for ps, pid, _, _ in sorted([t for t in scored if t[3] == al], key=key)[:5]:
            near = sorted([t for t in scored if t[3] != al and 80 * ps <= 100 * t[0] <= 100 * ps], key=key)[:5]
            for rank, (s, nid, _, _) in enumerate(near, 1):
                out[aid, pid, rank, nid, ps, s] += 1
    return out


def results(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def vectors(r, n, dim, spread):
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [[c + spread * r.gauss(0, 1) for c in r.choice(centres)] for _ in range(n)]


def test_pairs_of_blocks_equal_all_pairs(spark):
    r = random.Random(5)
    for dim, spread in ((20, 0.3), (3, 1.0)):
        rows = [(i, v, r.randrange(3)) for i, v in enumerate(vectors(r, 400, dim, spread))]
        rows += [(1000 + i, rows[7][1], i % 3) for i in range(150)]  # one vector that many rows have
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert results(hn.mine(df, 10, rows=90, anchors=20)) == brute(rows, 10)


def test_defined_cases(spark):
    r = random.Random(6)
    rows = [(i * 10, v, r.choice([0, 1, None])) for i, v in enumerate(vectors(r, 60, 5, 0.5))]
    rows += [(5, None, 1), (6, [1.0, None, 1.0, 1.0, 1.0], 1), (100, [float("nan")] * 5, 1), (200, [float("inf")] * 5, 0), (None, rows[0][1], 1), (None, rows[0][1], 0),
             (7, [], 0), (300, [], 0), (8, [], 1), (400, [0.1, 0.2], 0), (9, [0.1, 0.2], 0), (10, [0.1, 0.2], 1), (500, [3e38] * 5, 0), (600, [0.0] * 5, 0), (2 ** 60 + 1, [0.1] * 5, 0), (2 ** 60 + 3, [0.1] * 5, 1)]
    rows += [(20, rows[1][1], 0), (20, rows[1][1], 1), (0, rows[0][1], 1)]  # repeated ids
    want = brute(rows, 20)
    assert any(k[3] is None for k in want) and want
    df = spark.createDataFrame(rows, SCHEMA)
    assert results(hn.mine(df, 20)) == want
    clash = df.selectExpr("*", "1 AS row", "2 AS dim", "3 AS vector", "4 AS x", "5 AS a", "6 AS b", "7 AS anchor")
    assert results(hn.mine(clash, 20)) == want
    assert hn.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_components_are_summed_exactly(spark):
    r = random.Random(7)
    rows = [(i, [r.choice([-1, 1]) * r.uniform(2e6, 4e6) for _ in range(3)], i % 2) for i in range(60)]
    assert results(hn.mine(spark.createDataFrame(rows, SCHEMA), 10)) == brute(rows, 10)


def test_bounds_hold_at_every_level_and_tighten():
    rng = np.random.default_rng(8)
    for dim in (1, 7, 16, 64, 100):
        x = np.floor(rng.normal(rng.normal(0, 60, dim), 30, (50, dim)))
        levels, scores, width = hn.weighted_levels(*hn.summaries(x), dim), x @ x.T, np.inf
        for m, d in levels:
            assert (np.abs(scores - m @ m.T) <= d @ d.T + 1e-6 * np.abs(scores).max() + 1e-6).all()
            assert (d @ d.T).mean() <= width + 1e-9
            width = (d @ d.T).mean()


def test_bounds_leave_out_most_pairs_of_structured_vectors():
    import pandas as pd

    rng = np.random.default_rng(9)
    x = np.floor(256 * np.repeat(rng.normal(0, 1, (500, 16)), 4, axis=1))
    frame = pd.DataFrame({"row": range(500), "id": range(500), "nameless": False, "label": 0, "vector": [v.astype("<i4").tobytes() for v in x],
                          "summary": [s.astype("<f4").tobytes() for s in np.concatenate(hn.summaries(x), axis=1)]})
    block = hn.Block(frame, 64)
    top = np.sort(x[:20] @ x.T, axis=1)[:, -5]
    alive = hn.within_bounds(block, slice(0, 20), block, np.ones((20, 500), bool), top, np.full(20, np.inf))
    assert ((x[:20] @ x.T >= top[:, None]) <= alive).all() and alive.mean() < 0.05
