"""Toxicity and quality scores: segment search next to brute force, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest

from regionloom.llm import quality, toxicity
from tests.llm.conftest import frame

LABELS = "doc_id long, quality int, toxic int"


def test_best_run_equals_brute_force():
    rng = random.Random(1)
    lengths = [rng.choice([0, 1, 7, 30]) for _ in range(40)]
    scores = np.array([rng.choice([-1.0, -0.3, 0.5, 2.0]) for _ in range(sum(lengths))])
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = toxicity.best_runs(scores, first)
    for i, n in enumerate(lengths):
        s = scores[first[i]:first[i + 1]]
        want = max([0.0] + [s[a:b].sum() for a in range(n) for b in range(a + 1, n + 1)])
        assert got[i] == pytest.approx(want)


def test_maximal_runs_equal_their_definition():
    """Taking the best run away and searching both sides gives the same runs."""
    def split(s, at, out):
        best = max(((s[a:b].sum(), -(b - a), a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0, 0, 0, 0))
        if best[0] > 0:
            _, _, a, b = best
            out.append((at + a, at + b, pytest.approx(best[0])))
            split(s[:a], at, out)
            split(s[b:], at + b, out)
        return out

    rng = random.Random(2)
    for _ in range(60):
        s = np.array([rng.choice([-1.3, -0.4, 0.7, 2.1]) + rng.random() * 0.01 for _ in range(rng.randrange(14))])
        assert toxicity.maximal_runs(s) == sorted(split(s, 0, []), key=lambda r: r[:2])


def outcome(spark, sf, module, label):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = module.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~module.held_out())
    got = module.score(docs, model).withColumn("held_out", module.held_out()).toPandas()
    assert got["score"].between(0, 1).all() and len(got) == docs.count()
    return got, got[got["held_out"]].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")


def test_toxicity_on_held_out_rows(spark):
    got, held = outcome(spark, "/root/testdata/sf0.1", toxicity, "toxic")
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got["doc_id"], got["held_out"]))
    toxic, clean = held[held["toxic"] == 1]["predicted"], held[held["toxic"] == 0]["predicted"]
    assert toxic.mean() > 0.75 and clean.mean() < 0.02
    spans = got[got["predicted"] == 1]["segments"]
    assert (spans.map(len) > 0).mean() > 0.9


def test_quality_on_held_out_rows(spark, sf):
    got, held = outcome(spark, sf, quality, "quality")
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got["doc_id"], got["held_out"]))
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    # calibrated: the mean score is near the share of label 1
    assert abs(held["score"].mean() - held["quality"].mean()) < 0.05


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd_rows, empty, module, label):
    docs = frame(spark, odd_rows).withColumnRenamed("lang", "score").withColumnRenamed("source", "predicted")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 0), (7, 0, 1), (8, 1, 1), (None, 1, 1), (6, None, None)], LABELS)
    for learned in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        model = module.fit(docs, learned, ~module.held_out(), label)
        rows = module.score(docs, model).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert module.score(empty, module.fit(empty, labels, ~module.held_out(), label)).count() == 0


def test_the_calibration_is_not_sampled(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    whole = toxicity.fit(docs, labels, ~toxicity.held_out())
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    few = toxicity.fit(docs, labels, ~toxicity.held_out())
    assert few.lam == whole.lam and abs(few.k / whole.k - 1) < 1e-9 and few.weights != whole.weights
