"""The license scan against a brute-force count of every block and template."""

import random
import re
from collections import Counter

import pytest

from regionloom.llm import licenses
from regionloom.llm.licenses import Template

from .conftest import frame

SMALL = [Template("ab", "a b", 1.0, True), Template("aa", "a a b", 1.0, True), Template("long", "a c d e f g", 0.8), Template("x", "c c h", 1.0),
         Template("ab", "h i j k l", 0.6)]


def brute(text, templates):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    stride = max(len(t.words) for t in templates)
    starts, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        if t.exact:
            mine = [p for p in range(len(words)) if words[p:p + len(t.words)] == t.words]
            starts += mine
            if mine:
                base.add(t.label)
                score = 1.0
            continue
        for k in range(0, len(words), stride):
            share = len(set(t.words) & set(words[k:k + 2 * stride])) / len(set(t.words))
            if share >= t.threshold:
                labels.add(t.label)
                score = max(score, share)
    labels |= base
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)


def results(df):
    return Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 12)) for r in df.collect())


def wanted(rows, templates):
    return Counter((d, *b[:-1], round(b[-1], 12)) for d, t in rows for b in [brute(t, templates)])


def test_blocks_and_places_equal_brute_force(spark):
    r = random.Random(3)
    seps = [" ", "\n", ", ", "--", " «", "\t"]
    rows = [(i, "".join(r.choice("aabcdefghijklABKé") + r.choice(seps) for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for i in range(120)]
    assert results(licenses.scan(frame(spark, rows), SMALL)) == wanted(rows, SMALL)


@pytest.mark.parametrize("templates", [SMALL, licenses.TEMPLATES], ids=["small", "licenses"])
def test_defined_cases(spark, odd_rows, empty, templates):
    mit = licenses.TEXTS[8].text
    rows = odd_rows + [(20, "Released under the MIT License. " * 3), (21, mit.upper()), (22, "word " * 20_000 + mit + " word" * 20_000), (23, " ".join(mit.split()[:10])),
                       (24, "mitKlicense mit-license"), (25, "a a a b b a b")]
    docs = frame(spark, rows)
    assert results(licenses.scan(docs, templates)) == wanted(rows, templates)
    assert licenses.scan(empty, templates).collect() == []
    clash = docs.selectExpr("*", "1 AS row", "2 AS k", "3 AS hits", "'x' AS label", "4 AS n_words", "5 AS token", "6 AS words", "7 AS blocks")
    assert results(licenses.scan(clash, templates)) == wanted(rows, templates)


def test_no_python_and_no_text_in_a_shuffle(spark, sf):
    out = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
