"""Toxicity by maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

1. *Counts.* A word has several tokens: itself and its stems (byte prefixes). Tokens are hashed
   into ``BUCKETS`` counters. For labelled texts a counter holds the number of toxic and of clean
   documents with the token; for all documents it holds occurrences, which give the prior.
2. *Log-odds* with an informative Dirichlet prior: prior mass ``PRIOR`` dealt by corpus frequency.
   A word's score is the best lower confidence bound of its tokens, or else a small negative
   number, the log-odds of a word that is no lexicon word.
3. *Segments.* The best-scoring run of words of every document comes from one linear scan, and
   all maximal scoring runs (Ruzzo-Tompa) for the documents whose best run is significant.
4. *Extreme values.* lambda solves sum p(s) exp(lambda s) = 1 over the clean documents' word
   scores, K follows from their best runs; a run of score S in n words has
   E = K n exp(-lambda S). A logistic curve over -log E turns it into a probability.

Memory: a task holds one slice of text and the counters; what reaches the driver is the counter
table (``BUCKETS`` rows), a histogram, and at most ``SAMPLE`` labelled rows with two numbers each.
The counters, the histogram and the scores cover all documents.

Defined cases: a null or empty text has score of no segment (never toxic by itself). Copies of
one text count once while learning. Labels that differ for one doc_id: the largest counts. Null
labels and labels without a document are ignored. Without both classes every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regionloom.llm.textkit import ByteHash, slices, text_buffer, with_columns, word_spans
from regionloom.session import checkpointed

BUCKETS = 1 << 18
STEMS = (4, 5, 6, 7, 8)
PRIOR = 500.0
BOUND = 3.0
#: Labelled rows that the logistic curve is fitted on (the only sampled step).
SAMPLE = 40_000
#: Rows of labels up to which they are broadcast (16 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 4_000_000
_PARTS = 256
_STEP = 0.25
_HIST = 256


@dataclass
class Model:
    """What scoring needs: a score per counter, the score of other words, and the calibration."""
    table: np.ndarray
    base: float
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: bool = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counter numbers (one row per kind of token, -1: no such token), first word per row, spans."""
    starts, ends, first = word_spans(data, offsets)
    hashed = ByteHash(data, lower=True)
    size = ends - starts
    out = np.full((len(STEMS) + 1, len(starts)), -1, np.int64)
    mask = np.uint64(BUCKETS - 1)
    out[0] = (hashed.of(starts, ends) & mask).astype(np.int64)
    for i, k in enumerate(STEMS, 1):
        long = np.flatnonzero(size > k)
        # stems and words of the same bytes share a counter: "idiot" and "idiot,"
        out[i, long] = (hashed.of(starts[long], starts[long] + k) & mask).astype(np.int64)
    return out, first, starts, ends


def word_scores(ids: np.ndarray, model: Model) -> np.ndarray:
    """The best score of a word's tokens, or the base score."""
    best = np.zeros(ids.shape[1], np.float32)
    for row in ids:
        np.maximum(best, np.where(row >= 0, model.table[row], 0), out=best)
    return np.where(best > 0, best, model.base).astype(np.float64)


def best_runs(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Score of the best run of words per row, by one linear scan (0: none)."""
    n = np.diff(first)
    out = np.zeros(len(n))
    if not len(scores):
        return out
    # the drop between rows is larger than any sum, so the running minimum starts anew
    drop = float(np.abs(scores).sum()) + 1.0
    row = np.repeat(np.arange(len(n)), n)
    sums = np.cumsum(scores) - drop * row
    before = sums - scores
    gain = sums - np.minimum.accumulate(before)
    full = np.flatnonzero(n > 0)
    out[full] = np.maximum(np.maximum.reduceat(gain, first[:-1][full]), 0)
    return out


def maximal_runs(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (start, end, score) of one document, in linear time (Ruzzo-Tompa)."""
    runs: list[list] = []  # start, end, sum before the run, sum at its end
    total = 0.0
    for i, s in enumerate(scores.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        cur = [i, i + 1, before, total]
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= cur[2]:
                j -= 1
            if j < 0 or runs[j][3] >= cur[3]:
                runs.append(cur)
                break
            cur = [runs[j][0], cur[1], runs[j][2], cur[3]]
            del runs[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in runs]


def training_labels(docs: DataFrame, labels: DataFrame, usable: Column, label: str) -> DataFrame:
    """(doc_id, y) of the labelled rows that may be learned from, one per distinct text."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y_"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("h1_"), F.hash("text").alias("h2_")).filter(usable)
    found = keys.join(y, "doc_id")
    return found.groupBy("h1_", "h2_").agg(F.min(F.struct("doc_id", "y_")).alias("s_")).select("s_.doc_id", "s_.y_").distinct()


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, text and y_ (null: none); labels are broadcast only if they are few."""
    few = marks.count() <= BROADCAST_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id", "left")


def _count_batches(batches):
    counts = np.zeros((3, BUCKETS), np.int64)
    docs = np.zeros(2, np.int64)
    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        y = batch["y_"].cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        for a, b in slices(offsets):
            ids, first, _, _ = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            for row in ids:
                counts[2] += np.bincount(row[row >= 0], minlength=BUCKETS)
            part = y[a:b]
            row_of = np.repeat(np.arange(b - a), np.diff(first))
            for kind in (0, 1):
                docs[kind] += int((part == kind).sum())
                mine = np.flatnonzero((part == kind)[row_of])
                if len(mine):
                    at = row_of[mine]
                    seen = np.unique(np.concatenate([(at * BUCKETS + r[mine])[r[mine] >= 0] for r in ids]))
                    counts[kind] += np.bincount(seen % BUCKETS, minlength=BUCKETS)
    width = BUCKETS // _PARTS
    parts = [counts[:, i * width:(i + 1) * width].tobytes() for i in range(_PARTS)]
    yield pa.RecordBatch.from_pydict({
        "part": pa.array(range(-1, _PARTS), pa.int32()), "counts": pa.array([docs.tobytes(), *parts], pa.binary())})


def _sum_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [total.tobytes()]})


def log_odds(counts: np.ndarray, docs: np.ndarray) -> Model:
    """Scores from document counts (toxic, clean) and corpus occurrences per counter."""
    clean, toxic, corpus = counts.astype(float)
    if docs.min() == 0:
        return Model(np.zeros(BUCKETS, np.float32), -1.0)
    prior = PRIOR * corpus / max(1.0, corpus.sum())
    n_toxic, n_clean = toxic.sum(), clean.sum()

    def logit(y, n):
        y = np.maximum(y + prior, 1e-9)
        return np.log(y) - np.log(n + PRIOR - y), 1 / y  # variance of the log-odds

    (lt, vt), (lc, vc) = logit(toxic, n_toxic), logit(clean, n_clean)
    low = (lt - lc) - BOUND * np.sqrt(vt + vc)
    table = np.where((low > 0) & (toxic >= 3), low, 0).astype(np.float32)
    inside = table > 0
    q_toxic, q_clean = toxic[inside].sum() / n_toxic, clean[inside].sum() / n_clean
    # a toxic document has few lexicon words per word: the drift of all others
    base = float(np.log1p(-min(q_toxic, 0.5)) - np.log1p(-min(q_clean, 0.49)))
    return Model(table, min(base, -0.01), known=bool(inside.any()))


def _sample_batches(model: Model):
    def run(batches):
        hist, sums = np.zeros(_HIST, np.int64), np.zeros(3)  # clean texts, their best runs, the logarithms of their words
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            y = batch["y_"].to_numpy(zero_copy_only=False)
            best, words = np.zeros(len(y)), np.zeros(len(y), np.int64)
            for a, b in slices(offsets):
                ids, first, _, _ = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                scores = word_scores(ids, model)
                best[a:b], words[a:b] = best_runs(scores, first), np.diff(first)
                clean = np.repeat(y[a:b] == 0, np.diff(first))
                cell = np.where(scores > 0, np.ceil(scores / _STEP), 0).astype(np.int64)
                hist += np.bincount(np.minimum(cell[clean], _HIST - 1), minlength=_HIST)
            told = (y == 0) & (words > 0)
            sums += told.sum(), best[told].sum(), np.log(words[told]).sum()
            pick = batch["pick_"].to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_pydict({
                "y": pa.array(y[pick].astype(np.int32)), "best": pa.array(best[pick]), "words": pa.array(words[pick]),
                "hist": pa.array([None] * int(pick.sum()), pa.binary()), "sums": pa.array([None] * int(pick.sum()), pa.binary())})
        yield pa.RecordBatch.from_pydict({"y": pa.array([-1], pa.int32()), "best": pa.array([0.0]), "words": pa.array([0], pa.int64()),
                                          "hist": pa.array([hist.tobytes()], pa.binary()), "sums": pa.array([sums.tobytes()], pa.binary())})
    return run


def _lambda(hist: np.ndarray, base: float) -> float:
    """The positive root of sum p(s) exp(lambda s) = 1; 1 where clean words score too high or never."""
    share = hist / max(1, hist.sum())
    values = np.where(np.arange(len(hist)) > 0, np.arange(len(hist)) * _STEP, base)
    if (share * values).sum() >= 0 or share[1:].sum() == 0:
        return 1.0
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (share * np.exp(np.minimum(mid * values, 700))).sum() > 1 else (mid, hi)
    return max(lo, 1e-3)


def evidence(best: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    """-log E of the best run: how far it exceeds what chance gives in a text of that length."""
    return model.lam * best - np.log(model.k * np.maximum(words, 1))


def features(best: np.ndarray, words: np.ndarray, model: Model) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.clip(evidence(best, words, model), -20, 40) / 10, np.minimum(best, 40) / 10])


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge, so that separable samples stay finite."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = probability(x, w)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model:
    """Learn counts, log-odds and calibration from the labelled rows for which ``usable`` holds."""
    marks = checkpointed(training_labels(docs, labels, usable, label))
    marked = labelled(docs, marks)
    counted = marked.mapInArrow(_count_batches, "part int, counts binary").groupBy("part").applyInPandas(_sum_counts, "part int, counts binary")
    rows = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in counted.collect()}  # BUCKETS numbers times 3
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), -1.0)
    width = BUCKETS // _PARTS
    counts = np.concatenate([rows[i].reshape(3, width) for i in range(_PARTS)], axis=1)
    model = log_odds(counts, rows[-1])
    if not model.known:
        return model
    total = int(rows[-1].sum())
    rate = min(1.0, SAMPLE / total)
    # only the rows of the logistic curve are sampled
    pick = F.lit(True) if rate == 1.0 else F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(rate * (1 << 20))
    sample = marked.filter(F.col("y_").isNotNull()).withColumn("pick_", pick)
    sent = model
    got = sample.mapInArrow(_sample_batches(sent), "y int, best double, words bigint, hist binary, sums binary").toPandas()
    hist = sum((np.frombuffer(h, np.int64) for h in got["hist"].dropna()), np.zeros(_HIST, np.int64))
    clean, runs, logs = sum((np.frombuffer(x) for x in got["sums"].dropna()), np.zeros(3))
    got = got[got["y"] >= 0]
    y, best, words = got["y"].to_numpy() > 0, got["best"].to_numpy(), got["words"].to_numpy()
    model.lam = _lambda(hist, model.base)
    if clean:
        # Gumbel: the mean of lambda S is log(K n) plus Euler's constant
        model.k = float(np.exp(np.clip((model.lam * runs - logs) / clean - np.euler_gamma, -30, 5)))
    model.weights = tuple(_logistic(features(best, words, model), y.astype(float))) if y.any() and (~y).any() else (-5.0, 0.0, 0.0)
    return model


def _score_batches(model: Model, keep_clean: bool):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch["text"])
            n = len(offsets) - 1
            best, words = np.zeros(n), np.zeros(n, np.int64)
            runs = np.zeros(n, np.int64)
            spans: list = [[] for _ in range(n)]
            for a, b in slices(offsets):
                ids, first, starts, ends = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                scores = word_scores(ids, model)
                best[a:b], words[a:b] = best_runs(scores, first), np.diff(first)
                if keep_clean:
                    continue
                for i in np.flatnonzero(evidence(best[a:b], words[a:b], model) > np.log(20)):  # E below 0.05
                    lo, hi = first[i], first[i + 1]
                    found = [(s, e, v) for s, e, v in maximal_runs(scores[lo:hi])
                             if evidence(np.array([v]), np.array([hi - lo]), model)[0] > np.log(20)]
                    runs[a + i] = len(found)
                    at = offsets[a + i] - offsets[a]
                    spans[a + i] = [{"start": int(starts[lo + s] - at), "stop": int(ends[lo + e - 1] - at), "score": float(v)} for s, e, v in found]
            score = probability(features(best, words, model), model.weights) if model.known else np.zeros(n)
            if keep_clean:
                yield batch.filter(pa.array(score < 0.5))
            else:
                yield with_columns(batch, ["score", "predicted", "n_segments", "segments"], [
                    pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(runs),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score, predicted, n_segments and segments (byte ranges in the text)."""
    docs = docs.drop("score", "predicted", "n_segments", "segments")
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                           T.StructField("n_segments", T.LongType()),
                           T.StructField("segments", T.ArrayType(T.StructType([
                               T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("score", T.DoubleType())])))])
    return docs.mapInArrow(_score_batches(model, False), schema)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns."""
    return docs.mapInArrow(_score_batches(model, True), docs.schema)


def held_out() -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
