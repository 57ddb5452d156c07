"""Document quality from random-indexing word vectors and a small calibrated network.

1. *Random indexing.* Words are hashed into ``BUCKETS`` entries, their shapes (capitals, symbols,
   digits, equal to the word before) into ``SHAPES`` more. Every entry has a fixed sparse ternary index
   vector of ``DIM`` places; an entry's word vector is the sum of the index vectors of the words up to
   ``REACH`` places away and of its own shape, over all documents. Tasks add up their part and send one
   table each; the sum is centred and scaled to unit length.
2. *Pooling.* A document is the mean of its word vectors, of its shapes' vectors, the spread of the
   word vectors and how alike neighbouring words are.
3. *Network.* One hidden layer of ``HIDDEN`` units and an output, plain numpy, trained on at most
   ``SAMPLE`` labelled rows (a hash of the doc_id picks them); a fifth of these sets the temperature
   by which the output is divided, so that scores are probabilities.

The vectors cover all documents; only the network is fitted on the stated sample. The driver holds
the vector table (``BUCKETS + SHAPES`` rows) and the pooled sample.

Defined cases: null and empty texts pool to zeros and get the score of that vector; copies of one
text count once among the labels; conflicting labels of a doc_id: the largest counts; without
both classes every score is the share of label 1 (or 0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from regionloom.llm.textkit import ByteHash, slices, text_buffer, with_columns, word_spans
from regionloom.llm.toxicity import labelled, training_labels
from regionloom.session import checkpointed

BUCKETS = 1 << 13
SHAPES = 128
DIM = 48
REACH = 2
NONZERO = 4
HIDDEN = 32
SAMPLE = 20_000
EPOCHS = 40
_PARTS = 65
_SIZE = BUCKETS + SHAPES
_RNG = np.random.default_rng(9)
_PLACES = np.array([_RNG.choice(DIM, NONZERO, replace=False) for _ in range(_SIZE)])
_SIGNS = np.tile(np.array([1.0, 1.0, -1.0, -1.0]), (_SIZE, 1))
_CLASSES = np.zeros((5, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, ord("!")] = True
_CLASSES[2, [ord(c) for c in "*$#&%@^~=<>{}\\_"]] = True
_CLASSES[3, [ord(c) for c in "|/"]] = True
_CLASSES[4, 48:58] = True


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: list = field(default_factory=list)
    temperature: float = 1.0
    constant: float = 0.5


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry of every word, entry of its shape, first word of each row."""
    starts, ends, first = word_spans(data, offsets)
    hashes = ByteHash(data).of(starts, ends)
    shape = np.zeros(len(starts), np.int64)
    for bit, chars in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(chars[data], dtype=np.int64)])
        # a capital at the start of a word is no sign of anything
        shape |= ((sums[ends] - sums[starts]) > (1 if bit == 0 else 0)).astype(np.int64) << bit
    again = np.zeros(len(starts), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[first[:-1][np.diff(first) > 0]] = False
    shape |= again.astype(np.int64) << 5
    shape |= (ends - starts > 12).astype(np.int64) << 6
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), BUCKETS + shape, first


def _add(total: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
    """Add the index vectors of ``others`` to the vectors of ``rows``."""
    for j in range(NONZERO):
        total += np.bincount(rows * DIM + _PLACES[others, j], _SIGNS[others, j], minlength=_SIZE * DIM)


def _context_batches(batches):
    total = np.zeros(_SIZE * DIM)
    for batch in batches:
        data, offsets = text_buffer(batch["text"])
        for a, b in slices(offsets):
            words, shapes, first = word_ids(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            row = np.repeat(np.arange(b - a), np.diff(first))
            _add(total, words, shapes)
            for gap in range(1, REACH + 1):
                same = np.flatnonzero(row[gap:] == row[:-gap])
                _add(total, words[same], words[same + gap])
                _add(total, words[same + gap], words[same])
                if gap == 1:
                    _add(total, shapes[same], shapes[same + 1])
    parts = np.array_split(total.astype(np.float32), _PARTS)
    yield pa.RecordBatch.from_pydict({"part": pa.array(range(_PARTS), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})


def _sum_parts(rows: pd.DataFrame) -> pd.DataFrame:
    # sums of whole numbers, so the order of the rows does not matter
    total = sum(np.frombuffer(s, np.float32).astype(np.float64) for s in rows["sums"])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "sums": [total.tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit-length word vectors from all documents, one row per entry."""
    summed = docs.select("text").mapInArrow(_context_batches, "part int, sums binary").groupBy("part").applyInPandas(_sum_parts, "part int, sums binary")
    parts = {r["part"]: np.frombuffer(r["sums"]) for r in summed.collect()}  # _SIZE rows of DIM numbers
    if not parts:
        return np.zeros((_SIZE, DIM), np.float32)
    table = np.concatenate([parts[i] for i in range(_PARTS)]).reshape(_SIZE, DIM)
    weight = np.linalg.norm(table, axis=1, keepdims=True)
    unit = table / np.maximum(weight, 1e-9)
    unit = unit - (unit * (weight > 0)).sum(axis=0) / max(1, (weight > 0).sum())
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9) * (weight > 0)).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of each row: 3 * DIM + 3 numbers."""
    words, shapes, first = word_ids(data, offsets)
    n = np.diff(first)
    out = np.zeros((len(n), 3 * DIM + 3), np.float32)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    starts = first[:-1][full]
    v = vectors[words]
    mean = np.add.reduceat(v, starts, axis=0) / n[full, None]
    spread = np.add.reduceat(v * v, starts, axis=0) / n[full, None] - mean * mean
    counts = np.zeros((len(full), SHAPES), np.float32)
    np.add.at(counts, (np.repeat(np.arange(len(full)), n[full]), shapes - BUCKETS), 1.0)
    near = np.zeros(len(words), np.float32)
    near[:-1] = (v[:-1] * v[1:]).sum(axis=1)
    near[first[1:][full] - 1] = 0
    out[full, :DIM], out[full, DIM:2 * DIM] = mean, np.sqrt(np.maximum(spread, 0))
    out[full, 2 * DIM:3 * DIM] = counts @ vectors[BUCKETS:] / n[full, None]
    out[full, -3] = np.add.reduceat(near, starts) / n[full]
    out[full, -2] = np.linalg.norm(mean, axis=1)
    out[full, -1] = np.log1p(n[full])
    return out


def batch_features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    data, offsets = text_buffer(texts)
    out = [pooled(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], vectors) for a, b in slices(offsets, 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, 3 * DIM + 3), np.float32)


def _sample_batches(vectors: np.ndarray):
    def run(batches):
        for batch in batches:
            x = batch_features(batch["text"], vectors)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "y": batch["y_"].cast(pa.int32()), "x": pa.array([r.tobytes() for r in x], pa.binary())})
    return run


def _forward(x: np.ndarray, layers: list) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2[0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(x: np.ndarray, y: np.ndarray) -> list:
    """Adam over shuffled batches of 256 rows, with weight decay."""
    rng = np.random.default_rng(1)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(order), 256):
            rows = order[s:s + 256]
            hidden, z = _forward(x[rows], layers)
            dz = (_sigmoid(z) - y[rows]) / len(rows)
            dh = np.outer(dz, layers[2]) * (hidden > 0)
            grads = [x[rows].T @ dh, dh.sum(axis=0), hidden.T @ dz, np.array([dz.sum()])]
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - 3e-3 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the output with the least log loss on rows that were not trained on."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [-(y * np.log(_sigmoid(z / t)) + (1 - y) * np.log(_sigmoid(-z / t))).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model:
    """Word vectors from all documents, the network from labelled rows for which ``usable`` holds."""
    model = Model(word_vectors(docs))
    marks = checkpointed(training_labels(docs, labels, usable, label))
    total = marks.count()
    if not total:
        return model
    rate = min(1.0, SAMPLE / total)
    pick = marks if rate == 1.0 else marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    sample = labelled(docs, pick).filter(F.col("y_").isNotNull())
    got = sample.mapInArrow(_sample_batches(model.vectors), "doc_id long, y int, x binary").toPandas().sort_values(["doc_id", "y", "x"])
    if not len(got):
        return model
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(float)
    y = (got["y"].to_numpy() > 0).astype(float)
    model.constant = float(y.mean())
    if y.min() == y.max():
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - model.mean) / model.scale, -8, 8)
    held = np.arange(len(x)) % 5 == 4
    if held.sum() < 10 or y[held].min() == y[held].max():
        held[:] = False
    model.layers = _train(x[~held], y[~held])
    if held.any():
        model.temperature = _temperature(_forward(x[held], model.layers)[1], y[held])
    return model


def _score_batches(model: Model):
    def run(batches):
        for batch in batches:
            x = batch_features(batch["text"], model.vectors)
            if model.layers:
                x = np.clip((x - model.mean) / model.scale, -8, 8)
                score = _sigmoid(_forward(x, model.layers)[1] / model.temperature)
            else:
                score = np.full(len(x), model.constant)
            yield with_columns(batch, ["score", "predicted"], [pa.array(score), pa.array((score >= 0.5).astype(np.int32))])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with score and predicted."""
    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(_score_batches(model), T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out() -> Column:
    """Rows whose labels are never learned from: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
