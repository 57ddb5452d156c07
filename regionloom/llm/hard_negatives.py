"""Hard-negative mining with bounds from segment summaries.

A vector is cut into segments. With mean m and deviation s of a segment of L components, the part of
an inner product that falls into it lies within L * (m * m' - s * s') and L * (m * m' + s * s')
(Cauchy-Schwarz on the centred parts). Every row stores the summaries of its finest segments; those
of coarser ones follow from them. A pair is bounded by one segment first, then by finer ones
(``LEVELS``); only pairs whose bounds still reach the wanted range of scores are scored exactly.

Rows are dealt to blocks of about ``ROWS`` by a hash, anchors to blocks of about ``ANCHORS``; each pair
of blocks is one group, worked on in slices of ``SLICE`` anchors, and returns at most ``k`` rows per
anchor (or per anchor and positive score). No label and no vector is a key, so a frequent one is
spread like any other. A first pass finds each anchor's positives, a second one the negatives
below each of their scores. Both keep the best of a group before anything is shuffled.

Scores are exact: components are whole numbers, summed as doubles where all sums stay below 2**53,
else as 64-bit numbers. Bounds are widened by more than their rounding.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part;
nor do rows whose squares could add up to more than a long holds (a component of 2**31 / sqrt(n) or more
after scaling). A row with a null vec_id is no anchor and comes last among ties. Vectors of
different lengths never meet; those without components score 0 with each other. Repeated rows are rows of
their own, also as anchors; remaining ties go to a number given to each row. Other columns of the
table are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.session import shared_path

SCALE = 256
ROWS = 1 << 15
ANCHORS = 1 << 13
SLICE = 32
#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
K = 5


def segment_bounds(dim: int, parts: int = LEVELS[-1]) -> np.ndarray:
    """Where the finest segments begin and end; the coarser ones join neighbours of these."""
    return np.arange(parts + 1) * dim // parts


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the finest segments of the rows of ``x``."""
    at = segment_bounds(x.shape[1])
    size = np.diff(at)
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, axis=1)], axis=1)
    mean = (total[:, at[1:]] - total[:, at[:-1]]) / np.maximum(size, 1)
    centred = x - np.repeat(mean, size, axis=1)
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(centred * centred, axis=1)], axis=1)
    return mean, np.sqrt(np.maximum(total[:, at[1:]] - total[:, at[:-1]], 0) / np.maximum(size, 1))


def weighted_levels(mean: np.ndarray, deviation: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the means and deviations, times the root of the segment's length: plain products then sum to bounds."""
    size = np.diff(segment_bounds(dim)).astype(float)
    out = []
    for parts in LEVELS:
        shape = (len(mean), parts, -1)
        n = size.reshape(parts, -1).sum(1)
        m = (mean * size).reshape(shape).sum(2) / np.maximum(n, 1)
        square = ((deviation ** 2 + mean ** 2) * size).reshape(shape).sum(2) / np.maximum(n, 1)
        out.append((m * np.sqrt(n), np.sqrt(np.maximum(square - m * m, 0)) * np.sqrt(n)))
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "vec_id", "label", "dim", "vector", "summary"]
    for batch in batches:
        lists = batch.column("x")
        dims = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        vector, summary, fits = [None] * len(dims), [None] * len(dims), np.ones(len(dims), bool)
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            with np.errstate(over="ignore"):
                x = np.floor(SCALE * flat[first[rows][:, None] + np.arange(d)])
            fits[rows] = (np.abs(x) < 2 ** 31 / np.sqrt(max(d, 1))).all(1)
            x[~fits[rows]] = 0
            stats = np.concatenate(summaries(x), axis=1).astype("<f4")
            x = x.astype("<i4")
            for i, r in enumerate(rows):
                vector[r], summary[r] = x[i].tobytes(), stats[i].tobytes()
        arrays = [batch.column("row"), batch.column("vec_id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(vector, pa.binary()), pa.array(summary, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(fits))


def prepare(embeddings: DataFrame, labels: Column) -> DataFrame:
    """(row, vec_id, label, dim, vector, summary) of the rows that take part, written to the shared folder."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), labels.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.col("embedding").alias("x"))
    path = shared_path(embeddings.sparkSession, "negatives-rows")
    rows.mapInArrow(_prepared, "row long, vec_id long, label int, dim int, vector binary, summary binary").write.parquet(path)
    return embeddings.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- one pair of blocks

class Block:
    """Vectors of one length with their summaries by level."""

    def __init__(self, df: pd.DataFrame, dim: int):
        n = len(df)
        self.row, self.label = df["row"].to_numpy(), df["label"].to_numpy()
        self.ids, self.nameless = df["id"].to_numpy(), df["nameless"].to_numpy()
        self.x = np.frombuffer(b"".join(df["vector"]), "<i4").reshape(n, dim).astype(float)
        stats = np.frombuffer(b"".join(df["summary"]), "<f4").reshape(n, 2, -1).astype(float)
        self.levels = weighted_levels(stats[:, 0], stats[:, 1], dim)
        self.norm = np.sqrt((self.x * self.x).sum(1))

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple]:
        """(score, vec_id, row) of the k best rows at ``at`` by score, then by vec_id (null last), then by row."""
        if len(at) > k:
            top = scores >= np.partition(scores, -k)[-k]
            at, scores = at[top], scores[top]
        for j in np.lexsort((self.row[at], self.ids[at], self.nameless[at], -scores))[:k]:
            yield scores[j], None if self.nameless[at[j]] else self.ids[at[j]], self.row[at[j]]


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit numbers."""
    top = max(1, a.shape[1]) * np.abs(a).max(initial=0) * np.abs(x).max(initial=0)
    return (a @ x.T).astype(np.int64) if top < 2 ** 53 else a.astype(np.int64) @ x.astype(np.int64).T


def within_bounds(a: Block, some: slice, b: Block, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``alive`` pairs (anchor of the slice, row) that can score from low to high, level by level."""
    slack = 1 + 1e-5 * a.norm[some].max(initial=0) * b.norm.max(initial=0)
    cols = np.flatnonzero(alive.any(0))
    for (am, ad), (bm, bd) in zip(a.levels, b.levels):
        middle, reach = am[some] @ bm[cols].T, ad[some] @ bd[cols].T
        alive[:, cols] &= (middle + reach + slack >= low[:, None]) & (middle - reach - slack <= high[:, None])
        cols = cols[alive[:, cols].any(0)]
    return alive


def _positives(a: Block, b: Block, k: int) -> Iterator[tuple]:
    for label in np.unique(a.label):
        mine, near = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        for lo in range(0, len(mine), SLICE):
            some = mine[lo:lo + SLICE]
            alive = np.zeros((len(some), len(b.row)), bool)
            alive[:, near] = a.row[some][:, None] != b.row[near]
            # a few exact scores give what a row must reach
            seed = near[:4 * k]
            first = np.where(alive[:, seed], exact_scores(a.x[some], b.x[seed]).astype(float), -np.inf)
            low = np.partition(first, -k, axis=1)[:, -k] if len(seed) >= k else np.full(len(some), -np.inf)
            within_bounds(a, some, b, alive, low, np.full(len(some), np.inf))
            cols = np.flatnonzero(alive.any(0))
            scores = exact_scores(a.x[some], b.x[cols])
            for i, anchor in enumerate(some):
                at = cols[alive[i, cols]]
                s = scores[i, alive[i, cols]]
                for found in b.best(at, s, k):
                    yield a.row[anchor], *found


def _negatives(a: Block, wanted: list, b: Block, k: int) -> Iterator[tuple]:
    for lo in range(0, len(a.row), SLICE):
        some = np.arange(lo, min(lo + SLICE, len(a.row)))
        ranges = [wanted[i] for i in some]
        low, high = np.array([0.8 * p.min() - 1 for p in ranges]), np.array([float(p.max()) for p in ranges])
        alive = within_bounds(a, some, b, a.label[some][:, None] != b.label, low, high)
        cols = np.flatnonzero(alive.any(0))
        scores = exact_scores(a.x[some], b.x[cols])
        for i, anchor in enumerate(some):
            at = cols[alive[i, cols]]
            s = scores[i, alive[i, cols]]
            for p in ranges[i]:
                # 80 p <= 100 s <= 100 p in numbers that fit a long
                fit = (s >= -(-4 * int(p) // 5)) & (s <= p)
                for found in b.best(at[fit], s[fit], k):
                    yield a.row[anchor], p, *found


_POSITIVES = ["anchor", "positive_score", "positive_id", "positive_row"]
_NEGATIVES = ["anchor", "positive_score", "negative_score", "negative_id", "negative_row"]


def _frame(rows: Iterator[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=names)
    return out.astype({n: "Int64" for n in names})


def _positive_cell(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(anchors):
        return _frame(iter(()), _POSITIVES)
    dim = int(rows["dim"].iloc[0])
    return _frame(_positives(Block(anchors, dim), Block(rows, dim), K), _POSITIVES)


def _negative_cell(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(anchors):
        return _frame(iter(()), _NEGATIVES)
    dim = int(rows["dim"].iloc[0])
    wanted = [np.sort(np.asarray(w, np.int64))[::-1] for w in anchors["wanted"]]
    return _frame(_negatives(Block(anchors, dim), wanted, Block(rows, dim), K), _NEGATIVES)


# ---------------------------------------------------------------- the two passes

def _cells(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, work, schema: str) -> DataFrame:
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # a null would turn whole numbers into floats on the way to pandas
    known = {"id": F.coalesce("vec_id", F.lit(0).cast("long")), "nameless": F.col("vec_id").isNull()}
    rows, anchors = rows.withColumns(known).drop("vec_id"), anchors.withColumns(known).drop("vec_id")
    left = rows.withColumn("b", block(row_blocks)).withColumn("a", every(anchor_blocks))
    # new names for the columns: both sides come from one table
    right = anchors.toDF(*anchors.columns).withColumn("a", block(anchor_blocks)).withColumn("b", every(row_blocks))
    key = ["dim", "a", "b"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(work, schema)


def _ranked(df: DataFrame, by: list[str], score: str, vec_id: str, row: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(vec_id).asc_nulls_last(), row)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= K)


def mine(embeddings: DataFrame, every: int = 100, labels: Column | None = None, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``. Their positives are the ``K`` best other rows
    of the same label; for each, the ``K`` best rows of another label that score at least 0.8 of
    the positive and no more than it. ``labels`` replaces the column label.
    """
    spark = embeddings.sparkSession
    stored = prepare(embeddings, F.col("label") if labels is None else labels)
    asked = stored.filter(F.col("vec_id") % every == 0)
    sizes = stored.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    blocks = [max(1, -(-n // most)) for n, most in zip(sizes, (rows, anchors))]
    long = lambda names: ", ".join(f"{n} long" for n in names)
    found = _cells(stored, asked, *blocks, _positive_cell, long(_POSITIVES))
    path = shared_path(spark, "negatives-positives")
    _ranked(found, ["anchor"], "positive_score", "positive_id", "positive_row").drop("rank").write.parquet(path)
    positives = spark.read.parquet(path)
    # a positive score below zero leaves no score between 0.8 of it and itself
    wanted = positives.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("wanted"))  # K at most
    found = _cells(stored, asked.join(wanted, "row"), *blocks, _negative_cell, long(_NEGATIVES))
    negatives = _ranked(found, ["anchor", "positive_score"], "negative_score", "negative_id", "negative_row")
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives.join(positives, ["anchor", "positive_score"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


MINE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS s
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT a, b AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
neg AS (SELECT a, p, ps, b, s, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) AS r
        FROM pos JOIN scored USING (a) WHERE NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM neg WHERE r <= 5
"""
