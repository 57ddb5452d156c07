"""The one interval to choose among those that overlap, without making the pairs.

Intervals meet in the bins of the range join, but a bin's pairs are never listed: all its questions
walk down a binary tree over the candidates in their order of choice, in numpy, so a bin with n
candidates and m questions costs (n + m) times a power of log n, however many overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from regionloom.plans.bins import KEY, _levels_in_use, _salt, _slots
from regionloom.plans.scan import _directed

BIN = 8192  # wider than for pairs: a bin's work hardly grows faster than its rows
HOT = 1 << 17  # rows of one side that are searched at once; a bin as wide as a chromosome holds more


def first_hit(starts: np.ndarray, stops: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each question the first position with ``start < high`` and ``stop > low``, -1 without one.

    A block of the tree, sorted by start, with the running maximum of stops says whether one in it fits.
    """
    n = len(starts)
    depth = (n - 1).bit_length()
    size = 1 << depth
    by_start = np.argsort(starts, kind="stable")
    place = np.arange(size)
    place[by_start] = np.arange(n)
    reach = np.full(size, np.iinfo(np.int64).min)
    reach[:n] = stops
    below = np.searchsorted(starts[by_start], highs)

    def fits(block: np.ndarray, level: int) -> np.ndarray:
        shape = (-1, 1 << level)
        places = place.reshape(shape)
        order = np.argsort(places, axis=1)
        far = np.maximum.accumulate(np.take_along_axis(reach.reshape(shape), order, axis=1), axis=1).ravel()
        keys = (np.take_along_axis(places, order, axis=1) + np.arange(len(places))[:, None] * size).ravel()
        upto = np.searchsorted(keys, block * size + below)
        return (upto > block << level) & (far[np.maximum(upto, 1) - 1] > lows)

    block = np.zeros(len(lows), dtype=np.int64)
    some = fits(block, depth)
    for level in reversed(range(depth)):
        block = 2 * block
        block = block + ~fits(block, level)
    return np.where(some, block, -1)


def _met(a: DataFrame, b: DataFrame, by: list[str], width: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides in the bins where they can meet, large bins in parts; ``b`` columns get the prefix ``b_``.

    The choice among the parts is made afterwards, with that among the bins that an interval touches.
    """
    fixed = ["chrom", *by]
    right = b.select(*[F.col(c).alias(c if c in fixed else f"b_{c}") for c in b.columns])
    left = _slots(a, width, _levels_in_use(b, width), False).drop("w_")
    right = _slots(right, width, _levels_in_use(a, width), True, "b_start", "b_stop")
    keys = [*fixed, "place_"]
    place = F.struct("slot_", "bin_")
    left, right = (df.withColumn("place_", place).drop("slot_", "bin_") for df in (left, right))
    known = F.lit(True)
    for c in fixed:
        known = known & F.col(c).isNotNull()
    return *_salt(left.filter(known), right.filter(known), keys, HOT), [*keys, "salt_"]


def _longs(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy().astype(np.int64) for n in names]


def first_overlap(a: DataFrame, b: DataFrame, order: list[str], by: list[str] | None = None, width: int = BIN) -> DataFrame:
    """Per distinct ``a`` interval (and ``by``) the first overlapping ``b`` row; those without one are left out.

    ``order`` names columns of ``b``, with a minus before it descending; nulls come first ascending and last
    descending. It should leave no ties between rows that differ. Rows of both sides meet where chrom and ``by``
    are equal and not null. ``b`` columns come back with the prefix ``b_``.
    """
    by = by or []
    asked = [*KEY, *by]
    a, b = a.select(*asked).distinct(), b.distinct()
    left, right, keys = _met(a, b, by, width)
    own = [f"b_{c}" for c in b.columns if c not in ("chrom", *by)]
    choice = _directed([o.replace("-", "-b_", 1) if o.startswith("-") else f"b_{o}" for o in order], False)
    right = right.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(*choice)))
    types = {f.name: f.dataType for f in [*left.schema, *right.schema]}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*asked, *own]])

    def chosen(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(questions) or not len(rows):
            return pa.table({c: pa.array([], (questions if c in asked else rows).schema.field(c).type) for c in schema.names})
        rows = rows.sort_by("rank_")
        at = first_hit(*_longs(rows, "b_start", "b_stop"), *_longs(questions, "start", "stop"))
        found = at >= 0
        questions, rows = questions.filter(pa.array(found)), rows.take(pa.array(at[found]))
        return pa.table([*[questions[c] for c in asked], *[rows[c] for c in own]], names=schema.names)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(chosen, schema)
    first = W.partitionBy(*asked).orderBy(*choice)  # a row per bin that the interval touches
    return found.withColumn("rank_", F.row_number().over(first)).filter("rank_ = 1").drop("rank_")


def largest_overlap(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Per distinct ``a`` interval the ``b`` interval with the largest overlap, then the smallest (start, stop).

    Columns: chrom, start, stop, b_start, b_stop; intervals without a hit are left out. The best one either
    reaches the end of ``a``, or covers its start, or lies inside; each kind has an order of choice.
    """
    left, right, keys = _met(a.select(*KEY).distinct(), b.select(*KEY).distinct(), [], width)
    names = [*KEY, "b_start", "b_stop", "overlap"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "chrom" else T.LongType()) for n in names])

    def chosen(questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(questions) or not len(rows):
            return pa.table({n: pa.array([], pa.string() if n == "chrom" else pa.int64()) for n in names})
        (start, stop), (low, high) = _longs(rows, "b_start", "b_stop"), _longs(questions, "start", "stop")
        kinds = [
            (np.lexsort((stop, start)), start, stop, high - 1, high),
            (np.lexsort((start, -stop)), start, stop, low, low + 1),
            (np.lexsort((start, start - stop)), -start, -stop, -high - 1, 1 - low),
        ]
        best = np.zeros((3, len(low)), dtype=np.int64)  # overlap, -start, -stop
        for order, first, last, over, under in kinds:
            at = first_hit(first[order], last[order], over, under)
            row = order[np.maximum(at, 0)]
            shared = np.where(at >= 0, np.minimum(stop[row], high) - np.maximum(start[row], low), 0)
            new = np.stack([shared, -start[row], -stop[row]])
            more = np.zeros(len(low), dtype=bool)
            for i in reversed(range(3)):
                more = (new[i] > best[i]) | ((new[i] == best[i]) & more)
            best = np.where(more & (shared > 0), new, best)
        found = best[0] > 0
        questions, best = questions.filter(pa.array(found)), best[:, found]
        return pa.table([*[questions[c] for c in KEY], -best[1], -best[2], best[0]], names=names)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(chosen, schema)
    best = found.groupBy(*KEY).agg(F.max(F.struct("overlap", -F.col("b_start"), -F.col("b_stop"))).alias("m_"))
    return best.select(*KEY, (-F.col("m_.col2")).alias("b_start"), (-F.col("m_.col3")).alias("b_stop"))
