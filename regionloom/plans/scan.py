"""Ordered scans (running sum, running max, ranks) that never put one key into one task.

A window over a whole chromosome, contrast or table would run in a single task. Here rows
are first cut into consecutive *parts* of the order; the window runs per part, and one small
table with a row per part carries the running values from part to part. Several running values,
from either end, share one range partition.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.session import checkpointed

PART = "part_"
BEFORE = (W.unboundedPreceding, -1)
UPTO = (W.unboundedPreceding, W.currentRow)

_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
}
_AGG = {"total": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


class Running(NamedTuple):
    """A running aggregate: of what, how (sum, max or min), its name, with the row itself or not, from which end.

    ``total`` is the group's sum, the same for all its rows. Rows that the order leaves equal may stand
    differently in each aggregate, so two that have to fit together need an order without ties.
    """

    value: Column
    how: str
    out: str
    inclusive: bool = True
    reverse: bool = False


def _directed(order: list, reverse: bool) -> list[Column]:
    """Sort columns of an order; a name is ascending, with a minus before it descending."""
    out = []
    for o in order:
        if isinstance(o, str):
            down = o.startswith("-") != reverse
            out.append(F.col(o.removeprefix("-")).desc() if down else F.col(o.removeprefix("-")).asc())
        elif reverse:
            raise ValueError("an order that is followed backwards is given by names")
        else:
            out.append(o)
    return out


def carried_all(df: DataFrame, group: list[str], part: str, order: list, values: list[Running]) -> DataFrame:
    """Running aggregates over (group, part, order), each added as a column, by one shuffle of the rows.

    ``part`` must follow the order: all rows of a lower part come before those of a higher one.
    The part table holds one row per (group, part), so its own windows stay small.
    """
    # a struct of the group's columns is equal to another with nulls in the same places, so the
    # null group is kept; windows, totals and join share one partitioning. Rows without a part have
    # no place in the order; the filter stands above both branches, so they read one shuffle
    df = df.filter(F.col(part).isNotNull()).withColumn("g_", F.struct(*group) if group else F.lit(0))
    df = df.withColumns({f"v{n}_": r.value for n, r in enumerate(values)})
    frames = [UPTO if r.inclusive else BEFORE for r in values]
    local = [W.partitionBy("g_", part).orderBy(*_directed(order, r.reverse)).rowsBetween(*f) for r, f in zip(values, frames)]
    whole = W.partitionBy("g_")
    across = [whole if r.how == "total" else whole.orderBy(*_directed([part], r.reverse)).rowsBetween(*BEFORE) for r in values]
    parts = df.groupBy("g_", part).agg(*[_AGG[r.how](f"v{n}_").alias(f"t{n}_") for n, r in enumerate(values)])
    parts = parts.select("g_", part, *[_AGG[r.how](f"t{n}_").over(w).alias(f"c{n}_") for n, (r, w) in enumerate(zip(values, across))])
    rows = df.select("*", *[_AGG[r.how](f"v{n}_").over(w).alias(f"l{n}_") for n, (r, w) in enumerate(zip(values, local)) if r.how != "total"])
    out = rows.join(parts, ["g_", part]).withColumns({
        r.out: F.col(f"c{n}_") if r.how == "total" else _COMBINE[r.how](F.col(f"c{n}_"), F.col(f"l{n}_")) for n, r in enumerate(values)})
    return out.drop("g_", *[f"{x}{n}_" for x in "vcl" for n in range(len(values))])


def carried(df: DataFrame, group: list[str], part: str, order: list, value: Column, how: str, out: str,
            inclusive: bool = True, reverse: bool = False) -> DataFrame:
    """Running ``how`` of ``value`` over (group, part, order), added as column ``out``; see ``carried_all``."""
    return carried_all(df, group, part, order, [Running(value, how, out, inclusive, reverse)])


def ordered_parts(df: DataFrame, order: list) -> DataFrame:
    """Range-partition by the order keys and store the part number with each row.

    Range bounds come from a sample, so a recomputed plan could cut elsewhere; the
    checkpoint fixes them. A hot value is spread as soon as a later key breaks the tie.
    """
    ranged = df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id())
    return checkpointed(ranged)


def running_all(df: DataFrame, group: list[str], order: list, values: list[Running]) -> DataFrame:
    """Running aggregates over a total order inside each group, spread over all tasks; one range partition for all."""
    keys = [*(F.col(g) for g in group), *_directed(order, False)]
    return carried_all(ordered_parts(df, keys), group, PART, order, values).drop(PART)


def running(df: DataFrame, group: list[str], order: list, value: Column, how: str, out: str,
            inclusive: bool = True) -> DataFrame:
    """One running aggregate over a total order inside each group."""
    return running_all(df, group, order, [Running(value, how, out, inclusive)])


def numbered(df: DataFrame, group: list[str], order: list, out: str = "rn") -> DataFrame:
    """1-based row number in a total order, per group."""
    return running(df, group, order, F.lit(1).cast("long"), "sum", out)


def value_ranks(df: DataFrame, group: list[str], value: str, descending: bool = False, also: list[Column] | None = None) -> DataFrame:
    """One row per (group, value): ``n_ties``, ``n_before``, ``rank``, ``avg_rank``, ``n_group``, and the aggregates ``also``.

    Rows are counted per distinct value before anything is ordered, so a value that a third
    of all rows share costs one row here.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_ties"), *(also or []))
    n = F.col("n_ties")
    order = [f"-{value}" if descending else value]
    cum = running_all(counts, group, order, [Running(n, "sum", "n_upto"), Running(n, "total", "n_group")])
    before = F.col("n_upto") - F.col("n_ties")
    return (
        cum.withColumn("n_before", before)
        .withColumn("rank", before + 1)
        .withColumn("avg_rank", before + (F.col("n_ties") + 1) / 2)
    )


def with_avg_rank(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Average rank (ties share the mean of their ranks) of ``value`` inside each group."""
    ranks = value_ranks(df, group, value).select(*group, value, F.col("avg_rank").alias(out))
    return df.join(ranks, [*group, value], "left")
