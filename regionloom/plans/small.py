"""Every row of one table with every row of another, dealt evenly to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def small_grid(a: DataFrame, b: DataFrame, cells: int | None = None) -> DataFrame:
    """Every row of ``a`` with every row of ``b`` (clusters, contrasts), as an equi-join on cells.

    The rows of ``a`` are dealt to cells, four for each shuffle partition unless given; ``b``, the
    smaller side, goes to all of them. So the work spreads over as many tasks as the session has
    partitions. The result has rows(a) * rows(b) rows by definition; neither side has to fit
    one task, and the planner may still broadcast a side that it finds small.
    """
    cells = cells or 4 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = a.withColumn("cell_", F.pmod(F.xxhash64(*a.columns), F.lit(cells)).cast("int"))
    right = b.withColumn("cell_", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return left.join(right, "cell_").drop("cell_")
