"""Windows, sorts, limits and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.functions.vectors import vargmax
from regionloom.operators.matrix import every_kth
from regionloom.plans.scan import Running, numbered, running_all


def rows_at_max(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows equal to their group's maximum, ties kept; the maximum is combined before the shuffle."""
    top = df.groupBy(*key).agg(F.max(value).alias(value))
    return df.join(top, [*key, value], "left_semi").select(*df.columns)


def row_of_max(df: DataFrame, key: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of each group's maximum, the first by ``tie`` among equals; a null is below every value."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(F.col(value).isNull().alias("n_"), (-F.col(value)).alias("v_"), *[F.col(c).alias(f"t{i}_") for i, c in enumerate(tie)],
                                               F.struct(*rest).alias("r_"))).alias("b_"))
    return best.select(*key, *[F.col(f"b_.r_.{c}").alias(c) for c in rest])


def sequential_ids(df: DataFrame, order: list, out: str = "unique_id") -> DataFrame:
    """0-based number of each row in a total order."""
    return numbered(df, [], order, out).withColumn(out, F.col(out) - 1)


def cumulative_labels(df: DataFrame, score: str, tie: str, label: str) -> DataFrame:
    """Rank by descending score and the running sum of labels."""
    return running_all(df, [], [f"-{score}", tie], [
        Running(F.lit(1).cast("long"), "sum", "rank"), Running(F.col(label).cast("long"), "sum", "captured")])


def trim_extremes(df: DataFrame, key: list[str], value: str, times: int = 2) -> DataFrame:
    """Drop each group's ``times`` largest and smallest distinct values."""
    out = df
    for _ in range(times):
        ends = out.groupBy(*key).agg(F.max(value).alias("hi_"), F.min(value).alias("lo_"))
        out = (out.join(ends, key) if key else out.join(F.broadcast(ends))).filter((F.col(value) < F.col("hi_")) & (F.col(value) > F.col("lo_"))).drop("hi_", "lo_")
    return out


def shares(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Share of the group's total."""
    totals = df.groupBy(*key).agg(F.sum(value).alias("t_"))
    return (df.join(totals, key) if key else df.join(F.broadcast(totals))).withColumn("share", F.col(value) / F.col("t_")).drop("t_")


def best_task(df: DataFrame, key: list[str], task: str, value: str) -> DataFrame:
    """Each group's best task (smallest task among equals), next to every row of the group."""
    best = df.groupBy(*key).agg(F.min(F.struct(F.col(value).isNull().alias("n"), (-F.col(value)).alias("v"), F.col(task).alias("t"))).alias("b_"))
    return df.join(best.select(*key, F.col("b_.t").alias("best_task")), key)


def genome_sorted(df: DataFrame) -> DataFrame:
    """L01."""
    return df.orderBy("chrom", "start")


def shuffled_by_clusters(df: DataFrame, keys: list[str], row: str, seed: int) -> DataFrame:
    """Sort by the cluster keys; rows inside a cluster lie in a seeded random order."""
    return df.orderBy(*keys, F.xxhash64(F.col(row), F.lit(seed)))


def score_sorted(df: DataFrame, score: str) -> DataFrame:
    """L03."""
    return df.orderBy(F.col(score).desc())


def top_ranked(df: DataFrame, order: list[Column], n: int = 1000) -> DataFrame:
    """The first ``n`` rows of a ranked list; the report keeps only those by definition."""
    return df.orderBy(*order).limit(n)


def flag_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows by several ascending keys."""
    return df.dropDuplicates().orderBy(*keys)


def peak_sorted(df: DataFrame, vector: str, key: str) -> DataFrame:
    """Order rows by the position of their vector's maximum."""
    return df.withColumn("peak", vargmax(F.col(vector))).orderBy("peak", key)


def random_subset(df: DataFrame, row: str, n: int, seed: int = 42) -> DataFrame:
    """A reproducible random subset of ``n`` rows, in the order of a digest of seed and key; any engine draws the same."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row).cast("string"), F.lit("")))), row).limit(n)


def ordered_joint_label(clusters: DataFrame, marks: DataFrame, k_target: int) -> DataFrame:
    """Joint label ``cluster.mark`` in (cluster, mark) order, every k-th row."""
    joined = clusters.join(marks, "id").withColumn("label", F.concat_ws(".", "cluster", "mark"))
    return every_kth(joined, ["cluster", "mark", "id"], k_target)


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """R01."""
    return df.unpivot(ids, columns, name, value)


def widen(df: DataFrame, key: list[str], name: str, names: list, value: str) -> DataFrame:
    """Pivot with stated values, so no extra job looks for them."""
    return df.groupBy(*key).pivot(name, names).agg(F.max(value))


def explode_list(df: DataFrame, col: str, sep: str, out: str) -> DataFrame:
    """R03."""
    return df.withColumn(out, F.explode(F.split(col, sep)))


def transpose(df: DataFrame, key: str, keys: list, columns: list[str]) -> DataFrame:
    """Rows to columns for a small result with known keys."""
    return df.unpivot([key], columns, "name", "value").groupBy("name").pivot(key, keys).agg(F.max("value"))


def signed_long(df: DataFrame, key: str, up: str, down: str) -> DataFrame:
    """Up counts positive, down counts negative, in long form."""
    return df.select(key, F.col(up).alias("up"), (-F.col(down)).alias("down")).unpivot([key], ["up", "down"], "direction", "n")
