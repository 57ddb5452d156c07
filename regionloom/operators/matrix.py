"""Signal matrices: vectors, normalisation, correlation, subsets (A31, A32, A39-A42, A74, W05-W07, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.operators.transforms import exact_percentiles
from regionloom.plans.scan import BEFORE, PART, numbered, value_ranks, with_avg_rank
from regionloom.session import checkpointed


def vectors(long: DataFrame, key: str, axis: str, points: list, value: str = "value", fill: float | None = 0.0,
            out: str = "vector") -> DataFrame:
    """One array per key over the given points of ``axis``; built by an aggregate, not by collecting rows."""
    at = lambda p: F.max(F.when(F.col(axis) == p, F.col(value).cast("double")))
    item = (lambda p: F.coalesce(at(p), F.lit(fill))) if fill is not None else at
    return long.groupBy(key).agg(F.array(*[item(p) for p in points]).alias(out))


def quantile_normalise(long: DataFrame, samples: list[str]) -> DataFrame:
    """Give each value the mean, over the samples, of the values at its rank.

    Long rows with ``sample`` and ``value``; those of other samples are left out. Adds ``normalised``.
    Ties take the highest tied rank. A null has no rank and stays, with a null. Where a sample
    has fewer values than the longest, both are read off by linear interpolation, first values at first
    ranks and last at last; a single value stands for every rank and gets the mean in the middle.

    Rows are put in order once, with their number in the part; a table with a row per part makes ranks of these, so
    no row is moved to be ranked. A value's level is looked up once and comes back to the rows of each part
    that holds the value, so a frequent value is spread as its rows are.
    """
    mine = long.filter(F.col("sample").isin(samples))
    rows = mine.filter(F.col("value").isNotNull()).withColumn("value_", F.col("value").cast("double"))
    ranged = rows.repartitionByRange("sample", "value_", F.xxhash64(*long.columns)).sortWithinPartitions("sample", "value_")
    ranged = checkpointed(ranged.withColumns({PART: F.spark_partition_id(), "o_": F.monotonically_increasing_id()}))
    counts = ranged.groupBy("sample", PART).agg(F.count("*").alias("n_"), F.min("o_").alias("head_"))
    each = W.partitionBy("sample")
    behind = F.coalesce(F.sum("n_").over(each.orderBy(PART).rowsBetween(*BEFORE)), F.lit(0))
    parts = counts.select("sample", PART, (behind - F.col("head_")).alias("shift_"), (F.sum("n_").over(each) - 1).alias("last_"))
    parts = checkpointed(parts.join(F.broadcast(parts.agg(F.max("last_").alias("top_"), F.count_distinct("sample").alias("of_")))))
    ranked = ranged.join(F.broadcast(parts), ["sample", PART]).withColumn("at_", F.col("o_") + F.col("shift_"))
    at, last, top = F.col("at_"), F.col("last_"), F.col("top_")
    # places 0..top that a row has a share in: those nearer than one rank of its sample
    first = lambda n: F.floor((n * top + last - 1) / last)
    spots = F.when(last == 0, F.sequence(F.lit(0).cast("long"), top)).when(last == top, F.array(at)).otherwise(
        F.sequence(first(F.greatest(at - 1, F.lit(0))), F.least(first(at + 1) - 1, top)))
    off = F.when((last == 0) | (last == top), 0.0).otherwise(F.abs(F.col("spot_") * last - at * top) / top)
    read = ranked.withColumn("spot_", F.explode(spots)).withColumn("off_", off).filter("off_ < 1").withColumn("x_", (1 - F.col("off_")) * F.col("value_"))
    means = read.groupBy("spot_").agg((F.sum("x_") / F.max("of_")).alias("m_"))
    # the last of equal values, and the parts from its first to its last row
    heads = ranked.groupBy("sample", "value_").agg(F.max("at_").alias("at_"), F.max("last_").alias("last_"), F.max("top_").alias("top_"),
                                                   F.min(PART).alias("low_"), F.max(PART).alias("high_"))
    place = F.when(last == 0, top / 2).otherwise(at * top / last)
    heads = heads.withColumn("place_", place).withColumn("spot_", F.explode(F.array_distinct(F.array(F.floor("place_"), F.ceil("place_")))))
    near = heads.join(means, "spot_").withColumn("x_", (1 - F.abs(F.col("place_") - F.col("spot_"))) * F.col("m_"))
    levels = near.groupBy("sample", "value_").agg(F.sum("x_").alias("normalised"), F.max("low_").alias("low_"), F.max("high_").alias("high_"))
    levels = levels.select("sample", "value_", "normalised", F.explode(F.sequence("low_", "high_")).alias(PART))
    found = ranged.join(levels, ["sample", PART, "value_"]).select(*long.columns, "normalised")
    return found.unionByName(mine.filter(F.col("value").isNull()).withColumn("normalised", F.lit(None).cast("double")))


def spearman(df: DataFrame, group: list[str], x: str, y: str, out: str = "rho") -> DataFrame:
    """Spearman correlation per group by average ranks."""
    ranked = with_avg_rank(with_avg_rank(df, group, x, "rx_"), group, y, "ry_")
    return ranked.groupBy(*group).agg(F.corr("rx_", "ry_").alias(out))


def expressed_counts(long: DataFrame, threshold: float, axis: str = "timepoint", value: str = "value") -> DataFrame:
    """Number of ids above the threshold at each timepoint."""
    return long.groupBy(axis).agg(F.count_if(F.col(value) > threshold).alias("n_expressed"))


def size_factors(counts: DataFrame, key: str, sample: str, value: str, n_samples: int) -> DataFrame:
    """Median-of-ratios size factor per sample, over ids counted in every sample."""
    logs = counts.filter(F.col(value) > 0).select(key, sample, F.log(value).alias("l_"))
    centre = logs.groupBy(key).agg(F.avg("l_").alias("m_"), F.count("*").alias("n_")).filter(F.col("n_") == n_samples)
    ratios = logs.join(centre, key).select(sample, (F.col("l_") - F.col("m_")).alias("ratio"))
    return exact_percentiles(ratios, [sample], "ratio", {"f_": 0.5}).select(sample, F.exp("f_").alias("size_factor"))


def log2_normalised(counts: DataFrame, factors: DataFrame, sample: str, value: str) -> DataFrame:
    """A42 tail: log2(count / size factor + 1)."""
    return counts.join(factors, sample).withColumn("log2_signal", F.log2(F.col(value) / F.col("size_factor") + 1))


def _co_moments(n: int):
    """Per task and pair of samples (i <= j): number of ids with both, means, and centred squares and products."""
    def run(batches):
        for batch in (b for b in batches if b.num_rows):
            flat = batch["vector"].flatten()
            seen = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, n)
            x = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, n)
            odd = seen & ~np.isfinite(x)
            kept, x = seen.astype(float), np.where(seen & ~odd, x, 0.0)
            # moved to a value of the sample, then to the mean: equal values stay exactly equal
            low = x[seen.argmax(axis=0), np.arange(n)]
            x = (x - low) * kept
            rest = x.sum(axis=0) / np.maximum(kept.sum(axis=0), 1)
            x = (x - rest) * kept
            count, total, square, product = kept.T @ kept, x.T @ kept, (x * x).T @ kept, x.T @ x
            blank = odd.astype(float).T @ kept
            i, j = np.triu_indices(n)
            size, a, b = np.maximum(count[i, j], 1), total[i, j], total[j, i]
            spoilt = np.where(blank[i, j] + blank[j, i] > 0, np.nan, 0.0)
            some = count[i, j] > 0
            columns = {"i": i, "j": j, "n": count[i, j], "mx": (low + rest)[i] + a / size, "my": (low + rest)[j] + b / size,
                       "xx": square[i, j] - a * a / size, "yy": square[j, i] - b * b / size, "xy": product[i, j] - a * b / size + spoilt}
            yield pa.RecordBatch.from_pydict({k: pa.array(v[some]) for k, v in columns.items()})
    return run


def correlation_matrix(long: DataFrame, key: str, sample: str, samples: list, value: str) -> DataFrame:
    """Pearson r and r squared of every sample pair, over ids seen in both.

    One pass over the wide rows: a batch gives the moments of all pairs as matrix products, which are then added up
    around common means.
    """
    wide = vectors(long, key, sample, samples, value, fill=None)
    found = wide.select("vector").mapInArrow(_co_moments(len(samples)), "i long, j long, n double, mx double, my double, xx double, yy double, xy double")
    pair = W.partitionBy("i", "j")
    # counted from the smallest mean, so that equal means stay exactly equal
    found = found.withColumn("low_x", F.min("mx").over(pair)).withColumn("low_y", F.min("my").over(pair))
    middle = lambda m, low: F.col(low) + F.sum(F.col("n") * (F.col(m) - F.col(low))).over(pair) / F.sum("n").over(pair)
    found = found.withColumns({"dx": F.col("mx") - middle("mx", "low_x"), "dy": F.col("my") - middle("my", "low_y")})
    n, dx, dy = F.col("n"), F.col("dx"), F.col("dy")
    sums = found.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("xx") + n * dx * dx).alias("xx"),
                                       F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"))
    r = sums.select("i", "j", F.when(F.col("n") > 1, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("r"))
    names = [F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), F.lit(a).alias("a"), F.lit(samples[j]).alias("b"))
             for i, a in enumerate(samples) for j in range(i, len(samples))]
    pairs = long.sparkSession.range(1).select(F.inline(F.array(*names)))
    return pairs.join(r, ["i", "j"], "left").select("a", "b", "r", (F.col("r") * F.col("r")).alias("r2"))


def top_percent(long: DataFrame, key: str, value: str, percentile: float) -> DataFrame:
    """Ids in the top share by row maximum: the first int((100-p)/100*n), ties by id."""
    tops = long.groupBy(key).agg(F.max(value).alias("max"))
    ranked = numbered(tops, [], [F.col("max").desc(), F.col(key)], "rn")
    n = ranked.agg(((F.lit(100 - percentile) / 100) * F.count("*")).cast("long").alias("k_"))
    return ranked.join(F.broadcast(n)).filter(F.col("rn") <= F.col("k_")).select(key, "max")


def above_nth(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows strictly above the n-th largest value (all rows when there are fewer)."""
    ranks = value_ranks(df, [], value, descending=True)
    nth = ranks.agg(F.max(F.when(F.col("n_before") + F.col("n_ties") >= n, F.col(value))).alias("nth_"))
    return df.join(F.broadcast(nth)).filter(F.col("nth_").isNull() | (F.col(value) > F.col("nth_"))).drop("nth_")


def every_kth(df: DataFrame, order: list, target: int) -> DataFrame:
    """Systematic sample of about ``target`` rows: every k-th row in order, k = ceil(n / target)."""
    rows = numbered(df, [], order, "rn")
    k = rows.agg(F.ceil(F.count("*") / target).alias("k_"))
    return rows.join(F.broadcast(k)).filter((F.col("rn") - 1) % F.col("k_") == 0).drop("rn", "k_")


def key_changes(df: DataFrame, key: str, order: list) -> DataFrame:
    """0-based positions where the sort key changes, and the end position."""
    rows = numbered(df, [], [key, *order], "rn")
    ends = rows.groupBy(key).agg((F.min("rn") - 1).alias("row_sep"))
    last = rows.agg(F.count("*").alias("row_sep"))
    return ends.select("row_sep").unionByName(last)


def renumber(df: DataFrame, key: str, by: Column | None = None, out: str = "number") -> DataFrame:
    """Dense numbers 1..n for the distinct keys, by first appearance (smallest ``by``) or by the key itself."""
    firsts = df.groupBy(key).agg(F.min(by if by is not None else F.col(key)).alias("first_"))
    numbers = numbered(firsts, [], ["first_", key], out).select(key, out)
    return df.join(numbers, key)


def feature_shares(counts: DataFrame, key: str, sample: str, value: str) -> DataFrame:
    """Share of the sample's total, then scaled per feature to mean 0 and sample sd 1."""
    totals = counts.groupBy(sample).agg(F.sum(value).alias("t_"))
    shares = counts.join(totals, sample).withColumn("share", F.col(value) / F.col("t_")).drop("t_")
    stats = shares.groupBy(key).agg(F.avg("share").alias("m_"), F.stddev_samp("share").alias("s_"))
    return shares.join(stats, key).withColumn("scaled", (F.col("share") - F.col("m_")) / F.nullif(F.col("s_"), F.lit(0.0))).drop("m_", "s_")


