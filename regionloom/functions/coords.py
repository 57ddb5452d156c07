"""Coordinate expressions on half-open (chrom, start, stop) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


REGION_PATTERN = r"^([^:\s]+):(\d+)-(\d+)"


def region_id(chrom="chrom", start="start", stop="stop") -> Column:
    """``chrom:start-stop``."""
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(stop).cast("string"))


def parse_region(c: Column) -> dict[str, Column]:
    """chrom, start and stop columns of a region id; anything after the stop is ignored."""
    return {
        "chrom": F.regexp_extract(c, REGION_PATTERN, 1),
        "start": F.regexp_extract(c, REGION_PATTERN, 2).try_cast("long"),
        "stop": F.regexp_extract(c, REGION_PATTERN, 3).try_cast("long"),
    }


def cut_site(df: DataFrame) -> DataFrame:
    """One base at the cut end: first base on ``+``, last base on ``-``, other strands unchanged."""
    s = F.col("strand")
    return df.withColumns({
        "start": F.when(s == "-", F.col("stop") - 1).otherwise(F.col("start")),
        "stop": F.when(s == "+", F.col("start") + 1).otherwise(F.col("stop")),
    })


def fragment_midpoint(df: DataFrame) -> DataFrame:
    """One base at the middle of a read pair, measured from the upstream mate.

    Pairs without a strand keep the first mate's coordinates.
    """
    plus = F.col("start1") + ((F.col("stop2") - F.col("start1")) / 2).cast("long")
    minus = F.col("start2") + ((F.col("stop1") - F.col("start2")) / 2).cast("long")
    mid = F.when(F.col("strand1") == "+", plus).when(F.col("strand1") == "-", minus)
    return df.select(
        F.col("chrom1").alias("chrom"),
        F.coalesce(mid, F.col("start1")).alias("start"), F.coalesce(mid + 1, F.col("stop1")).alias("stop"),
        F.col("strand1").alias("strand"),
    )


def slop(df: DataFrame, sizes: DataFrame, left: int, right: int | None = None, stranded: bool = False) -> DataFrame:
    """Grow (or shrink, with negative numbers) intervals, clamped to the chromosome.

    ``sizes`` has one row per chromosome, which is checked before it is broadcast, so a long
    chromosome never becomes one join partition. Intervals that a negative slop empties are
    dropped.
    """
    right = left if right is None else right
    lo, hi = F.lit(left), F.lit(right)
    if stranded:
        minus = F.col("strand") == "-"
        lo, hi = F.when(minus, hi).otherwise(lo), F.when(minus, lo).otherwise(hi)
    cols = df.columns
    return (
        df.join(sizes.select("chrom", F.col("size").alias("size_")), "chrom", "left")
        .withColumns({
            "start": F.greatest(F.lit(0).cast("long"), F.col("start") - lo),
            # least() passes over a null: a chromosome without a size has no right end
            "stop": F.least(F.col("size_"), F.col("stop") + hi),
        })
        .filter(F.col("start") < F.col("stop"))
        .select(*cols)
    )


def midpoint() -> Column:
    return F.col("start") + F.floor((F.col("stop") - F.col("start")) / 2).cast("long")


def midpoint_extend(df: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """Midpoint of each interval, extended ``n`` bases both ways."""
    mid = midpoint()
    return slop(df.withColumns({"start": mid, "stop": mid}), sizes, n)


def tss_point(df: DataFrame) -> DataFrame:
    """Transcript start of a gene row with 1-based ``start``/``stop``: ``[s-2, s-1)`` on ``+``, else ``[e, e+1)``."""
    plus = F.col("strand") == "+"
    return df.withColumns({
        "start": F.when(plus, F.col("start") - 2).otherwise(F.col("stop")),
        "stop": F.when(plus, F.col("start") - 1).otherwise(F.col("stop") + 1),
        "gene_id": strip_version(F.col("gene_id")),
    })


def strip_version(c: Column) -> Column:
    """``ENSG0001.7`` to ``ENSG0001``."""
    return F.split_part(c, F.lit("."), F.lit(1))


def distance_decay(d: Column, half_life: float = 25000.0) -> Column:
    """``exp(-d ln2 / half_life)``: 1 at distance 0, one half at ``half_life``."""
    return F.exp(-d * F.lit(0.6931471805599453 / half_life))


def repair_link(df: DataFrame, strict: bool = False) -> DataFrame:
    """Fix text link coordinates: swap reversed ends, drop rows with non-numeric starts or a foreign chromosome.

    In strict mode a foreign chromosome raises an error instead.
    """
    named = F.col("chrom").startswith("chr") & F.col("dst_chrom").startswith("chr")
    if strict:
        df = df.withColumn("chrom", F.when(named, F.col("chrom")).otherwise(F.raise_error(F.lit("not a chromosome"))))
    ends = {c: F.col(c).try_cast("long") for c in ("src_start", "src_stop", "dst_start", "dst_stop")}
    whole = df.filter(named).withColumns(ends).dropna(subset=list(ends))
    return whole.withColumns({
        "src_start": F.least("src_start", "src_stop"), "src_stop": F.greatest("src_start", "src_stop"),
        "dst_start": F.least("dst_start", "dst_stop"), "dst_stop": F.greatest("dst_start", "dst_stop"),
    })
