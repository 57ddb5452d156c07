"""Range joins, interval merging and neighbour search on (chrom, start, stop) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.plans.scan import Running, carried, carried_all
from regionloom.plans.small import small_grid

KEY = ["chrom", "start", "stop"]
BIN_WIDTH = 1024
LEVEL_FACTOR = 8
LEVELS = 9  # the widest bins of the default width hold 2**34 positions
MERGE_SHIFT = 16  # positions per carry bin, as a power of two


def _level(width: int, start: str = "start", stop: str = "stop") -> Column:
    """The first level whose bins are at least as wide as the interval is long, so that it touches two of them at most."""
    size, out = F.col(stop) - F.col(start), F.lit(LEVELS - 1)
    for level in reversed(range(LEVELS - 1)):
        out = F.when(size <= width * LEVEL_FACTOR ** level, F.lit(level)).otherwise(out)
    return out


def _levels_in_use(df: DataFrame, width: int) -> Column:
    """The levels that intervals of ``df`` have, as one array; it reads two columns."""
    return df.filter(F.col("stop") > F.col("start")).agg(F.collect_set(_level(width))).scalar()


def _slots(df: DataFrame, width: int, other: Column, indexed: bool, start: str = "start", stop: str = "stop") -> DataFrame:
    """One row per (slot_, bin_) that an interval has: at its own level, and at each higher one that ``other`` has.

    A slot is a level and which side is at home there: both or the left side (even), or only the right side (odd).
    So two intervals that are both finer than a level never meet in its wide bins.
    """
    widths = F.array(*[F.lit(width * LEVEL_FACTOR ** n).cast("long") for n in range(LEVELS)])
    df = df.filter(F.col(stop) > F.col(start)).withColumn("own_", _level(width, start, stop)).withColumn("other_", other)
    levels = F.array_append(F.filter("other_", lambda n: n > F.col("own_")), F.col("own_"))
    df = df.withColumn("level_", F.explode(levels))
    home = F.col("level_") == F.col("own_")
    if indexed:
        finer = F.exists("other_", lambda n: n < F.col("own_"))
        odd = F.when(home & finer, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        df = df.withColumn("odd_", F.explode(odd))
    else:
        df = df.withColumn("odd_", F.when(home, 0).otherwise(1))
    df = df.withColumn("slot_", F.col("level_") * 2 + F.col("odd_")).withColumn("w_", F.get(widths, F.col("level_")))
    bins = F.sequence(F.floor(F.col(start) / F.col("w_")), F.floor((F.col(stop) - 1) / F.col("w_")))
    df = df.withColumn("bin_", F.explode(bins))
    return df.drop("own_", "other_", "level_", "odd_", *(["w_"] if indexed else []))


def overlap_pairs(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH, hot_rows: int | None = None) -> DataFrame:
    """All pairs of ``a`` and ``b`` rows that share at least one base, with the shared length.

    ``b`` columns come back with the prefix ``b_``. Bins come in levels, each ``LEVEL_FACTOR`` times
    as wide as the one below. An interval has at most two rows at its own level, and two at every
    higher level at which the other side has intervals, whatever its length. Two intervals meet at
    the higher one of their levels, in an equi-join by (chrom, level, bin); a pair is kept only in
    the bin of the larger start, so it appears once without a ``distinct``. The adaptive planner
    splits a hot bin; with ``hot_rows`` set, bins with more rows than that on either side are
    salted as well.
    """
    right = b.select(*[F.col(c).alias(c if c == "chrom" else f"b_{c}") for c in b.columns])
    left = _slots(a, width, _levels_in_use(b, width), False)
    right = _slots(right, width, _levels_in_use(a, width), True, "b_start", "b_stop")
    keys = ["chrom", "slot_", "bin_"]
    if hot_rows is not None:
        left, right = _salt(left, right, keys, hot_rows)
        keys = [*keys, "salt_"]
    first = F.greatest("start", "b_start")
    pairs = left.join(right, keys).filter(
        (F.col("start") < F.col("b_stop"))
        & (F.col("b_start") < F.col("stop"))
        & (F.col("bin_") == F.floor(first / F.col("w_")))
    )
    return pairs.withColumn("overlap", F.least("stop", "b_stop") - first).drop("slot_", "bin_", "w_", "salt_")


def _salt(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Cut the rows of a hot bin into parts of about ``hot_rows`` on either side; every left part meets every right part.

    The few hot bins go to all rows, so the rows themselves are shuffled once, where they meet.
    """
    def hot(df: DataFrame, name: str) -> DataFrame:
        # at most rows / hot_rows bins can be hot, so this table stays small
        n = df.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") > hot_rows)
        return n.select(*keys, F.ceil(F.col("n_") / hot_rows).alias(name))

    one = F.lit(1).cast("long")
    parts = hot(left, "l_parts").join(hot(right, "r_parts"), keys, "full").select(
        *keys, F.coalesce("l_parts", one).alias("l_parts"), F.coalesce("r_parts", one).alias("r_parts"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        # a hash, not a random number: a recomputed task must send its rows to the same place
        place = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.coalesce(own, one))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1))
        out = df.join(F.broadcast(parts), keys, "left").withColumn("own_", place).withColumn("other_", copies)
        pair = ("own_", "other_") if own == "l_parts" else ("other_", "own_")
        return out.withColumn("salt_", F.struct(F.col(pair[0]).alias("l"), F.col(pair[1]).alias("r"))).drop("own_", "other_", "l_parts", "r_parts")

    return dealt(left, "l_parts", "r_parts"), dealt(right, "r_parts", "l_parts")


def hit_intervals(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH, by: list[str] | None = None, shift: int = MERGE_SHIFT) -> DataFrame:
    """Distinct ``a`` intervals (with their ``by`` values) that overlap ``b``, of the same ``by`` values where named.

    An interval is hit when the largest stop among the ``b`` intervals that start before its own stop lies
    beyond its start, so one running maximum answers all and no pairs are made; ``width`` changes nothing.
    """
    group = ["chrom", *(by or [])]
    full = (F.col("stop") > F.col("start")) & F.col("chrom").isNotNull()
    heads = b.filter(full).groupBy(*group, F.col("start").alias("x_")).agg(F.max("stop").alias("far_")).withColumn("kind_", F.lit(1))
    asked = a.filter(full).select(*group, "start", "stop").distinct().withColumns({"x_": F.col("stop"), "kind_": F.lit(0)})
    events = asked.unionByName(heads, allowMissingColumns=True).withColumn("bin_", F.shiftright("x_", shift))
    reach = carried(events, group, "bin_", ["x_", "kind_"], F.col("far_"), "max", "reach_")
    return reach.filter((F.col("kind_") == 0) & (F.col("reach_") > F.col("start"))).select(*KEY, *(by or []))


def overlap_semi(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Rows of ``a`` that overlap any row of ``b``, each once."""
    return a.join(hit_intervals(a, b, width), KEY, "left_semi").select(*a.columns)


def overlap_anti(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Rows of ``a`` that overlap no row of ``b``."""
    return a.join(hit_intervals(a, b, width), KEY, "left_anti").select(*a.columns)


def overlap_left(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Overlap pairs, plus the ``a`` rows without a partner (nulls, length 0).

    Pairs go straight to the result and are not shuffled again; the rows without one are found by a running
    maximum, without pairs.
    """
    pairs = overlap_pairs(a, b, width)
    alone = overlap_anti(a, b).withColumn("overlap", F.lit(0).cast("long"))
    cols = [*a.columns, *[c for c in pairs.columns if c not in a.columns]]
    return pairs.select(*cols).unionByName(alone, allowMissingColumns=True)


def overlap_counts(a: DataFrame, b: DataFrame, by: list[str] | None = None, width: int = BIN_WIDTH,
                   out: str = "n", shift: int = MERGE_SHIFT, dense: bool = False) -> DataFrame:
    """Per distinct ``a`` interval (and per ``by`` of ``b``) the number of overlapping ``b`` rows.

    Copies of a ``b`` interval are counted first, so a pile-up at one place is one weighted row. Without ``by``
    no pairs are made: the rows that start before the interval's stop, less those that stop at its start or before.
    ``dense`` does the same with ``by``, asking each interval for each of its values; for few values with many hits.
    """
    by = by or []
    if by and not dense:
        weighted = b.groupBy(*KEY, *by).agg(F.count("*").alias("w"))
        pairs = overlap_pairs(a.select(*KEY).distinct(), weighted, width)
        return pairs.groupBy(*KEY, *[F.col(f"b_{c}").alias(c) for c in by]).agg(F.sum("b_w").alias(out))
    full = (F.col("stop") > F.col("start")) & F.col("chrom").isNotNull()
    begun, ended, asks = 2, 0, 1  # at one place stops come first, then questions, then starts
    spot = lambda c, kind: b.filter(full).groupBy("chrom", *by, F.col(c).alias("x_")).agg(F.count("*").alias("w_")).withColumn("kind_", F.lit(kind))
    asked = a.select(*KEY).filter(full).distinct()
    asked = small_grid(asked, b.select(*by).distinct()) if by else asked
    asked = asked.withColumn("x_", F.explode(F.array("start", "stop"))).withColumn("kind_", F.lit(asks))
    events = asked.unionByName(spot("start", begun).unionByName(spot("stop", ended)), allowMissingColumns=True)
    of = lambda kind: F.when(F.col("kind_") == kind, F.col("w_")).otherwise(0)
    sums = carried_all(events.withColumn("bin_", F.shiftright("x_", shift)), ["chrom", *by], "bin_", ["x_", "kind_"],
                       [Running(of(begun), "sum", "begun_"), Running(of(ended), "sum", "ended_")])
    n = F.sum(F.when(F.col("x_") == F.col("stop"), F.col("begun_")).otherwise(-F.col("ended_")))
    return sums.filter(F.col("kind_") == asks).groupBy(*KEY, *by).agg(n.alias(out)).filter(F.col(out) > 0)


def merge_intervals(df: DataFrame, min_overlap: int = 0, shift: int = MERGE_SHIFT) -> DataFrame:
    """Merge intervals that touch (``min_overlap`` 0) or share at least ``min_overlap`` bases.

    Copies are folded first, so a bin holds only distinct intervals (with ``min_overlap`` 0 at
    most one per start); the running maximum of ``stop`` and the open island are carried from
    bin to bin. Every branch reads the same three columns, so the first shuffle is reused and
    the input is scanned once.
    """
    df = df.select(*KEY)
    if min_overlap == 0:
        heads = df.groupBy("chrom", "start").agg(F.max("stop").alias("stop"))
    else:
        heads = df.select(*KEY).distinct()
    heads = heads.withColumn("bin_", F.shiftright("start", shift))
    order = ["start", "stop"]
    reach = carried(heads, ["chrom"], "bin_", order, F.col("stop"), "max", "reach_", inclusive=False)
    opens = F.col("reach_").isNull() | (F.col("start") > F.col("reach_") - min_overlap)
    islands = carried(
        reach.withColumn("open_", F.when(opens, F.struct("start", "stop"))),
        ["chrom"], "bin_", order, F.col("open_"), "max", "island_",
    )
    return (
        islands.groupBy("chrom", "island_")
        .agg(F.max("stop").alias("stop"))
        .select("chrom", F.col("island_.start").alias("start"), "stop")
    )


def gaps(df: DataFrame, sizes: DataFrame, shift: int = MERGE_SHIFT) -> DataFrame:
    """Stretches of each chromosome (``sizes``: chrom, size) that no interval covers.

    A gap lies before each interval that starts beyond all stops before it, so one running
    maximum finds the gaps and nothing has to be merged. A chromosome without a size has no
    stretch after its last interval.
    """
    heads = df.groupBy("chrom", "start").agg(F.max("stop").alias("stop")).withColumn("bin_", F.shiftright("start", shift))
    reach = carried(heads, ["chrom"], "bin_", ["start"], F.col("stop"), "max", "reach_", inclusive=False)
    zero = F.lit(0).cast("long")
    inner = reach.select("chrom", F.coalesce("reach_", zero).alias("start"), F.col("start").alias("stop"))
    last = heads.groupBy("chrom").agg(F.max("stop").alias("last_"))
    tail = sizes.join(last, "chrom", "left").select("chrom", F.coalesce("last_", zero).alias("start"), F.col("size").alias("stop"))
    return inner.unionByName(tail).filter(F.col("stop") > F.col("start"))


def subtract(a: DataFrame, b: DataFrame, width: int = BIN_WIDTH) -> DataFrame:
    """Pieces of ``a`` that ``b`` leaves over: ``a`` cut with the gaps of ``b``, long as these may be."""
    ends = a.groupBy("chrom").agg(F.max("stop").alias("size"))
    pairs = overlap_pairs(a, gaps(b, ends), width)
    return pairs.select(
        *[c for c in a.columns if c not in ("start", "stop")],
        F.greatest("start", "b_start").alias("start"),
        F.least("stop", "b_stop").alias("stop"),
    ).select(*a.columns)


def _sided(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Two rows per interval: ``left`` as is, ``right`` mirrored, so one search serves both sides."""
    return df.withColumn("e_", F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.col(left).cast("long").alias(out)),
        F.struct(F.lit("right").alias("side"), (-F.col(right)).cast("long").alias(out)),
    ))).withColumns({"side": F.col("e_.side"), out: F.col(f"e_.{out}")}).drop("e_")


def _neighbours(keys: DataFrame, b: DataFrame, k: int, shift: int) -> DataFrame:
    """For each (chrom, side, p) the ``k`` largest distinct targets t <= p.

    On the left side p is the start of ``keys`` and t a stop of ``b``; on the right side both
    are negated, p being the stop and t a start. Bins bound every window.
    """
    group = ["chrom", "side"]
    asked = _sided(keys, "start", "stop", "x").select(*group, "x", F.lit(1).alias("kind_"))
    targets = _sided(b, "stop", "start", "x").select(*group, "x", F.lit(0).alias("kind_"))
    events = asked.unionByName(targets).distinct().withColumn("bin_", F.shiftright("x", shift))
    place = F.when(F.col("kind_") == 0, F.col("x"))
    near = carried(events, group, "bin_", ["x", "kind_"], place, "max", "t", inclusive=False)
    found = near.filter((F.col("kind_") == 1) & F.col("t").isNotNull()).select(*group, F.col("x").alias("p"), "t")
    if k == 1:
        return found
    # each target with the targets before it, by following the link to the previous one
    link = near.filter((F.col("kind_") == 0) & F.col("t").isNotNull()).select(*group, F.col("x").alias("t"), F.col("t").alias("prev"))
    chain = targets.select(*group, F.col("x").alias("t")).distinct().withColumn("chain", F.array("t"))
    chain = chain.withColumn("at", F.col("t"))
    for _ in range(k - 1):
        step = link.select(*group, F.col("t").alias("at"), "prev")
        chain = (
            chain.join(step, [*group, "at"], "left")
            .withColumn("chain", F.when(F.col("prev").isNotNull(), F.array_append("chain", F.col("prev"))).otherwise(F.col("chain")))
            .withColumn("at", F.col("prev")).drop("prev")
        )
    return found.join(chain.drop("at"), [*group, "t"]).select(*group, "p", F.explode("chain").alias("t"))


def side_distances(keys: DataFrame, b: DataFrame, k: int = 1, shift: int = MERGE_SHIFT) -> DataFrame:
    """Per distinct interval up to ``k`` non-overlapping target positions on each side.

    Columns: chrom, start, stop, side, t (mirrored on the right), distance. A bookended
    neighbour has distance 1.
    """
    near = _neighbours(keys, b, k, shift)
    asked = _sided(keys.select(*KEY), "start", "stop", "p")
    return asked.join(near, ["chrom", "side", "p"]).select(*KEY, "side", "t", (F.col("p") - F.col("t") + 1).alias("distance"))


def nearest_first(a: DataFrame, b: DataFrame, payload: list[str]) -> DataFrame:
    """Nearest ``b`` row for each ``a`` row (left join); ties go to the smallest (start, stop, payload).

    Overlap is distance 0. Adds ``b_start``, ``b_stop``, ``b_<payload>`` and ``distance`` (null
    when the chromosome has no target).
    """
    from regionloom.plans.ranked import first_overlap
    cols = ["start", "stop", *payload]
    keys, b = a.select(*KEY).distinct(), b.select("chrom", *cols)
    first = _sided(b, "stop", "start", "t").groupBy("chrom", "side", "t").agg(F.min(F.struct(*cols)).alias("row_"))
    beside = side_distances(keys, b).join(first, ["chrom", "side", "t"]).select(*KEY, "distance", "row_")
    # of the overlapping rows only the first one is looked for, not every pair
    hits = first_overlap(keys, b, cols).select(
        *KEY, F.lit(0).cast("long").alias("distance"), F.struct(*[F.col(f"b_{c}").alias(c) for c in cols]).alias("row_"))
    best = beside.unionByName(hits).groupBy(*KEY).agg(F.min(F.struct("distance", "row_")).alias("best_"))
    out = a.join(best, KEY, "left")
    return out.select(
        *a.columns, *[F.col(f"best_.row_.{c}").alias(f"b_{c}") for c in cols], F.col("best_.distance").alias("distance"))


def nearest_k(a: DataFrame, b: DataFrame, k: int, max_dist: int | None = None) -> DataFrame:
    """The k nearest ``b`` rows of each ``a`` interval by rank (ties kept), closer than ``max_dist``.

    Ranks are taken over counted distances, at most 2k+1 per interval, before any ``b`` row is
    joined. ``a`` is used by distinct interval; join its other columns back by chrom, start, stop.
    """
    keys = a.select(*KEY).distinct()
    sided = _sided(b, "stop", "start", "t")
    copies = sided.groupBy("chrom", "side", "t").agg(F.count("*").alias("n_"))
    beside = side_distances(keys, b, k)
    if max_dist is not None:
        beside = beside.filter(F.col("distance") < max_dist)
    beside = beside.join(copies, ["chrom", "side", "t"])
    hits = overlap_counts(keys, b, out="n_").select(
        *KEY, F.lit("hit").alias("side"), F.lit(None).cast("long").alias("t"), F.lit(0).cast("long").alias("distance"), "n_")
    before = W.partitionBy(*KEY).orderBy("distance").rangeBetween(W.unboundedPreceding, -1)
    ranked = beside.unionByName(hits, allowMissingColumns=True).withColumn("rank", F.coalesce(F.sum("n_").over(before), F.lit(0)) + 1)
    kept = ranked.filter((F.col("rank") <= k) & (F.col("side") != "hit")).drop("n_")
    rows = sided.select("chrom", "side", "t", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "chrom"])
    cols = [*KEY, *[f"b_{c}" for c in b.columns if c != "chrom"], "distance", "rank"]
    on_sides = kept.join(rows, ["chrom", "side", "t"]).select(*cols)
    # an overlap has distance 0 and so always rank 1
    inside = overlap_pairs(keys, b).withColumns({"distance": F.lit(0).cast("long"), "rank": F.lit(1).cast("long")})
    return on_sides.unionByName(inside.select(*cols))


def clamp(c: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(low), F.least(c, as_col(high)))
