"""Histone marks, chromatin states, profiles and spreading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.functions.coords import midpoint, region_id, slop
from regionloom.functions.vectors import vflank_normalise
from regionloom.operators.annotate import decimal_code
from regionloom.operators.transforms import exact_percentiles
from regionloom.plans.bins import KEY, MERGE_SHIFT, hit_intervals, overlap_anti, overlap_pairs
from regionloom.plans.ranked import first_overlap
from regionloom.plans.scan import Running, carried_all, numbered
from regionloom.plans.small import small_grid
from regionloom.session import checkpointed

NO_MARK = 9  # fixed value: code of a region without the mark
MIDDLE = 4   # fixed value: code of a mark that does not change


def chosen_marks(keys: DataFrame, marks: DataFrame, mode: str, by: list[str] | None = None) -> DataFrame:
    """The code of the chosen mark (``b_code``) among those that overlap one region.

    ``width``: the smallest width difference (mark minus region), the later mark among equals.
    ``most_diff``: the code farthest from the middle, codes past 8 ignored, the first among equals.
    For one region the widths of the marks decide, so both are orders of the marks alone.
    """
    if mode == "width":
        ranked, order = marks.withColumn("by_", F.col("stop") - F.col("start")), ["by_", "-start", "-stop", "-code"]
    elif mode == "most_diff":
        far = F.abs(F.col("code") - MIDDLE)
        ranked, order = marks.withColumn("by_", -F.when(far > MIDDLE, 0).otherwise(far)), ["by_", "start", "stop", "code"]
    else:
        raise ValueError(f"unknown mode {mode}")
    return first_overlap(keys, ranked, order, by)


def nearest_mark(regions: DataFrame, marks: DataFrame, sizes: DataFrame, n: int, mode: str) -> DataFrame:
    """A14 with J04: one code per region, 9 where no mark (grown by ``n``) overlaps."""
    keys = regions.select(*KEY).distinct()
    found = chosen_marks(keys, slop(marks.select(*KEY, "code"), sizes, n), mode).select(*KEY, F.col("b_code").alias("code"))
    return keys.join(found, KEY, "left").fillna(NO_MARK, ["code"])


def histone_overlaps(regions: DataFrame, marks: DataFrame, sizes: DataFrame, names: list[str], n: int, mode: str) -> DataFrame:
    """The code of every mark for each region and their decimal code, all marks in one search.

    ``marks`` has a column ``mark``; the first name is the most significant digit.
    """
    keys = regions.select(*KEY).distinct()
    asked = keys.withColumn("mark", F.explode(F.array(*[F.lit(m) for m in names])))
    chosen = chosen_marks(asked, slop(marks.select(*KEY, "mark", "code"), sizes, n), mode, ["mark"])
    wide = chosen.groupBy(*KEY).agg(*[F.max(F.when(F.col("mark") == m, F.col("b_code"))).alias(m) for m in names])
    full = keys.join(wide, KEY, "left").fillna(NO_MARK, names)
    return full.withColumn("id", region_id()).withColumn("state", decimal_code([F.col(m) for m in reversed(names)]))


def mark_groups(regions: DataFrame, names: list[str], min_size: int = 100) -> DataFrame:
    """Members of every (cluster, mark, level) and (cluster, state) group larger than ``min_size``.

    ``regions`` has id, cluster, one column per mark and ``state``. Level 9 and the states 99
    and 999 are no groups.
    """
    marks = regions.unpivot(["id", "cluster"], names, "kind", "level").filter(F.col("level") != NO_MARK)
    states = regions.select("id", "cluster", F.lit("state").alias("kind"), F.col("state").alias("level")).filter(
        ~F.col("level").isin(99, 999))
    rows = marks.unionByName(states)
    big = rows.groupBy("cluster", "kind", "level").agg(F.count("*").alias("size")).filter(F.col("size") > min_size)
    return rows.join(big, ["cluster", "kind", "level"])


def split_by_dynamics(regions: DataFrame, min_size: int = 300) -> DataFrame:
    """Stable open regions labelled ``dynamic`` or ``stable`` by their marks.

    Dynamic regions with H3K27me3 next to both other marks, and dynamic states of at most
    ``min_size`` regions, drop out.
    """
    quiet = lambda c: F.col(c).isin(NO_MARK, MIDDLE)
    marked = regions.filter(F.col("state") != 999)
    still = quiet("h3k27ac") & quiet("h3k4me1") & quiet("h3k27me3")
    both = (F.col("h3k27me3") != NO_MARK) & (F.col("h3k27ac") != NO_MARK) & (F.col("h3k4me1") != NO_MARK)
    dynamic = marked.filter(~still & ~both)
    big = dynamic.groupBy("state").agg(F.count("*").alias("n_")).filter(F.col("n_") > min_size)
    kept = dynamic.join(big, "state", "left_semi").withColumn("kind", F.lit("dynamic"))
    return kept.unionByName(marked.filter(still).withColumn("kind", F.lit("stable")))


def set_signal(members: DataFrame, signal: DataFrame, group: list[str]) -> DataFrame:
    """Per region set, signal sums over the number of regions for each timepoint and their maximum.

    ``members``: group columns and id; ``signal``: id and one column per timepoint.
    """
    values = [c for c in signal.columns if c != "id"]
    n = members.groupBy(*group).agg(F.count_distinct("id").alias("num_regions"))
    sums = members.join(signal, "id").groupBy(*group).agg(*[F.sum(c).alias(c) for c in values])
    out = n.join(sums, group, "left").fillna(0, values)
    out = out.select(*group, "num_regions", *[(F.col(c) / F.col("num_regions")).alias(c) for c in values])
    return out.withColumn("max", F.greatest(*values))


def state_membership(regions: DataFrame, names: list[str], min_group: int = 100, min_left: int = 500) -> DataFrame:
    """Members of each chromatin state of a cluster.

    States come first. Where at least ``min_left`` regions of a cluster are left, every mark
    group that holds that many of them is used (a region can be in several). What is then left
    becomes ``Null`` when it is that many again.
    """
    groups = mark_groups(regions, names, min_group)
    label = F.concat(F.col("kind"), F.lit("-"), F.col("level").cast("string"))
    states = groups.filter("kind = 'state'").select("cluster", label.alias("group"), "id")
    left = regions.select("id", "cluster").join(states, ["cluster", "id"], "left_anti")
    enough = lambda df, keys: df.groupBy(*keys).agg(F.count("*").alias("n_")).filter(F.col("n_") >= min_left)
    left_big = left.join(enough(left, ["cluster"]), "cluster", "left_semi")
    marked = groups.filter("kind <> 'state'").select("cluster", label.alias("group"), "id").join(left_big, ["cluster", "id"], "left_semi")
    used = marked.join(enough(marked, ["cluster", "group"]), ["cluster", "group"], "left_semi").select("cluster", "group", "id")
    rest = left.join(used, ["cluster", "id"], "left_anti")
    null = rest.join(enough(rest, ["cluster"]), "cluster", "left_semi").select("cluster", F.lit("Null").alias("group"), "id")
    return states.unionByName(used).unionByName(null)


def stable_states(files: DataFrame, stable: DataFrame) -> DataFrame:
    """Members of each state of the stable regions, and those that no state before it has.

    ``files``: state and id, states taken by name; ``stable``: the stable ids. Rows: group, id, fresh.
    """
    members = files.join(stable.select("id").distinct(), "id", "left_semi").select(F.col("state").alias("group"), "id").distinct()
    first = members.groupBy("id").agg(F.min("group").alias("first_"))
    return members.join(first, "id").select("group", "id", (F.col("group") == F.col("first_")).alias("fresh"))


def state_table(dynamic: DataFrame, stable: DataFrame, total: int, sort: list[str]) -> DataFrame:
    """The stable states under the dynamic table, and the whole sorted from the largest down.

    ``dynamic`` has a cluster, which becomes one column of 0 and 1 each (``traj_1``..``traj_total``, none for stable
    rows); then the ``sort`` columns decide, the group's name last. ``position`` counts from 1.
    """
    both = dynamic.unionByName(stable.withColumn("cluster", F.lit(None).cast("long")), allowMissingColumns=True)
    flags = {f"traj_{k}": F.coalesce((F.col("cluster") == k).cast("int"), F.lit(0)) for k in range(1, total + 1)}
    flagged = both.withColumns(flags)
    order = [F.col(c).desc() for c in [*flags, *sort]]
    return numbered(flagged, [], [*order, F.col("group")], "position")


def relative_signal(ids: DataFrame, mapping: DataFrame, signal: DataFrame) -> DataFrame:
    """Signal of the mark regions mapped to a region set, relative to the first timepoint."""
    values = [c for c in signal.columns if c != "id"]
    wanted = mapping.join(ids.select(F.col("id").alias("in_id")).distinct(), "in_id", "left_semi").select(F.col("out_id").alias("id")).distinct()
    rows = signal.join(wanted, "id", "left_semi")
    return rows.select("id", *[(F.col(c) - F.col(values[0])).alias(c) for c in values])


def profiles(points: DataFrame, reads: DataFrame, sizes: DataFrame, group: str, groups: list, extend: int, bins: int) -> DataFrame:
    """Read counts in bins around each point, one array per point and group value (bins without reads 0)."""
    size = 2 * extend // bins
    windows = points.select("chrom", F.col("start"), F.col("stop"), "gene_id").withColumn("mid", midpoint())
    windows = slop(windows.withColumns({"start": F.col("mid"), "stop": F.col("mid")}), sizes, extend)
    edge = F.greatest("start", F.least(F.col("stop"), F.col("mid") - extend + F.col("i_") * size))
    edges = windows.filter(F.col("chrom").isNotNull()).withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(bins)))).select(
        "gene_id", "chrom", "i_", edge.alias("x_"))
    # reads before each edge of a bin, by one running sum per group value: no pairs of points and reads
    n = [f"n{g}_" for g in range(len(groups))]
    spots = reads.filter(F.col("chrom").isNotNull() & F.col("start").isNotNull()).groupBy("chrom", F.col("start").alias("x_")).agg(
        *[F.count_if(F.col(group) == v).alias(c) for v, c in zip(groups, n)])
    asked = edges.select("chrom", "x_").distinct().withColumn("kind_", F.lit(0))
    events = asked.unionByName(spots.withColumn("kind_", F.lit(1)), allowMissingColumns=True).withColumn("bin_", F.shiftright("x_", MERGE_SHIFT))
    sums = carried_all(events, ["chrom"], "bin_", ["x_", "kind_"], [Running(F.coalesce(c, F.lit(0)), "sum", f"{c}upto_") for c in n])
    rows = edges.join(sums.filter("kind_ = 0").select("chrom", "x_", *[f"{c}upto_" for c in n]), ["chrom", "x_"])
    within = lambda c, i: F.sum(F.when(F.col("i_") == i + 1, F.col(c)).when(F.col("i_") == i, -F.col(c)).otherwise(0)).cast("double")
    per = rows.groupBy("gene_id").agg(*[F.array(*[within(f"{c}upto_", i) for i in range(bins)]).alias(c) for c in n])
    counts = per.select("gene_id", F.inline(F.array(*[F.struct(F.lit(v).alias(group), F.col(c).alias("profile")) for v, c in zip(groups, n)])))
    grid = points.select("gene_id", F.explode(F.array(*[F.lit(g) for g in groups])).alias(group))
    empty = F.array_repeat(F.lit(0.0), bins)
    return grid.join(counts, ["gene_id", group], "left").withColumn("profile", F.coalesce("profile", empty))


def profile_summary(rows: DataFrame, group: str, flank: int) -> DataFrame:
    """Flank-normalised profiles, then median and population sd per group and bin."""
    normal = rows.withColumn("p_", vflank_normalise(F.col("profile"), flank)).select(group, F.posexplode("p_").alias("bin", "x"))
    # stored once: the median and the spread would each repeat the range join behind it
    normal = checkpointed(normal.filter(F.col("x").isNotNull()))
    medians = exact_percentiles(normal, [group, "bin"], "x", {"median": 0.5})
    spread = normal.groupBy(group, "bin").agg(F.stddev_pop("x").alias("sd"))
    return medians.join(spread, [group, "bin"])


def mean_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean profile value per assay, day and bin."""
    return rows.select(*keys, F.posexplode("profile").alias("bin", "x")).groupBy(*keys, "bin").agg(F.avg("x").alias("mean"))


def pooled_fold_change(contrasts: DataFrame) -> DataFrame:
    """Pooled log2 fold change of rising and of falling regions per contrast."""
    base, lfc = F.col("base_mean"), F.col("log2_fold_change")
    sign = F.when(lfc > 0, "up").when(lfc < 0, "down")
    return contrasts.withColumn("direction", sign).filter(F.col("direction").isNotNull()).groupBy("contrast", "direction").agg(
        F.log2(F.sum(base * F.pow(F.lit(2.0), lfc)) / F.sum(base)).alias("log2_fold_change"), F.count("*").alias("n"))


def consensus_summits(master: DataFrame, peaks: DataFrame, file: str) -> DataFrame:
    """Per region and file the summit of the strongest peak, then the mean over files as a one-base point."""
    keys = master.select(*KEY).distinct()
    pairs = overlap_pairs(keys, peaks.select(*KEY, "summit_offset", "signal_value", file))
    summit = F.col("b_start") + F.col("b_summit_offset")
    per_file = pairs.groupBy(*KEY, f"b_{file}").agg(
        F.min(F.struct(F.col("b_signal_value").isNull().alias("n"), (-F.col("b_signal_value")).alias("s"), "b_start", "b_stop", summit.alias("summit"))).getField("summit").alias("summit"))
    mean = per_file.groupBy(*KEY).agg(F.floor(F.avg("summit")).cast("long").alias("summit"))
    return mean.select(*KEY, "summit")


def best_summits(regions: DataFrame, peaks: DataFrame) -> DataFrame:
    """Summit of the peak with the best q-value in each region (first peak among equals), null without a peak."""
    keys = regions.select(*KEY).distinct()
    pairs = overlap_pairs(keys, peaks.select(*KEY, "summit_offset", "q_value"))
    best = pairs.groupBy(*KEY).agg(F.min(F.struct(
        F.col("b_q_value").isNull().alias("n"), (-F.col("b_q_value")).alias("q"), "b_start", "b_stop", (F.col("b_start") + F.col("b_summit_offset")).alias("summit"))).getField("summit").alias("summit"))
    return keys.join(best, KEY, "left")


def rich_domains(domains: DataFrame, peaks: DataFrame, least: int = 3) -> DataFrame:
    """Domains that hold at least ``least`` peaks."""
    from regionloom.plans.bins import overlap_counts
    return domains.select(*KEY).join(overlap_counts(domains, peaks), KEY).filter(F.col("n") >= least)


def _best_initial(df: DataFrame) -> DataFrame:
    """Per interval the initial peak with the best score, the first one among equals."""
    best = df.groupBy(*KEY).agg(F.min(F.struct("s_", "init_start", "init_stop")).alias("b_"))
    return best.select(*KEY, "b_.s_", "b_.init_start", "b_.init_stop")


def spread_genes(domains: DataFrame, initial: DataFrame, receiving: DataFrame, tss: DataFrame, sizes: DataFrame,
                 threshold: int, spread_bp: int, increase: bool = True) -> DataFrame:
    """Genes next to marks that moved in a domain larger than its first-day peak.

    Keeps domain and initial peak pairs whose domain reaches more than ``threshold`` bases past
    the peak, receiving regions that change in the wanted direction (code below or above the
    middle) and TSS within ``spread_bp`` of them. One row per gene, by the best initial score;
    the distance to the initial midpoint is positive upstream, and rows come ordered by it.
    """
    pairs = overlap_pairs(domains.select(*KEY), initial.select(*KEY, "score"))
    grown = (F.col("b_start") - F.col("start")) + (F.col("stop") - F.col("b_stop"))
    spread = pairs.filter(grown > threshold).select(
        *KEY, F.col("b_start").alias("init_start"), F.col("b_stop").alias("init_stop"), F.col("b_score").alias("score"))
    moves = (F.col("b_code") < MIDDLE) if increase else ((F.col("b_code") > MIDDLE) & (F.col("b_code") < NO_MARK))
    # of a domain's initial peaks only the best one can be any gene's; the same holds for a receiving region
    spread = _best_initial(spread.withColumn("s_", -F.col("score")))
    got = overlap_pairs(spread, receiving.select(*KEY, "code")).filter(moves)
    got = _best_initial(got.select("chrom", F.col("b_start").alias("start"), F.col("b_stop").alias("stop"), "s_", "init_start", "init_stop"))
    near = first_overlap(tss, slop(got, sizes, spread_bp), ["s_", "init_start", "init_stop"])
    hits = tss.select(*KEY, "gene_id", "strand").join(near, KEY)
    mid = F.col("b_init_start") + F.floor((F.col("b_init_stop") - F.col("b_init_start")) / 2)
    away = F.when(F.col("strand") == "-", mid - F.col("start")).otherwise(F.col("start") - mid)
    best = hits.groupBy("gene_id").agg(F.min(F.struct(
        F.col("b_s_").alias("s"), "b_init_start", "b_init_stop", "chrom", "start", "strand", away.alias("init_to_tss"))).alias("b_"))
    return best.select("gene_id", "b_.chrom", "b_.start", "b_.strand", (-F.col("b_.s")).alias("score"), "b_.init_to_tss").orderBy("init_to_tss", "gene_id")


def flag_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """Number of regions for each combination of flags, then one row per flag of it."""
    counts = df.groupBy(*flags).agg(F.count("*").alias("count"))
    items = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("fill")) for f in flags])
    return counts.select(F.inline(items), "count")


def fold_change_groups(regions: DataFrame, tss_groups: DataFrame) -> DataFrame:
    """Fold change of regions by the TSS group they overlap; the rest is ``distal``.

    ``regions`` carries ``foldchange``, ``tss_groups`` a column ``group``.
    """
    keys = small_grid(regions.select(*KEY).distinct(), tss_groups.select("group").distinct())
    near = regions.join(hit_intervals(keys, tss_groups, by=["group"]), KEY).select(*regions.columns, "group").distinct()
    return near.unionByName(overlap_anti(regions, tss_groups).withColumn("group", F.lit("distal")))


