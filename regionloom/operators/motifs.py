"""Motif hits and motif tables (J28, A43-A57, A82-A86, S28-S31 shapes)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from regionloom.functions.coords import parse_region
from regionloom.operators.matrix import above_nth
from regionloom.operators.transforms import exact_percentiles
from regionloom.plans.bins import merge_intervals
from regionloom.session import checkpointed


def motif_regions(hits: DataFrame, n: int = 30000) -> DataFrame:
    """Best score per region, then regions above the n-th best score, with coordinates."""
    best = hits.groupBy("region_id").agg(F.max("score").alias("score"))
    return above_nth(best, "score", n).withColumns(parse_region(F.col("region_id")))


def regions_with_all(scores: DataFrame, motifs: list[str]) -> DataFrame:
    """Regions whose example holds every motif (forward plus reverse not zero); the largest motif score of it."""
    both = scores.filter(F.col("motif").isin(motifs)).groupBy("example_id", "region_id", "motif").agg(
        F.sum(F.col("fwd") + F.col("rev")).alias("s_"))
    whole = both.groupBy("example_id", "region_id").agg(
        F.max("s_").alias("score"), F.count_if(F.col("s_") != 0).alias("n_")).filter(F.col("n_") == len(motifs))
    return whole.groupBy("region_id").agg(F.max("score").alias("score"))


def _hits(a: Column) -> Column:
    return F.filter(a, lambda x: x > 0)


def homotypic_rows(rows: DataFrame, max_dist: int) -> DataFrame:
    """Rows with a mean hit score above the 20th percentile of rows with exactly two hits and a hit near the middle."""
    h = _hits(F.col("scores"))
    pairs = rows.filter(F.size(h) == 2).select(F.explode(h).alias("x"))
    cut = exact_percentiles(pairs, [], "x", {"cut_": 0.2})
    mean = F.aggregate(h, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(h), F.lit(0))
    mid = F.floor(F.size("scores") / 2)
    window = F.slice("scores", (mid - max_dist + 1).cast("int"), F.lit(2 * max_dist))
    return rows.join(F.broadcast(cut)).filter((mean > F.col("cut_")) & F.exists(window, lambda x: x > 0)).drop("cut_")


def hit_distances(rows: DataFrame) -> DataFrame:
    """Scores and distance of hit pairs in a row: neighbours first to last, others later to earlier.

    -1 marks padding; position 0 is never a hit. A row is as short as its sequence window.
    """
    items = F.transform("scores", lambda x, i: F.struct(i.alias("pos"), F.when(x == -1, 0.0).otherwise(x).alias("score")))
    h = rows.select("row_id", F.filter(items, lambda s: (s["pos"] > 0) & (s["score"] != 0)).alias("h"))
    h = h.filter(F.size("h") > 1)
    later = F.transform("h", lambda b, j: F.transform(F.slice(F.col("h"), F.lit(1), j), lambda a, i: F.struct(
        F.when(i == j - 1, a["score"]).otherwise(b["score"]).alias("start_score"),
        F.when(i == j - 1, b["score"]).otherwise(a["score"]).alias("stop_score"),
        (b["pos"] - a["pos"]).alias("distance"))))
    return h.select("row_id", F.inline(F.flatten(later)))


def distance_histograms(a: DataFrame, b: DataFrame, least: int = 4) -> DataFrame:
    """Normalised score by distance of two hit sets beyond ``least`` bases, and their difference."""
    def one(df: DataFrame, out: str) -> DataFrame:
        sums = df.filter(F.col("distance") > least).groupBy("distance").agg(F.sum("start_score").alias("s_"))
        total = sums.agg(F.sum("s_").alias("t_"))
        return sums.join(F.broadcast(total)).select("distance", (F.col("s_") / F.col("t_")).alias(out))
    both = one(a, "share_a").join(one(b, "share_b"), "distance", "full").fillna(0.0, ["share_a", "share_b"])
    return both.withColumn("difference", F.col("share_a") - F.col("share_b"))


def hits_and_means(rows: DataFrame) -> DataFrame:
    """Number of hits and mean hit score of every row."""
    h = _hits(F.col("scores"))
    return rows.select("row_id", F.size(h).alias("n_hits"),
                       (F.aggregate(h, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(h), F.lit(0))).alias("mean_score"))


def position_means(rows: DataFrame, min_rows: int = 1000) -> DataFrame:
    """Mean score by position over all rows (n_hits null) and over rows of one hit count, where more than ``min_rows`` rows have it."""
    counted = rows.withColumn("n_hits", F.size(_hits(F.col("scores"))))
    flat = counted.select("n_hits", F.posexplode("scores").alias("pos", "x"))
    per = flat.groupBy("n_hits", "pos").agg(F.avg("x").alias("mean_score"), F.count("*").alias("n_rows")).filter(F.col("n_rows") > min_rows)
    whole = flat.groupBy("pos").agg(F.avg("x").alias("mean_score"), F.count("*").alias("n_rows")).withColumn("n_hits", F.lit(None).cast("int"))
    return per.unionByName(whole)


def spacing_distribution(rows: DataFrame, reach: int) -> DataFrame:
    """Scores around each row's best position: non-zero mean (share of the window), hit frequency and mean signal.

    The best position itself counts 0 in the shares.
    """
    anchor = F.array_position("scores", F.array_max("scores")) - 1
    flat = rows.select("signal", anchor.alias("at"), F.posexplode("scores").alias("pos", "x"))
    flat = flat.withColumn("position", (F.col("pos") - F.col("at")).cast("int")).filter(F.abs("position") <= reach)
    n = rows.agg(F.count("*").alias("n_all"))
    means = flat.groupBy("position").agg(
        F.coalesce(F.avg(F.nullif("x", F.lit(0.0))), F.lit(0.0)).alias("m_"), F.count_if(F.col("x") != 0).alias("h_"),
        F.avg(F.when(F.col("x") > 0, F.col("signal"))).alias("mean_signal"))
    means = means.withColumn("m_", F.when(F.col("position") == 0, 0.0).otherwise(F.col("m_")))
    total = means.agg(F.sum("m_").alias("t_"))
    return means.join(F.broadcast(total)).join(F.broadcast(n)).select(
        "position", (F.col("m_") / F.col("t_")).alias("share"), (F.col("h_") / F.col("n_all")).alias("frequency"), "mean_signal")


def activity_by_count(rows: DataFrame, tasks: list[str], max_count: int = 6, share: float = 0.9) -> DataFrame:
    """Median activity per motif, count 1..max and task (missing counts 0), and whether the motif passes the threshold.

    ``rows``: motif, count, one column per task; rows without positive activity are left out.
    """
    live = rows.filter((F.col("count") >= 1) & (F.col("count") <= max_count) & (F.greatest(*tasks) > 0))
    long = live.unpivot(["motif", "count"], tasks, "task", "x")
    medians = exact_percentiles(long, ["motif", "count", "task"], "x", {"median": 0.5})
    grid = rows.select("motif").distinct().withColumn("count", F.explode(F.array(*[F.lit(i) for i in range(1, max_count + 1)]))).withColumn(
        "task", F.explode(F.array(*[F.lit(t) for t in tasks])))
    full = grid.join(medians, ["motif", "count", "task"], "left").fillna(0.0, ["median"])
    cut = exact_percentiles(full, [], "median", {"cut_": share})
    keep = full.join(F.broadcast(cut)).groupBy("motif").agg(F.bool_or(F.col("median") >= F.col("cut_")).alias("keep"))
    return full.join(keep, "motif")


def dose_response(rows: DataFrame, axis: str, least: float = 1.0) -> DataFrame:
    """A52 (axis = count) and A53 (axis = distance): median gain over the sample's own background.

    ``rows``: motif, sample, ``axis`` (0 is the background), prediction. Samples whose mean gain
    is not positive drop out; motifs need a median gain of at least ``least`` somewhere.
    """
    over = F.when(F.col(axis) > 0, F.col("prediction"))
    stats = rows.filter(F.col(axis) >= 0).groupBy("motif", "sample").agg(
        F.min(F.when(F.col(axis) == 0, F.col("prediction"))).alias("b_"), F.min(over).alias("low_"), F.max(over).alias("high_"), F.avg(over).alias("mean_"))
    # a sample that never falls below its background, or never rises above it, needs no mean, which is rounded
    gains = F.when(F.col("high_") <= F.col("b_"), False).when(F.col("low_") >= F.col("b_"), True).otherwise(F.col("mean_") - F.col("b_") > 0)
    good = stats.filter(gains).select("motif", "sample", "b_")
    # a row per sample, dealt evenly: hashed by task, so that neither side is sorted
    kept = rows.filter(F.col(axis) > 0).join(good.hint("shuffle_hash"), ["motif", "sample"]).withColumn("gain", F.col("prediction") - F.col("b_"))
    medians = exact_percentiles(kept, ["motif", axis], "gain", {"median": 0.5})
    strong = medians.groupBy("motif").agg(F.max("median").alias("top_")).filter(F.col("top_") >= least)
    return medians.join(strong, "motif", "left_semi")


def multiplicity_sets(hits: DataFrame, max_count: int = 5, min_regions: int = 50) -> DataFrame:
    """A54 head: (motif, n) region sets with at least n hits, where enough regions have them.

    ``hits``: motif, chrom, start, stop, hits. A region joins every threshold it reaches.
    """
    rows = hits.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_count), F.col("hits").cast("int"))))).filter("hits >= 1")
    big = rows.groupBy("motif", "n").agg(F.count("*").alias("c_")).filter(F.col("c_") >= min_regions)
    return rows.join(F.broadcast(big), ["motif", "n"], "left_semi")  # a row per set


def nested_means(hits: DataFrame, vector: str, points: int, max_count: int = 5) -> DataFrame:
    """Mean vector of each motif's regions with at least n hits, for every n.

    Regions are added up once per motif and hit count; a region set holds the sets of all higher
    counts, so the sums run from the highest count down over at most ``max_count`` rows.
    """
    rows = hits.filter("hits >= 1").withColumn("n", F.least(F.lit(max_count), F.col("hits").cast("int")))
    one = rows.groupBy("motif", "n").agg(F.count("*").alias("c_"), *[F.sum(F.get(vector, F.lit(i))).alias(f"s{i}_") for i in range(points)])
    # a count that no region has stands for the set of the next higher one
    every = one.select("motif").distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(max_count))))
    one = every.join(one, ["motif", "n"], "left")
    down = W.partitionBy("motif").orderBy(F.col("n").desc())
    size = F.sum("c_").over(down)
    means = one.select("motif", "n", size.alias("size"), F.array(*[F.sum(f"s{i}_").over(down) / size for i in range(points)]).alias("mean_vector"))
    return means.filter("size > 0").drop("size")


def multiplicity_enrichment(hits: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, background: DataFrame,
                            sets: DataFrame, p_max: float, gene_vectors: DataFrame, points: int, r_min: float = 0.0, r_sig: float = 0.0,
                            min_score: float = 0.5, extend: int = 0, max_count: int = 5, min_regions: int = 50) -> DataFrame:
    """Largest hit count per motif whose linked genes are still enriched in some gene set.

    ``hits`` has the region's ``vector``, ``gene_vectors`` those of genes. A gene counts for (motif, n) when
    its link score is above ``min_score`` and its vector follows the mean of the regions with at least n hits (J31).
    All motifs and counts are one job.
    """
    from regionloom.operators.links import correlated_genes, linked_gene_scores
    from regionloom.operators.statistics import over_representation
    by = ["motif", "n"]
    regions = multiplicity_sets(hits.drop("vector"), max_count, min_regions)
    genes = linked_gene_scores(regions, links, tss, sizes, extend, by).filter(F.col("score") > min_score)
    kept = correlated_genes(genes, gene_vectors, nested_means(hits, "vector", points, max_count), r_min, r_sig, by=by)
    tested = over_representation(kept, background, sets, by)
    return tested.filter(F.col("p_value") < p_max).groupBy("motif").agg(F.max("n").alias("max_enriched"))


# fixed values: which orientation and side of the anchor make up each arrangement
SYNTAX_CLASSES = [
    ("BOTH_BOTH", "FWD_FWD", "."), ("BOTH_BOTH", "FWD_REV", "."), ("BOTH_BOTH", "REV_FWD", "."), ("BOTH_BOTH", "REV_REV", "."),
    ("BOTH_IN", "FWD_FWD", "-"), ("BOTH_IN", "FWD_REV", "+"), ("BOTH_IN", "REV_FWD", "-"), ("BOTH_IN", "REV_REV", "+"),
    ("BOTH_OUT", "FWD_FWD", "+"), ("BOTH_OUT", "FWD_REV", "-"), ("BOTH_OUT", "REV_FWD", "+"), ("BOTH_OUT", "REV_REV", "-"),
    ("SAME", "FWD_FWD", "."), ("SAME", "REV_REV", "."),
    ("IN", "FWD_REV", "+"), ("IN", "REV_FWD", "-"), ("OUT", "FWD_REV", "-"), ("OUT", "REV_FWD", "+"),
]


def syntax_classes(pairs: DataFrame) -> DataFrame:
    """Every motif pair in each arrangement it belongs to (``orientation``, signed ``distance``)."""
    table = pairs.sparkSession.createDataFrame(SYNTAX_CLASSES, "class string, orientation string, side string")
    side = F.when(F.col("distance") > 0, "+").when(F.col("distance") < 0, "-")
    joined = pairs.join(F.broadcast(table), "orientation")
    return joined.filter((F.col("side") == ".") | (F.col("side") == side)).drop("side")


def syntax_profile(pairs: DataFrame, scores: str, centre: int) -> DataFrame:
    """How the second motif's scores lie around the anchor in each arrangement.

    Score vectors are aligned, the anchor at index ``centre``. Their mean per position, without the anchor's own
    place, is divided by its total: class, position, active, n (examples).
    """
    rows = syntax_classes(pairs).select("class", F.posexplode(scores).alias("i_", "x_"))
    mean = rows.groupBy("class", (F.col("i_") - centre).alias("position")).agg(F.avg("x_").alias("m_"), F.count("*").alias("n"))
    mean = mean.withColumn("m_", F.when(F.col("position") == 0, 0.0).otherwise(F.col("m_")))
    total = F.sum("m_").over(W.partitionBy("class"))  # a row per position
    return mean.select("class", "position", (F.col("m_") / F.nullif(total, F.lit(0.0))).alias("active"), "n")


def syntax_enrichment(pairs: DataFrame, links: DataFrame, tss: DataFrame, sizes: DataFrame, background: DataFrame, sets: DataFrame,
                      min_rows: int, min_score: float = 0.5, extend: int = 0) -> DataFrame:
    """Gene sets over-represented among the genes linked to the regions of each arrangement, all arrangements in one job.

    ``pairs`` has the region's place. Arrangements with fewer than ``min_rows`` examples are left out.
    """
    from regionloom.operators.links import linked_gene_scores
    from regionloom.operators.statistics import over_representation
    rows = syntax_classes(pairs)
    big = rows.groupBy("class").agg(F.count("*").alias("n_")).filter(F.col("n_") >= min_rows).drop("n_")
    regions = rows.join(F.broadcast(big), "class").select("chrom", "start", "stop", "class").distinct()
    genes = linked_gene_scores(regions, links, tss, sizes, extend, ["class"]).filter(F.col("score") > min_score)
    return over_representation(genes, background, sets, ["class"])


def syntax_summary(pairs: DataFrame, min_rows: int) -> DataFrame:
    """A55 tail: examples and score distribution per arrangement, where enough examples have it."""
    rows = syntax_classes(pairs)
    size = rows.groupBy("class").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).filter(F.col("n") >= min_rows)
    return size.join(exact_percentiles(rows, ["class"], "score", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "class")


def distance_ranges(rows: DataFrame, ranges: list[tuple[int, int]], min_rows: int = 500) -> DataFrame:
    """Examples with a hit in a distance range on either side of the middle, for ranges with more than ``min_rows``."""
    mid = F.floor(F.size("scores") / 2)
    table = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in ranges])
    spread = rows.select("row_id", "scores", mid.alias("mid"), F.inline(table))
    off = lambda i: i - F.col("mid")
    near = F.transform("scores", lambda x, i: (x > 0) & (
        ((off(i) >= F.col("lo")) & (off(i) < F.col("hi"))) | ((off(i) >= -F.col("hi")) & (off(i) < -F.col("lo")))))
    hit = spread.filter(F.exists(near, lambda b: b)).select("row_id", "lo", "hi")
    big = hit.groupBy("lo", "hi").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > min_rows)
    return hit.join(big, ["lo", "hi"])


def solo_rows(rows: DataFrame, window: int, least: float = 0.9) -> DataFrame:
    """Rows whose important positions lie (nearly) all in windows around hits, with the number of hits.

    A position inside two windows counts twice, as the share is a sum over hits.
    """
    marked = F.transform("importance", lambda x: (x > 0).cast("int"))
    rows = rows.withColumn("m_", marked)
    half = window // 2
    spots = F.filter(F.transform("scores", lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    lo = lambda i: F.greatest(i - half, F.lit(0))
    inside = F.transform(spots, lambda i: total(F.slice("m_", (lo(i) + 1).cast("int"), (F.least(i + half, F.size("m_")) - lo(i)).cast("int"))))
    share = total(inside) / F.nullif(total(F.col("m_")), F.lit(0))
    return rows.select("row_id", F.size(spots).alias("n_hits"), share.alias("share")).filter(F.col("share") >= least)


def footprint_depth(profile: DataFrame, flank: tuple[int, int], bias: tuple[int, int], foot: tuple[int, int]) -> DataFrame:
    """Flank-normalised, bias-subtracted footprint: mean depth below its own maximum, per track.

    ``profile``: track, position, value. ``flank`` and ``bias`` are distance bands from the
    centre, ``foot`` the position range of the footprint.
    """
    band = lambda b: F.abs("position").between(*b)
    bg = profile.groupBy("track").agg(F.avg(F.when(band(flank), F.col("value"))).alias("bg_"))
    norm = profile.join(bg, "track").withColumn("v_", F.col("value") / F.nullif("bg_", F.lit(0.0)))
    shift = norm.groupBy("track").agg(F.avg(F.when(band(bias), F.col("v_"))).alias("bias_"))
    inside = norm.filter(F.col("position").between(*foot)).join(shift, "track").withColumn("v_", F.col("v_") - F.col("bias_"))
    return inside.groupBy("track").agg((F.avg("v_") - F.max("v_")).alias("depth"))


def motif_order(rules: DataFrame) -> DataFrame:
    """Motifs by their mean day over all rules they take part in."""
    long = rules.select(F.explode(F.array("pwm1", "pwm2")).alias("motif"), "day")
    return long.groupBy("motif").agg(F.avg("day").alias("mean_day")).orderBy("mean_day", "motif")


def adjacency(rules: DataFrame, motifs: list[str]) -> DataFrame:
    """Pair table of rule counts, one column per second motif."""
    return rules.groupBy("pwm1").pivot("pwm2", motifs).agg(F.count(F.lit(1))).fillna(0)


def distance_summary(near: DataFrame, limit: int = 100000, width: int = 50) -> DataFrame:
    """Share of regions within ``limit`` of a TSS next to the histogram of distances."""
    hist = near.groupBy((F.floor(F.col("distance") / width) * width).alias("bin")).agg(F.count("*").alias("n"))
    share = near.agg(F.avg((F.col("distance") <= limit).cast("double")).alias("share_within"))
    return hist.join(F.broadcast(share))


def rule_regions(metadata: DataFrame) -> DataFrame:
    """A85 head: active intervals of all rules' examples, merged."""
    from regionloom.functions.text import metadata_field
    return merge_intervals(metadata.select(*[c.alias(n) for n, c in parse_region(metadata_field(F.col("metadata"), "active")).items()]))


def _softmax(w: np.ndarray) -> np.ndarray:
    e = np.exp(w)
    return e / e.sum(axis=1, keepdims=True)


def _merged_ic(p: np.ndarray, q) -> np.ndarray:
    """Information per column of two merged motifs; ``q`` 0.25 stands for padding."""
    merged = _softmax(np.log2((p + q) / 0.5))
    return 2 + (merged * np.log2(merged)).sum(axis=1)


IC_MIN = 0.4  # information that makes a column strong


def _aligned(a: np.ndarray, b: np.ndarray, offset: int, ic_min: float) -> tuple[np.ndarray, np.ndarray]:
    """Pearson r and aligned width of a stack of motif pairs (n, 4, length), given as probabilities, at one offset.

    Every column has mean 1/4 and padding adds nothing to a covariance; only the columns where both motifs lie are worked out.
    """
    n, _, la = a.shape
    lb = b.shape[2]
    width = la + 2 * (lb - 1)
    start = lb - 1  # first column of the left motif
    ca, cb = a - 0.25, b - 0.25
    lo, hi = max(start, offset), min(start + la, offset + lb)
    ia, ib = slice(lo - start, hi - start), slice(lo - offset, hi - offset)
    strong = np.zeros((n, width), dtype=bool)
    strong[:, start:start + la] = _merged_ic(a, 0.25) > ic_min
    strong[:, offset:offset + lb] = _merged_ic(b, 0.25) > ic_min
    strong[:, lo:hi] = _merged_ic(a[:, :, ia], b[:, :, ib]) > ic_min
    some = strong.any(axis=1)
    first = strong.argmax(axis=1)
    # the scan for the last strong column stops before column 0
    last = width - 1 - strong[:, :0:-1].argmax(axis=1)
    last = np.where(strong[:, 1:].any(axis=1), last, width)
    cols = np.arange(width)
    mask = (cols >= first[:, None]) & (cols <= last[:, None]) & some[:, None]
    xy = ((ca[:, :, ia] * cb[:, :, ib]).sum(axis=1) * mask[:, lo:hi]).sum(axis=1)
    sx = ((ca * ca).sum(axis=1) * mask[:, start:start + la]).sum(axis=1)
    sy = ((cb * cb).sum(axis=1) * mask[:, offset:offset + lb]).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return xy / np.sqrt(sx * sy), mask.sum(axis=1).astype(float)


def _best_offsets(a: np.ndarray, b: np.ndarray, ic_min: float) -> tuple[np.ndarray, np.ndarray]:
    """Best plain and width-normalised Pearson over all offsets for a stack of motif pairs (n, 4, length)."""
    n, _, la = a.shape
    lb = b.shape[2]
    pa, pb = _softmax(a), _softmax(b)
    cor, ncor = np.full(n, -1.0), np.full(n, -1.0)
    for offset in range(la + lb - 1):
        r, w = _aligned(pa, pb, offset, ic_min)
        with np.errstate(divide="ignore", invalid="ignore"):
            cor = np.fmax(cor, r)
            ncor = np.fmax(ncor, r * (la + lb - w) / w)
    return cor, ncor


def _passing(a: np.ndarray, b: np.ndarray, ic_min: float, cor_min: float, ncor_min: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of two blocks of motifs (rows, 4, length) that may pass both thresholds.

    Where the aligned part ends is mostly known from one motif alone, by a strong column beside the other one, or from
    the outermost column that both share. Then the scores of a whole block are one matrix product; from the other
    pairs columns are taken off one by one. The scores are those of ``_best_offsets`` but for rounding.
    """
    (na, _, la), (nb, _, lb) = a.shape, b.shape
    if min(la, lb) == 1:
        return np.repeat(np.arange(na), nb), np.tile(np.arange(nb), na)
    pa, pb = _softmax(a), _softmax(b)
    ca, cb = pa - 0.25, pb - 0.25
    strong_a, strong_b = _merged_ic(pa, 0.25) > ic_min, _merged_ic(pb, 0.25) > ic_min
    upto = lambda c: np.concatenate([np.zeros((len(c), 1)), np.cumsum((c * c).sum(axis=1), axis=1)], axis=1)
    sum_a, sum_b = upto(ca), upto(cb)
    rows_a, rows_b = np.arange(na), np.arange(nb)
    cor, ncor = np.full((na, nb), -1.0), np.full((na, nb), -1.0)
    start = lb - 1

    def edge(own: np.ndarray, x: np.ndarray, other: np.ndarray, inner: int, theirs: int) -> tuple[np.ndarray, np.ndarray]:
        """First strong column of each outer motif, else the first shared one; whether each pair has none of both."""
        some = own.any(axis=1)
        weak = np.zeros((len(x), len(other)), dtype=bool)
        if not some.all():
            weak[~some] = ~(_merged_ic(x[~some][:, :, None, inner], other[:, :, theirs].T[None]) > ic_min)
        return np.where(some, own.argmax(axis=1) if own.shape[1] else 0, own.shape[1]), weak

    for offset in range(la + lb - 1):
        lo, hi = max(start, offset), min(start + la, offset + lb)
        first_a, first_b, last_a, last_b = lo - start, lo - offset, hi - start, hi - offset
        before, after = lo - min(start, offset), max(start + la, offset + lb) - hi
        # where the aligned part begins and ends, in columns of each motif
        from_a, from_b, to_a, to_b = (np.full(n, v) for n, v in ((na, first_a), (nb, first_b), (na, last_a), (nb, last_b)))
        w = np.full((na, nb), float(hi - lo))
        if start <= offset:
            at, weak = edge(strong_a[:, :before], pa, pb, first_a, first_b)
            from_a, w = at, w + (before - at)[:, None]
        else:
            at, weak = edge(strong_b[:, :before], pb, pa, first_b, first_a)
            from_b, w, weak = at, w + (before - at)[None], weak.T
        if start + la >= offset + lb:
            at, more = edge(strong_a[:, last_a:][:, ::-1], pa, pb, last_a - 1, last_b - 1)
            to_a, w = la - at, w + (after - at)[:, None]
        else:
            at, more = edge(strong_b[:, last_b:][:, ::-1], pb, pa, last_b - 1, last_a - 1)
            to_b, w, more = lb - at, w + (after - at)[None], more.T
        xy = ca[:, :, first_a:last_a].reshape(na, -1) @ cb[:, :, first_b:last_b].reshape(nb, -1).T
        sx = np.broadcast_to((sum_a[rows_a, to_a] - sum_a[rows_a, from_a])[:, None], xy.shape).copy()
        sy = np.broadcast_to((sum_b[rows_b, to_b] - sum_b[rows_b, from_b])[None], xy.shape).copy()
        odd = np.zeros((na, nb), dtype=bool)  # no strong column shared, or too little left to trust a difference: aligned one by one
        for side, out, into in ((weak, 0, 1), (more, hi - lo - 1, -1)):
            i, j = np.nonzero(side)  # shared columns are left out until one is strong
            for n in range(hi - lo):
                at_a, at_b = first_a + out + n * into, first_b + out + n * into
                xa, xb = ca[i, :, at_a], cb[j, :, at_b]
                xy[i, j] -= (xa * xb).sum(axis=1)
                sx[i, j] -= (xa * xa).sum(axis=1)
                sy[i, j] -= (xb * xb).sum(axis=1)
                w[i, j] -= 1
                if n + 1 == hi - lo:
                    break
                still = ~(_merged_ic(pa[i, :, at_a + into], pb[j, :, at_b + into]) > ic_min)
                i, j = i[still], j[still]
            odd[i, j] = True
        odd |= (sx < 1e-6 * sum_a[:, -1:]) | (sy < 1e-6 * sum_b[:, -1][None])
        i, j = np.nonzero(odd)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = xy / np.sqrt(sx * sy)
            for k in range(0, len(i), 1 << 13):
                u, v = i[k:k + (1 << 13)], j[k:k + (1 << 13)]
                r[u, v], w[u, v] = _aligned(pa[u], pb[v], offset, ic_min)
            cor = np.fmax(cor, r)
            ncor = np.fmax(ncor, r * (la + lb - w) / w)
    return np.nonzero((cor >= cor_min - 1e-7) & (ncor >= ncor_min - 1e-7))


@F.pandas_udf(T.StructType([T.StructField("cor", T.DoubleType()), T.StructField("ncor", T.DoubleType())]))
def motif_correlation(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Best-offset Pearson of two motifs, plain and normalised by the aligned width.

    Motifs are arrays of four rows of log weights. Pairs of equal lengths are computed together.
    """
    left = [np.stack(m) for m in a]
    right = [np.stack(m) for m in b]
    out = np.empty((len(left), 2))
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right)):
        shapes.setdefault((x.shape[1], y.shape[1]), []).append(i)
    for rows in shapes.values():
        for k in range(0, len(rows), 4096):
            part = rows[k:k + 4096]
            cor, ncor = _best_offsets(np.stack([left[i] for i in part]), np.stack([right[i] for i in part]), IC_MIN)
            out[part, 0], out[part, 1] = cor, ncor
    return pd.DataFrame({"cor": out[:, 0], "ncor": out[:, 1]})


def _compared(cor_min: float, ncor_min: float, block: int = 512):
    """The passing pairs of one cell: the rows of one block of motifs with each other, or of two blocks."""
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        name, stacks = cell["motif"].to_numpy(), [np.stack(m) for m in cell["weights"]]
        left = (cell["block"] == cell["p"]).to_numpy()
        right = left if left.all() else ~left
        shapes: dict[int, list[int]] = {}
        for row, m in enumerate(stacks):
            shapes.setdefault(m.shape[1], []).append(row)
        groups = {n: np.array(rows) for n, rows in shapes.items()}
        out = [pd.DataFrame({"i": name[:0], "j": name[:0], "cor": np.zeros(0), "ncor": np.zeros(0)})]
        for x, y in ((x[left[x]], y[right[y]]) for x in groups.values() for y in groups.values()):
            for xs, ys in ((x[k:k + block], y[m:m + block]) for k in range(0, len(x), block) for m in range(0, len(y), block)):
                one, two = np.stack([stacks[r] for r in xs]), np.stack([stacks[r] for r in ys])
                i, j = _passing(one, two, IC_MIN, cor_min, ncor_min)
                i, j = xs[i], ys[j]
                if right is left:
                    kept = name[i] <= name[j]
                    ways = [(i[kept], j[kept])]
                else:
                    turned = name[j] < name[i]
                    ways = [(i[~turned], j[~turned]), (j[turned], i[turned])]
                for u, v in ((u[k:k + 4096], v[k:k + 4096]) for u, v in ways for k in range(0, len(u), 4096)):
                    cor, ncor = _best_offsets(np.stack([stacks[r] for r in u]), np.stack([stacks[r] for r in v]), IC_MIN)
                    good = (cor >= cor_min) & (ncor >= ncor_min)
                    out.append(pd.DataFrame({"i": name[u[good]], "j": name[v[good]], "cor": cor[good], "ncor": ncor[good]}))
        return pd.concat(out)
    return run


def compare_motifs(motifs: DataFrame, cor_min: float = 0.6, ncor_min: float = 0.4, block_rows: int = 2000,
                   blocks: int | None = None) -> DataFrame:
    """Pairs of motifs (i, j) that pass both thresholds, mirrored.

    The comparison needs each unordered pair once. Motifs are dealt to ``blocks`` blocks, by
    default of about ``block_rows`` motifs and at least 8, and meet by pair of blocks, so a
    cell's pairs stay bounded and are spread evenly over the tasks. The pairs are not listed: a cell's scores are matrix products, and
    only pairs that pass are aligned once more, one by one.
    """
    blocks = blocks or max(8, -(-motifs.count() // block_rows))
    known = motifs.select("motif", "weights").filter("motif is not null")
    block = known.withColumn("block", F.pmod(F.xxhash64("motif"), F.lit(blocks)).cast("int"))
    every = block.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = every.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("other")
    kind = motifs.schema["motif"].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("cor", T.DoubleType()), T.StructField("ncor", T.DoubleType())])
    kept = cells.groupBy("p", "q").applyInPandas(_compared(cor_min, ncor_min), schema)
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "cor", "ncor")
    both = F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j", "cor", "ncor"), turned)).otherwise(F.array(F.struct("i", "j", "cor", "ncor")))
    return kept.select(F.inline(both))


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Group of each node in an undirected graph, named by its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so the rounds grow with the logarithm of the longest path. Rounds end with a checkpoint.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = checkpointed(both)
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("n_"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old_"), F.least("label", "n_").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("up_"))
        done = checkpointed(step.join(jump, "label", "left").select("id", "old_", F.least("label", "up_").alias("label")))
        labels = done.select("id", "label")
        if done.filter("label <> old_").limit(1).count() == 0:
            return labels


def group_members(labels: DataFrame, names: DataFrame) -> DataFrame:
    """A86 tail: one row per member: label of its group, name, and the group's size."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").join(names, "id").select("label", "name", "size")


def group_name(members: DataFrame, asked: DataFrame) -> DataFrame:
    """A86 tail: the joined, sorted member names of the groups in ``asked`` (label); one text per group."""
    chosen = members.join(asked.select("label").distinct(), "label", "left_semi")
    return chosen.groupBy("label").agg(F.concat_ws(";", F.sort_array(F.collect_list("name"))).alias("group_name"), F.count("*").alias("size"))
