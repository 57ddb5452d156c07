"""Reporter assays: barcodes, library normalisation, rule calls (A10, A11, A60-A65, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from regionloom.operators.statistics import signed_rank, with_p_values
from regionloom.operators.transforms import exact_percentiles
from regionloom.session import checkpointed


def umi_counts(reads: DataFrame) -> DataFrame:
    """A10: distinct molecule tags per barcode.

    Deduplicating (barcode, tag) first spreads a hot barcode over many tasks.
    """
    return reads.select("barcode", "umi").distinct().groupBy("barcode").agg(F.count("umi").alias("n_umi"))


def trim_with_umi(reads: DataFrame, n: int) -> DataFrame:
    """Move the first ``n`` bases of a read to its name and cut them off."""
    return reads.withColumns({
        "name": F.concat(F.col("name"), F.lit(":"), F.substring("bases", 1, n)),
        "bases": F.expr(f"substring(bases, {n + 1})"),
    })


def demultiplex(reads: DataFrame, index: DataFrame, key: str = "read_id") -> DataFrame:
    """Sample of each read; reads without a sample keep null, so they can be counted."""
    return reads.join(index, key, "left")


DAYS = ["d0", "d3", "d6"]
COMBOS = ["0,0", "0,1", "1,0", "1,1"]


def library_normalise(counts: DataFrame, plasmid: str = "plasmid") -> DataFrame:
    """Share of the sample times the plasmid share, made a share again, times the sample's reads; log2 CPM next to it.

    ``counts``: barcode, sample, n. A barcode missing in the plasmid library gets 0.
    """
    totals = counts.groupBy("sample").agg(F.sum("n").alias("total_"))
    shares = counts.join(totals, "sample").withColumn("share_", F.col("n") / F.col("total_"))
    base = shares.filter(F.col("sample") == plasmid).select("barcode", F.col("share_").alias("p_"))
    mixed = shares.filter(F.col("sample") != plasmid).join(base, "barcode", "left").withColumn(
        "x_", F.col("share_") * F.coalesce(F.col("p_"), F.lit(0.0)))
    again = mixed.groupBy("sample").agg(F.sum("x_").alias("sum_"))
    share = F.col("x_") / F.nullif(F.col("sum_"), F.lit(0.0))
    return mixed.join(again, "sample").select(
        "barcode", "sample", (share * F.col("total_")).alias("normalised"),
        F.when(share * 1e6 > 1, F.log2(share * 1e6)).otherwise(0.0).alias("log2_signal"))


def average_signal(rows: DataFrame, threshold: float) -> DataFrame:
    """Mean over the barcodes of a replicate, then over the replicates of a day; low values count as not seen."""
    seen = rows.filter((F.col("value") >= threshold) & (F.col("value") != 0))
    per_rep = seen.groupBy("rule", "example_id", "combos", "day", "rep").agg(F.avg("value").alias("value"))
    return per_rep.groupBy("rule", "example_id", "combos", "day").agg(F.avg("value").alias("value"))


def trajectory_signal(avg: DataFrame, method: str = "d0_norm") -> DataFrame:
    """Mean-centred days, minus the rule's median on day 0.

    ``d0_norm`` takes each combo's own median, ``d0_endog_norm`` that of ``0,0`` and
    ``d0_double_mut_norm`` that of ``1,1`` for all combos.
    """
    return trajectory_signals(avg, {"value": method})


def trajectory_signals(avg: DataFrame, methods: dict[str, str]) -> DataFrame:
    """A61 by several methods, a column for each: the days are centred once and stored, only the medians differ."""
    keys = ["rule", "example_id", "combos", "day"]
    mean = F.avg("value").over(W.partitionBy(*keys[:3]))  # a row per day
    # stored once: each method's medians and the rows themselves read it
    centred = checkpointed(avg.dropna(subset=keys[:3]).withColumn("c_", F.col("value") - mean).select(*keys, "c_"))
    zero = centred.filter(F.col("day") == "d0")
    out = centred
    for name, method in methods.items():
        if method == "d0_norm":
            by, rows = ["rule", "combos"], zero
        else:
            by, rows = ["rule"], zero.filter(F.col("combos") == {"d0_endog_norm": "0,0", "d0_double_mut_norm": "1,1"}[method])
        medians = exact_percentiles(rows, by, "c_", {"d0_": 0.5})
        out = out.join(medians, by, "left").withColumn(name, F.col("c_") - F.col("d0_")).drop("d0_")
    return out.select(*keys, *methods)


def background_subtracted(avg: DataFrame, need_all: bool = False) -> DataFrame:
    """Minus the example's ``1,1`` value of the day; examples without it (or, on request, without all four combos) drop out."""
    base = avg.filter(F.col("combos") == "1,1").select("rule", "example_id", "day", F.col("value").alias("b_"))
    if need_all:
        combo = F.when(F.col("combos").isin(COMBOS), F.col("combos"))
        full = avg.groupBy("rule", "example_id").agg(F.count_distinct(combo).alias("n_")).filter("n_ = 4")
        avg = avg.join(full, ["rule", "example_id"], "left_semi")
    # an example without background has no base on any day
    return avg.join(base, ["rule", "example_id", "day"]).withColumn("value", F.col("value") - F.col("b_")).drop("b_")


def _any_significant(diffs: DataFrame, keys: list[str], rule: str, limit: float, out: str) -> DataFrame:
    """Per rule: is any of its signed-rank tests significant."""
    tested = with_p_values(signed_rank(diffs, keys, "d"), "z")
    return tested.groupBy(rule).agg(F.max((F.col("p_value") < limit).cast("int")).alias(out))


def call_rules(rows: DataFrame, rule_days: DataFrame, threshold: float = 0.5, p_max: float = 0.10) -> DataFrame:
    """Interaction call of every motif-pair rule, all rules in one grouped job.

    ``rows``: rule, example_id, combos, day, rep, value; ``rule_days``: rule and the day its
    trajectory should peak. A rule fails when the endogenous medians do not peak on that day
    (day 3 and day 6 may stand for each other) or no two days differ, when no example has a
    background, or when the endogenous mean lies below the background.
    """
    # read several times below: stored once, so the assay rows are scanned once
    avg = checkpointed(average_signal(rows, threshold))
    traj = checkpointed(trajectory_signal(avg).filter(F.col("value").isNotNull()))
    endog = traj.filter(F.col("combos") == "0,0")
    medians = checkpointed(exact_percentiles(endog, ["rule", "day"], "value", {"median": 0.5}))
    wide = medians.groupBy("rule").agg(*[F.max(F.when(F.col("day") == d, F.col("median"))).alias(f"traj_{d}") for d in DAYS])
    others = medians.select("rule", F.col("day").alias("other"), "median")
    day_diffs = endog.join(others, "rule").filter("day <> other").select("rule", "day", "other", (F.col("value") - F.col("median")).alias("d"))
    days_differ = _any_significant(day_diffs, ["rule", "day", "other"], "rule", 0.05, "days_differ")
    null_diffs = traj.filter((F.col("combos") == "1,1") & F.col("day").isin("d3", "d6")).join(medians, ["rule", "day"]).select(
        "rule", "day", (F.col("value") - F.col("median")).alias("d"))
    null_differs = _any_significant(null_diffs, ["rule", "day"], "rule", 0.05, "traj_sig")

    peak = F.greatest(*[F.col(f"traj_{d}") for d in DAYS])
    at = lambda d: F.col(f"traj_{d}") == peak
    swap = F.when(F.col("day") == "d3", at("d6")).when(F.col("day") == "d6", at("d3")).otherwise(F.lit(False))
    direct = F.when(F.col("day") == "d0", at("d0")).when(F.col("day") == "d3", at("d3")).otherwise(at("d6"))
    rules = rule_days.join(wide, "rule").join(days_differ, "rule", "left").join(null_differs, "rule", "left").fillna(0, ["days_differ", "traj_sig"])
    rules = rules.withColumns({
        "pattern": F.coalesce(direct | swap, F.lit(False)),
        "day_used": F.when(F.coalesce(direct, F.lit(False)), F.col("day")).when(
            F.coalesce(swap, F.lit(False)), F.when(F.col("day") == "d3", "d6").otherwise("d3")).otherwise(F.col("day")),
    })

    mut = checkpointed(background_subtracted(avg))
    used = mut.join(rules.select("rule", F.col("day_used").alias("day")), ["rule", "day"])
    pick = lambda c: F.max(F.when(F.col("combos") == c, F.col("value")))
    pivot = checkpointed(used.groupBy("rule", "example_id").agg(pick("0,0").alias("actual"), (pick("0,1") + pick("1,0")).alias("expected")))
    means = pivot.groupBy("rule").agg(
        F.avg("actual").alias("actual"), F.avg("expected").alias("expected"), F.avg(F.col("actual") - F.col("expected")).alias("diff"))
    gaps = pivot.join(means.select("rule", F.col("expected").alias("e_")), "rule").filter(F.col("actual").isNotNull()).select(
        "rule", (F.col("actual") - F.col("e_")).alias("d"))
    tested = with_p_values(signed_rank(gaps, ["rule"], "d"), "z").select("rule", "p_value")
    lean = gaps.groupBy("rule").agg(F.avg("d").alias("lean_"))
    tested_rules = mut.select("rule").distinct().withColumn("can_test", F.lit(True))

    out = rules.join(tested_rules, "rule", "left").join(means, "rule", "left").join(tested, "rule", "left").join(lean, "rule", "left")
    significant = F.col("p_value") < p_max
    call = (
        F.when(~(F.col("pattern") & (F.col("days_differ") == 1)), "FAILED.TRAJ_PATTERN")
        .when(F.col("can_test").isNull(), "FAILED.CANT_TEST")
        .when(F.coalesce(F.col("actual") < 0, F.lit(True)), "FAILED.NEGATIVE_ENDOG")
        .when(significant & (F.col("lean_") > 0), "SYNERGY").when(significant & (F.col("lean_") < 0), "BUFFER").otherwise("ADDITIVE")
    )
    failed = F.contains("interaction", F.lit("FAILED"))
    zero = lambda c: F.when(failed, 0.0).otherwise(F.col(c))
    return out.withColumn("interaction", call).withColumns({
        **{c: zero(c) for c in ("actual", "expected", "diff")},
        "traj_sig": F.when(failed, 0).otherwise(F.col("traj_sig")), "p_value": F.when(failed, 1.0).otherwise(F.col("p_value")),
        "max_diff": F.greatest(*[F.abs(f"traj_{d}") for d in DAYS]),
    }).select("rule", "day", "day_used", "interaction", "actual", "expected", "diff", "p_value", "traj_sig",
              *[f"traj_{d}" for d in DAYS], "max_diff").orderBy("interaction", "max_diff")


def example_check(rows: DataFrame, early: DataFrame, n_reps: int = 4) -> DataFrame:
    """Does an example peak early (day 0) or late as its rule says; every replicate must have seen it.

    Rows are barcodes by replicate and day; a barcode without any signal in a replicate is left
    out there, and its missing days count 0.
    """
    barcodes = rows.groupBy("rule", "example_id", "rep", "barcode").agg(
        *[F.coalesce(F.max(F.when(F.col("day") == d, F.col("value"))), F.lit(0.0)).alias(d) for d in DAYS])
    seen = barcodes.filter(F.col("d0") + F.col("d3") + F.col("d6") != 0)
    per_rep = seen.groupBy("rule", "example_id", "rep").agg(*[F.avg(d).alias(d) for d in DAYS])
    per = per_rep.groupBy("rule", "example_id").agg(F.count("*").alias("n_reps"), *[F.avg(d).alias(d) for d in DAYS])
    first_max = F.array_position(F.array(*DAYS), F.greatest(*DAYS))
    flagged = per.join(early.select("rule", F.lit(True).alias("early_")), "rule", "left")
    ok = F.when(F.col("early_"), first_max == 1).otherwise(first_max != 1) & (F.col("n_reps") == n_reps)
    return flagged.select("rule", "example_id", "n_reps", ok.alias("passed"))


def assay_vs_signal(rows: DataFrame, signal: DataFrame) -> DataFrame:
    """Per construct and day the median over replicates, then per example the medians of assay and signal.

    ``rows``: construct, example, day, value (zeros count); ``signal``: construct, day, signal.
    """
    per = exact_percentiles(rows, ["construct", "example", "day"], "value", {"assay": 0.5}).join(signal, ["construct", "day"])
    a = exact_percentiles(per, ["example", "day"], "assay", {"assay": 0.5})
    return a.join(exact_percentiles(per, ["example", "day"], "signal", {"signal": 0.5}), ["example", "day"])


def summed_signals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two signals side by side, gaps 0, and their sum."""
    both = a.withColumnRenamed("signal", "signal_a").join(b.select("example", "day", F.col("signal").alias("signal_b")), ["example", "day"], "full")
    return both.fillna(0.0, ["assay", "signal_a", "signal_b"]).withColumn("signal", F.col("signal_a") + F.col("signal_b"))


def construct_correlation(rows: DataFrame) -> DataFrame:
    """Correlation over constructs of the mean assay and mean signal, per day."""
    means = rows.groupBy("construct", "day").agg(F.avg("value").alias("assay"), F.avg("signal").alias("signal"))
    return means.groupBy("day").agg(F.corr("assay", "signal").alias("r"), F.count("*").alias("n"))


def library_quality(rows: DataFrame) -> DataFrame:
    """Barcodes seen per sequence and reads per sample, with the count a uniform library would give.

    ``rows``: sample, sequence, barcode, n.
    """
    per_sample = rows.groupBy("sample").agg(F.sum("n").alias("reads"), F.count_distinct("sequence").alias("sequences"))
    barcodes = rows.filter("n > 0").groupBy("sample", "sequence").agg(F.count_distinct("barcode").alias("barcodes"))
    spread = barcodes.groupBy("sample").agg(F.avg("barcodes").alias("mean_barcodes"), F.max("barcodes").alias("max_barcodes"))
    return per_sample.join(spread, "sample").withColumn("uniform_reads", F.col("reads") / F.col("sequences"))


def sequence_presence(rows: DataFrame) -> DataFrame:
    """Distinct barcodes and samples that each sequence is present in, over all samples; absent ones count zero.

    ``rows``: sample, sequence, barcode, n.
    """
    seen = F.col("n") > 0
    return rows.groupBy("sequence").agg(F.count_distinct(F.when(seen, F.col("barcode"))).alias("barcodes"), F.count_distinct(F.when(seen, F.col("sample"))).alias("samples"))


def category_means(rows: DataFrame, category: str) -> DataFrame:
    """Mean signal per category (genomic, shuffled, ...) and day."""
    return rows.groupBy(category, "day").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
