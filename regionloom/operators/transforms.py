"""Row transforms and filters on long tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.functions.coords import parse_region
from regionloom.functions.text import any_of, joined_max
from regionloom.plans.scan import value_ranks


def ids_to_intervals(df: DataFrame, col: str = "id") -> DataFrame:
    """Region ids to coordinates; header lines, empty lines and other text drop out."""
    head = F.contains(F.col(col), F.lit("region")) | F.contains(F.col(col), F.lit("id"))
    parsed = df.filter(~head & (F.col(col) != "")).withColumns(parse_region(F.col(col)))
    return parsed.dropna(subset=["start", "stop"])


def drop_timepoints(long: DataFrame, labels: list[str]) -> DataFrame:
    """P15."""
    return long.filter(~F.col("timepoint").isin(labels))


def drop_samples(long: DataFrame, sample: Column, samples: list, value: str, key: str = "id") -> DataFrame:
    """Drop samples, then ids that are zero everywhere."""
    kept = long.filter(~sample.isin(samples))
    live = kept.groupBy(key).agg(F.max(F.abs(F.col(value))).alias("m_")).filter("m_ > 0")
    return kept.join(live, key, "left_semi")


def one_replicate(long: DataFrame, rep: str) -> DataFrame:
    """P17."""
    return long.filter(F.col("rep") == rep)


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "id", opposite: bool = False) -> DataFrame:
    """P18."""
    return df.join(ids.select(key).distinct(), key, "left_anti" if opposite else "left_semi")


def row_ranges(long: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """Max, min and their difference per id."""
    return long.groupBy(key).agg(F.max(value).alias("max"), F.min(value).alias("min")).withColumn(
        "max_diff", F.col("max") - F.col("min"))


def drop_constant(long: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """P20: ids whose values are all equal are dropped."""
    moving = row_ranges(long, key, value).filter("max > min")
    return long.join(moving, key, "left_semi")


def keep_moving(long: DataFrame, span: float = 1.0, key: str = "id", value: str = "value") -> DataFrame:
    """Ids whose values span more than ``span`` (one log2 unit is two-fold)."""
    moving = row_ranges(long, key, value).filter(F.col("max_diff") > span)
    return long.join(moving, key, "left_semi")


def clean_signal(long: DataFrame, threshold: float, key: list[str], value: str = "value") -> DataFrame:
    """Values below the threshold count as not seen (null); rows without any value drop out."""
    seen = F.when(F.col(value) >= threshold, F.nullif(F.col(value), F.lit(0.0)))
    marked = long.withColumn(value, seen)
    live = marked.groupBy(*key).agg(F.max(value).alias("m_")).filter("m_ > 0")
    return marked.join(live, key, "left_semi")


def log2_cpm(long: DataFrame, sample: list[str], value: str = "n") -> DataFrame:
    """log2 counts per million of the sample, never below 0."""
    totals = long.groupBy(*sample).agg(F.sum(value).alias("total_"))
    cpm = F.col(value) / F.nullif(F.col("total_"), F.lit(0)) * 1e6
    return long.join(totals, sample).withColumn(
        "log2_cpm", F.when(cpm > 1, F.log2(cpm)).otherwise(F.lit(0.0))).drop("total_")


def filter_terms(terms: DataFrame, drop: list[str], keep: list[str], drop_exact: list[str]) -> DataFrame:
    """P25: biological-process terms that hold a keep-word and none of the drop-words, each once."""
    name = F.col("term_name")
    ok = (F.col("domain") == "BP") & ~any_of(name, drop) & any_of(name, keep) & ~any_of(name, drop_exact)
    return terms.filter(ok).withColumn("neg_log10_p", -F.log10("p_value"))


def is_enriched(terms: DataFrame, group: str, drop: list[str], drop_exact: list[str]) -> DataFrame:
    """Per group, is any biological-process term left after removal."""
    left = (F.col("domain") == "BP") & ~any_of(F.col("term_name"), drop) & ~F.col("term_name").isin(drop_exact)
    return terms.groupBy(group).agg((F.count_if(left) > 0).alias("enriched"))


def synergy_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows whose joined integer list has a non-zero maximum."""
    return df.withColumn("max_value", joined_max(F.col(col))).filter("max_value <> 0")


def snps_only(variants: DataFrame) -> DataFrame:
    """One-letter alleles; of a comma list the first letter is taken, other long alleles drop."""
    first = lambda c: F.when(F.contains(F.col(c), F.lit(",")), F.substring(c, 1, 1)).otherwise(F.col(c))
    cut = variants.withColumns({"ref": first("ref"), "alt": first("alt")})
    return cut.filter((F.length("ref") == 1) & (F.length("alt") == 1))


def clean_alignments(sam: DataFrame) -> DataFrame:
    """Mapping quality 40 or more, no indel, at most one mismatch and none in the first five bases."""
    md = F.regexp_replace("md", "^MD:Z:", "")
    mismatches = F.length(F.regexp_replace(md, "[^ACGTN]", ""))
    lead = F.regexp_extract(md, r"^(\d+)", 1).try_cast("int")
    return sam.filter(
        (F.col("mapq") >= 40) & ~F.col("cigar").rlike("[ID]") & (mismatches <= 1)
        & ((mismatches == 0) | (lead >= 5))
    )


def allele_counts(pileup: DataFrame) -> DataFrame:
    """Counts of reference, alternative and other bases; indel rows and repeated positions drop."""
    clean = pileup.filter(~F.col("bases").rlike(r"[+\-<>*]"))
    once = clean.groupBy("chrom", "pos").agg(
        F.count("*").alias("n_"), *[F.max(c).alias(c) for c in ("ref", "alt", "bases")]).filter("n_ = 1")
    counts = {
        "n_ref": F.length(F.regexp_replace("bases", r"[^.,]", "")),
        "n_alt": F.length("bases") - F.length(F.replace(F.upper("bases"), F.upper("alt"), F.lit(""))),
    }
    return once.withColumns(counts).withColumn(
        "n_err", F.length("bases") - F.col("n_ref") - F.col("n_alt")).drop("n_", "bases")


def exact_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per group from counted ranks, for groups of any size."""
    ranks = value_ranks(df, group, value)
    out = []
    for name, p in shares.items():
        place = F.lit(float(p)) * (F.col("n_group") - 1)
        low = F.max(F.when(F.col("n_before") <= F.floor(place), F.col(value)))
        high = F.max(F.when(F.col("n_before") <= F.ceil(place), F.col(value)))
        frac = F.max(place - F.floor(place))
        out.append((low + (high - low) * frac).alias(name))
    return ranks.groupBy(*group).agg(*out)


def percentile_clip(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Clip to two percentiles of all values; a null stays null."""
    limits = exact_percentiles(df, [], value, {"lo_": low, "hi_": high})
    clipped = F.when(F.col(value).isNotNull(), F.greatest(F.col("lo_"), F.least(F.col("hi_"), F.col(value))))
    return df.join(F.broadcast(limits)).withColumn(value, clipped).drop("lo_", "hi_")


def fixed_clip(df: DataFrame, value: str, limit: float) -> DataFrame:
    """P35; a null stays null."""
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col(value)))))


def unit_max(df: DataFrame, row_max: Column) -> DataFrame:
    """P36 tail: row maximum relative to the largest one, mapped to one half .. one."""
    top = df.agg(F.max(row_max).alias("top_"))
    return df.join(F.broadcast(top)).withColumn("unit_max", row_max / F.col("top_") / 2 + 0.5).drop("top_")


def presence_codes(df: DataFrame) -> DataFrame:
    """Ordinal codes of the region flags."""
    # fixed values: the codes of the summary table
    marks = {"H3K27ac": 3, "H3K4me1": 2, "H3K27me3": 1}
    codes = {
        "atac_dynamic": F.when(F.col("atac_cluster") > 0, 8).when(F.col("atac_cluster") == 0, 7).otherwise(0),
        "rna_present": F.when(F.col("rna_pattern") == "dynamic", 6).when(F.col("rna_pattern") == "stable", 5)
                        .when(F.col("rna_pattern") == "nonexpr", 4).otherwise(0),
        **{f"{m}_present": F.when(F.col(m) == 9, 0).otherwise(code) for m, code in marks.items()},
    }
    return df.withColumns(codes)


def log_additive(df: DataFrame, logits: Column) -> DataFrame:
    """Observed and expected effect of a motif pair; endogenous highest, double mutant lowest, observed >= expected."""
    l0, l1, l2, l3 = (F.element_at(logits, i) for i in range(1, 5))
    out = df.withColumns({"observed": l0 - l3, "expected": l1 + l2 - 2 * l3})
    return out.filter((l0 == F.array_max(logits)) & (l3 == F.array_min(logits)) & (F.col("observed") >= F.col("expected")))


def constant_cluster(ids: DataFrame) -> DataFrame:
    """Every id in cluster 0; a header row is dropped."""
    return ids.filter(F.col("id") != "id").select(F.lit(0).alias("cluster"), "id")


def named_sets(results: DataFrame, names: list[str], fdr: float = 0.25) -> DataFrame:
    """Keep named gene sets and flag FDR below the limit."""
    return results.filter(F.col("set_name").isin(names)).withColumn("significant", (F.col("fdr") < fdr).cast("int"))


def stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key by an explicit order, as an aggregate so a hot key is combined early."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct(*[o.alias(f"o{i}_") for i, o in enumerate(order)], F.struct(*rest).alias("r_"))).alias("b_"))
    return best.select(*key, *[F.col(f"b_.r_.{c}").alias(c) for c in rest]).select(*df.columns)


