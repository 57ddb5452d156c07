"""Searches, counts and choices among overlaps without pairs, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionloom.operators import links, overlap, states
from regionloom.plans.bins import hit_intervals, nearest_first, overlap_counts, overlap_left
from regionloom.plans.ranked import first_hit, first_overlap, largest_overlap

SIZES = [("chr1", 100000), ("chr2", 100000)]


def intervals(seed, n, span=4000, longest=600, extra=lambda r: ()):
    r = random.Random(seed)
    return [(f"chr{r.randint(1, 2)}", s := r.randrange(span), s + r.randint(0, longest), *extra(r)) for _ in range(n)]


def frame(spark, rows, *more):
    return spark.createDataFrame(rows, ", ".join(["chrom string, start bigint, stop bigint", *more]))


def meet(x, y):
    return x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]


def no_range_join(df):
    """The range join joins on slot_ and bin_; a search without pairs has no join on them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any("Join" in line and "slot_" in line for line in plan.splitlines())


def test_first_hit_matches_a_scan():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 200):
        start = r.integers(-50, 50, n)
        stop, low = start + r.integers(1, 9, n), r.integers(-60, 60, 300)
        high = low + r.integers(1, 6, 300)
        want = [next((i for i in range(n) if start[i] < h and stop[i] > lo), -1) for lo, h in zip(low, high)]
        assert first_hit(start, stop, low, high).tolist() == want


@pytest.mark.parametrize("width", [64, 8192])
def test_first_overlap(spark, width):
    a = intervals(1, 150)
    b = intervals(2, 150, extra=lambda r: (r.choice([None, 1, 2, 3]), r.choice("xy")))
    da, db = frame(spark, a), frame(spark, b, "code int", "kind string")
    out = first_overlap(da, db, ["-code", "start", "-stop", "kind"], width=width)
    assert no_range_join(out)
    want = set()
    for x in set(a):
        hits = [y for y in b if meet(x, y)]
        if hits:
            y = min(hits, key=lambda y: (-(y[3] or 0), y[1], -y[2], y[4]))
            want.add((*x, y[1], y[2], y[3], y[4]))
    assert {tuple(r) for r in out.select("chrom", "start", "stop", "b_start", "b_stop", "b_code", "b_kind").collect()} == want


@pytest.mark.parametrize("longest", [40, 900])
def test_largest_overlap(spark, longest):
    a, b = intervals(3, 200), intervals(4, 200, longest=longest)
    out = largest_overlap(frame(spark, a), frame(spark, b))
    shared = lambda x, y: min(x[2], y[2]) - max(x[1], y[1])
    want = {x: min((y for y in b if meet(x, y)), key=lambda y: (-shared(x, y), y[1], y[2]))[1:] for x in set(a) if any(meet(x, y) for y in b)}
    assert no_range_join(out) and {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == want
    assert no_range_join(links.most_overlapping(frame(spark, a), frame(spark, b)))


def test_counts_hits_and_repeats(spark):
    a, b = intervals(5, 200) + [(None, 1, 9)], intervals(6, 300, extra=lambda r: (r.choice([None, "u", "v"]),)) + [(None, 1, 9, "u")]
    da, db = frame(spark, a), frame(spark, b, "k string")
    n = {x: sum(meet(x, y) for y in b) for x in a if x[0]}
    counts = overlap_counts(da, db)
    assert no_range_join(counts) and {tuple(r)[:3]: r.n for r in counts.collect()} == {x: c for x, c in n.items() if c}
    dense = overlap_counts(da, db, by=["k"], dense=True)
    assert sorted(map(repr, map(tuple, dense.select("chrom", "start", "stop", "k", "n").collect()))) == sorted(
        map(repr, map(tuple, overlap_counts(da, db, by=["k"]).select("chrom", "start", "stop", "k", "n").collect())))
    hits = hit_intervals(da, db)
    assert no_range_join(hits) and {tuple(r) for r in hits.collect()} == {x for x, c in n.items() if c}
    rows = overlap.repeat_per_hit(da, db)
    assert no_range_join(rows) and rows.count() == sum(n[x] for x in a if x[0])
    left = overlap_left(da, db)
    assert left.count() == sum(max(1, n.get(x, 0)) for x in a)


def test_left_join_does_not_shuffle_its_pairs(spark):
    left = overlap_left(frame(spark, intervals(5, 20)), frame(spark, intervals(6, 20)))
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.splitlines()[0]


def test_repeats_in_parts(spark):
    rows = overlap.repeat_per_hit(frame(spark, [("chr1", 0, 10)] * 2), frame(spark, [("chr1", 5, 6)] * 9000))
    assert rows.count() == 18000


def test_nearest_first_makes_no_pairs(spark):
    assert no_range_join(nearest_first(frame(spark, intervals(7, 20)), frame(spark, intervals(8, 20)), []))


def test_profiles_and_groups(spark):
    points = [(f"chr{i % 2 + 1}", p, p + 1, f"g{i % 7}") for i, p in enumerate(range(0, 4000, 371))]
    reads = intervals(9, 800, extra=lambda r: (r.choice(["d0", "d1", "d9", None]),))
    sizes = spark.createDataFrame([("chr1", 3000), ("chr2", 100000)], "chrom string, size bigint")
    out = states.profiles(frame(spark, points, "gene_id string"), frame(spark, reads, "day string"), sizes, "day", ["d0", "d1"], 200, 4)
    assert no_range_join(out)
    end = {"chr1": 3000, "chr2": 100000}
    want = {}
    for gene in {p[3] for p in points}:
        for day in ("d0", "d1"):
            want[gene, day] = [float(sum(
                p[3] == gene and r[3] == day and r[0] == p[0] and max(0, p[1] - 200) <= r[1] < min(end[p[0]], p[1] + 200)
                and (r[1] - p[1] + 200) // 100 == i for p in points for r in reads)) for i in range(4)]
    assert {(r.gene_id, r.day): r.profile for r in out.collect()} == want


def test_fold_change_groups(spark):
    a, b = [(*x, 1.5) for x in intervals(10, 100)], intervals(11, 30, longest=40, extra=lambda r: (r.choice(["+", "-", None]),))
    out = states.fold_change_groups(frame(spark, a, "foldchange double"), frame(spark, b, "`group` string"))
    assert no_range_join(out)
    near = {(*x, y[3]) for x in a for y in b if meet(x, y)}
    far = [(*x, "distal") for x in a if not any(meet(x, y) for y in b)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [*near, *far]))


def test_spread_genes_keeps_the_best_initial_peak_only(spark):
    domains, marks = [("chr1", 0, 20000)], [("chr1", p, p + 50, p % 7) for p in range(0, 20000, 97)]
    first = [("chr1", p, p + 100, float(p % 13)) for p in range(100, 19000, 331)]
    tss = [("chr1", p, p + 1, f"g{p % 11}", "+-"[p % 2]) for p in range(5, 20000, 711)]
    sizes = spark.createDataFrame([("chr1", 20000)], "chrom string, size bigint")
    out = states.spread_genes(frame(spark, domains), frame(spark, first, "score double"), frame(spark, marks, "code int"),
                              frame(spark, tss, "gene_id string", "strand string"), sizes, 5000, 30)
    top = min(first, key=lambda f: (-f[3], f[1], f[2]))
    want = {t[3] for t in tss if any(m[3] < 4 and m[1] - 30 < t[2] and t[1] < m[2] + 30 for m in marks)}
    rows = out.collect()
    assert {r.gene_id for r in rows} == want and {r.score for r in rows} == {top[3]}


def test_linked_gene_scores_equal_the_rows_added_up(spark):
    regions = frame(spark, intervals(12, 120, extra=lambda r: (r.choice([1, 2]),)), "k int")
    ends = [(c, s, e, s2 := s % 900 * 4, s2 + 300, float(s % 5)) for c, s, e in intervals(13, 120)]
    tie = spark.createDataFrame(ends, "chrom string, src_start bigint, src_stop bigint, dst_start bigint, dst_stop bigint, score double")
    tss = frame(spark, intervals(14, 60, longest=2, extra=lambda r: (f"g{r.randint(1, 20)}",)), "gene_id string")
    sizes = spark.createDataFrame(SIZES, "chrom string, size bigint")
    rows = links.gene_scores(links.linked_genes(regions, tie, tss, sizes, 50, ["k"]), ["k"]).select("k", "gene_id", "score")
    out = links.linked_gene_scores(regions, tie, tss, sizes, 50, ["k"])
    assert "region_id" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in rows.collect()} and rows.count() > 10


def linked_frames(spark, seed, gene):
    """Regions of all lengths with copies, links with copies and null scores, and TSS rows named by ``gene``."""
    r = random.Random(seed)
    spots = lambda n, longest: [(c, s := r.randrange(3_000_000), s + r.choice([1, 90, 600, longest])) for c in ("chr1", "chr2") for _ in range(n)]
    regions = [(*x, r.choice([1, 2, None])) for x in [*spots(300, 9000), *spots(4, 900_000)]]
    near, far = [x for x in spots(150, 70_000) for _ in range(r.choice([1, 1, 2]))], spots(700, 40_000)
    ties = [(c, s, e, f[1], f[2], r.choice([None, 0.1, 1.7, 2.3])) for (c, s, e), f in zip(near, far)]
    tss = [(c, s, s + 1, gene(i)) for i, (c, s, _) in enumerate(spots(400, 1))]
    tss += [(None, 5, 6, "g1"), ("chr1", None, None, "g2"), *tss[:5]]
    sizes = spark.createDataFrame([("chr1", 3_000_000), ("chr2", 3_000_000)], "chrom string, size bigint")
    links_ = spark.createDataFrame(ties, "chrom string, src_start bigint, src_stop bigint, dst_start bigint, dst_stop bigint, score double")
    return frame(spark, regions + regions[:9], "k int"), links_, frame(spark, tss, "gene_id string"), sizes


@pytest.mark.parametrize("gene", [lambda i: f"g{i}", lambda i: None if i % 50 == 3 else f"g{i % 600}"], ids=["single", "several"])
@pytest.mark.parametrize("by", [[], ["k"]], ids=["all", "by"])
def test_linked_gene_counts_equal_the_counted_rows(spark, gene, by):
    regions, ties, tss, sizes = linked_frames(spark, 21, gene)
    rows = links.linked_genes(regions, ties, tss, sizes, 700, by)
    want = {tuple(r[:-2]): (r["score"], r["n_regions"]) for r in links.gene_scores(rows, by).collect()}
    out = links.linked_gene_counts(regions, ties, tss, sizes, 700, by)
    got = {tuple(r[:-2]): (r["score"], r["n_regions"]) for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for k, (score, n) in want.items():
        assert got[k] == (score if score is None else pytest.approx(score), n)


@pytest.mark.parametrize("gene", [lambda i: f"g{i}", lambda i: None if i % 50 == 3 else f"g{i % 600}"], ids=["single", "several"])
def test_linked_pairs_are_each_made_once(spark, gene):
    regions, ties, tss, sizes = linked_frames(spark, 22, gene)
    want = sorted(map(repr, links.linked_genes(regions, ties, tss, sizes, 700).select("gene_id", "region_id").collect()))
    assert sorted(map(repr, links.linked_pairs(regions, ties, tss, sizes, 700).collect())) == want and len(want) > 300


def test_linked_gene_counts_make_no_pairs(spark):
    regions, ties, tss, sizes = linked_frames(spark, 23, lambda i: f"g{i}")
    plan = links.linked_gene_counts(regions, ties, tss, sizes, 700)._jdf.queryExecution().optimizedPlan().toString()
    assert "region_id" not in plan and "b_start" not in plan


def test_linked_gene_scores_count_links_in_one_array_for_all_groups(spark):
    # every link once for all values of ``by``, not once for each; copies, null groups, scores that are null, infinite or far larger than others
    regions, ties, tss, sizes = linked_frames(spark, 22, lambda i: None if i % 50 == 3 else f"g{i % 300}")
    odd = [("chr1", 10, 900, 5000 * i, 5000 * i + 4000, s) for i, s in enumerate([1e300, float("inf"), float("nan"), -2.5, None] * 9)]
    ties = ties.unionByName(spark.createDataFrame(odd, ties.schema))
    tss = tss.unionByName(frame(spark, [("chr1", s, s + 700, f"long{s % 3}") for s in range(0, 200_000, 9000)], "gene_id string"))
    out = links.linked_gene_scores(regions, ties, tss, sizes, 700, ["k"])
    rows = links.gene_scores(links.linked_genes(regions, ties, tss, sizes, 700, ["k"]), ["k"])
    want, got = ({(r.k, r.gene_id): r.score for r in x.collect()} for x in (rows, out))
    assert got.keys() == want.keys() and len(want) > 200 and None in want.values()
    assert all(got[g] is None if s is None else got[g] == pytest.approx(s, nan_ok=True, rel=1e-9) for g, s in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_" not in plan and "begun_" not in plan  # the grid of links and groups that filled the disk


def test_salted_pairs_shuffle_their_rows_once(spark):
    from regionloom.plans.bins import overlap_pairs
    a, b = frame(spark, intervals(15, 200)), frame(spark, intervals(16, 200))
    plan = overlap_pairs(a, b, hot_rows=50)._jdf.queryExecution().executedPlan().toString()
    # the hot bins are broadcast; a shuffle for them moved every row a second time
    assert not any("SortMergeJoin" in line and "LeftOuter" in line for line in plan.splitlines())


def test_a_bin_as_wide_as_a_chromosome_is_searched_in_parts(spark, monkeypatch):
    from regionloom.plans import ranked
    monkeypatch.setattr(ranked, "HOT", 20)
    a = [("chr1", 37 * i, 37 * i + 90) for i in range(150)] + [(None, 1, 5), ("chr1", None, 9)]
    b = [("chr1", 0, 5_000_000), ("chr1", 10, 5_000_000), ("chr1", 300, 4_000_000), *[("chr1", 100 * i, 100 * i + 130) for i in range(60)]]
    out = largest_overlap(frame(spark, a), frame(spark, b))
    shared = lambda x, y: min(x[2], y[2]) - max(x[1], y[1])
    want = {x: min((y for y in b if meet(x, y)), key=lambda y: (-shared(x, y), y[1], y[2]))[1:] for x in a[:150]}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == want
    first = first_overlap(frame(spark, a), frame(spark, b), ["-start", "stop"])
    want = {x: min((y for y in b if meet(x, y)), key=lambda y: (-y[1], y[2]))[1:] for x in a[:150]}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in first.collect()} == want
    # what reaches one search: no group has more rows of a side than HOT in the mean
    left, _, keys = ranked._met(frame(spark, a).distinct(), frame(spark, b), [], ranked.BIN)
    assert "salt_" in keys and max(r["count"] for r in left.groupBy(*keys).count().collect()) <= 40
