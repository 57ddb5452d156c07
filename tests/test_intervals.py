"""Interval algebra against hand cases and brute force."""

import random
from collections import Counter

import pytest

from regionloom.functions.coords import cut_site, midpoint_extend, repair_link, slop, tss_point
from regionloom.operators import overlap, sets
from regionloom.operators.links import best_direction, canonical_pairs, most_overlapping
from regionloom.plans import bins
from regionloom.plans.bins import (
    gaps, merge_intervals, nearest_first, nearest_k, overlap_anti, overlap_counts, overlap_left, overlap_pairs,
    overlap_semi, subtract,
)
from pyspark.sql import functions as F

BED = "chrom string, start bigint, stop bigint"


def bed(spark, rows):
    return spark.createDataFrame(rows, BED)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def random_intervals(seed, n, span=30000, longest=3000):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randrange(span)
        out.append((f"chr{r.randint(1, 2)}", s, s + r.randint(1, longest)))
    return out


def brute_merge(rows, d=0):
    out = []
    for c, s, e in sorted(set(rows)):
        if out and out[-1][0] == c and s <= out[-1][2] - d:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return sorted(map(tuple, out))


HAND = [
    ("chr1", 10, 100), ("chr1", 20, 50), ("chr1", 20, 50),          # nested, identical
    ("chr1", 100, 120),                                             # touching
    ("chr1", 200, 210), ("chr1", 209, 230),                         # one base shared
    ("chr1", 1000, 1400), ("chr1", 1201, 1500), ("chr1", 1300, 1700),  # 199 and 200 bases
    ("chr2", 5, 6),
]


def test_merge_hand_cases(spark):
    assert got(merge_intervals(bed(spark, HAND))) == [
        ("chr1", 10, 120), ("chr1", 200, 230), ("chr1", 1000, 1700), ("chr2", 5, 6)]
    assert got(merge_intervals(bed(spark, HAND), min_overlap=200)) == brute_merge(HAND, 200)


@pytest.mark.parametrize("shift", [4, 10, 16])
def test_merge_matches_brute_force_for_any_bin(spark, shift):
    rows = random_intervals(shift, 150, longest=400)
    once = merge_intervals(bed(spark, rows), shift=shift)
    assert got(once) == brute_merge(rows)
    assert got(merge_intervals(once, shift=shift)) == got(once)


def test_merge_of_nothing(spark):
    assert got(merge_intervals(bed(spark, []))) == []


@pytest.mark.parametrize("width", [64, 1024])
def test_overlaps_match_brute_force(spark, width):
    a, b = random_intervals(1, 120), random_intervals(2, 120)
    want = sorted((*x, y[1], y[2], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b
                  if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    pairs = overlap_pairs(bed(spark, a), bed(spark, b), width)
    assert sorted(tuple(r) for r in pairs.select("chrom", "start", "stop", "b_start", "b_stop", "overlap").collect()) == want
    salted = overlap_pairs(bed(spark, a), bed(spark, b), width, hot_rows=2)
    assert sorted(tuple(r) for r in salted.select("chrom", "start", "stop", "b_start", "b_stop", "overlap").collect()) == want
    hit = {w[:3] for w in want}
    assert got(overlap_semi(bed(spark, a), bed(spark, b), width)) == sorted(x for x in a if x in hit)
    assert got(overlap_anti(bed(spark, a), bed(spark, b), width)) == sorted(x for x in a if x not in hit)
    assert overlap_left(bed(spark, a), bed(spark, b), width).count() == len(want) + sum(x not in hit for x in a)


def test_touching_and_empty_intervals_do_not_overlap(spark):
    a, b = bed(spark, [("chr1", 0, 10), ("chr1", 20, 20)]), bed(spark, [("chr1", 10, 20), ("chr1", 15, 30)])
    assert overlap_pairs(a, b).count() == 0


def test_pile_up_is_counted_by_weight(spark):
    reads = bed(spark, [("chr1", 100, 136)] * 500 + [("chr1", 4090, 4100)])
    n = overlap_counts(bed(spark, [("chr1", 90, 110), ("chr1", 4000, 9000)]), reads)
    assert got(n.select("start", "n")) == [(90, 500), (4000, 1)]


def test_complement_and_subtract(spark):
    sizes = spark.createDataFrame([("chr1", 2000), ("chr2", 50), ("chr3", 30)], "chrom string, size bigint")
    assert got(gaps(bed(spark, [("chr1", 0, 100), ("chr1", 500, 2000), ("chr2", 10, 20)]), sizes)) == [
        ("chr1", 100, 500), ("chr2", 0, 10), ("chr2", 20, 50), ("chr3", 0, 30)]
    a = bed(spark, [("chr1", 0, 100), ("chr1", 200, 300), ("chr2", 0, 10)])
    b = bed(spark, [("chr1", 0, 100), ("chr1", 220, 240), ("chr1", 230, 250)])
    assert got(subtract(a, b)) == [("chr1", 200, 220), ("chr1", 250, 300), ("chr2", 0, 10)]


def test_complement_twice_gives_the_merged_set(spark):
    rows = random_intervals(5, 60, longest=200)
    sizes = spark.createDataFrame([("chr1", 40000), ("chr2", 40000)], "chrom string, size bigint")
    twice = gaps(gaps(bed(spark, rows), sizes), sizes)
    assert got(twice) == brute_merge(rows)


def test_subtract_and_overlap_split_the_covered_bases(spark):
    a, b = random_intervals(7, 60, longest=300), random_intervals(8, 60, longest=300)
    bases = lambda rows: {(c, i) for c, s, e in rows for i in range(s, e)}
    left = got(sets.subtract_merged(bed(spark, a), bed(spark, b)))
    assert bases(left) == bases(a) - bases(b)


def distance(x, y):
    if x[1] < y[2] and y[1] < x[2]:
        return 0
    return x[1] - y[2] + 1 if y[2] <= x[1] else y[1] - x[2] + 1


def test_nearest_matches_brute_force(spark):
    a, b = sorted(set(random_intervals(11, 70))), sorted(set(random_intervals(12, 40, longest=50)))
    a.append(("chr9", 5, 9))  # a chromosome without targets
    out = {tuple(r)[:3]: (r.b_start, r.b_stop, r.distance) for r in nearest_first(bed(spark, a), bed(spark, b), []).collect()}
    for x in a:
        near = [(distance(x, y), y[1], y[2]) for y in b if y[0] == x[0]]
        want = (min(near)[1], min(near)[2], min(near)[0]) if near else (None, None, None)
        assert out[x] == want


@pytest.mark.parametrize("k", [1, 3])
def test_k_nearest_keeps_ties_and_the_limit(spark, k):
    a, b = sorted(set(random_intervals(21, 40))), random_intervals(22, 40, longest=30) + [("chr1", 700, 720)] * 4
    got_rows = sorted((r.chrom, r.start, r.stop, r.b_start, r.b_stop, r.distance) for r in nearest_k(bed(spark, a), bed(spark, b), k, 2000).collect())
    want = []
    for x in a:
        near = sorted((distance(x, y), y) for y in b if y[0] == x[0] and distance(x, y) < 2000)
        for d, y in near:
            if sum(e < d for e, _ in near) < k:
                want.append((*x, y[1], y[2], d))
    assert got_rows == sorted(want)


def test_signed_distance_follows_the_strand(spark):
    a = spark.createDataFrame([("chr1", 100, 101, "+"), ("chr1", 100, 101, "-"), ("chr1", 500, 501, "+")], f"{BED}, strand string")
    b = bed(spark, [("chr1", 80, 90), ("chr1", 490, 510)])
    out = {(r.start, r.strand): r.distance for r in overlap.nearest_signed(a, b, []).collect()}
    assert out == {(100, "+"): -11, (100, "-"): 11, (500, "+"): 0}


def test_most_overlapping_tie_and_miss(spark):
    out = most_overlapping(bed(spark, [("chr1", 10, 30), ("chr1", 900, 950)]), bed(spark, [("chr1", 0, 20), ("chr1", 20, 40)]))
    assert got(out) == [("chr1", 10, 30, 0, 20), ("chr1", 900, 950, 900, 950)]


def test_pairs_in_both_directions(spark):
    links = spark.createDataFrame([("a", "b", 1, 2.0), ("b", "a", 2, 5.0), ("c", "c", 3, 1.0)], "src_id string, dst_id string, pos int, score double")
    assert got(canonical_pairs(links, F.col("pos"))) == [("a", "b"), ("c", "c")]
    assert got(best_direction(links, F.col("score")).select("src_id", "dst_id")) == [("b", "a"), ("c", "c")]


def test_coordinate_expressions(spark):
    sizes = spark.createDataFrame([("chr1", 1000)], "chrom string, size bigint")
    rows = spark.createDataFrame([("chr1", 10, 20, "+"), ("chr1", 10, 20, "-"), ("chr1", 990, 999, ".")], f"{BED}, strand string")
    assert got(cut_site(rows)) == [("chr1", 10, 11, "+"), ("chr1", 19, 20, "-"), ("chr1", 990, 999, ".")]
    assert got(slop(rows, sizes, 0, 100, stranded=True)) == [("chr1", 0, 20, "-"), ("chr1", 10, 120, "+"), ("chr1", 990, 1000, ".")]
    assert got(slop(rows, sizes, -5).select("start")) == []
    assert got(midpoint_extend(bed(spark, [("chr1", 1, 4)]), sizes, 10)) == [("chr1", 0, 12)]
    genes = spark.createDataFrame([("chr1", 100, 200, "G1.3", "+"), ("chr1", 100, 200, "G2", "-")], f"{BED}, gene_id string, strand string")
    assert got(tss_point(genes)) == [("chr1", 98, 99, "G1", "+"), ("chr1", 200, 201, "G2", "-")]


def test_repair_link(spark):
    rows = spark.createDataFrame(
        [("chr1", "chr1", "20", "10", "40", "30"), ("x", "chr1", "1", "2", "3", "4"), ("chr1", "chr1", "a", "2", "3", "4")],
        "chrom string, dst_chrom string, src_start string, src_stop string, dst_start string, dst_stop string")
    assert got(repair_link(rows)) == [("chr1", "chr1", 10, 20, 30, 40)]
    with pytest.raises(Exception, match="not a chromosome"):
        repair_link(rows, strict=True).collect()


def test_small_grid_has_every_pair_once(spark):
    from regionloom.plans.small import small_grid
    a, b = spark.range(7).toDF("x"), spark.range(19).toDF("y")
    assert got(small_grid(a, b)) == sorted((x, y) for x in range(7) for y in range(19))


def test_slop_keeps_contigs_without_a_size(spark):
    from regionloom.functions.coords import slop
    rows = spark.createDataFrame([("chr1", 5, 20), ("chrUn", 5, 20), ("chr1", 90, 100)], "chrom string, start long, stop long")
    sizes = spark.createDataFrame([("chr1", 100)], "chrom string, size long")
    assert got(slop(rows, sizes, 10)) == [("chr1", 0, 30), ("chr1", 80, 100), ("chrUn", 0, 30)]


def test_running_sum_keeps_the_null_group(spark):
    from regionloom.plans.scan import running
    rows = spark.createDataFrame([("a", 1, 2), (None, 1, 3), (None, 2, 4), ("a", 2, 5)], "g string, o long, v long")
    out = running(rows, ["g"], ["o"], F.col("v"), "sum", "total")
    assert sorted((r["g"] or "", r["o"], r["total"]) for r in out.collect()) == [("", 1, 3), ("", 2, 7), ("a", 1, 2), ("a", 2, 7)]


def test_wide_intervals_take_few_rows_and_lose_no_pair(spark):
    r = random.Random(17)

    def some(n):
        out = []
        for i in range(n):
            start = r.randrange(3_000_000)
            out.append((r.choice("xy"), start, start + r.choice([0, 1, 30, 1024, 1025, 9_000, 70_000, 600_000, 3_000_000]), i))
        return out

    a, b = some(250), some(250) + [("x", 0, 2 ** 33, 900), ("y", 0, 250_000_000, 901)]
    want = {(p[3], q[3]) for p in a for q in b if p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2])}
    da, db = (spark.createDataFrame(x, "chrom string, start long, stop long, id int") for x in (a, b))
    for kw in ({}, {"width": 5000}, {"hot_rows": 20}):
        pairs = [(x.id, x.b_id) for x in overlap_pairs(da, db, **kw).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want, kw
    long = db.filter("id >= 900")
    for indexed in (False, True):
        slots = bins._slots(long, bins.BIN_WIDTH, bins._levels_in_use(da, bins.BIN_WIDTH), indexed)
        assert slots.count() <= 8
    left = {(x.id, x.b_id) for x in bins.overlap_left(da, db).collect()}
    assert left == want | {(p[3], None) for p in a if p[3] not in {i for i, _ in want}}


def test_gaps_and_subtraction_equal_a_walk_over_positions(spark):
    r = random.Random(18)
    a = [("x", s, s + r.randrange(1, 40)) for s in (r.randrange(400) for _ in range(40))] + [("z", 5, 9)]
    b = [("x", s, s + r.randrange(0, 12)) for s in (r.randrange(420) for _ in range(45))]
    covered = {p for _, s, t in b for p in range(s, t)}
    da, db = (spark.createDataFrame(x, "chrom string, start long, stop long") for x in (a, b))
    free = {p for x in bins.gaps(db, spark.createDataFrame([("x", 500)], "chrom string, size long"), shift=4).collect() for p in range(x.start, x.stop)}
    assert free == set(range(500)) - covered
    left = Counter((x.chrom, p) for x in bins.subtract(da, db).collect() for p in range(x.start, x.stop))
    assert left == Counter((c, p) for c, s, t in a for p in range(s, t) if c == "z" or p not in covered)
