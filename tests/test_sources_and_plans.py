"""Files written and read back, and the shape of the physical plans."""

import glob
import gzip

from pyspark.sql import functions as F

from regionloom.catalog.views import Tables
from regionloom.operators import counting
from regionloom.plans.bins import KEY, merge_intervals, overlap_counts, overlap_pairs
from regionloom.sources import readers as rd, schemas as sc, writers as wr

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bed_sink_is_sorted_over_its_part_files(spark, tmp_path):
    peaks = Tables(spark, SF).peaks.select(*KEY, "name")
    path = wr.write_bed(peaks, str(tmp_path / "bed"))
    lines = []
    for part in sorted(glob.glob(f"{path}/part-*.gz")):
        lines += [l.rstrip("\n").split("\t") for l in gzip.open(part, "rt")]
    places = [(l[0], int(l[1])) for l in lines]
    assert len(places) == peaks.count() and places == sorted(places)


def test_lines_keep_their_number_over_file_splits(spark, tmp_path):
    path = tmp_path / "reads.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = rd.numbered_lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 0
        out = {r.line: r.value.split()[1] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out == {i: str(i) for i in range(3000)}


def test_fastq_quality_may_start_with_an_at_sign(spark, tmp_path):
    for mate, bases in (("1", "ACGTACGTACGTACGTTT"), ("2", "TTTTTTTTTTTTTTTTTACG")):
        (tmp_path / f"lane1_{mate}.fq").write_text("".join(f"@r{i} {mate}\n{bases}\n+\n@{'I' * (len(bases) - 1)}\n" for i in range(5)))
    one, two = (rd.read_fastq(spark, str(tmp_path / f"lane1_{m}.fq"), r"(lane\d)_") for m in "12")
    out = rd.umi_reads(one, two).orderBy("record").collect()
    assert [(r.name, r.bases) for r in out] == [(f"@r{i}:ACGTACGTACGTACG", "ACG") for i in range(5)]


def test_motif_text_round_trip(spark, tmp_path):
    motifs = spark.createDataFrame([("M1", [[0.5, 0.1], [0.25, 0.2], [0.125, 0.3], [0.125, 0.4]])], "motif string, weights array<array<double>>")
    wr.homer_lines(motifs).write.text(str(tmp_path / "homer"))
    assert rd.read_motifs(spark, str(tmp_path / "homer")).first().weights == motifs.first().weights
    assert rd.read_motifs(spark, str(tmp_path / "homer"), probabilities=True).first().weights[0][0] == 1.0
    text = wr.transfac_lines(motifs).first().value.split("\n")
    assert text[0] == "ID M1" and text[2].startswith("P0\tA") and text[3].startswith("01\t") and text[-1] == "//"


def test_interaction_names(spark):
    df = spark.createDataFrame([("chr2:5-9,0.5,G1",), ("chr2:5-9,1.5",)], "name string")
    out = df.select(*[c.alias(n) for n, c in rd.split_interaction(F.col("name")).items()]).collect()
    assert [tuple(r) for r in out] == [("chr2", 5, 9, 0.5, "G1"), ("chr2", 5, 9, 1.5, None)]


def test_motif_slices_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "tensor")
    spark.range(100).select(F.concat(F.lit("m"), F.col("id") % 5).alias("pwm"), F.lit("t0").alias("task"), F.array(F.rand(1)).alias("scores")).write.parquet(path)
    plan = final_plan(rd.motif_slices(spark, path, "m2", ["t0"]).select("scores"))
    assert "EqualTo(pwm,m2)" in plan and "PushedFilters: [IsNotNull(pwm)" in plan


def test_range_join_is_an_equi_join_on_bins(spark):
    t = Tables(spark, SF)
    plan = final_plan(overlap_pairs(t.peaks.select(*KEY), t.reads.select(*KEY)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "bin_" in plan
    # only the columns that make up the reads are read
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_merge_scans_its_input_once(spark):
    plan = final_plan(merge_intervals(Tables(spark, SF).peaks))
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan


def test_counts_fold_copies_before_the_join(spark):
    t = Tables(spark, SF)
    plan = final_plan(overlap_counts(counting.master_regions(t.peaks), t.reads))
    assert "partial_count" in plan and "CartesianProduct" not in plan


def test_schemas_are_stated():
    assert all(isinstance(v, str) for k, v in vars(sc).items() if k.isupper())
