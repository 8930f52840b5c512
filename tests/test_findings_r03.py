"""Steps whose work grew faster than their answer, against brute force and by their plans."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from jointspark.functions import alignment, models
from jointspark.operators import features, intervals, sites
from jointspark.plans import joint
from jointspark.plans.catalogue import QUERIES
from jointspark.sources import reference

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_latest_records_on_sites(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), s := rng.randint(-300, 300), s + rng.randint(0, 200), rng.choice([1, 2, 3, None]), rng.random() < 0.2, rng.choice([0, 10, None]), rng.randint(1, 9), k) for k in range(150)]
    df = spark.createDataFrame(rows, "contig long, start long, end long, sample long, true boolean, p int, dp long, rec_no long")
    for starts_only in (False, True):
        want = {}
        for c, pos in {(r[0], x) for r in rows if r[4] and r[0] is not None for x in ([r[1]] if starts_only else range(r[1], r[2] + 1))}:
            latest = {}
            for r in sorted((r for r in rows if r[0] == c and r[1] <= pos <= r[2]), key=lambda r: (r[1], r[7])):
                latest[r[3]] = r
            for r in latest.values():
                n, dp = want.get((c, pos, r[5]), (0, 0))
                want[(c, pos, r[5])] = (n + 1, dp + r[6])
        got = sites.counted(df, ["rec_no"], "true", ["p"], ["dp"], starts_only).collect()
        assert {(r["contig"], r["pos"], r["p"]): (r["n"], r["dp"]) for r in got} == want and len(got) == len(want)


def test_joint_call_makes_no_row_of_a_record_on_a_site(spark):
    text = plan(joint.called(joint.records(spark, DIR)))
    assert "Join" not in text and text.count("Repartition") == 1


def test_large_sites_keep_every_digit_far_from_the_peak():
    gl = np.array([[0.0, -2, -5], [-3, 0, -3], [-4, -1, 0]])
    n = np.array([9000.0, 300, 20])
    a, found = models.Counts(gl, n).around(0.02)
    assert found.max() - found[0] > 5 and len(found) < 2000
    whole = models.count_likelihoods(gl, n / 10, None)
    assert len(whole) == 1865 and np.isfinite(whole).all()


def _intervals(spark, seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 2, None]), s := rng.randint(-6000, 6000), s + rng.choice([-3, 0, 1, 5, 30, 900, 9000]), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "contig long, start long, end long, key long")


def _meet(a, b):
    return a[0] is not None and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]


def test_overlap_sums_without_pairs(spark):
    (a, left), (b, right) = _intervals(spark, 1), _intervals(spark, 2)
    want = {x[3]: (len(m), sum(m)) for x in a if (m := [y[3] for y in b if _meet(x, y)])}
    got = intervals.overlap_sums(left, right, "key").groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    assert {r["key"]: (r["n"], r["total"]) for r in got} == want


def test_rightmost_without_pairs(spark):
    (a, left), (b, right) = _intervals(spark, 3), _intervals(spark, 4)
    want = {x[3]: max(m)[1] for x in a if (m := [(y[1], y[3]) for y in b if _meet(x, y)])}
    got = features.rightmost(left, right, ["key"]).collect()
    assert {r["key"]: r["feature"]["key_r"] for r in got} == want


def test_reciprocal_pairs_of_mixed_lengths(spark):
    (a, left), (b, right) = _intervals(spark, 6), _intervals(spark, 7)
    more = [(1, s, s + n, 1000 + s) for s, n in ((0, 9), (4, 9), (5, 9), (0, 19), (0, 4), (-5, 19), (3000, 8000), (1000, 9000))]
    extra = spark.createDataFrame(more, "contig long, start long, end long, key long")
    for share in (0.5, 0.3, 1.0):
        fits = lambda x, y: (min(x[2], y[2]) - max(x[1], y[1]) + 1) >= share * max(x[2] - x[1] + 1, y[2] - y[1] + 1)  # noqa: E731, B023
        want = sorted((x[3], y[3]) for x in a + more for y in b + more if _meet(x, y) and fits(x, y))
        got = intervals.reciprocal(left.union(extra), right.union(extra), share)
        assert sorted((r["key"], r["key_r"]) for r in got.collect()) == want


def test_equal_regions_are_paired_once(spark):
    assert plan(QUERIES["q09_reciprocal_overlap_all"](spark, DIR)).count("Aggregate") >= 4


def test_bins_fit_the_intervals(spark):
    short = spark.createDataFrame([(1, k, k + 9) for k in range(100)], "contig long, start long, end long")
    assert intervals.fitting(short) == 16 and intervals.fitting(short.withColumn("end", F.col("start") + 999)) == 1024
    assert intervals.fitting(short.where("false")) == 16


def test_equal_pairs_are_aligned_once():
    alignment._align_once.cache_clear(), alignment._likelihood_once.cache_clear()
    ref, alt = pd.Series(["ACGTACGTAC"] * 500), pd.Series(["GTACG"] * 500)
    assert len(alignment.aligned.func(ref, alt).drop_duplicates()) == 1 and alignment._align_once.cache_info().misses == 1
    assert alignment.read_likelihoods.func(ref, alt, pd.Series([30.0] * 500)).nunique() == 1 and alignment._likelihood_once.cache_info().misses == 1


def test_sequences_are_cut_in_one_pass(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nacg\ntacgt\n>y\n\n>z\nAC\n")
    got = reference.fasta(spark, str(tmp_path / "a.fa"), 3)
    assert sorted(tuple(r) for r in got.collect()) == [("x", 0, "ACG"), ("x", 1, "TAC"), ("x", 2, "GT"), ("y", 0, ""), ("z", 0, "AC")]
    assert "regexp_extract_all" in plan(got)
