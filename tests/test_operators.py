"""Operators on small rows: what SQL over the driver's tables cannot show."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from jointspark.functions import alignment, distributions, models
from jointspark.functions import statistics as st
from jointspark.operators import annotate, annotations, features, filters, gates, genotypes, intervals, pileup, sites, somatic
from jointspark.plans import jobs
from jointspark.sinks import tables as out_tables
from jointspark.sinks import vcf as out
from jointspark.sources import headers, merge, reference, vcf


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_left_overlap_join_keeps_lonely_rows_once(spark):
    left = spark.createDataFrame([("c", 1, 9000, None), ("c", 20, 30, "x"), ("d", 1, 5, None), ("c", 8200, 8200, "y"), (None, 1, 2, "z")], "contig string, start long, end long, tag string")
    right = spark.createDataFrame([("c", 4000, 4200, 7), ("c", 8193, 8300, 8), ("c", 25, 25, None)], "contig string, start long, end long, v int")
    got = rows(intervals.overlap_join(left, right, how="left").select("contig", "start", "tag", "start_r", "v_r"))
    want = [("c", 1, None, 25, None), ("c", 1, None, 4000, 7), ("c", 1, None, 8193, 8), ("c", 20, "x", 25, None), ("c", 8200, "y", 8193, 8), ("d", 1, None, None, None), (None, 1, "z", None, None)]
    assert got == sorted(want, key=str)


def test_latest_pieces_resume_below_a_shorter_record(spark):
    rec = spark.createDataFrame([("c", "s", 1, 50, 1), ("c", "s", 10, 20, 2), ("c", "s", 10, 15, 3), ("c", "t", 5, 5, 4), ("c", None, 7, 9000, 5)], "contig string, sample string, start long, end long, no long")
    got = rows(sites.latest_pieces(rec, ["no"]).select("sample", "first", "last", "no"))
    assert [g for g in got if g[0] == "s"] == [("s", 1, 9, 1), ("s", 10, 15, 3), ("s", 16, 20, 2), ("s", 21, 50, 1)]
    assert sum(g[2] - g[1] + 1 for g in got if g[0] is None) == 8994 and ("t", 5, 5, 4) in got


def test_balanced_windows_begin_and_end_at_sites(spark):
    positions = [101, 104, 105, 110, 113]
    s = spark.createDataFrame([("c", p) for p in positions], "contig string, pos long")
    assert rows(intervals.split_balanced(s, 2, 1).select("start", "end")) == [(101, 104), (105, 110), (113, 114)]
    assert rows(intervals.split_balanced(s.where("pos < 106"), 2, 1).select("start", "end")) == [(101, 101), (104, 104), (105, 105)]
    assert intervals.uncovered(s, intervals.split_balanced(s, 2, 1)).isEmpty()


def test_strand_tables_and_excess_heterozygotes():
    assert st.scaled_table(300, 200, 250, 450) == (50, 33, 41, 75) and st.scaled_table(100, 100, 100, 100) == (100, 100, 100, 100)
    p = st.fisher_tables(np.array([[10, 10, 10, 10], [10, 10, 20, 0], [30, 5, 7, 3], [50, 33, 41, 75]]))
    assert (-10 * np.log10(p[:3])).round(3).tolist() == [0.0, 33.606, 4.570] and -10 * math.log10(p[3]) == pytest.approx(32.5, abs=0.05)
    by_one = [st.fisher_two_sided(*t) for t in ([10, 10, 20, 0], [30, 5, 7, 3])]
    assert p[1:3] == pytest.approx(by_one)
    q = [-10 * math.log10(st.hardy_weinberg_excess(*t)) for t in ((1, 9, 0), (5, 5, 0), (10, 0, 0), (4, 4, 2))]
    assert [round(x, 4) for x in q] == [3.0103, 5.8492, 25.5733, 1.4371]
    assert st.hardy_weinberg_excess(100, 0, 0) == 0


def test_exact_model_by_hand():
    gl = np.array([(0, 30, 300), (30, 0, 300), (300, 30, 0), (0, 20, 200)]) / -10.0
    likelihood = models.count_likelihoods(gl, np.ones(4))
    assert likelihood.round(4).tolist() == [-33.0, -6.6021, -3.7482, -1.4471, -3.2016, -5.8451, -23.8451, -50.6016, -80.0]
    l0, l1, p0, p1, mle = models.exact_site(gl, np.ones(4), 0.001)
    assert mle == 3 and -10 * (l0 + p0 - np.logaddexp((l0 + p0) * math.log(10), (l1 + p1) * math.log(10)) / math.log(10)) == pytest.approx(289.98, abs=0.01)
    assert models.frequency(gl, np.ones(4)) == pytest.approx(0.376123, abs=1e-6)
    assert models.count_likelihoods(gl, np.ones(4), 3).round(4).tolist() == likelihood[:4].round(4).tolist()


def test_independent_alleles_of_two_are_the_exact_model(spark):
    pl = [[0, 30, 300], [30, 0, 300], [300, 30, 0], [0, 20, 200], [0, 0, 0]]
    df = spark.createDataFrame([(1, p) for p in pl], "site long, pl array<int>")
    got = models.independent(df, ["site"], 2, 0.001).first()
    assert got["qual"] == pytest.approx(289.98, abs=0.01) and got["mle_ac"] == 3 and got["log10_absent"] == pytest.approx(-got["qual"] / 10)
    six = spark.createDataFrame([(1, [*p, 400, 400, 400]) for p in pl[:4]], "site long, pl array<int>")
    multi = {r["allele"]: r for r in models.independent(six, ["site"], 3, 0.001).collect()}
    assert multi[1]["mle_ac"] == 3 and multi[2]["mle_ac"] == 0 and multi[1]["log10_absent"] < -20 < multi[2]["log10_absent"]
    assert models.genotype_order(3) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def test_dirichlet_ignores_spanning_deletions():
    gl = np.array([[0, 30, 300, 0, 40, 300]]) / -10.0
    _, with_star = models.dirichlet_site(gl, np.ones(1), np.array([10, 0.01, 0.00125]), star=2)
    _, without = models.dirichlet_site(gl, np.ones(1), np.array([10, 0.01, 0.00125]))
    assert with_star > without


def naive_likelihood(hap, read, q, gap_open=45.0, gap_extend=10.0):
    e, o, x = 10 ** (-q / 10), 10 ** (-gap_open / 10), 10 ** (-gap_extend / 10)
    n, m = len(hap), len(read)
    M, I, D = ([[0.0] * (n + 1) for _ in range(m + 1)] for _ in range(3))
    D[0] = [1 / n] * (n + 1)
    for i, j in itertools.product(range(1, m + 1), range(n + 1)):
        if j:
            emit = 1 - e if hap[j - 1] == read[i - 1] else e / 3
            M[i][j] = emit * (D[0][j - 1] if i == 1 else (1 - 2 * o) * M[i - 1][j - 1] + (1 - x) * (I[i - 1][j - 1] + D[i - 1][j - 1]))
            D[i][j] = o * M[i][j - 1] + x * D[i][j - 1]
        I[i][j] = o * M[i - 1][j] + x * I[i - 1][j]
    return math.log10(sum(M[m]) + sum(I[m]))


def test_read_likelihoods_and_alignment():
    rng = np.random.default_rng(4)
    for _ in range(20):
        hap, read = ("".join(rng.choice(list("ACGT"), n)) for n in (15, 7))
        assert alignment.read_likelihood(hap, read, np.full(7, 30.0)) == pytest.approx(naive_likelihood(hap, read, 30.0), abs=1e-9)
    hap = "ACGTTGCAGGACCATGTACC"
    assert alignment.read_likelihood(hap, hap[4:12], np.full(8, 30.0)) > alignment.read_likelihood(hap, "GGGGGGGG", np.full(8, 30.0))
    assert alignment.align(hap, hap) == (20 * alignment.MATCH, 0, "20M")
    assert alignment.align(hap, hap[3:10])[1:] == (3, "7M")
    assert alignment.align(hap, hap[:8] + hap[10:])[2] == "8M2D10M"
    assert alignment.align(hap, hap[:8] + "TT" + hap[8:])[2] in ("8M2I12M", "9M2I11M", "7M2I13M")
    assert alignment.align("", "AC") == (0, 0, "2S") and alignment.align("AAAA", "CCCC") == (0, 0, "4S")


def test_segments_and_minima():
    values = np.array([0.0] * 20 + [10.0] * 20 + [3.0] * 20) + np.random.default_rng(1).normal(0, 0.1, 60)
    assert somatic.changepoints(values, 6, 10, 20.0) == [19, 39]
    assert somatic.changepoints(values[:20], 6, 10, 20.0) == [] and somatic.changepoints(values[:5], 6, 10, 20.0) == []
    found = somatic.persistent_minima(np.array([3.0, 1.0, 4.0, 0.0, 5.0, 2.0, 6.0]))
    assert found == [(3, 6.0), (1, 3.0), (5, 3.0)]


def test_orientation_artifacts_are_told_from_variants(spark):
    data = [("x", 60, 18, 18)] * 30 + [("x", 60, 30, 15)] * 30 + [("x", 60, 0, 0)] * 300
    got = somatic.orientation_model(spark.createDataFrame(data, "context string, depth int, alt int, f1 int"), ["context"], "depth", "alt", "f1").first()
    assert got["n"] == 360 and got["artifact_f1r2"] == pytest.approx(30 / 360, abs=0.01) and got["artifact_f2r1"] < 0.01


def test_options_and_sizes():
    o = jobs.parsed(["-i", "list", "-o", "out", "-r", "ref.fa", "-w", "300M", "-l", "c:1-9", "-l", "d", "--confidence", "20", "--priors", "0.1,0.2", "--old-quality", "false"])
    assert (o.window, o.target, o.genotype.confidence, o.genotype.priors, o.genotype.old_quality) == (300_000_000, ("c:1-9", "d"), 20.0, (0.1, 0.2), False)
    assert o.parts(99) == 9 and jobs.Options(combine_parts=4).parts(99) == 4
    assert jobs.GenotypeArguments().pseudocounts() == pytest.approx((10, 0.01, 0.00125))
    assert [jobs.size(x) for x in ("1k", "2g", "17")] == [1000, 2_000_000_000, 17]
    for bad in ("", "k", "3x", "-1"):
        with pytest.raises(ValueError, match="size"):
            jobs.size(bad)
    with pytest.raises(ValueError, match="heterozygosity"):
        jobs.GenotypeArguments(heterozygosity=1.0)
    with pytest.raises(SystemExit):
        jobs.parsed(["-i", "x"])
    with pytest.raises(ValueError, match="prior"):
        distributions.custom_prior([0.9, 0.9], 2)


def test_stages_run_again_only_without_their_output(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    run = jobs.Stages(spark, f"file://{tmp_path}")
    assert run.run("a", make, {"k": "v"}).count() == 3 and run.state("a")["metadata"] == {"k": "v"}
    again = jobs.Stages(spark, f"file://{tmp_path}")
    assert again.run("a", make).count() == 3 and made == [1]
    again.drop("a")
    assert again.state("a") is None and again.run("a", make).count() == 3 and made == [1, 1]


def test_files_of_each_form(spark, tmp_path):
    base = f"file://{tmp_path}"
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description=\"x\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nc\t5\t.\tACG\tA,<NON_REF>\t30.5\tPASS\tDP=3;DB\tGT:GQ:PL\t0|1:9:1,2,3,4,5,6\t./.\nc\t9\tr\tT\t.\t.\t.\tEND=20\tGT\t0\t1/1\n\n")
    text = vcf.lines(spark, f"{base}/a.vcf")
    rec = {r["start"]: r for r in vcf.records(text).collect()}
    assert (rec[5]["end"], rec[5]["alts"], rec[5]["qual"], rec[9]["end"], rec[9]["alts"], rec[9]["qual"]) == (7, ["A", "<NON_REF>"], 30.5, 20, [], None)
    g = {(r["start"], r["sample"]): r for r in vcf.genotypes(vcf.records(text), vcf.samples(text)).collect()}
    assert g[5, "s1"]["gt"] == [0, 1] and g[5, "s1"]["fields"]["GQ"] == "9" and g[5, "s2"]["gt"] == [-1, -1] and "GQ" not in g[5, "s2"]["fields"] and g[9, "s1"]["gt"] == [0]
    assert vcf.records(text).select(vcf.info_value(F.col("info"), "DB"), vcf.info_value(F.col("info"), "P")).first()[:] == ("", None)
    (tmp_path / "list").write_text(f"{base}/a.vcf\n\n")
    assert vcf.listed(spark, f"{base}/list") == [f"{base}/a.vcf"]
    (tmp_path / "none").write_text("\n")
    with pytest.raises(ValueError, match="no file"):
        vcf.listed(spark, f"{base}/none")
    (tmp_path / "x.fai").write_text("c1\t1000\t3\t60\t61\nc2\t20\t9\t60\t61\n")
    assert rows(reference.dictionary(spark, f"{base}/x.fai")) == [("c1", 1000, 0), ("c2", 20, 1)]
    (tmp_path / "x.fa").write_text(">c1 text\nacgtac\nGTNN\n>c2\nTTTT\n")
    chunks = reference.fasta(spark, f"{base}/x.fa", 4)
    asked = spark.createDataFrame([("c1", 3, 9), ("c2", 4, 90), ("c2", 5, 9)], "contig string, start long, end long")
    assert rows(reference.bases_at(chunks, asked, 4)) == [("c1", 3, 9, "GTACGTN"), ("c2", 4, 90, "T")]
    (tmp_path / "x.bed").write_text("track x\nc1\t0\t10\n")
    (tmp_path / "x.list").write_text("# note\nc1:1,000-2,000\nc2:7\nc3\n")
    assert rows(reference.intervals(spark, f"{base}/x.bed")) == [("c1", 1, 10)]
    assert rows(reference.intervals(spark, f"{base}/x.list")) == [("c1", 1000, 2000), ("c2", 7, 7), ("c3", None, None)]
    assert out.window_name("c", 1, 9, 9, 0) == "result.c.0.vcf.gz" and out.window_name("c", 1, 8, 9, 3) == "result.c_1_8.3.vcf.gz"
    assert out.no_call(3) == "./././."[:5] and out_tables.bitset_positions(out_tables.bitset_bytes(np.array([0, 3, 9]))).tolist() == [0, 3, 9]
    with pytest.raises(ValueError, match="size"):
        out_tables.bitset_positions(b"\x05\x00\x00\x00\x01")
    assert out.header_lines([], [], ["b", "a", "b"])[-1].endswith("FORMAT\ta\tb")


def test_call_text_and_formats(spark):
    df = spark.createDataFrame([([0, 1], 3, None), ([-1, -1], None, None), ([1], None, 7)], "gt array<int>, dp int, gq int")
    text = [r[0] for r in df.select(out.call_text([out.genotype_text(F.col("gt")), F.col("dp"), F.col("gq")])).collect()]
    assert text == ["0/1:3", "./.", "1:.:7"]
    assert df.agg(out.format_keys({"DP": F.col("dp"), "GT": F.col("gt"), "XX": F.lit(None), "GQ": F.col("gq")})).first()[0] == "GT:DP:GQ"


def test_inputs_that_disagree_are_errors(spark):
    a, b = spark.createDataFrame([(1, 2)], "site long, v long"), spark.createDataFrame([(2, 2)], "site long, v long")
    with pytest.raises(Exception, match="same sites"):
        merge.zipped([a, b], ["site"]).collect()
    names = spark.createDataFrame([(0, "x"), (1, "x")], "file long, sample string")
    assert rows(headers.sample_columns(names)) == [("x", 0, 2)]
    with pytest.raises(Exception, match="repeats"):
        headers.sample_columns(names, strict=True).collect()
    register = features.Registry(spark)
    register.add("a", a)
    for bad in (lambda: register.add("a", b), lambda: register.add("c", "x.unknown")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        register.get("z")
    known = annotations.standard()
    with pytest.raises(ValueError):
        known.add(known.known["AN"])
    with pytest.raises(KeyError):
        known.enabled(names=("nothing",))
    assert [a.name for a in known.enabled(("Strand",), ("AN",), ("FS",))] == ["AN", "SOR"]


def test_gates_and_filters(spark):
    df = spark.createDataFrame([("A", ["*"]), ("A", []), ("AC", ["GT", "<NON_REF>"]), ("A", ["<DEL>"]), ("A", ["T", "*"])], "ref string, alts array<string>")
    got = [tuple(r) for r in df.select(gates.properly_polymorphic(F.col("alts")), gates.only_spanning(F.col("alts")), gates.unmixed_mnp(F.col("ref"), F.col("alts"))).collect()]
    assert got == [(False, True, False), (False, False, False), (True, False, True), (False, False, False), (True, False, False)]
    cigars = {"10M": True, "3S7M": True, "2D8M": False, "3H2S1D4M": False, "4M1I1D4M": False, "M10": False, "5M2S3M": False, "*": False}
    c = spark.createDataFrame([(k,) for k in cigars], "cigar string")
    assert {r[0]: r[1] for r in c.select("cigar", filters.good_cigar(F.col("cigar"))).collect()} == cigars
    t = filters.Filter("n", F.lit(None).cast("boolean"))
    assert spark.range(1).select(t.passed, (~t).passed, (t | ~t).passed, (t & ~t).passed).first()[:] == (False, True, True, False)
    reads = spark.createDataFrame([("r", 0, "c", 5, 0, "2S2M1D1M", "=", 0, 0, "ACGTA", "!!III", 8)], "name string, flags int, contig string, start long, mapq int, cigar string, mate_contig string, mate_start long, tlen int, seq string, qual string, end long")
    assert [tuple(r) for r in pileup.bases(reads).orderBy("pos").select("pos", "base", "quality").collect()] == [(5, "G", 40), (6, "T", 40), (7, "-", None), (8, "A", 40)]


def test_any_ploidy_by_summing_all_genotypes():
    rng = np.random.default_rng(7)
    for ploidy in (1, 3, 4):
        gl = -rng.integers(0, 40, (3, ploidy + 1)) / 10.0
        want = np.zeros(3 * ploidy + 1)
        for g in itertools.product(range(ploidy + 1), repeat=3):
            want[sum(g)] += math.prod(math.comb(ploidy, k) * 10 ** gl[i, k] for i, k in enumerate(g))
        want = np.log10(want) - np.log10([math.comb(3 * ploidy, k) for k in range(3 * ploidy + 1)])
        assert models.count_likelihoods(gl, np.ones(3)) == pytest.approx(want)
        assert models.exact_site(gl, np.ones(3), 0.001)[4] == want.argmax()


def test_kmers_of_texts_with_any_characters(spark):
    import collections

    texts = ["abcabc", "", None, "ab", "\x00\x00\x00a\x00\x00\x00a", "é日本😀é日本😀", "abc"]
    df = spark.createDataFrame([(k % 2 if k != 3 else None, t) for k, t in enumerate(texts)], "g long, t string")
    want = collections.Counter((k % 2 if k != 3 else None, t[i : i + 3]) for k, t in enumerate(texts) for i in range(len(t or "") - 2))
    got = {(r["g"], r["kmer"]): r["n"] for r in annotate.kmers(df, ["g"], "t", 3).collect()}
    assert got == dict(want)
    assert {r["kmer"]: r["n"] for r in annotate.kmers(df, [], "t", 3, 2).collect()} == {"abc": 3, "\x00\x00\x00": 2, "\x00\x00a": 2, "é日本": 2, "日本😀": 2}


def test_exact_rank_sums_by_enumeration(spark):
    rng = np.random.default_rng(11)
    for n, n1 in ((2, 1), (5, 2), (7, 3), (9, 6)):
        values = rng.integers(0, 4, n).astype(float)
        first = np.zeros(n, int)
        first[rng.permutation(n)[:n1]] = 1
        rank = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
        own = rank[first == 1].sum()
        sums = [sum(rank[k] for k in c) for c in itertools.combinations(range(n), n1)]
        want = sum(1.0 if x < own - 1e-9 else 0.5 if abs(x - own) < 1e-9 else 0.0 for x in sums) / len(sums)
        assert st.exact_rank_p(values, first) == pytest.approx(want)
    assert math.isnan(st.exact_rank_p(np.array([1.0]), np.array([1]))) and st.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True), *[("c", k, k % 2 == 0) for k in range(40)]], "g string, v int, f boolean")
    assert rows(genotypes.small_rank_sums(df, ["g"], "v", F.col("f")).select("g", "n1", "n2", "p")) == [("a", 1, 1, 0.25)]
