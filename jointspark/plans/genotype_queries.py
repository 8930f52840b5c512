"""Queries on genotypes, site statistics and allele-frequency models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models
from ..functions import statistics as st
from ..operators import alleles as al
from ..operators import annotate as an
from ..operators import genotypes as gt
from .registry import query
from .views import GT, genotypes, rounded, table


def r(x: str, scale: int = 10000) -> str:
    return f"floor(({x}) * {scale}.0 + 0.5) / {scale}.0"


#: The likeliest genotype and its quality from p0, p1, p2.
BEST = "CASE WHEN p0 <= p1 AND p0 <= p2 THEN 0 WHEN p1 <= p2 THEN 1 ELSE 2 END"
QUAL = "list_sort([p0, p1, p2])[2] - list_sort([p0, p1, p2])[1]"
CALLED = "-(p0 + p1 + p2) / 10.0 < -0.1"
HARD = f"h AS (SELECT site, count(*) FILTER ({BEST} = 0) AS n_ref, count(*) FILTER ({BEST} = 1) AS n_het, count(*) FILTER ({BEST} = 2) AS n_hom FROM gt GROUP BY site)"
STRANDS = "s AS (SELECT site, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS rf, count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'F') AS rr, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS af, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus <> 'F') AS ar FROM gt GROUP BY site)"


def _pl6(pl):
    a, b, c = (F.get(pl, F.lit(k)) for k in range(3))
    return F.array(a, b, c, a + b, b + c, a + c)


@query("q15_pl_remap", f"WITH {GT} SELECT site, CAST(sum(p0) AS BIGINT) AS s0, CAST(sum(p0 + p1) AS BIGINT) AS s1, CAST(sum(p0 + p2) AS BIGINT) AS s2, CAST(sum(p1) AS BIGINT) AS s3, CAST(sum(p1 + p2) AS BIGINT) AS s4, CAST(sum(p2) AS BIGINT) AS s5 FROM gt GROUP BY site")
def pl_remap(spark, d):
    new = al.remapped(_pl6(F.col("pl")), al.genotype_index_map(F.array(F.lit(0), F.lit(2), F.lit(1))))
    g = genotypes(spark, d).select("site", new.alias("new"))
    return g.groupBy("site").agg(*(F.sum(F.get("new", F.lit(k))).cast("long").alias(f"s{k}") for k in range(6)))


@query("q15_ad_remap", f"WITH {GT} SELECT site, CAST(sum(dp) AS BIGINT) AS a0, CAST(sum(p2) AS BIGINT) AS a1, CAST(0 AS BIGINT) AS a2 FROM gt GROUP BY site")
def ad_remap(spark, d):
    ad = F.array(F.col("dp"), F.col("line"), F.get("pl", F.lit(2)).cast("long"))
    new = al.remapped(ad, F.array(F.lit(0), F.lit(2), F.lit(5)), 0)
    return genotypes(spark, d).select("site", new.alias("ad")).groupBy("site").agg(*(F.sum(F.get("ad", F.lit(k))).alias(f"a{k}") for k in range(3)))


@query("q16_upper_median", f"WITH {GT} SELECT site, list_sort(list(dp))[len(list(dp)) // 2 + 1] AS median FROM gt GROUP BY site")
def upper_median(spark, d):
    return gt.upper_median(genotypes(spark, d), ["site"], "dp")


@query("q17_reducible_sum", f"SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS pos, {r('sum(CAST(embedding[i + 1] AS DOUBLE))', 1000)} AS total FROM embeddings, unnest(range(64)) u(i) GROUP BY label, i")
def reducible_sum(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return gt.element_sums(e, ["label"], "v").select("label", F.col("pos").cast("long").alias("pos"), rounded(F.col("total"), 3).alias("total"))


BINS = "b AS (SELECT l_partkey % 500 AS site, CAST(floor((l_extendedprice / 1000.0 + 0.01 * 0.1) / 0.1) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL)"


def _bins(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 500).alias("site"), (F.col("l_extendedprice") / 1000.0).alias("v"))
    return gt.histogram(li, ["site"], "v")


@query("q18_histogram_merge", f"WITH {BINS} SELECT * FROM b")
def histogram_merge(spark, d):
    return _bins(spark, d)


@query(
    "q18_histogram_median",
    f"""WITH {BINS}, c AS (SELECT *, sum(n) OVER (PARTITION BY site ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY site) AS total FROM b)
SELECT site, {r("(min(bin) FILTER (upto >= (total + 1) // 2) + min(bin) FILTER (upto >= total // 2 + 1)) / 2.0 * 0.1", 1000)} AS median FROM c GROUP BY site""",
)
def histogram_median(spark, d):
    return gt.histogram_median(_bins(spark, d), ["site"]).select("site", rounded(F.col("median"), 3).alias("median"))


@query("q19_depth_coalesce", f"WITH {GT} SELECT site, CAST(sum(coalesce(CASE WHEN line >= 5 THEN dp END, CASE WHEN line = 4 THEN CAST(p2 AS BIGINT) END, CASE WHEN line = 3 THEN line END, CASE WHEN line = 2 THEN dp + line END, 0)) AS BIGINT) AS depth FROM gt GROUP BY site")
def depth_coalesce(spark, d):
    line, dp = F.col("line"), F.col("dp")
    depth = gt.site_depth(F.when(line >= 5, dp).otherwise(0), F.when(line == 4, F.get("pl", F.lit(2)).cast("long")), F.when(line == 3, line), F.when(line == 2, dp + line))
    return genotypes(spark, d).groupBy("site").agg(F.sum(depth).alias("depth"))


@query("q20_top_k_alleles", f"WITH {GT}, s AS (SELECT site, line AS allele, CAST(sum(p0 - p1) AS BIGINT) AS score FROM gt GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, allele) AS BIGINT) AS rank FROM s) WHERE rank <= 3")
def top_k_alleles(spark, d):
    g = genotypes(spark, d).select("site", F.col("line").alias("allele"), (F.get("pl", F.lit(0)) - F.get("pl", F.lit(1))).cast("long").alias("gain"))
    return al.likeliest(g, ["site"], "allele", "gain", 3).withColumn("rank", F.col("rank").cast("long"))


@query("q21_ac_an_af", f"WITH {GT} SELECT site, CAST(sum({BEST}) AS BIGINT) AS ac, 2 * count(*) AS an, {r(f'CAST(sum({BEST}) AS DOUBLE) / (2 * count(*))')} AS af FROM gt WHERE {CALLED} GROUP BY site")
def ac_an_af(spark, d):
    return gt.allele_counts(genotypes(spark, d), ["site"]).withColumn("af", rounded(F.col("af")))


SOFT = "l AS (SELECT site, l_returnflag, pow(10, (least(p0, p1, p2) - p0) / 10.0) AS a, pow(10, (least(p0, p1, p2) - p1) / 10.0) AS b, pow(10, (least(p0, p1, p2) - p2) / 10.0) AS c FROM gt)"
ROUNDED = f"{SOFT}, h AS (SELECT site, CAST(sum(floor(a / (a + b + c) + 0.5)) AS BIGINT) AS n_ref, CAST(sum(floor(b / (a + b + c) + 0.5)) AS BIGINT) AS n_het, CAST(sum(floor(c / (a + b + c) + 0.5)) AS BIGINT) AS n_hom, count(*) AS n_samples FROM l GROUP BY site)"


@query("q22_genotype_counts", f"WITH {GT}, {ROUNDED} SELECT site, n_ref, n_het, n_hom FROM h")
def genotype_counts(spark, d):
    return gt.rounded_counts(genotypes(spark, d), ["site"]).drop("n")


@query("q22_likeliest_genotypes", f"WITH {GT}, {HARD} SELECT * FROM h")
def likeliest_genotypes(spark, d):
    return gt.hard_counts(genotypes(spark, d), ["site"])


@query("q22_soft_counts", f"WITH {GT}, {SOFT} SELECT site, {r('sum(a / (a + b + c))')} AS ref, {r('sum(b / (a + b + c))')} AS het, {r('sum(c / (a + b + c))')} AS hom FROM l GROUP BY site")
def soft_counts(spark, d):
    return gt.soft_counts(genotypes(spark, d), ["site"]).select("site", *(rounded(F.col(c)).alias(c) for c in ("ref", "het", "hom")))


#: 1 - het / (2 p q n) of summed shares, with the number of samples.
INBRED = r("1 - het / (2 * ((2 * ref + het) / (2.0 * (ref + het + hom))) * (1 - (2 * ref + het) / (2.0 * (ref + het + hom))) * n)")
SUMS = "h AS (SELECT {keys}, sum(a / (a + b + c)) AS ref, sum(b / (a + b + c)) AS het, sum(c / (a + b + c)) AS hom, count(*) AS n FROM l GROUP BY ALL)"


def _inbreeding(h, *keys):
    return h.where("n >= 10").select(*keys, rounded(st.inbreeding(*(F.col(c) for c in ("ref", "het", "hom")), F.col("n"))).alias("f"))


@query("q23_inbreeding_coeff", f"WITH {GT}, {SOFT}, {SUMS.format(keys='site')} SELECT site, {INBRED} AS f FROM h WHERE n >= 10")
def inbreeding_coeff(spark, d):
    return _inbreeding(gt.soft_counts(genotypes(spark, d), ["site"]), "site")


@query("q23_as_inbreeding", f"WITH {GT}, {SOFT}, {SUMS.format(keys='site, l_returnflag')} SELECT site, l_returnflag AS allele, {INBRED} AS f FROM h WHERE n >= 10")
def as_inbreeding(spark, d):
    return _inbreeding(gt.soft_counts(genotypes(spark, d).withColumnRenamed("l_returnflag", "allele"), ["site", "allele"]), "site", "allele")


def _strands(spark, d, *keys):
    return gt.strand_table(genotypes(spark, d), ["site", *keys], F.col("l_returnflag") != "N", F.col("l_linestatus") != "F")


SOR = r("ln((rf + 1.0) * (ar + 1.0) / ((rr + 1.0) * (af + 1.0)) + (rr + 1.0) * (af + 1.0) / ((rf + 1.0) * (ar + 1.0))) + ln(least(rf + 1.0, rr + 1.0) / greatest(rf + 1.0, rr + 1.0)) - ln(least(af + 1.0, ar + 1.0) / greatest(af + 1.0, ar + 1.0))")


@query("q24_sor", f"WITH {GT}, {STRANDS} SELECT site, {SOR} AS sor FROM s")
def sor(spark, d):
    return _strands(spark, d).select("site", rounded(st.strand_odds(*(F.col(c) for c in ("rf", "rr", "af", "ar")))).alias("sor"))


AS_STRANDS = "s AS (SELECT a.site, a.allele, b.rf, b.rr, a.af, a.ar FROM (SELECT site, l_returnflag AS allele, count(*) FILTER (l_linestatus = 'F') AS af, count(*) FILTER (l_linestatus <> 'F') AS ar FROM gt WHERE l_returnflag <> 'N' GROUP BY ALL) a JOIN (SELECT site, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS rf, count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'F') AS rr FROM gt GROUP BY 1) b USING (site))"


@query("q24_as_sor", f"WITH {GT}, {AS_STRANDS} SELECT site, allele, {SOR} AS sor FROM s")
def as_sor(spark, d):
    g = genotypes(spark, d)
    alt = F.col("l_returnflag") != "N"
    own = gt.strand_table(g.where(alt).withColumnRenamed("l_returnflag", "allele"), ["site", "allele"], F.lit(True), F.col("l_linestatus") != "F").select("site", "allele", "af", "ar")
    ref = gt.strand_table(g, ["site"], alt, F.col("l_linestatus") != "F").select("site", "rf", "rr")
    return own.join(ref, "site").select("site", "allele", rounded(st.strand_odds(*(F.col(c) for c in ("rf", "rr", "af", "ar")))).alias("sor"))


@query(
    "q25_fisher_strand",
    f"""WITH {GT}, {STRANDS}, y AS (SELECT *, greatest(CAST(rf + rr + af + ar AS DOUBLE) / 200, 1) AS shrink, rf + rr + af + ar > 400 AS large FROM s),
  z AS (SELECT site, CASE WHEN large THEN CAST(floor(rf / shrink) AS BIGINT) ELSE rf END AS a, CASE WHEN large THEN CAST(floor(rr / shrink) AS BIGINT) ELSE rr END AS b, CASE WHEN large THEN CAST(floor(af / shrink) AS BIGINT) ELSE af END AS c, CASE WHEN large THEN CAST(floor(ar / shrink) AS BIGINT) ELSE ar END AS d FROM y),
  x AS (SELECT *, unnest(range(greatest(0, b * 0 + a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS x FROM z),
  l AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM x),
  o AS (SELECT *, max(p) FILTER (x = a) OVER (PARTITION BY site) AS own FROM l)
SELECT site, {r("-10 * log10(greatest(least(sum(p) FILTER (p <= own * (1 + 1e-7)), 1), 1e-320))", 1000)} AS fs FROM o GROUP BY site""",
)
def fisher_strand(spark, d):
    p = st.fisher_p(*(F.col(c) for c in ("rf", "rr", "af", "ar")))
    return _strands(spark, d).select("site", p.alias("p")).select("site", rounded(-10 * F.log10(F.greatest("p", F.lit(1e-320))), 3).alias("fs"))


@query(
    "q26_excess_het",
    f"""WITH {GT}, {ROUNDED}, n AS (SELECT *, n_ref + n_het + n_hom AS n, 2 * least(n_ref, n_hom) + n_het AS rare FROM h),
  w AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(rare * (2.0 * n - rare) / (2.0 * n - 1.0)) AS BIGINT) ELSE 0 END AS middle FROM n),
  x AS (SELECT *, least(middle + abs(middle - rare) % 2, rare) AS mode, unnest(range(rare % 2, rare + 1, 2)) AS x FROM w),
  g AS (SELECT *, lgamma(n + 1) - lgamma((rare - x) // 2 + 1) - lgamma(x + 1) - lgamma(n - x - (rare - x) // 2 + 1) + x * ln(2) AS l FROM x),
  e AS (SELECT *, exp(l - max(l) FILTER (x = mode) OVER (PARTITION BY site)) AS e FROM g), p AS (SELECT *, CASE WHEN e < 1e-16 THEN 0 ELSE e END AS p FROM e),
  m AS (SELECT site, any_value(rare) AS rare, (coalesce(sum(p) FILTER (x > n_het), 0) + coalesce(sum(p) FILTER (x = n_het), 0) / 2) / sum(p) AS mid FROM p GROUP BY site)
SELECT site, CASE WHEN rare <= 1 THEN {r("-10 * log10(0.5)")} WHEN mid < 1e-59 THEN 160.0 ELSE {r("-10 * log10(mid)")} END AS excess_het FROM m""",
)
def excess_het(spark, d):
    h = gt.rounded_counts(genotypes(spark, d), ["site"])
    p = h.select("site", st.excess_het_p("n_het", "n_ref", "n_hom").alias("p"))
    return p.select("site", rounded(st.excess_het(F.col("p"))).alias("excess_het"))


@query("q27_rms_mq", f"WITH {GT} SELECT site, {r('sqrt(CAST(sum(dp * dp) AS DOUBLE) / count(*))')} AS mq FROM gt GROUP BY site")
def rms_mq(spark, d):
    return genotypes(spark, d).groupBy("site").agg(rounded(F.sqrt(F.sum(F.col("dp") * F.col("dp")) / F.count("*"))).alias("mq"))


@query("q27_as_mq", f"WITH {GT} SELECT site, l_returnflag AS allele, {r('sqrt(CAST(sum(dp * dp) AS DOUBLE) / sum(line))')} AS mq FROM gt GROUP BY ALL")
def as_mq(spark, d):
    return genotypes(spark, d).groupBy("site", F.col("l_returnflag").alias("allele")).agg(rounded(F.sqrt(F.sum(F.col("dp") * F.col("dp")) / F.sum("line"))).alias("mq"))


@query("q28_qual_by_depth", f"WITH {GT} SELECT site, CAST(sum(p0) AS BIGINT) AS qual, CAST(sum(dp) AS BIGINT) AS depth, {r('CAST(sum(p0) AS DOUBLE) / sum(dp)')} AS qd FROM gt WHERE {BEST} > 0 GROUP BY site")
def qual_by_depth(spark, d):
    g = genotypes(spark, d).where(gt.best(F.col("pl")) > 0)
    out = g.groupBy("site").agg(F.sum(F.get("pl", F.lit(0)).cast("long")).alias("qual"), F.sum("dp").alias("depth"))
    return out.withColumn("qd", rounded(F.col("qual") / F.col("depth")))


@query("q29_het_prior", f"SELECT CAST(i AS BIGINT) AS ac, {r('CASE WHEN i = 0 THEN log10(1 - 0.001 * (SELECT sum(1.0 / CAST(j AS DOUBLE)) FROM range(1, 201) t(j))) ELSE log10(0.001) - log10(i) END')} AS log10_prior FROM range(0, 201) t(i)")
def het_prior(spark, d):
    prior = st.heterozygosity_prior(0.001, 200)
    return spark.createDataFrame([(i, float(p)) for i, p in enumerate(prior)], "ac long, p double").select("ac", rounded(F.col("p")).alias("log10_prior"))


@query("q30_log10_sum", f"WITH {GT} SELECT site, {r('sum(-least(p0, p1, p2) / 10.0 + log10(pow(10, (least(p0, p1, p2) - p0) / 10.0) + pow(10, (least(p0, p1, p2) - p1) / 10.0) + pow(10, (least(p0, p1, p2) - p2) / 10.0)))', 1000)} AS total FROM gt GROUP BY site")
def log10_sum(spark, d):
    total = st.log10_sum(st.genotype_likelihoods(F.col("pl")))
    return genotypes(spark, d).groupBy("site").agg(rounded(F.sum(total), 3).alias("total"))


@query("q30_normalise", f"WITH {GT}, {SOFT} SELECT site, {r('max(b / (a + b + c))')} AS most_het, {r('min(a / (a + b + c))')} AS least_ref FROM l GROUP BY site")
def normalise(spark, d):
    g = genotypes(spark, d).select("site", st.normalised(st.genotype_likelihoods(F.col("pl"))).alias("p"))
    return g.groupBy("site").agg(rounded(F.max(F.get("p", F.lit(1)))).alias("most_het"), rounded(F.min(F.get("p", F.lit(0)))).alias("least_ref"))


@query("q30_log10_one_minus", f"SELECT CAST(i AS BIGINT) AS i, {r('log10(1 - pow(10, -i / 50.0))', 100000)} AS v FROM range(1, 201) t(i)")
def log10_one_minus(spark, d):
    return spark.range(1, 201).select(F.col("id").alias("i"), rounded(st.log10_one_minus(-F.col("id") / 50.0), 5).alias("v"))


@query("q31_gt_assign", f"WITH {GT}, g AS (SELECT site, CASE WHEN {CALLED} THEN {BEST} ELSE -1 END AS genotype, {QUAL} AS gq FROM gt) SELECT site, CAST(genotype AS BIGINT) AS genotype, count(*) AS n, CAST(sum(gq) AS BIGINT) AS sum_gq FROM g GROUP BY site, genotype")
def gt_assign(spark, d):
    pl = F.col("pl")
    g = genotypes(spark, d).select("site", F.when(gt.is_called(pl), gt.best(pl)).otherwise(-1).cast("long").alias("genotype"), gt.quality(pl).alias("gq"))
    return g.groupBy("site", "genotype").agg(F.count("*").alias("n"), F.sum("gq").cast("long").alias("sum_gq"))


GL = f"gl AS (SELECT site, -p0 / 10.0 AS g0, -p1 / 10.0 AS g1, -p2 / 10.0 AS g2, row_number() OVER (PARTITION BY site) AS k FROM gt WHERE {CALLED})"
LINEAR = "lin AS (SELECT site, k, pow(10, g0) AS a, pow(10, g1) AS b, pow(10, g2) AS c FROM gl)"


@query(
    "q32_em_af",
    f"""WITH RECURSIVE {GT}, {GL}, {LINEAR}, s AS (SELECT site, count(*) AS n FROM lin GROUP BY 1),
  em(site, step, af, last) AS (SELECT site, 0, CAST(0.5 AS DOUBLE), CAST(0 AS DOUBLE) FROM s
    UNION ALL SELECT em.site, em.step + 1, sum((b * 2 * af * (1 - af) + 2 * c * af * af) / (a * (1 - af) * (1 - af) + b * 2 * af * (1 - af) + c * af * af)) / (2 * any_value(n)), af
    FROM em JOIN lin USING (site) JOIN s USING (site) WHERE step < 100 AND (step = 0 OR NOT (abs(af - last) < 1.0 / (200 * n) OR af < 1.0 / (10 * n))) GROUP BY em.site, em.step, em.af, em.last)
SELECT site, n, {r('arg_max(af, step)')} AS af FROM em JOIN s USING (site) GROUP BY site, n""",
)
def em_af(spark, d):
    return models.frequencies(genotypes(spark, d), ["site"]).select("site", "n", rounded(F.col("af")).alias("af"))


#: log10 likelihoods of no and some alternate copies by adding one sample at a time, values scaled by their largest.
EXACT = """s AS (SELECT site, count(*) AS n, sum(g0) AS l0 FROM gl GROUP BY 1),
  z(site, k, v, shift) AS (SELECT site, 0, [CAST(1 AS DOUBLE)], CAST(0 AS DOUBLE) FROM s
    UNION ALL SELECT site, k, list_transform(w, lambda x: x / list_max(w)), shift + log10(list_max(w)) FROM (
      SELECT z.site, z.k + 1 AS k, shift, [coalesce(v[i], 0) * a + CASE WHEN i > 1 THEN coalesce(v[i - 1], 0) * 2 * b ELSE 0 END + CASE WHEN i > 2 THEN v[i - 2] * c ELSE 0 END FOR i IN range(1, len(v) + 3)] AS w
      FROM z JOIN lin ON lin.site = z.site AND lin.k = z.k + 1)),
  f AS (SELECT z.site, n, l0, v, shift FROM z JOIN s ON s.site = z.site AND s.n = z.k),
  c AS (SELECT site, n, l0, i, log10(v[i + 1]) + shift - (lgamma(2 * n + 1) - lgamma(i + 1) - lgamma(2 * n - i + 1)) / ln(10) AS l FROM (SELECT *, unnest(range(0, 2 * n + 1)) AS i FROM f) WHERE v[i + 1] > 0),
  m AS (SELECT site, n, any_value(l0) AS l0, max(l) AS top, arg_max(i, l) AS mle FROM c GROUP BY site, n),
  t AS (SELECT c.site, m.top + log10(sum(pow(10, c.l - m.top)) FILTER (c.i > 0)) AS l1 FROM c JOIN m USING (site) GROUP BY c.site, m.top),
  p AS (SELECT m.site, m.n, m.l0, t.l1, m.mle, log10(1 - 0.001 * h) AS prior0, log10(0.001 * h) AS prior1 FROM m JOIN t USING (site) JOIN (SELECT n, sum(1.0 / CAST(j AS DOUBLE)) AS h FROM (SELECT n, unnest(range(1, 2 * n + 1)) AS j FROM (SELECT DISTINCT n FROM s)) GROUP BY n) USING (n))"""
LOG_SUM = "greatest({0}, {1}) + log10(1 + pow(10, least({0}, {1}) - greatest({0}, {1})))"


@query(
    "q33_exact_af_qual",
    f"""WITH RECURSIVE {GT}, {GL}, {LINEAR}, {EXACT} SELECT site, n, {r("-10 * (l0 + prior0 - (" + LOG_SUM.format("(l0 + prior0)", "(l1 + prior1)") + "))", 100)} AS qual, CAST(mle AS BIGINT) AS mle_ac FROM p""",
)
def exact_af_qual(spark, d):
    return models.exact(genotypes(spark, d), ["site"], 0.001).select("site", "n", rounded(F.col("qual"), 2).alias("qual"), "mle_ac")


@query("q33_emitted_sites", f"WITH RECURSIVE {GT}, {GL}, {LINEAR}, {EXACT}, q AS (SELECT *, -10 * (l0 + prior0 - ({LOG_SUM.format('(l0 + prior0)', '(l1 + prior1)')})) AS qual FROM p) SELECT site, CASE WHEN qual < 1000 THEN 'LowQual' ELSE 'PASS' END AS filter FROM q WHERE mle > 0 AND qual >= 30")
def emitted_sites(spark, d):
    from ..operators import gates

    called = models.exact(genotypes(spark, d), ["site"], 0.001)
    return called.where(gates.emitted(F.col("qual"), F.col("mle_ac"))).select("site", F.coalesce(gates.low_quality(F.col("qual"), 1000.0), F.lit("PASS")).alias("filter"))


@query("q33_independent_alleles")
def independent_alleles(spark, d):
    g = genotypes(spark, d).select("site", _pl6(F.col("pl")).alias("pl"))
    out = models.independent(g, ["site"], 3, 0.001)
    return out.select("site", F.col("allele").cast("long").alias("allele"), "mle_ac", rounded(F.col("qual"), 2).alias("qual"), models.plausible(F.col("log10_absent")).alias("plausible"))


@query(
    "q34_dirichlet_af",
    f"""WITH RECURSIVE {GT}, g AS (SELECT site, -p0 / 10.0 AS g0, log10(2) - p1 / 10.0 AS g1, -p2 / 10.0 AS g2 FROM gt), s AS (SELECT site, count(*) AS n FROM g GROUP BY 1),
  em(site, step, w0, w1, c0, c1, moved) AS (SELECT site, 0, log10(0.5), log10(0.5), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1e9 AS DOUBLE) FROM s
    UNION ALL SELECT site, step + 1, log10(10 + x) - log10(10.01 + x + y), log10(0.01 + y) - log10(10.01 + x + y), x, y, greatest(abs(x - c0), abs(y - c1)) FROM (
      SELECT site, step, c0, c1, sum((2 * a + b) / (a + b + c)) AS x, sum((b + 2 * c) / (a + b + c)) AS y FROM (
        SELECT em.site, step, c0, c1, pow(10, g0 + 2 * w0) AS a, pow(10, g1 + w0 + w1) AS b, pow(10, g2 + 2 * w1) AS c FROM em JOIN g USING (site) WHERE moved > 0.1)
      GROUP BY site, step, c0, c1)),
  f AS (SELECT site, arg_max(w0, step) AS w0, arg_max(w1, step) AS w1, arg_max(c1, step) AS alt FROM em GROUP BY site)
SELECT site, count(*) AS n, {r('any_value(alt)', 1000)} AS alt_count, {r('sum(-10 * (g0 + 2 * w0 - log10(pow(10, g0 + 2 * w0) + pow(10, g1 + w0 + w1) + pow(10, g2 + 2 * w1))))', 100)} AS qual FROM f JOIN g USING (site) GROUP BY site""",
)
def dirichlet_af(spark, d):
    return models.dirichlet(genotypes(spark, d), ["site"], [10.0, 0.01]).select("site", "n", rounded(F.col("alt_count"), 3).alias("alt_count"), rounded(F.col("qual"), 2).alias("qual"))


@query(
    "q39_mann_whitney",
    f"""WITH {GT}, v AS (SELECT site, dp, count(*) FILTER (l_returnflag <> 'N') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM gt GROUP BY ALL),
  k AS (SELECT *, coalesce(sum(a + b) OVER (PARTITION BY site ORDER BY dp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2.0 AS rank FROM v),
  s AS (SELECT site, CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(b) AS DOUBLE) AS n2, sum(a * rank) AS r1, sum(CAST(a + b AS DOUBLE) ** 3 - (a + b)) AS ties FROM k GROUP BY site),
  u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS off, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM s WHERE n1 > 0 AND n2 > 0)
SELECT s.site, CAST(s.n1 AS BIGINT) AS n1, CAST(s.n2 AS BIGINT) AS n2, {r("CASE WHEN u.var > 0 THEN (u.off - sign(u.off) * 0.5) / sqrt(u.var) END")} AS z FROM s LEFT JOIN u USING (site)""",
)
def mann_whitney(spark, d):
    out = gt.rank_sums(genotypes(spark, d), ["site"], "dp", F.col("l_returnflag") != "N")
    return out.select("site", "n1", "n2", rounded(F.col("z")).alias("z"))


@query(
    "q39_exact_rank_sums",
    f"""WITH {GT}, g AS (SELECT DISTINCT site, dp % 10 AS k, count(*) FILTER (l_returnflag <> 'N') OVER w AS n1, count(*) FILTER (l_returnflag = 'N') OVER w AS n2 FROM gt WINDOW w AS (PARTITION BY site, dp % 10))
SELECT site, k, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, true AS inside FROM g WHERE n1 BETWEEN 1 AND 9 AND n2 BETWEEN 1 AND 9""",
)
def exact_rank_sums(spark, d):
    """Small groups' exact tests; SQL says which groups and how large, a test by enumeration holds the probabilities."""
    g = genotypes(spark, d).select("site", (F.col("dp") % 10).alias("k"), F.get("pl", F.lit(1)).alias("v"), "l_returnflag")
    out = gt.small_rank_sums(g, ["site", "k"], "v", F.col("l_returnflag") != "N")
    return out.select("site", "k", "n1", "n2", ((F.col("p") > 0) & (F.col("p") < 1) & F.abs("z").between(0, 40)).alias("inside"))


@query("q40_gq_stats", f"WITH {GT} SELECT site, {r(f'avg({QUAL})')} AS gq_mean, {r(f'stddev_samp({QUAL})')} AS gq_stdev, count(*) FILTER (NOT ({CALLED})) AS n_no_call FROM gt GROUP BY site")
def gq_stats(spark, d):
    pl = F.col("pl")
    return genotypes(spark, d).groupBy("site").agg(rounded(F.avg(gt.quality(pl))).alias("gq_mean"), rounded(F.stddev_samp(gt.quality(pl))).alias("gq_stdev"), F.count_if(~gt.is_called(pl)).alias("n_no_call"))


@query("q40_sample_list", f"WITH {GT} SELECT site, string_agg(DISTINCT CAST(sample AS VARCHAR), ',' ORDER BY CAST(sample AS VARCHAR)) AS samples FROM gt WHERE {CALLED} AND {BEST} > 0 GROUP BY site")
def sample_list(spark, d):
    pl = F.col("pl")
    g = genotypes(spark, d).where(gt.is_called(pl) & (gt.best(pl) > 0))
    return g.groupBy("site").agg(F.array_join(F.sort_array(F.collect_set(F.col("sample").cast("string"))), ",").alias("samples"))


@query("q41_coverage_outlier", f"WITH {GT}, t AS (SELECT site, CAST(sum(dp) AS BIGINT) AS total FROM gt GROUP BY site) SELECT site, total FROM t WHERE total > 0 AND total > 0.9 * (SELECT median(total) FROM t WHERE total > 0) AND total < 1.2 * (SELECT avg(total) FROM t WHERE total > 0)")
def coverage_outlier(spark, d):
    totals = genotypes(spark, d).groupBy("site").agg(F.sum("dp").alias("total"))
    return an.coverage_outliers(totals, "total", 0.9, 1.2)


@query("q52_joint_call_micro")
def joint_call_micro(spark, d):
    """The whole pipeline over the driver's rows read as single-sample records."""
    from . import joint

    return joint.called(joint.records(spark, d))
