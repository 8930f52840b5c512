"""Queries on annotations, distributions, allele strings and genotype clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions import models, strings
from ..functions import statistics as st
from ..operators import gates
from ..operators import genotypes as gt
from .genotype_queries import AS_STRANDS, BEST, r
from .registry import query
from .views import AL, DNA, GT, allele_rows, dna, genotypes, rounded, table

LF = "(lgamma({0} + 1) / ln(10))"


@query("q55_number_of_genotypes", "SELECT DISTINCT CAST(p_size % 6 + 1 AS BIGINT) AS ploidy, p_partkey % 7 + 1 AS alleles, CAST(factorial(CAST(p_size % 6 + p_partkey % 7 + 1 AS INT)) // (factorial(CAST(p_size % 6 + 1 AS INT)) * factorial(CAST(p_partkey % 7 AS INT))) AS BIGINT) AS n FROM part")
def number_of_genotypes(spark, d):
    ploidy, alleles = (F.col("p_size") % 6 + 1).cast("long"), F.col("p_partkey") % 7 + 1
    return table(spark, d, "part").select(ploidy.alias("ploidy"), alleles.alias("alleles"), dist.number_of_genotypes(ploidy, alleles).alias("n")).distinct()


@query("q55_allele_pair", "WITH p AS (SELECT i, j, i * (i + 1) // 2 + j AS idx FROM range(0, 60) a(i), range(0, 60) b(j) WHERE j <= i) SELECT DISTINCT p_partkey AS key, j AS first, i AS second FROM part JOIN p ON idx = p_partkey % 1500")
def allele_pair(spark, d):
    pair = dist.allele_pair(F.col("p_partkey") % 1500)
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), pair["first"].alias("first"), pair["second"].alias("second"))


@query("q55_genotype_ways", f"WITH {GT}, g AS (SELECT DISTINCT line % 3 AS a, sample % 3 AS b, dp % 3 AS c FROM gt) SELECT CAST(a AS BIGINT) AS a, b, c, {r('log10(CASE WHEN a = b AND b = c THEN 1 WHEN a = b OR b = c OR a = c THEN 3 ELSE 6 END)')} AS ways FROM g")
def genotype_ways(spark, d):
    g = genotypes(spark, d).select((F.col("line") % 3).alias("a"), (F.col("sample") % 3).alias("b"), (F.col("dp") % 3).alias("c")).distinct()
    return g.select("a", "b", "c", rounded(dist.genotype_ways(F.array("a", "b", "c"))).alias("ways"))


@query(
    "q55_distributions",
    f"""WITH {GT}, x AS (SELECT DISTINCT CAST(line AS DOUBLE) AS k, CAST(dp AS DOUBLE) + 7 AS n FROM gt)
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n,
  {r(f"{LF.format('n')} - {LF.format('k')} - {LF.format('(n - k)')} + k * log10(CAST(0.3 AS DOUBLE)) + (n - k) * log10(CAST(0.7 AS DOUBLE))")} AS binomial,
  {r(f"{LF.format('(n + 3)')} - {LF.format('k')} - {LF.format('(n - k)')} - {LF.format('3')} + k * log10(CAST(0.2 AS DOUBLE)) + (n - k) * log10(CAST(0.5 AS DOUBLE)) + 3 * log10(CAST(0.3 AS DOUBLE))")} AS multinomial,
  {r(f"{LF.format('n')} - {LF.format('k')} - {LF.format('(n - k)')} + (lgamma(k + 2) + lgamma(n - k + 3) - lgamma(n + 5) - lgamma(2) - lgamma(3) + lgamma(5)) / ln(10)")} AS beta_binomial,
  {r(f"{LF.format('n')} - {LF.format('k')} - {LF.format('(n - k)')} + (lgamma(3.5) - lgamma(3.5 + n) + lgamma(k + 1.5) - lgamma(1.5) + lgamma(n - k + 2) - lgamma(2)) / ln(10)")} AS dirichlet_multinomial,
  {r("exp(-0.5 * ((k - n / 5) / 2) ** 2) / (2 * sqrt(2 * pi()))")} AS normal FROM x""",
)
def distributions(spark, d):
    x = genotypes(spark, d).select(F.col("line").cast("double").alias("k"), (F.col("dp") + 7).cast("double").alias("n")).distinct()
    k, n = F.col("k"), F.col("n")
    return x.select(
        k.cast("long").alias("k"), n.cast("long").alias("n"), rounded(dist.log10_binomial(n, k, F.log10(F.lit(0.3)))).alias("binomial"),
        rounded(dist.log10_multinomial_probability(F.array(k, n - k, F.lit(3.0)), F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))).alias("multinomial"),
        rounded(dist.log10_beta_binomial(n, k, F.lit(2.0), F.lit(3.0))).alias("beta_binomial"),
        rounded(dist.log10_dirichlet_multinomial(F.array(k, n - k), F.array(F.lit(1.5), F.lit(2.0)))).alias("dirichlet_multinomial"),
        rounded(dist.normal_density(k, n / 5, F.lit(2.0))).alias("normal"),
    )


@query("q55_custom_prior", "WITH v AS (SELECT p_size AS i, count(*) / CAST((SELECT count(*) FROM part) * 2 AS DOUBLE) AS p FROM part GROUP BY 1) SELECT CAST(i AS BIGINT) AS ac, floor(log10(p) * 10000 + 0.5) / 10000 AS log10_prior FROM v UNION ALL SELECT 0, floor(log10(0.5) * 10000 + 0.5) / 10000")
def custom_prior(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    shares = {row["p_size"]: row["n"] / (2 * n) for row in p.groupBy("p_size").agg(F.count("*").alias("n")).collect()}  # sizes are 1 to 50
    prior = dist.custom_prior([shares.get(k, 0.0) for k in range(1, 51)], 50)
    rows = [(k, float(v)) for k, v in enumerate(prior) if v > float("-inf")]
    return spark.createDataFrame(rows, "ac long, p double").select("ac", rounded(F.col("p")).alias("log10_prior"))


@query("q55_array_arithmetic", f"WITH {GT} SELECT site, CAST(sum(p0 + p1 + p2) AS BIGINT) AS total, CAST(sum(p0 * dp + p1 * line) AS BIGINT) AS product, {r('sum(sqrt((p0 * p0 + p1 * p1 + p2 * p2) / CAST(3 AS DOUBLE)))', 1000)} AS rms, CAST(sum(CASE WHEN p0 <= p1 AND p0 <= p2 THEN 0 WHEN p1 <= p2 THEN 1 ELSE 2 END) AS BIGINT) AS least FROM gt GROUP BY site")
def array_arithmetic(spark, d):
    pl = F.col("pl")
    product = dist.array_sum(dist.elementwise(F.slice(pl, 1, 2), F.array("dp", "line"), lambda a, b: (a * b).cast("double")))
    g = genotypes(spark, d).groupBy("site")
    return g.agg(F.sum(dist.array_sum(pl)).cast("long").alias("total"), F.sum(product).cast("long").alias("product"), rounded(F.sum(dist.root_mean_square(pl)), 3).alias("rms"), F.sum(dist.index_of_least(pl)).alias("least"))


@query("q55_phred_conversions", f"WITH {GT}, q AS (SELECT DISTINCT p0 AS q FROM gt) SELECT CAST(q AS BIGINT) AS q, {r('pow(10, -q / 10.0)', 1000000)} AS error, CAST(greatest(1, q) AS BIGINT) AS again FROM q")
def phred_conversions(spark, d):
    q = genotypes(spark, d).select(F.get("pl", F.lit(0)).alias("q")).distinct()
    return q.select(F.col("q").cast("long").alias("q"), rounded(dist.to_error(F.col("q")), 6).alias("error"), dist.to_quality(dist.to_error(F.col("q"))).cast("long").alias("again"))


@query("q55_likelihood_round_trip", f"WITH {GT} SELECT site, CAST(sum(p0 - least(p0, p1, p2)) AS BIGINT) AS s0, CAST(sum(p1 - least(p0, p1, p2)) AS BIGINT) AS s1, CAST(sum(p2 - least(p0, p1, p2)) AS BIGINT) AS s2 FROM gt GROUP BY site")
def likelihood_round_trip(spark, d):
    pl = st.phred_likelihoods(st.genotype_likelihoods(F.col("pl")))
    g = genotypes(spark, d).select("site", pl.alias("pl"))
    return g.groupBy("site").agg(*(F.sum(F.get("pl", F.lit(k))).cast("long").alias(f"s{k}") for k in range(3)))


@query("q56_mle_frequency", f"WITH {GT}, m AS (SELECT site, CAST(sum({BEST}) AS BIGINT) AS ac, count(*) AS n FROM gt GROUP BY site) SELECT site, ac AS mleac, {r('least(1, ac / (1.5 * n))')} AS mleaf FROM m")
def mle_frequency(spark, d):
    g = genotypes(spark, d).groupBy("site").agg(F.sum(gt.copies(gt.best(F.col("pl")))).alias("mleac"), F.count("*").alias("n"))
    return g.select("site", "mleac", rounded(gt.mle_frequency(F.col("mleac"), 1.5 * F.col("n"))).alias("mleaf"))


@query("q56_allele_fraction", f"WITH {GT} SELECT site, {r('sum(line / CAST(dp + line + p2 AS DOUBLE))', 1000)} AS first, {r('sum(p2 / CAST(dp + line + p2 AS DOUBLE))', 1000)} AS second FROM gt GROUP BY site")
def allele_fraction(spark, d):
    ad = F.array(F.col("dp"), F.col("line"), F.get("pl", F.lit(2)).cast("long"))
    g = genotypes(spark, d).select("site", gt.allele_fractions(ad).alias("f"))
    return g.groupBy("site").agg(*(rounded(F.sum(F.get("f", F.lit(k))), 3).alias(n) for k, n in enumerate(("first", "second"))))


@query("q56_strand_table_min_count", f"WITH {GT}, g AS (SELECT site, sample, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus <> 'F') AS r FROM gt GROUP BY ALL) SELECT site, CAST(coalesce(sum(f) FILTER (f + r > 2), 0) AS BIGINT) AS f, CAST(coalesce(sum(r) FILTER (f + r > 2), 0) AS BIGINT) AS r FROM g GROUP BY site")
def strand_table_min_count(spark, d):
    g = genotypes(spark, d).groupBy("site", "sample").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") != "F").alias("r"))
    out = gt.summed_strands(g.withColumn("sb", F.array("f", "r", F.lit(0), F.lit(0))), ["site"], "sb", 2)
    return out.select("site", F.coalesce("rf", F.lit(0)).alias("f"), F.coalesce("rr", F.lit(0)).alias("r"))


@query(
    "q56_variant_depth",
    f"""WITH {GT}, g AS (SELECT site, dp, line, p2, CASE WHEN line - 1 > 0 AND p2 - 14 > 1 THEN line - 1 + p2 - 14 END AS strict, CASE WHEN line - 1 + p2 - 14 <> 0 THEN line - 1 + p2 - 14 ELSE dp END AS loose FROM gt WHERE {BEST} > 0)
SELECT site, CAST(CASE WHEN coalesce(sum(strict), 0) > 0 THEN sum(strict) ELSE sum(loose) END AS BIGINT) AS depth FROM g GROUP BY site""",
)
def variant_depth(spark, d):
    ad = F.array(F.col("line") - 1, F.get("pl", F.lit(2)).cast("long") - 14)
    g = genotypes(spark, d).withColumn("ad", ad)
    return gt.quality_depth(g, ["site"], "pl", "ad", "dp", F.get(ad, F.lit(0)) > 0)


@query("q56_as_quality_by_depth", f"WITH {GT} SELECT site, line AS allele, {r('-10 * sum(-p0 / 10.0) / (sum(dp) + sum(p2))')} AS qd FROM gt GROUP BY ALL HAVING sum(dp) + sum(p2) > 0")
def as_quality_by_depth(spark, d):
    g = genotypes(spark, d).groupBy("site", F.col("line").alias("allele")).agg(F.sum(-F.get("pl", F.lit(0)) / 10.0).alias("q"), F.sum("dp").alias("own"), F.sum(F.get("pl", F.lit(2)).cast("long")).alias("ref"))
    return g.where("own + ref > 0").select("site", "allele", rounded(gt.allele_quality_by_depth(F.col("q"), F.col("own"), F.col("ref"))).alias("qd"))


@query(
    "q56_as_fisher_strand",
    f"""WITH {GT}, {AS_STRANDS}, y AS (SELECT *, greatest(CAST(rf + rr + af + ar AS DOUBLE) / 200, 1) AS shrink, rf + rr + af + ar > 400 AS large FROM s),
  z AS (SELECT site, allele, {', '.join(f'CASE WHEN large THEN CAST(floor({c} / shrink) AS BIGINT) ELSE {c} END AS {n}' for c, n in zip(('rf', 'rr', 'af', 'ar'), 'abcd', strict=True))} FROM y),
  x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM z),
  l AS (SELECT *, exp(lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM x),
  o AS (SELECT *, max(p) FILTER (x = a) OVER (PARTITION BY site, allele) AS own FROM l)
SELECT site, allele, {r("-10 * log10(greatest(least(sum(p) FILTER (p <= own * (1 + 1e-7)), 1), 1e-320))", 1000)} AS fs FROM o GROUP BY site, allele""",
)
def as_fisher_strand(spark, d):
    g = genotypes(spark, d)
    alt = F.col("l_returnflag") != "N"
    own = gt.strand_table(g.where(alt).withColumnRenamed("l_returnflag", "allele"), ["site", "allele"], F.lit(True), F.col("l_linestatus") != "F").select("site", "allele", "af", "ar")
    ref = gt.strand_table(g, ["site"], alt, F.col("l_linestatus") != "F").select("site", "rf", "rr")
    p = own.join(ref, "site").select("site", "allele", st.fisher_p("rf", "rr", "af", "ar").alias("p"))
    return p.select("site", "allele", rounded(-10 * F.log10(F.greatest("p", F.lit(1e-320))), 3).alias("fs"))


@query(
    "q56_genotype_cleanup",
    f"""WITH {GT}, g AS (SELECT site, {BEST} AS g, dp, line FROM gt)
SELECT site, CASE WHEN g = 2 THEN '1|1' ELSE '0|1' END AS pgt, count(*) AS n, CAST(sum(CASE WHEN line = 1 THEN 99 ELSE dp END) AS BIGINT) AS dp, CAST(sum(CASE WHEN line > 4 THEN line ELSE CASE WHEN line = 1 THEN 99 ELSE dp END END) AS BIGINT) AS ad0, count(*) FILTER (g = 0 AND line = 2) AS n_dropped FROM g GROUP BY ALL""",
)
def genotype_cleanup(spark, d):
    g = genotypes(spark, d)
    best = gt.best(F.col("pl"))
    call = F.when(best == 0, F.array(F.lit(0), F.lit(0))).when(best == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))
    rows = g.select("site", "line", call.alias("gt"), F.col("dp"), F.when(F.col("line") == 1, 99).alias("min_dp"), F.lit("0|1").alias("pgt"), F.when(F.col("line") > 4, F.array("line", F.lit(0))).alias("ad"), F.array(F.lit(1)).alias("sb"), "pl")
    clean = gt.cleaned(rows, 2)
    gone = gates.empty_reference_call(F.col("gt"), F.col("pl"), F.lit(0), F.when(F.col("line") == 2, 0).otherwise(9))
    return clean.groupBy("site", "pgt").agg(F.count("*").alias("n"), F.sum("dp").cast("long").alias("dp"), F.sum(F.get("ad", F.lit(0))).cast("long").alias("ad0"), F.count_if(gone).alias("n_dropped"))


A2 = f"a2 AS (SELECT p_partkey AS key, p_partkey AS pos, 'CA' || {DNA.format('p_name', 'p_size % 5')} AS ref, 'CA' || {DNA.format('p_type', 'p_partkey % 5')} AS alt, {DNA.format('p_brand', '12')} AS after FROM part)"


def _pairs(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("pos"), F.concat(F.lit("CA"), dna("p_name", F.col("p_size") % 5)).alias("ref"), F.concat(F.lit("CA"), dna("p_type", F.col("p_partkey") % 5)).alias("alt"), dna("p_brand", 12).alias("after"))


@query("q57_forward_trim", f"WITH {A2}, c AS (SELECT *, (SELECT max(n) FROM unnest(range(0, least(length(ref), length(alt)))) u(n) WHERE left(ref, n) = left(alt, n)) AS cut FROM a2) SELECT key, pos + cut AS pos, substr(ref, cut + 1) AS ref, substr(alt, cut + 1) AS alt FROM c")
def forward_trim(spark, d):
    t = _pairs(spark, d).withColumn("t", strings.forward_trimmed(F.array("ref", "alt")))
    return t.select("key", (F.col("pos") + F.col("t.trimmed")).alias("pos"), F.get("t.alleles", F.lit(0)).alias("ref"), F.get("t.alleles", F.lit(1)).alias("alt"))


@query(
    "q57_mnp_primitives",
    f"""WITH {A2}, e AS (SELECT *, unnest(range(1, length(ref) + 1)) AS i FROM a2 WHERE length(ref) = length(alt))
SELECT key, pos + i - 1 AS pos, substr(ref, CAST(i AS INT), 1) AS ref, substr(alt, CAST(i AS INT), 1) AS alt FROM e WHERE substr(ref, CAST(i AS INT), 1) <> substr(alt, CAST(i AS INT), 1) UNION ALL SELECT key, pos, ref, alt FROM a2 WHERE length(ref) <> length(alt)""",
)
def mnp_primitives(spark, d):
    return strings.primitives(_pairs(spark, d).drop("after"), "ref", "alt", "pos")


@query(
    "q57_tandem_repeats",
    f"""WITH {A2}, b AS (SELECT *, substr(ref, 2) AS a, substr(alt, 2) AS b FROM a2 WHERE length(ref) <> length(alt)), l AS (SELECT *, CASE WHEN length(a) > length(b) THEN a ELSE b END AS longer FROM b),
  u AS (SELECT *, left(longer, (SELECT min(k) FROM unnest(range(1, length(longer) + 1)) t(k) WHERE length(longer) % k = 0 AND repeat(left(longer, k), length(longer) // k) = longer)) AS unit FROM l)
SELECT key, unit, (SELECT max(k) FROM unnest(range(0, 40)) t(k) WHERE length(a || after) >= k * length(unit) AND starts_with(a || after, repeat(unit, k))) AS ref_repeats, (SELECT max(k) FROM unnest(range(0, 40)) t(k) WHERE length(b || after) >= k * length(unit) AND starts_with(b || after, repeat(unit, k))) AS alt_repeats FROM u""",
)
def tandem_repeats(spark, d):
    t = _pairs(spark, d).repartition("key").select("key", strings.tandem_repeat(F.col("ref"), F.col("alt"), F.col("after")).alias("t")).where("t is not null")
    return t.select("key", "t.unit", F.col("t.ref_repeats").cast("long").alias("ref_repeats"), F.col("t.alt_repeats").cast("long").alias("alt_repeats"))


@query("q57_reference_context", f"WITH {A2} SELECT key, substr('NNN' || after || 'NNN', CAST(key % 12 AS INT) + 1, 7) AS bases FROM a2")
def reference_context(spark, d):
    return _pairs(spark, d).select("key", strings.context(F.col("after"), F.lit(1), F.col("key") % 12 + 1, 3).alias("bases"))


@query("q57_allele_tests", f"WITH {A2} SELECT key, CASE WHEN ref = alt THEN 'SAME' WHEN length(ref) = length(alt) THEN 'MNP' ELSE 'INDEL' END AS kind, abs(length(ref) - length(alt)) % 3 <> 0 AS frameshift, (right(ref, 1) || right(alt, 1)) IN ('AG', 'GA', 'CT', 'TC') AS transition FROM a2")
def allele_tests(spark, d):
    from ..operators import alleles as al

    p = _pairs(spark, d)
    ref, alt = F.col("ref"), F.col("alt")
    kind = F.when(ref == alt, "SAME").when(F.length(ref) == F.length(alt), "MNP").otherwise(al.variant_type(ref, F.array(alt)))
    return p.select("key", kind.alias("kind"), al.is_frameshift(ref, alt).alias("frameshift"), al.is_transition(F.right(ref, F.lit(1)), F.right(alt, F.lit(1))).alias("transition"))


@query("q57_variant_type", f"WITH {AL} SELECT key, CASE WHEN len(list_distinct(k)) > 1 THEN 'MIXED' ELSE k[1] END AS kind FROM (SELECT key, [CASE WHEN a LIKE '<%' OR a = '*' THEN 'SYMBOLIC' WHEN length(a) = 1 AND length(ref) = 1 THEN 'SNP' ELSE 'INDEL' END FOR a IN alts[1:2]] AS k FROM al)")
def variant_type(spark, d):
    from ..operators import alleles as al

    return allele_rows(spark, d).select("key", al.variant_type(F.col("ref"), F.col("alts")).alias("kind"))


@query("q57_allele_fields", "SELECT p_partkey AS key, printf('%.2f,0.00|%.2f', CAST(p_size AS DOUBLE), p_size / 4.0::DOUBLE) AS again, CAST(p_size AS DOUBLE) + p_size / 4.0::DOUBLE AS total FROM part")
def allele_fields(spark, d):
    size = F.col("p_size")
    text = F.concat(size.cast("string"), F.lit(",nan|"), (size / 4.0).cast("string"))
    v = table(spark, d, "part").select(F.col("p_partkey").alias("key"), strings.allele_fields(text).alias("v"))
    return v.select("key", strings.allele_text(F.col("v")).alias("again"), dist.array_sum(F.flatten("v")).alias("total"))


PL6 = "six AS (SELECT site, sample, line, dp, p0, p1, p2, [p0, p1, p2, p0 + p1, p1 + p2, p0 + p2] AS pl FROM gt)"


def _six(spark, d):
    p = [F.get("pl", F.lit(k)) for k in range(3)]
    return genotypes(spark, d).withColumn("pl", F.array(p[0], p[1], p[2], p[0] + p[1], p[1] + p[2], p[0] + p[2]))


@query(
    "q57_likeliest_alternates",
    f"""WITH {GT}, {PL6}, b AS (SELECT site, list_position(pl, list_min(pl)) - 1 AS b, (pl[1] - list_min(pl)) / CAST(10 AS DOUBLE) AS gain FROM six),
  e AS (SELECT site, gain, unnest(CASE b WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [1] WHEN 3 THEN [0, 2] WHEN 4 THEN [1, 2] ELSE [2] END) AS a FROM b), s AS (SELECT site, a, sum(gain) AS s FROM e WHERE a > 0 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY s DESC, a) AS k FROM s) SELECT site, string_agg(a, ',' ORDER BY a) AS kept FROM k WHERE k <= 1 GROUP BY site""",
)
def likeliest_alternates(spark, d):
    from ..operators import alleles as al

    return al.best_alleles_kept(_six(spark, d), ["site"], "pl", 3, 1).select("site", F.array_join("kept", ",").alias("kept"))


@query(
    "q57_biallelic_calls",
    f"""WITH {GT}, {PL6}, c AS (SELECT *, [line % 3, sample % 3] AS g, k FROM six, (VALUES (1), (2)) t(k)), q AS (SELECT site, k, CASE k WHEN 1 THEN [pl[1], pl[2], pl[3]] ELSE [pl[1], pl[4], pl[6]] END AS pl, CASE k WHEN 1 THEN line ELSE dp END AS a, (g[1] = 0 OR g[2] = 0 OR g[1] = g[2]) AS called, CAST(g[1] = k AS INT) + CAST(g[2] = k AS INT) AS n FROM c)
SELECT site, CAST(k AS BIGINT) AS alt_no, CAST(sum(pl[1] - list_min(pl)) AS BIGINT) AS s0, CAST(sum(pl[2] - list_min(pl)) AS BIGINT) AS s1, CAST(sum(pl[3] - list_min(pl)) AS BIGINT) AS s2, CAST(sum(a) AS BIGINT) AS ad, CAST(sum(CASE WHEN called THEN n ELSE -2 END) AS BIGINT) AS copies FROM q GROUP BY ALL""",
)
def biallelic_calls(spark, d):
    from ..operators import alleles as al

    rows = _six(spark, d).select("site", "pl", F.array(F.lit(0).cast("long"), "line", "dp").alias("ad"), F.array((F.col("line") % 3).cast("int"), (F.col("sample") % 3).cast("int")).alias("g"))
    out = al.biallelic_calls(rows, "pl", "ad", "g", 2)
    sums = [F.sum(F.get("pl", F.lit(k))).cast("long").alias(f"s{k}") for k in range(3)]
    return out.groupBy("site", F.col("alt_no").cast("long").alias("alt_no")).agg(*sums, F.sum(F.get("ad", F.lit(1))).alias("ad"), F.sum(F.get("gt", F.lit(0)) + F.get("gt", F.lit(1))).cast("long").alias("copies"))


@query("q56_rms_mq_older_field", f"WITH {GT}, s AS (SELECT site, sum(CASE WHEN line > 3 THEN dp * dp WHEN line > 1 THEN p2 * 60 END) AS s, sum(CASE WHEN line > 3 THEN line WHEN line > 1 THEN dp - dp // 2 END) AS n FROM gt GROUP BY site) SELECT site, {r('CASE WHEN n > 0 THEN sqrt(s / CAST(n AS DOUBLE)) END')} AS mq FROM s")
def rms_mq_older_field(spark, d):
    line, dp = F.col("line"), F.col("dp")
    g = genotypes(spark, d).select("site", "dp", F.when(line > 3, F.array(dp * dp, line)).alias("raw"), F.when((line > 1) & (line <= 3), F.get("pl", F.lit(2)).cast("long") * 60).alias("older"))
    out = gt.root_mean_square_quality(g, ["site"], "raw", "older", "dp", F.floor(dp / 2))
    return out.select("site", rounded(F.col("mq")).alias("mq"))


@query("q56_quality_by_depth_jitter", f"WITH {GT}, s AS (SELECT site, sum(p0 * dp) / CAST(sum(line) AS DOUBLE) AS qd FROM gt GROUP BY site) SELECT site, CASE WHEN qd < 35 THEN {r('qd')} ELSE -1 END AS qd, true AS plausible FROM s")
def quality_by_depth_jitter(spark, d):
    s = genotypes(spark, d).groupBy("site").agg(F.sum(F.get("pl", F.lit(0)) * F.col("dp")).alias("q"), F.sum("line").alias("n"))
    qd, raw = gt.quality_by_depth(F.col("q"), F.col("n"), [F.col("site")]), F.col("q") / F.col("n")
    return s.select("site", F.when(raw < 35, rounded(raw)).otherwise(-1.0).alias("qd"), ((qd > 0) & ((raw >= 35) | (qd == raw)) & (qd < 60)).alias("plausible"))


@query("q60_two_pass_filter", f"WITH {GT}, c AS (SELECT site, p0, count(*) AS n FROM gt GROUP BY ALL), k AS (SELECT site, p0, sum(p0 * n) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS mean FROM c WINDOW w AS (PARTITION BY site ORDER BY p0 ROWS UNBOUNDED PRECEDING)), t AS (SELECT site, max(p0) AS t FROM k WHERE mean <= 20 GROUP BY site) SELECT gt.site, count(*) FILTER (t IS NULL OR p0 > t) AS n_failed, count(*) AS n FROM gt LEFT JOIN t USING (site) GROUP BY gt.site")
def two_pass_filter(spark, d):
    from ..operators import filters

    g = genotypes(spark, d).select("site", F.get("pl", F.lit(0)).cast("long").alias("v"))
    return filters.two_pass(g, ["site"], "v", 20.0).groupBy("site").agg(F.count_if("failed").alias("n_failed"), F.count("*").alias("n"))


@query("q33_tetraploid_model")
def tetraploid_model(spark, d):
    p = [F.get("pl", F.lit(k)) for k in range(3)]
    g = genotypes(spark, d).select("site", F.array(p[0], p[1], p[2], p[1] + p[2], p[0] + p[2]).alias("pl"))
    out = models.exact(g, ["site"], 0.001, 4)
    return out.select("site", "n", rounded(F.col("qual"), 2).alias("qual"), "mle_ac")
