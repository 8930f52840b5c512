"""Queries on feature sources, filters, somatic models, and annotation registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alignment
from ..operators import annotations as ann
from ..operators import features, filters, somatic
from ..operators import genotypes as gt
from ..sources import headers, merge, scratch
from . import jobs
from .genotype_queries import BEST, CALLED, r
from .registry import query
from .views import AL, DNA, GT, REC, REG, allele_rows, dna, genotypes, records, regions, rounded, table


@query("q59_feature_lookup", f"WITH {REG}, k AS (SELECT contig, min(start) AS s, min(start) + 3 AS e, contig * 100 + start % 97 AS name FROM reg GROUP BY contig, contig * 100 + start % 97) SELECT reg.key, count(k.name) AS n, coalesce(min(k.name), -1) AS first FROM reg LEFT JOIN k ON k.contig = reg.contig AND k.s <= reg.stop AND reg.start <= k.e GROUP BY reg.key")
def feature_lookup(spark, d):
    r_ = regions(spark, d)
    register = features.Registry(spark)
    known = r_.groupBy("contig", (F.col("contig") * 100 + F.col("start") % 97).alias("name")).agg(F.min("start").alias("start")).withColumn("end", F.col("start") + 3)
    path = f"{scratch.folder(spark)}/known.parquet"
    known.write.parquet(path)
    register.add("known", path)
    hits = features.lookup(r_.select("key", "contig", "start", "end"), register.get("known"))
    return hits.groupBy("key").agg(F.count("name_r").alias("n"), F.coalesce(F.min("name_r"), F.lit(-1)).alias("first"))


@query("q59_lookup_by_start", f"WITH {REG}, k AS (SELECT DISTINCT contig, start FROM reg WHERE priority < '2') SELECT reg.key, k.start IS NOT NULL AS found FROM reg LEFT JOIN k USING (contig, start)")
def lookup_by_start(spark, d):
    r_ = regions(spark, d)
    known = r_.where("priority < '2'").select("contig", "start").distinct()
    return features.lookup(r_.select("key", "contig", "start"), known, start_only=True).select("key", F.col("start_r").isNotNull().alias("found"))


@query("q59_records_on_sites", f"WITH {REC}, {REG}, s AS (SELECT DISTINCT contig, start FROM reg) SELECT contig, count(*) AS n, CAST(sum(dp) AS BIGINT) AS dp FROM rec SEMI JOIN s USING (contig, start) GROUP BY contig")
def records_on_sites(spark, d):
    sites = regions(spark, d).select("contig", F.col("start").alias("pos")).distinct()
    return features.on_sites(records(spark, d), sites).groupBy("contig").agg(F.count("*").alias("n"), F.sum("dp").alias("dp"))


@query(
    "q59_expression_join",
    f"""WITH {AL}, res AS (SELECT contig, pos, arg_min(ref, key) AS rref, arg_min(alts, key) AS ralts, arg_min([size, size + 1, size + 2], key) AS v FROM al WHERE key % 2 = 0 GROUP BY ALL)
SELECT al.key, array_to_string([coalesce(CAST(CASE WHEN rref = ref THEN v[list_position(ralts, a)] END AS VARCHAR), '.') FOR a IN alts], ',') AS v FROM al LEFT JOIN res USING (contig, pos)""",
)
def expression_join(spark, d):
    a = allele_rows(spark, d).withColumnRenamed("pos", "start")
    size = F.col("size")
    resource = a.where("key % 2 = 0").select("contig", "start", "ref", "alts", F.col("key").alias("rec_no"), F.array(size, size + 1, size + 2).alias("v"))
    out = features.expression(a.select("key", "contig", "start", "ref", "alts"), resource, "v")
    return out.select("key", F.array_join(F.transform("v", lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias("v"))


@query("q59_group_on_start", f"WITH {AL} SELECT contig, pos AS \"start\", count(*) AS n, string_agg(ref, ',' ORDER BY key) AS refs FROM al GROUP BY ALL")
def group_on_start(spark, d):
    rows = allele_rows(spark, d).withColumnRenamed("pos", "start")
    out = features.grouped_on_start(rows, ["ref"], ["key"])
    return out.select("contig", "start", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda x: x["ref"]), ",").alias("refs"))


@query("q59_rightmost_overlap", f"WITH {REG} SELECT a.key, arg_max(b.key, (b.start, b.key)) AS feature FROM reg a JOIN reg b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop AND a.priority < '3' AND b.priority >= '3' GROUP BY a.key")
def rightmost_overlap(spark, d):
    r_ = regions(spark, d)
    cols = ["key", "contig", "start", "end"]
    out = features.rightmost(r_.where("priority < '3'").select(*cols), r_.where("priority >= '3'").select(*cols), ["key"])
    return out.select("key", F.col("feature.key_r").alias("feature"))


@query("q59_interval_relations", f"WITH {REG}, w AS (SELECT key, contig, start AS a, stop AS b, lead(start) OVER w AS c, lead(stop) OVER w AS d FROM reg WINDOW w AS (PARTITION BY contig ORDER BY start, stop, key)) SELECT key, a <= c AND d <= b AS contains, a - 5 <= d AND c <= b + 5 AS near, CASE WHEN greatest(a, c) <= least(b, d) THEN least(b, d) - greatest(a, c) + 1 END AS shared, CASE WHEN a <= d + 1 AND c <= b + 1 THEN greatest(b, d) - least(a, c) + 1 END AS joined FROM w WHERE c IS NOT NULL")
def interval_relations(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("contig").orderBy("start", "end", "key")
    rows = regions(spark, d).select("key", "start", "end", F.lead("start").over(w).alias("c"), F.lead("end").over(w).alias("d")).where("c is not null")
    x = [F.col(c) for c in ("start", "end", "c", "d")]
    length = lambda s: s["end"] - s["start"] + 1
    return rows.select("key", features.contains(*x).alias("contains"), features.within_margin(*x, 5).alias("near"), length(features.meet(*x)).alias("shared"), length(features.contiguous(*x)).alias("joined"))


@query("q59_spanning_interval", f"WITH {REG} SELECT contig, min(start) AS \"start\", max(stop) AS \"end\" FROM reg GROUP BY contig")
def spanning_interval(spark, d):
    return features.spanning(regions(spark, d), ["contig"])


@query("q59_zipped_inputs", f"WITH {GT}, s AS (SELECT site, line % 2 AS file, CAST(sum(dp) AS BIGINT) AS dp FROM gt GROUP BY ALL), b AS (SELECT site FROM s GROUP BY 1 HAVING count(*) = 2) SELECT site, string_agg(dp, ',' ORDER BY file) AS dps FROM s SEMI JOIN b USING (site) GROUP BY site")
def zipped_inputs(spark, d):
    s = genotypes(spark, d).groupBy("site", (F.col("line") % 2).alias("half")).agg(F.sum("dp").alias("dp"))
    both = s.groupBy("site").agg(F.count("*").alias("n")).where("n = 2").select("site")
    rows = [s.where(F.col("half") == k).join(both, "site", "left_semi").select("site", "dp") for k in range(2)]
    return merge.zipped(rows, ["site"]).select("site", F.array_join(F.transform("rows", lambda x: x["dp"].cast("string")), ",").alias("dps"))


READS = f"""rd AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber * 331 + l_partkey * 37 & 4095 AS BIGINT) AS flags, l_partkey % 8 AS contig, CAST(l_quantity AS BIGINT) - 2 AS start, CAST(l_quantity AS BIGINT) - 2 + l_linenumber - CASE WHEN l_partkey % 11 = 0 THEN 12 ELSE 0 END AS stop, CAST(l_suppkey % 4 * 85 AS BIGINT) AS mapq,
  ['10M', '3S7M', '4M2I4M', '5M1I1D4M', '2D8M', '10I', '3M50N7M', '9M'][CAST(l_partkey % 8 + 1 AS INT)] AS cigar, l_suppkey % 8 AS mate_contig, l_linenumber - 3 AS tlen, {DNA.format('CAST(l_partkey AS VARCHAR)', 'CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE 10 END')} AS seq, repeat('I', CAST(9 + (l_suppkey % 3 > 0)::INT AS INT)) AS qual,
  CASE WHEN l_partkey % 5 > 0 THEN 'g1' END AS rg, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 2 END AS oa_contig, CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey % 2 END AS mate_oa_contig, CASE WHEN l_partkey % 8 < 7 THEN 40 END AS length FROM lineitem)"""


def _reads(spark, d):
    li = table(spark, d, "lineitem")
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    start = F.col("l_quantity").cast("long") - 2
    cigars = F.array(*(F.lit(x) for x in ("10M", "3S7M", "4M2I4M", "5M1I1D4M", "2D8M", "10I", "3M50N7M", "9M")))
    return li.select(
        (F.col("l_orderkey") * 10 + line).alias("id"), (line * 331 + part * 37).bitwiseAND(4095).cast("long").alias("flags"), (part % 8).alias("contig"), start.alias("start"), (start + line - F.when(part % 11 == 0, 12).otherwise(0)).alias("end"),
        (supp % 4 * 85).alias("mapq"), F.get(cigars, (part % 8).cast("int")).alias("cigar"), (supp % 8).alias("mate_contig"), (line - 3).alias("tlen"), dna(part.cast("string"), F.when(part % 9 == 0, 0).otherwise(10)).alias("seq"),
        F.repeat(F.lit("I"), 9 + (supp % 3 > 0).cast("int")).alias("qual"), F.when(part % 5 > 0, "g1").alias("rg"), F.when(part % 3 == 0, part % 2).alias("oa_contig"), F.when(supp % 3 == 0, supp % 2).alias("mate_oa_contig"), F.when(part % 8 < 7, 40).alias("length"),
    )


CONSUMED = "(SELECT coalesce(sum(CAST(x[:-2] AS BIGINT)), 0) FROM unnest(regexp_extract_all(cigar, '[0-9]+[{0}]')) u(x))"
READ_SQL = {
    "all": "true", "no_n_in_cigar": "cigar NOT LIKE '%N%'", "first_of_pair": "flags & 1 > 0 AND flags & 64 > 0", "second_of_pair": "flags & 1 > 0 AND flags & 128 > 0",
    "good_cigar": "cigar NOT IN ('5M1I1D4M', '2D8M')", "fragment_length": "tlen <> 0", "bases_match_qualities": "length(seq) = length(qual)", "read_group": "rg IS NOT NULL", "mapped": "flags & 4 = 0",
    "mapping_quality_known": "mapq <> 255", "mapping_quality_not_zero": "mapq <> 0", "mate_on_contig": "flags & 1 = 0 OR flags & 8 > 0 OR (flags & 4 = 0 AND contig = mate_contig)",
    "mate_on_other_strand": "flags & 1 > 0 AND flags & 12 = 0 AND (flags & 16 > 0) <> (flags & 32 > 0)", "reference_length": "cigar <> '10I'", "not_duplicate": "flags & 1024 = 0", "not_secondary": "flags & 256 = 0",
    "not_supplementary": "flags & 2048 = 0", "paired": "flags & 1 > 0", "passes_vendor": "flags & 512 = 0", "proper_pair": "flags & 2 > 0", "primary": "flags & 2304 = 0",
    "length_equals_cigar": f"flags & 4 > 0 OR {CONSUMED.format('MIS=X')} = length(seq)", "has_bases": "length(seq) > 0", "valid_start": "flags & 4 > 0 OR start > 0", "valid_end": "flags & 4 > 0 OR stop - start + 1 >= 0",
    "not_chimeric": "oa_contig IS NULL OR mate_oa_contig IS NULL OR oa_contig = mate_oa_contig", "agrees_with_header": "flags & 4 > 0 OR (length IS NOT NULL AND start <= length)",
}


@query("q60_all_read_filters", f"WITH {READS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (coalesce({t}, false)) AS n FROM rd" for n, t in READ_SQL.items()) + ")")
def all_read_filters(spark, d):
    known = filters.read_filters()
    sums = _reads(spark, d).agg(*(F.count_if(f.passed).alias(n) for n, f in known.items()))
    return sums.unpivot([], list(known), "filter", "n")


@query("q60_wellformed_reads", f"WITH {READS} SELECT contig, count(*) AS n FROM rd WHERE {' AND '.join(f'coalesce({READ_SQL[n]}, false)' for n in ('valid_start', 'valid_end', 'agrees_with_header', 'read_group', 'bases_match_qualities', 'length_equals_cigar', 'has_bases', 'no_n_in_cigar'))} GROUP BY contig")
def wellformed_reads(spark, d):
    return _reads(spark, d).where(filters.wellformed().passed).groupBy("contig").agg(F.count("*").alias("n"))


@query(
    "q60_filter_counts",
    f"""WITH {READS} SELECT CASE WHEN NOT (flags & 4 = 0 AND flags & 1024 = 0) THEN '(mapped and not_duplicate)' WHEN flags & 1 > 0 THEN 'not paired' WHEN NOT (mapq BETWEEN 20 AND 200 OR length(seq) >= 5) THEN '(quality or length)' ELSE 'passed' END AS filter, count(*) AS n FROM rd GROUP BY 1""",
)
def filter_counts(spark, d):
    f = filters.read_filters()
    asked = [f["mapped"] & f["not_duplicate"], ~f["paired"], filters.between("quality", F.col("mapq"), 20, 200) | filters.between("length", F.length("seq"), 5)]
    return filters.counted(_reads(spark, d), asked)


@query("q60_variant_filters", f"WITH {AL} SELECT count(*) AS n_all, count(*) FILTER (NOT (len(alts) = 3 AND alts[2] = '<DEL>' AND false)) AS n_not_symbolic, count(*) FILTER (size % 3 = 0 OR size % 3 = 1) AS n_passes FROM al")
def variant_filters(spark, d):
    a = allele_rows(spark, d)
    given = F.when(F.col("size") % 3 == 1, F.array(F.lit("PASS"))).when(F.col("size") % 3 == 2, F.array(F.lit("q10")))
    f = filters.variant_filters(F.col("ref"), F.col("alts"), given)
    return a.agg(*(F.count_if(f[n].passed).alias(f"n_{n}") for n in ("all", "not_symbolic", "passes")))


@query(
    "q60_strict_validation",
    f"""WITH {AL} SELECT key, concat_ws(',', CASE WHEN size % 2 = 1 THEN 'REF' END, CASE WHEN size % 3 = 2 THEN 'IDS' END, CASE WHEN size % 5 <> 0 THEN 'ALLELES' END, CASE WHEN size % 7 = 0 THEN 'CHR_COUNTS' END) AS failed FROM al""",
)
def strict_validation(spark, d):
    a = allele_rows(spark, d)
    size = F.col("size")
    calls = F.when(size % 5 == 0, F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(-1)))).otherwise(F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(1), F.lit(-1))))
    counts = F.when(size % 5 == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(0)))
    failed = filters.validation(
        F.col("ref"), F.when(size % 2 == 0, F.col("ref")).otherwise(F.concat("ref", F.lit("A"))), F.when(size % 3 == 0, ".").when(size % 3 == 1, "rs1;rs2").otherwise("rs1;rs9"), F.array(F.lit("rs1"), F.lit("rs2")),
        F.slice("alts", 1, 2), calls, F.when(size % 7 == 0, 9).otherwise(3), counts,
    )
    return a.select("key", F.array_join(failed, ",").alias("failed"))


@query(
    "q60_somatic_filters",
    f"""WITH {GT}, t AS (SELECT *, [p0 / 10.0, p1 / 10.0] AS lods FROM gt)
SELECT site, failed, count(*) AS n FROM (SELECT site, concat_ws(',', CASE WHEN p0 > 53 AND p1 > 53 THEN 'multiallelic' END, CASE WHEN line = 7 THEN 'panel_of_normals' END, CASE WHEN p2 < 20 THEN 'base_quality' END, CASE WHEN dp < 30 THEN 'mapping_quality' END,
    CASE WHEN abs(dp * 500 - 3000) > 10000 THEN 'fragment_length' END, CASE WHEN line - 4 > -1 AND line - 4 < 1 THEN 'read_position' END, CASE WHEN greatest(p0, p1) / 10.0 < 5.3 THEN 'weak_evidence' END, CASE WHEN line > 2 THEN 'clustered_events' END, CASE WHEN dp - 5 <= 0 THEN 'duplicate' END,
    CASE WHEN dp / 40.0 > 0.85 THEN 'chimeric_original_alignment' END, CASE WHEN l_linestatus = 'F' AND line = 1 THEN 'strict_strand' END) AS failed FROM t) GROUP BY ALL""",
)
def somatic_filters(spark, d):
    g = genotypes(spark, d)
    p = [F.get("pl", F.lit(k)) for k in range(3)]
    dp, line = F.col("dp"), F.col("line")
    calls = g.select(
        "site", F.array(p[0] / 10.0, p[1] / 10.0).alias("lods"), F.array(F.lit(99), p[2], p[2]).alias("mbq"), F.array(F.lit(99), dp, dp).alias("mmq"), F.array(F.lit(3000), dp * 500).alias("fragment"), (line - 4).alias("mpos"), F.lit(0).alias("indel"), line.alias("ecnt"),
        (dp - 5).alias("unique_alt"), dp.alias("chimeric_alt"), F.lit(40.0).alias("alt_reads"), dp.alias("depth"), (line == 7).alias("in_panel"), F.when((F.col("l_linestatus") == "F") & (line == 1), 0).otherwise(1).alias("forward"), F.lit(1).alias("reverse"),
    )
    return calls.select("site", F.array_join(filters.somatic_filters(), ",").alias("failed")).groupBy("site", "failed").agg(F.count("*").alias("n"))


@query("q60_weighted_median", f"WITH {GT}, s AS (SELECT site, p2, sum(dp) AS w FROM gt GROUP BY ALL), k AS (SELECT *, sum(w) OVER (PARTITION BY site ORDER BY p2) AS upto, sum(w) OVER (PARTITION BY site) AS total FROM s) SELECT site, CAST(min(p2) AS BIGINT) AS median FROM k WHERE 2 * upto >= total GROUP BY site")
def weighted_median(spark, d):
    g = genotypes(spark, d).withColumn("v", F.get("pl", F.lit(2)).cast("long"))
    return filters.weighted_median(g, ["site"], "v", "dp")


@query("q60_false_discovery", f"WITH {GT}, c AS (SELECT site, p0, count(*) AS n FROM gt GROUP BY ALL), k AS (SELECT site, p0, sum(n) OVER w AS upto, sum(p0 * n) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS mean FROM c WINDOW w AS (PARTITION BY site ORDER BY p0 ROWS UNBOUNDED PRECEDING)) SELECT site, CAST(max(p0) AS BIGINT) AS threshold, CAST(max(upto) AS BIGINT) AS n FROM k WHERE mean <= 20 GROUP BY site")
def false_discovery(spark, d):
    g = genotypes(spark, d).withColumn("v", F.get("pl", F.lit(0)).cast("long"))
    return filters.false_discovery_threshold(g, ["site"], "v", 20.0)


@query("q60_near_filtered", f"WITH {REG}, w AS (SELECT contig, start, key % 7 = 0 AS bad FROM (SELECT contig, start, min(key) AS key FROM reg GROUP BY ALL)) SELECT a.contig, a.start AS \"start\", coalesce(bool_or(b.bad), false) AS near FROM w a LEFT JOIN w b ON a.contig = b.contig AND b.bad AND b.start <> a.start AND abs(a.start - b.start) <= 10 GROUP BY ALL")
def near_filtered(spark, d):
    rows = regions(spark, d).groupBy("contig", "start").agg(F.min("key").alias("key"))
    return filters.near_filtered(rows, ["contig"], "start", F.col("key") % 7 == 0, 10).select("contig", "start", "near")


@query(
    "q61_contamination",
    f"""WITH {GT}, s AS (SELECT site, dp + 40 AS t, line AS opp, line % 2 AS other, 0.01::DOUBLE + p2 / 100::DOUBLE AS f FROM gt), a AS (SELECT site, 1.5::DOUBLE * sum(other) / sum(t) AS e, greatest(sum(opp) - floor(sum(t) * (1.5::DOUBLE * sum(other) / sum(t)) / 3 + 0.5), 0) / sum(t * f) AS c, sum(t * f) AS w FROM s GROUP BY site),
  b AS (SELECT site, e, least(c, 1) AS c, w FROM a)
SELECT s.site, {r('any_value(e)', 100000)} AS error_rate, {r('any_value(c)', 100000)} AS contamination, {r('sqrt(sum((1 - f) * t * c * ((1 - c) + f * t * c))) / any_value(w)', 100000)} AS deviation FROM s JOIN b USING (site) GROUP BY s.site""",
)
def contamination(spark, d):
    rows = genotypes(spark, d).select("site", (F.col("dp") + 40).alias("t"), F.col("line").alias("opp"), (F.col("line") % 2).alias("other"), (F.lit(0.01) + F.get("pl", F.lit(2)) / 100).alias("f"))
    out = somatic.contamination(rows, ["site"], "t", "opp", "other", "f")
    return out.select("site", *(rounded(F.col(c), 5).alias(c) for c in ("error_rate", "contamination", "deviation")))


@query(
    "q61_genotype_posteriors",
    f"""WITH {GT}, c AS (SELECT site, CAST(10 + sum(2 - {BEST}) AS DOUBLE) AS a, CAST(0.01 AS DOUBLE) + sum({BEST}) AS b FROM gt GROUP BY site),
  q AS (SELECT gt.site, p0 - 10 * log10(a * (a + 1) / ((a + b) * (a + b + 1))) AS x, p1 - 10 * log10(2 * a * b / ((a + b) * (a + b + 1))) AS y, p2 - 10 * log10(b * (b + 1) / ((a + b) * (a + b + 1))) AS z FROM gt JOIN c USING (site))
SELECT site, CAST(sum(floor(x - least(x, y, z) + 0.5)) AS BIGINT) AS s0, CAST(sum(floor(y - least(x, y, z) + 0.5)) AS BIGINT) AS s1, CAST(sum(floor(z - least(x, y, z) + 0.5)) AS BIGINT) AS s2 FROM q GROUP BY site""",
)
def genotype_posteriors(spark, d):
    g = genotypes(spark, d).withColumn("ac", gt.best(F.col("pl"))).withColumn("an", F.lit(2))
    joined = g.join(somatic.panel_counts(g, ["site"], "ac", "an"), "site")
    post = joined.select("site", somatic.genotype_posteriors(F.col("pl"), F.col("counts")).alias("p"))
    return post.groupBy("site").agg(*(F.sum(F.get("p", F.lit(k))).cast("long").alias(f"s{k}") for k in range(3)))


LBIN = "((lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) / ln(10) + {k} * log10({p}) + ({n} - {k}) * log10(1 - ({p})))"


@query(
    "q61_contaminated_likelihoods",
    f"""WITH {GT}, x AS (SELECT DISTINCT line, dp + 7 AS n FROM gt), w AS (SELECT line, n, log10(0.49::DOUBLE) + {LBIN.format(n='n', k='line', p='0.95::DOUBLE * 0.001 + 0.05 * 0.3')} AS a, log10(0.21::DOUBLE) + {LBIN.format(n='n', k='line', p='0.95::DOUBLE * 0.4 + 0.05 * 0.3')} AS b, log10(0.21::DOUBLE) + {LBIN.format(n='n', k='line', p='0.95::DOUBLE * 0.6 + 0.05 * 0.3')} AS c, log10(0.09::DOUBLE) + {LBIN.format(n='n', k='line', p='0.95::DOUBLE * 0.999 + 0.05 * 0.3')} AS d FROM x)
SELECT line, n, {r('pow(10, a) / (pow(10, a) + pow(10, b) + pow(10, c) + pow(10, d))')} AS hom_ref, {r('pow(10, d) / (pow(10, a) + pow(10, b) + pow(10, c) + pow(10, d))')} AS hom_alt FROM w""",
)
def contaminated_likelihoods(spark, d):
    x = genotypes(spark, d).select("line", (F.col("dp") + 7).alias("n")).distinct()
    w = x.withColumn("w", somatic.contaminated_likelihoods(F.col("n"), F.col("line"), F.lit(0.4), F.lit(0.3), F.lit(0.05)))
    return w.select("line", "n", rounded(F.get("w", F.lit(0))).alias("hom_ref"), rounded(F.get("w", F.lit(3))).alias("hom_alt"))


@query("q61_orientation_model")
def orientation_model(spark, d):
    g = genotypes(spark, d).select("l_returnflag", (F.col("dp") + 7).alias("depth"), F.col("line").alias("alt"), (F.col("sample") % (F.col("line") + 1)).alias("f1"))
    out = somatic.orientation_model(g, ["l_returnflag"], "depth", "alt", "f1")
    return out.select("l_returnflag", "n", *(rounded(F.col(c)).alias(c) for c in ("artifact_f1r2", "artifact_f2r1")))


@query("q61_segments")
def segments(spark, d):
    daily = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "value").groupBy("event_type", "day").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return somatic.segments(daily, ["event_type"], ["day"], "v", 4, 20, 1000.0)


@query("q61_levelled_downsampling", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS level FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level, event_type) AS k FROM p) SELECT user_id, event_id FROM f WHERE k <= 4")
def levelled_downsampling(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return somatic.levelled(e, ["user_id"], "event_type", 4, ["event_id"]).select("user_id", "event_id")


@query("q61_allele_biased_downsampling", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) SELECT user_id, event_id FROM p WHERE k > floor(n * 0.4)")
def allele_biased_downsampling(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return somatic.allele_biased(e, ["user_id"], "event_type", 0.4, ["event_id"]).select("user_id", "event_id")


@query("q61_local_alignment")
def local_alignment(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("key"), dna("p_name", 30).alias("ref"), F.concat(F.substring(dna("p_name", 30), 5, 10), F.lit("GG"), F.substring(dna("p_name", 30), 15, 8)).alias("alt"))
    return rows.select("key", alignment.aligned("ref", "alt").alias("a")).select("key", "a.score", "a.offset", "a.cigar")


@query("q61_pair_likelihood")
def pair_likelihood(spark, d):
    p = table(spark, d, "part")
    hap = dna("p_name", 30)
    read = F.when(F.col("p_partkey") % 2 == 0, F.substring(hap, 6, 12)).otherwise(dna("p_type", 12))
    return p.select(F.col("p_partkey").alias("key"), rounded(alignment.read_likelihoods(hap, read, F.lit(30.0))).alias("log10_likelihood"))


@query(
    "q62_annotation_register",
    f"""WITH {GT}, g AS (SELECT *, {BEST} AS b, list_sort([p0, p1, p2])[2] - list_sort([p0, p1, p2])[1] AS gq, l_returnflag <> 'N' AS alt, l_linestatus <> 'F' AS rev FROM gt),
  a AS (SELECT site, 2 * count(*) FILTER ({CALLED}) AS an, CAST(coalesce(sum(b) FILTER ({CALLED}), 0) AS BIGINT) AS ac, CAST(sum(dp) AS BIGINT) AS dp, sqrt(CAST(sum(dp * dp) AS DOUBLE) / count(*)) AS mq, count(*) FILTER (NOT ({CALLED})) AS ncc, avg(gq) AS gq_mean FROM g GROUP BY site)
SELECT site, ac, an, dp, {r('mq')} AS mq, ncc, {r('gq_mean')} AS gq_mean FROM a""",
)
def annotation_register(spark, d):
    register = ann.standard()
    g = genotypes(spark, d)
    rows = ann.per_genotype(g, {"gq": gt.quality(F.col("pl")), "alternate": F.col("l_returnflag") != "N", "reverse": F.col("l_linestatus") != "F", "mq2": F.col("dp") * F.col("dp")})
    chosen = register.enabled(("Standard", "Summaries"), excluded=("FS", "SOR"))
    # Two halves are annotated by themselves and their raw values combined, as a merge of call sets does.
    halves = [register.raw(rows.where(F.col("sample") % 2 == k), ["site"], chosen) for k in range(2)]
    out = register.finished(register.combined(halves[0].union(halves[1]), ["site"]), ["site"], chosen)
    return out.select("site", F.col("AC").alias("ac"), F.col("AN").alias("an"), F.col("DP").alias("dp"), rounded(F.col("MQ")).alias("mq"), F.col("NCC").alias("ncc"), rounded(F.col("GQ_MEAN")).alias("gq_mean"))


@query("q62_header_tree", "WITH l AS (SELECT conv_id AS file, role AS id, CASE WHEN conv_id % 50 = 0 THEN 'a' ELSE 'b' END || role AS line FROM conversations UNION ALL SELECT page_id, regexp_extract(url, '^([a-z]+):', 1), 'u' FROM pages) SELECT id, min(file) AS first_file, arg_min(line, (file, line)) AS line, count(DISTINCT file) AS n_files, count(DISTINCT line) > 1 AS conflict FROM l GROUP BY id")
def header_tree(spark, d):
    a = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("id"), F.concat(F.when(F.col("conv_id") % 50 == 0, "a").otherwise("b"), "role").alias("line"))
    b = table(spark, d, "pages").select(F.col("page_id").alias("file"), F.regexp_extract("url", "^([a-z]+):", 1).alias("id"), F.lit("u").alias("line"))
    out = headers.merged_tree(a.union(b).distinct().withColumn("kind", F.lit("FORMAT")))
    return out.select("id", "first_file", "line", "n_files", "conflict")


@query("q62_sample_columns", "SELECT c_name AS sample, row_number() OVER (ORDER BY c_name) - 1 AS \"column\", count(DISTINCT o_orderkey) AS n_files FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name")
def sample_columns(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("file"), F.col("c_name").alias("sample"))
    return headers.sample_columns(rows)


@query("q62_job_state", "SELECT p_partkey AS key, 'SUCCESS' AS state, 'part-' || p_size AS first, CAST(2 AS BIGINT) AS n FROM part")
def job_state(spark, d):
    size = F.col("p_size").cast("string")
    paths = F.create_map(F.lit(0), F.array(F.concat(F.lit("part-"), size), F.lit("b")))
    text = table(spark, d, "part").select(F.col("p_partkey").alias("key"), jobs.state_text(F.lit("SUCCESS"), paths, F.create_map(F.lit("size"), size)).alias("t"))
    s = text.select("key", jobs.state_of(F.col("t")).alias("s"))
    return s.select("key", F.col("s.job_state").alias("state"), F.get(F.element_at("s.output", "0"), F.lit(0)).alias("first"), F.size(F.element_at("s.output", "0")).cast("long").alias("n"))


@query("q62_resumed_stages", f"WITH {REC} SELECT contig, count(*) AS n, CAST(2 AS BIGINT) AS n_run FROM rec GROUP BY contig")
def resumed_stages(spark, d):
    """Two stages run once; taken up again in the same folder, none runs."""
    folder = scratch.folder(spark)
    first = jobs.Stages(spark, folder)
    make = lambda s: s.run("counts", lambda: s.run("records", lambda: records(spark, d)).groupBy("contig").agg(F.count("*").alias("n")))
    make(first)
    again = jobs.Stages(spark, folder)
    out = make(again)
    return out.withColumn("n_run", F.lit(len(first.ran) + 10 * len(again.ran)).cast("long"))


@query("q62_jobs_beside", f"WITH {REC} SELECT 0 AS job, count(*) AS n FROM rec WHERE n_allele > 2 UNION ALL SELECT 1, count(*) FROM rec WHERE n_allele = 2")
def jobs_beside(spark, d):
    rec = records(spark, d)
    counts = jobs.Beside(2).all([lambda: rec.where("n_allele > 2").count(), lambda: rec.where("n_allele = 2").count()], timeout=3600)
    return spark.createDataFrame(list(enumerate(counts)), "job int, n long")
