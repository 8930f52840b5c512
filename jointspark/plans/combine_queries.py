"""Queries on the combine stage: alleles, likelihoods and fields of records brought to one site."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alleles as al
from ..operators import combine, gates
from ..operators import genotypes as gt
from .registry import query
from .views import AL, GT, allele_rows, genotypes, rounded, table

SITE = "site AS (SELECT contig, pos, arg_max(ref, length(ref) * 1000000 - key) AS longest FROM al GROUP BY ALL), on_site AS (SELECT * FROM al JOIN site USING (contig, pos))"
SYMBOLIC = "(a LIKE '<%' OR a IN ('*', '.'))"
LONGER = f"list_transform(alts, lambda a: CASE WHEN {SYMBOLIC} THEN a ELSE a || substr(longest, length(ref) + 1) END)"
SPANNING = f"list_transform(alts, lambda a: CASE WHEN a = '<NON_REF>' THEN a WHEN NOT {SYMBOLIC} AND length(a) < length(ref) THEN '*' ELSE '.' END)"


def _on_site(spark, d):
    a = allele_rows(spark, d)
    longest = a.groupBy("contig", "pos").agg(F.max_by("ref", F.length("ref") * 1_000_000 - F.col("key")).alias("longest"))
    return a.join(longest, ["contig", "pos"])


@query("q53_remap_to_longest_ref", f"WITH {AL}, {SITE} SELECT key, array_to_string({LONGER}, ',') AS alts FROM on_site")
def remap_to_longest_ref(spark, d):
    return _on_site(spark, d).select("key", F.array_join(al.to_longer_ref(F.col("alts"), F.col("ref"), F.col("longest")), ",").alias("alts"))


@query("q53_spanning_alleles", f"WITH {AL} SELECT key, array_to_string({SPANNING}, ',') AS alts FROM al")
def spanning_alleles(spark, d):
    return allele_rows(spark, d).select("key", F.array_join(al.spanning(F.col("alts"), F.col("ref")), ",").alias("alts"))


@query(
    "q53_merged_alleles",
    f"""WITH {AL}, {SITE}, e AS (SELECT DISTINCT contig, pos, unnest(CASE WHEN key % 3 > 0 THEN {LONGER} ELSE {SPANNING} END) AS a FROM on_site)
SELECT contig, pos, string_agg(a, ',' ORDER BY a = '<NON_REF>', a LIKE '<%' OR a = '*', a) AS alts, count(*) AS n FROM e WHERE a <> '.' GROUP BY ALL""",
)
def merged_alleles(spark, d):
    start = F.when(F.col("key") % 3 > 0, F.col("pos")).otherwise(F.col("pos") - 1)
    rows = _on_site(spark, d).withColumn("alts", combine.at_site(start, F.col("pos"), F.col("ref"), F.col("alts"), F.col("longest")))
    out = combine.merged_alleles(rows, ["contig", "pos"], "alts")
    return out.select("contig", "pos", F.array_join("alts", ",").alias("alts"), F.size("alts").cast("long").alias("n"))


@query("q53_duplicate_alleles", f"WITH {GT}, k AS (SELECT site, line, p0, p1, p2, CASE WHEN p2 <= p0 + p1 THEN 0 ELSE 1 END AS kept FROM gt) SELECT site, CAST(sum(CAST(kept = 0 AS INT)) AS BIGINT) AS n_first, CAST(sum(kept) AS BIGINT) AS n_second FROM k GROUP BY site")
def duplicate_alleles(spark, d):
    p = [F.get("pl", F.lit(k)) for k in range(3)]
    # REF, *, *: homozygous values at 2 and 5.
    pl = F.array(p[0], p[1], p[2], p[0], p[1], p[0] + p[1])
    keep = combine.best_of_equal(F.array(F.lit("*"), F.lit("*")), pl)
    g = genotypes(spark, d).select("site", keep.alias("keep"))
    return g.groupBy("site").agg(F.sum(F.get("keep", F.lit(0)).cast("long")).alias("n_first"), F.sum(F.get("keep", F.lit(1)).cast("long")).alias("n_second"))


def _index_sql(alleles: str, ploidy: int) -> str:
    rank = lambda j: f"list_sort({alleles})[{j + 1}]"
    terms = []
    for j in range(ploidy):
        top = " * ".join(f"({rank(j)} + {j} - {i})" for i in range(j + 1))
        bottom = 1
        for i in range(2, j + 2):
            bottom *= i
        terms.append(f"({top}) // {bottom}")
    return " + ".join(terms)


@query("q53_genotype_index_tetraploid", f"WITH {GT} SELECT DISTINCT line, sample % 5 AS b, CAST({_index_sql('[line % 4, sample % 5, 2, (line + sample) % 3]', 4)} AS BIGINT) AS idx, (line + sample) % 3 AS c FROM gt")
def genotype_index_tetraploid(spark, d):
    line, sample = F.col("line"), F.col("sample")
    idx = combine.genotype_index([(line % 4).cast("int"), (sample % 5).cast("int"), F.lit(2), ((line + sample) % 3).cast("int")])
    return genotypes(spark, d).select("line", (sample % 5).alias("b"), idx.cast("long").alias("idx"), ((line + sample) % 3).alias("c")).distinct()


#: New alleles 0, 1, 2 are old ones 0, 2, 1: genotypes of three copies in likelihood order are 000 001 011 111 002 012 112 022 122 222.
@query("q53_pl_remap_triploid", f"WITH {GT}, m AS (SELECT site, [p0, p1, p2, p0 + 1, p1 + 1, p2 + 1, p0 + 2, p1 + 2, p2 + 2, p0 + 3] AS pl FROM gt) SELECT site, {', '.join(f'CAST(sum(pl[{o + 1}]) AS BIGINT) AS s{k}' for k, o in enumerate([0, 4, 7, 9, 1, 5, 8, 2, 6, 3]))} FROM m GROUP BY site")
def pl_remap_triploid(spark, d):
    p = [F.get("pl", F.lit(k)) for k in range(3)]
    pl = F.array(*(p[k % 3] + k // 3 for k in range(10)))
    new = combine.remapped_pl(pl, F.array(F.lit(0), F.lit(2), F.lit(1)), 3, 3)
    return genotypes(spark, d).select("site", new.alias("n")).groupBy("site").agg(*(F.sum(F.get("n", F.lit(k))).cast("long").alias(f"s{k}") for k in range(10)))


@query("q53_ad_remap_with_pl", f"WITH {GT} SELECT site, CAST(coalesce(sum(dp) FILTER (line > 2), 0) AS BIGINT) AS a0, CAST(coalesce(sum(line) FILTER (line > 2), 0) AS BIGINT) AS a1, count(*) FILTER (line <= 2) AS n_without FROM gt GROUP BY site")
def ad_remap_with_pl(spark, d):
    pl = F.when(F.col("line") > 2, F.col("pl"))
    ad = combine.remapped_ad(F.array("dp", "line"), F.array(F.lit(0), F.lit(1), F.lit(7)), pl)
    g = genotypes(spark, d).select("site", ad.alias("ad"))
    total = lambda k: F.coalesce(F.sum(F.get("ad", F.lit(k))), F.lit(0)).cast("long")
    return g.groupBy("site").agg(total(0).alias("a0"), total(1).alias("a1"), F.count_if(F.col("ad").isNull()).alias("n_without"))


@query(
    "q53_id_filter_merge",
    """WITH r AS (SELECT o_custkey AS site, CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE 'rs' || o_orderkey % 7 END AS id, CASE o_orderstatus WHEN 'F' THEN 'q10' WHEN 'O' THEN 's50' ELSE 'PASS' END AS filter FROM orders)
SELECT site, coalesce(string_agg(DISTINCT id, ';' ORDER BY id) FILTER (id <> '.'), '.') AS id, CASE WHEN bool_or(filter = 'PASS') THEN '.' ELSE string_agg(DISTINCT filter, ';' ORDER BY filter) END AS filter FROM r GROUP BY site""",
)
def id_filter_merge(spark, d):
    o = table(spark, d, "orders")
    filters = F.when(F.col("o_orderstatus") == "F", "q10").when(F.col("o_orderstatus") == "O", "s50").otherwise("PASS")
    rows = o.select(F.col("o_custkey").alias("site"), F.when(F.col("o_orderkey") % 3 == 0, ".").otherwise(F.concat(F.lit("rs"), (F.col("o_orderkey") % 7).cast("string"))).alias("id"), filters.alias("filter"))
    return rows.groupBy("site").agg(combine.merged_ids("id").alias("id"), combine.merged_filters("filter").alias("filter"))


@query("q53_stale_fields", "SELECT p_partkey AS key, 'MQ=' || p_size || ';SOR=1' AS info FROM part")
def stale_fields(spark, d):
    size = F.col("p_size").cast("string")
    info = F.create_map(F.lit("DP"), size, F.lit("AC"), size, F.lit("MQ"), size, F.lit("END"), size, F.lit("MLEAF"), size, F.lit("SOR"), F.lit("1"))
    kept = F.transform(F.map_entries(combine.without_stale(info)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.array_join(F.sort_array(kept), ";").alias("info"))


@query("q53_raw_mq_upgrade", f"WITH {GT} SELECT site, CAST(sum(CASE WHEN line > 3 THEN dp * dp WHEN line > 1 THEN p2 * 60 END) AS BIGINT) AS squares, CAST(sum(CASE WHEN line > 3 THEN line WHEN line > 1 THEN dp END) AS BIGINT) AS reads FROM gt GROUP BY site")
def raw_mq_upgrade(spark, d):
    line, dp = F.col("line"), F.col("dp")
    raw = combine.raw_mapping_quality(F.when(line > 3, F.array(dp * dp, line)), F.when(line > 1, F.get("pl", F.lit(2)) * 60), dp)
    g = genotypes(spark, d).select("site", raw.alias("raw"))
    return g.groupBy("site").agg(F.sum(F.get("raw", F.lit(0))).alias("squares"), F.sum(F.get("raw", F.lit(1))).alias("reads"))


RECORDS = """rec AS (SELECT contig, pos AS start, pos + length(ref) - 1 AS stop, key % 50 AS sample, ref, CASE WHEN size % 5 = 0 THEN ['<NON_REF>'] ELSE alts END AS alts, size AS dp,
    CASE WHEN key % 4 = 0 THEN 'rs' || key ELSE '.' END AS id, CASE WHEN key % 3 = 0 THEN 'q' || size % 3 ELSE '.' END AS filter, key AS rec_no FROM al)"""


def _records(spark, d):
    key, size = F.col("key"), F.col("size")
    return allele_rows(spark, d).select(
        "contig", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).alias("end"), (key % 50).alias("sample"), "ref", F.when(size % 5 == 0, F.array(F.lit(al.NON_REF))).otherwise(F.col("alts")).alias("alts"), size.alias("dp"),
        F.when(key % 4 == 0, F.concat(F.lit("rs"), key.cast("string"))).otherwise(".").alias("id"), F.when(key % 3 == 0, F.concat(F.lit("q"), (size % 3).cast("string"))).otherwise(".").alias("filter"), key.alias("rec_no"),
    )


@query(
    "q53_combined_sites",
    f"""WITH {AL}, {RECORDS}, sites AS (SELECT DISTINCT contig, start + 1 AS pos FROM rec UNION SELECT DISTINCT contig, start * 2 FROM rec),
  j AS (SELECT s.contig AS c, s.pos AS site, r.* FROM sites s LEFT JOIN rec r ON r.contig = s.contig AND s.pos BETWEEN r.start AND r.stop),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, site, sample ORDER BY start DESC, rec_no DESC) AS k FROM j) WHERE k = 1),
  f AS (SELECT c, site, coalesce(arg_max(ref, (length(ref), ref)) FILTER (start = site), 'N') AS longest FROM l GROUP BY ALL),
  o AS (SELECT l.*, f.longest, CASE WHEN start IS NULL THEN [] WHEN start = l.site THEN {LONGER} ELSE {SPANNING} END AS seen FROM l JOIN f ON f.c = l.c AND f.site = l.site),
  e AS (SELECT DISTINCT c, site, unnest(seen) AS a FROM o), u AS (SELECT c, site, string_agg(a, ',' ORDER BY a = '<NON_REF>', a LIKE '<%' OR a = '*', a) AS alts, bool_or(a <> '<NON_REF>') AS true_alt FROM e WHERE a <> '.' GROUP BY ALL),
  g AS (SELECT c, site, min(longest) AS ref, count(sample) AS n_samples, CAST(coalesce(sum(dp), 0) AS BIGINT) AS depth, coalesce(string_agg(DISTINCT id, ';' ORDER BY id) FILTER (start = site AND id <> '.'), '.') AS id,
    coalesce(bool_or(filter = '.') FILTER (start = site), true) AS clear, string_agg(DISTINCT filter, ';' ORDER BY filter) FILTER (start = site AND filter <> '.') AS filters FROM o GROUP BY ALL)
SELECT g.c AS contig, g.site AS pos, CASE WHEN coalesce(true_alt, false) THEN ref ELSE substr(ref, 1, 1) END AS ref, CASE WHEN coalesce(true_alt, false) THEN alts ELSE '<NON_REF>' END AS alts, NOT coalesce(true_alt, false) AS is_block, n_samples, depth, id, CASE WHEN clear THEN '.' ELSE filters END AS filter
FROM g LEFT JOIN u ON u.c = g.c AND u.site = g.site""",
)
def combined_sites(spark, d):
    rec = _records(spark, d)
    sites = rec.select("contig", (F.col("start") + 1).alias("pos")).union(rec.select("contig", F.col("start") * 2)).distinct()
    out = combine.combined(sites, rec)
    return out.select("contig", "pos", "ref", F.array_join("alts", ",").alias("alts"), "is_block", "n_samples", "depth", "id", "filter")


ALT = "[a FOR a IN alts[1:1 + size % 3]]"
FLAG = "CAST({0} AS BIGINT) AS {1}"


@query(
    "q54_site_gates",
    f"""WITH {AL}, g AS (SELECT key, size, ref, {ALT} AS alts FROM al)
SELECT key, {', '.join(FLAG.format(x, n) for x, n in {
    "len(alts) > 0 AND size % 7 > 0": "regenotyped",
    "CASE WHEN len(alts) = 0 THEN false WHEN len(alts) = 1 THEN NOT (alts[1] LIKE '<%' OR alts[1] IN ('*', '.')) ELSE true END": "polymorphic",
    "len(alts) = 1 AND alts[1] = '*'": "only_spanning",
    "len(list_filter(alts, lambda a: a <> '<NON_REF>')) = 1 AND list_filter(alts, lambda a: a <> '<NON_REF>')[1] = '*'": "reference_and_spanning",
    "len(alts) + 1 > 2": "too_many",
    "length(ref) >= 2 AND len(list_filter(alts, lambda a: NOT (a LIKE '<%' OR a IN ('*', '.')))) > 0 AND len(list_filter(alts, lambda a: NOT (a LIKE '<%' OR a IN ('*', '.')) AND length(a) <> length(ref))) = 0": "unmixed_mnp",
    "len(list_filter(alts, lambda a: a LIKE '<%')) = 0": "not_symbolic"}.items())} FROM g""",
)
def site_gates(spark, d):
    a = allele_rows(spark, d).withColumn("alts", F.slice("alts", F.lit(1), (F.col("size") % 3 + 1).cast("int")))
    alts, ref = F.col("alts"), F.col("ref")
    tests = {
        "regenotyped": gates.regenotyped(alts, F.col("size") % 7), "polymorphic": gates.properly_polymorphic(alts), "only_spanning": gates.only_spanning(alts),
        "reference_and_spanning": gates.reference_and_spanning(F.concat(F.array(ref), alts)), "too_many": gates.too_many_alleles(alts, 2), "unmixed_mnp": gates.unmixed_mnp(ref, alts), "not_symbolic": gates.not_symbolic(alts),
    }
    return a.select("key", *(t.cast("long").alias(n) for n, t in tests.items()))


@query("q54_true_sites", f"WITH {AL} SELECT contig, pos, max(2 + CAST(size % 5 = 0 AS INT)) > 2 AS has_alternate FROM al GROUP BY ALL")
def true_sites(spark, d):
    a = allele_rows(spark, d).withColumn("n_allele", 2 + (F.col("size") % 5 == 0).cast("int"))
    return a.groupBy("contig", "pos").agg(gates.true_alternate(F.col("n_allele")).alias("has_alternate"))


@query("q54_polymorphic_in_samples", f"WITH {GT}, g AS (SELECT site, CASE WHEN -(p0 + p1 + p2) / 10.0 < -0.1 AND p0 > least(p1, p2) THEN 1 ELSE 0 END AS alt FROM gt) SELECT site, max(alt) > 0 AS polymorphic FROM g GROUP BY site")
def polymorphic_in_samples(spark, d):
    pl = F.col("pl")
    best = gt.best(pl)
    called = F.when(gt.is_called(pl), F.when(best == 0, F.array(F.lit(0), F.lit(0))).when(best == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))).otherwise(F.array(F.lit(-1), F.lit(-1)))
    g = genotypes(spark, d).select("site", called.alias("g"))
    return g.groupBy("site").agg(F.max(gates.polymorphic_in_samples(F.array("g"))).alias("polymorphic"))


@query("q54_kept_alleles", f"WITH {AL}, k AS (SELECT key, size, list_filter(alts, lambda a, i: a <> '<NON_REF>' AND (size + i) % 2 = 0 AND (a <> '*' OR key % 2 = 0)) AS kept FROM al) SELECT key, array_to_string(kept, ',') AS kept FROM k")
def kept_alleles(spark, d):
    plausible = F.transform("alts", lambda _, i: (F.col("size") + i + 1) % 2 == 0)
    a = allele_rows(spark, d).withColumn("plausible", plausible)
    return a.select("key", F.array_join(gates.kept_alleles(F.col("alts"), F.col("plausible"), F.col("key") % 2 == 0), ",").alias("kept"))
