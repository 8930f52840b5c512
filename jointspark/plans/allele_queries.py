"""Queries on alleles, known variants, call sets, filters and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import alleles as al
from ..operators import annotate as an
from ..operators import genotypes as gt
from ..sources import headers
from .registry import query
from .views import table


@query("q12_longest_ref", "WITH m AS (SELECT p_brand, max(length(p_name)) AS n FROM part GROUP BY 1) SELECT p.p_brand, min(p_name) AS ref, count(DISTINCT p_name) AS n_refs FROM part p JOIN m ON m.p_brand = p.p_brand AND length(p_name) = n GROUP BY 1")
def longest_ref(spark, d):
    return al.longest_ref(table(spark, d, "part"), ["p_brand"], "p_name")


@query("q13_allele_union_ordered", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS alleles FROM part GROUP BY 1")
def allele_union(spark, d):
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("a"))
    return lists.select("p_brand", F.array_join(al.ordered(F.col("a")), ",").alias("alleles"))


SEEN = """k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  seen AS (SELECT user_id, list(event_type ORDER BY k) AS alts FROM (SELECT user_id, event_type, min(k) AS k FROM k GROUP BY 1, 2) GROUP BY 1)"""


def _seen(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.array("event_type").alias("alts"))
    return al.first_seen(e, ["user_id"], "alts", ["ts", "event_id"])


@query("q13_allele_union_first_seen", f"WITH {SEEN} SELECT user_id, array_to_string(alts, ',') AS alleles FROM seen")
def first_seen(spark, d):
    return _seen(spark, d).select("user_id", F.array_join("alts", ",").alias("alleles"))


@query("q14_allele_index_map", f"WITH {SEEN}, o AS (SELECT user_id, list_concat(list_concat(['REF'], alts), ['<NON_REF>']) AS old FROM seen) SELECT user_id, array_to_string([CASE WHEN x = 'REF' THEN 0 ELSE coalesce(nullif(list_position(old, x), 0) - 1, len(old) - 1) END FOR x IN ['REF', 'click', 'error', 'gone', 'view', '<NON_REF>']], ',') AS indices FROM o")
def allele_index_map(spark, d):
    old = F.concat(F.array(F.lit("REF")), F.col("alts"), F.array(F.lit(al.NON_REF)))
    new = F.array(*(F.lit(x) for x in ("REF", "click", "error", "gone", "view", al.NON_REF)))
    return _seen(spark, d).select("user_id", F.array_join(al.index_map(new, old).cast("array<string>"), ",").alias("indices"))


@query(
    "q36_rsid_join",
    """WITH calls AS (SELECT DISTINCT l_partkey % 8 AS contig, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem),
  known AS (SELECT o_custkey % 8 AS contig, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS pos, substr('ANR', CAST(o_orderkey % 3 + 1 AS INT), 1) AS ref, substr('FO', CAST(o_custkey % 2 + 1 AS INT), 1) AS alt, o_orderkey FROM orders WHERE o_orderstatus <> 'P'),
  hits AS (SELECT contig, pos, ref, alt, min(o_orderkey) AS k FROM known GROUP BY ALL)
SELECT contig, pos, ref, alt, coalesce('rs' || k, '.') AS id, k IS NOT NULL AS db FROM calls LEFT JOIN hits USING (contig, pos, ref, alt)""",
)
def rsid_join(spark, d):
    day = lambda c: F.datediff(F.to_date(c), F.lit("1995-01-01").cast("date")).cast("long")
    calls = table(spark, d, "lineitem").select((F.col("l_partkey") % 8).alias("contig"), day("l_shipdate").alias("pos"), F.col("l_returnflag").alias("ref"), F.array("l_linestatus").alias("alts"), F.lit(".").alias("id")).distinct()
    o = table(spark, d, "orders")
    ref, alt = F.substring(F.lit("ANR"), (F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(1)), F.substring(F.lit("FO"), (F.col("o_custkey") % 2 + 1).cast("int"), F.lit(1))
    known = o.select((F.col("o_custkey") % 8).alias("contig"), day("o_orderdate").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("rec_no"), (F.col("o_orderstatus") != "P").alias("passed"))
    return an.known_ids(calls, known).select("contig", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), "id", "db")


@query("q42_read_filters", "WITH f AS (SELECT l_returnflag, CAST(l_linenumber * 256 + l_partkey % 256 AS BIGINT) AS flags, CAST(l_quantity AS BIGINT) AS mapq FROM lineitem), t AS (SELECT l_returnflag, concat_ws(',', CASE WHEN flags & 4 <> 0 THEN 'mapped' END, CASE WHEN flags & 2304 <> 0 THEN 'primary' END, CASE WHEN flags & 1024 <> 0 THEN 'not_duplicate' END, CASE WHEN flags & 512 <> 0 THEN 'passes_vendor' END, CASE WHEN flags & 1 = 0 THEN 'paired' END, CASE WHEN flags & 1 <> 0 AND flags & 2 = 0 THEN 'proper_pair' END, CASE WHEN mapq IN (0, 255) THEN 'mapping_quality' END) AS failed FROM f) SELECT l_returnflag, failed, count(*) AS n FROM t GROUP BY ALL")
def read_filters(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") * 256 + F.col("l_partkey") % 256).cast("long").alias("flags"), F.col("l_quantity").cast("long").alias("mapq"))
    failed = an.failed_filters(an.read_filters(F.col("flags"), F.col("mapq")))
    return li.select("l_returnflag", F.array_join(failed, ",").alias("failed")).groupBy("l_returnflag", "failed").agg(F.count("*").alias("n"))


@query(
    "q43_trio_violation",
    """WITH p AS (SELECT c_custkey AS k, CAST(c_nationkey % 3 AS BIGINT) AS g FROM customer),
  t AS (SELECT c.k AS child, c.g AS child_gt, m.g AS mother_gt, f.g AS father_gt FROM p c JOIN p m ON m.k = 2 * c.k JOIN p f ON f.k = 2 * c.k + 1)
SELECT *, child_gt NOT BETWEEN CAST(mother_gt = 2 AS INT) + CAST(father_gt = 2 AS INT) AND CAST(mother_gt >= 1 AS INT) + CAST(father_gt >= 1 AS INT) AS violation FROM t""",
)
def trio_violation(spark, d):
    c = table(spark, d, "customer")
    people = c.select(F.col("c_custkey").alias("sample"), (F.col("c_nationkey") % 3).cast("long").alias("copies"))
    pedigree = c.select(F.col("c_custkey").alias("child"), (2 * F.col("c_custkey")).alias("mother"), (2 * F.col("c_custkey") + 1).alias("father"))
    return an.trio_violations(people, pedigree)


@query(
    "q45_split_multiallelic",
    """WITH r AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS ref, string_split(p_type, ' ') AS alts FROM part),
  b AS (SELECT p_partkey, ref, alts[i + 1] AS alt, i AS alt_no FROM r, unnest(range(len(alts))) u(i)),
  c AS (SELECT *, (SELECT max(n) FROM unnest(range(least(length(ref), length(alt)))) v(n) WHERE right(ref, n) = right(alt, n)) AS cut FROM b)
SELECT p_partkey, CAST(alt_no AS BIGINT) AS alt_no, left(ref, length(ref) - cut) AS alt_ref, left(alt, length(alt) - cut) AS alt FROM c""",
)
def split_multiallelic(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("ref"), F.split("p_type", " ").alias("alts"))
    return al.biallelic(p).select("p_partkey", F.col("alt_no").cast("long").alias("alt_no"), "alt_ref", "alt")


@query("q46_kmer_count_documents", "WITH k AS (SELECT lang, substr(text, CAST(i AS INT), 5) AS kmer FROM documents, unnest(range(1, length(text) - 3)) u(i)) SELECT lang, kmer, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 2")
def kmer_count_documents(spark, d):
    return an.kmers(table(spark, d, "documents"), ["lang"], "text", 5, 2)


@query("q47_downsample", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 5")
def downsample(spark, d):
    return gt.downsampled(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], 5, ["event_id"])


@query("q49_size_parse", "SELECT DISTINCT CAST(p_size AS VARCHAR) || s.unit AS given, CAST(p_size AS BIGINT) * s.k AS parsed FROM part, (VALUES ('', 1), ('k', 1000), ('K', 1000), ('m', 1000000), ('M', 1000000), ('g', 1000000000), ('G', 1000000000)) s(unit, k)")
def size_parse(spark, d):
    units = F.explode(F.array(*(F.lit(u) for u in ("", "k", "K", "m", "M", "g", "G"))))
    given = table(spark, d, "part").select("p_size").distinct().select(F.col("p_size").cast("string").alias("p"), units.alias("u")).select(F.concat("p", "u").alias("given"))
    return given.select("given", parsing.size(F.col("given")).alias("parsed"))


@query("q49_region_parse", "SELECT o_orderkey AS key, 'chr' || o_custkey % 8 AS contig, o_orderkey AS \"start\", o_orderkey + 10 AS \"end\" FROM orders")
def region_parse(spark, d):
    o = table(spark, d, "orders")
    text = F.format_string("chr%d:%d-%d", F.col("o_custkey") % 8, F.col("o_orderkey"), F.col("o_orderkey") + 10)
    region = parsing.region(text)
    return o.select(F.col("o_orderkey").alias("key"), region["contig"].alias("contig"), region["start"].alias("start"), region["end"].alias("end"))


@query("q50_header_merge", "WITH l AS (SELECT role AS id, conv_id AS file FROM conversations UNION ALL SELECT regexp_extract(url, '^([a-z]+):', 1), page_id FROM pages) SELECT 'FORMAT' AS kind, id, min(file) AS first_file, count(DISTINCT file) AS n_files FROM l GROUP BY id")
def header_merge(spark, d):
    c = table(spark, d, "conversations").select(F.lit("FORMAT").alias("kind"), F.col("role").alias("id"), F.col("conv_id").alias("file"))
    p = table(spark, d, "pages").select(F.lit("FORMAT"), F.regexp_extract("url", "^([a-z]+):", 1), "page_id")
    return headers.merged(c.union(p)).select("kind", "id", "first_file", "n_files")


@query("q50_sample_rename", "SELECT o_orderkey AS key, c.c_name || CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN '-' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) ELSE '' END AS sample FROM orders JOIN customer c ON c_custkey = o_custkey")
def sample_rename(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("key"), F.col("c_name").alias("sample"))
    return headers.renamed(rows, "sample", ["key"])


@query(
    "q51_simple_merge",
    """WITH r AS (SELECT o_custkey % 8 AS contig, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS pos, o_orderkey AS v, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS k, o_orderstatus AS s FROM orders),
  g AS (SELECT contig, pos, min(k) AS k, count(DISTINCT s) AS n FROM r GROUP BY ALL)
SELECT g.contig, g.pos, min(r.v) FILTER (r.k = g.k) AS v, CASE WHEN any_value(n) = 3 THEN 'Intersection' ELSE (SELECT string_agg(s, '-' ORDER BY k) FROM (SELECT DISTINCT s, k FROM r q WHERE q.contig = g.contig AND q.pos = g.pos)) END AS "set"
FROM g JOIN r ON r.contig = g.contig AND r.pos = g.pos GROUP BY g.contig, g.pos""",
)
def simple_merge(spark, d):
    o = table(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 8).alias("contig"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long").alias("pos"), F.col("o_orderkey").alias("v"), "o_orderstatus")
    return an.merged_calls({s: rows.where(F.col("o_orderstatus") == s) for s in "FOP"}, list("FOP"), ["contig", "pos"], "v")
