"""Queries on reads: SAM text, pileups, best alleles, read-based annotations, active regions, and banded combining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import pileup
from ..sources import scratch
from .genotype_queries import r
from .registry import query
from .views import DNA, REC, dna, records, rounded, table

CIGARS = ("10M", "3S7M", "4M2D6M", "5M1I4M", "10M")
SAM = f"""rd AS (SELECT 'r' || p_partkey AS name, CAST(p_size % 2 * 16 + p_size % 3 * 64 AS BIGINT) AS flags, 'c' || p_partkey % 4 AS contig, p_partkey % 300 + 1 AS start, CAST(p_size % 3 * 30 AS BIGINT) AS mapq, {list(CIGARS)!r}[CAST(p_partkey % 5 + 1 AS INT)] AS cigar, p_partkey % 5 AS form,
    {DNA.format('p_name', '10')} AS seq FROM part)"""
#: Aligned bases of each form: (offset in the reference, offset in the read or null) in order.
_FORMS = ([(k, k) for k in range(10)], [(k, k + 3) for k in range(7)], [*((k, k) for k in range(4)), (4, None), (5, None), *((k + 6, k + 4) for k in range(6))], [*((k, k) for k in range(5)), *((k + 5, k + 6) for k in range(4))], [(k, k) for k in range(10)])
BASES = "f(form, r, s) AS (VALUES " + ", ".join(f"({k}, {a}, {'NULL' if b is None else b})" for k, form in enumerate(_FORMS) for a, b in form) + "), b AS (SELECT rd.*, start + r AS pos, CASE WHEN s IS NULL THEN '-' ELSE substr(seq, CAST(s + 1 AS INT), 1) END AS base, s FROM rd JOIN f USING (form))"


def _reads(spark, d):
    """Reads written as SAM text and read again."""
    path = f"{scratch.folder(spark)}/sam"
    p = table(spark, d, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    line = pileup.line(F.concat(F.lit("r"), key.cast("string")), size % 2 * 16 + size % 3 * 64, F.concat(F.lit("c"), (key % 4).cast("string")), key % 300 + 1, size % 3 * 30, F.get(F.array(*(F.lit(c) for c in CIGARS)), (key % 5).cast("int")), dna("p_name", 10), F.lit("ABCDEFGHIJ"), F.lit("g"))
    p.select(line.alias("value")).write.text(path)
    return pileup.reads(spark, path)


@query("q63_sam_round_trip", f"WITH {SAM} SELECT name, flags, contig, start AS \"start\", start + CASE form WHEN 0 THEN 9 WHEN 1 THEN 6 WHEN 2 THEN 11 WHEN 3 THEN 8 ELSE 9 END AS \"end\", mapq, cigar, seq, 'g' AS rg FROM rd")
def sam_round_trip(spark, d):
    return _reads(spark, d).select("name", F.col("flags").cast("long").alias("flags"), "contig", "start", "end", F.col("mapq").cast("long").alias("mapq"), "cigar", "seq", "rg")


@query("q63_pileup", f"WITH {SAM}, {BASES} SELECT contig, pos, count(*) FILTER (base <> '-') AS depth, count(*) FILTER (base = '-') AS deletions, {', '.join(f'''count(*) FILTER (base = '{x}') AS {x.lower()}''' for x in 'ACGT')}, count(*) FILTER (mapq = 0) AS mapq0, count(*) FILTER (flags & 16 = 0) AS forward, CAST(0 AS BIGINT) AS ns FROM b GROUP BY ALL")
def pileups(spark, d):
    return pileup.pileup(_reads(spark, d))


def _read_rows(spark, d):
    """(name, allele, score): three likelihoods for each read."""
    p = table(spark, d, "part")
    scores = F.explode(F.array(*(F.struct(F.lit(a).alias("allele"), (-(F.col("p_size") * k % 17) / 4.0).alias("score")) for k, a in enumerate("ABC", 3))))
    return p.select(F.col("p_partkey").alias("name"), F.col("p_size").alias("length"), scores.alias("x")).select("name", "length", "x.*")


ROWS = "l AS (SELECT p_partkey AS name, p_size AS length, a.allele, -(p_size * a.k % 17) / CAST(4 AS DOUBLE) AS score FROM part, (VALUES ('A', 3), ('B', 4), ('C', 5)) a(allele, k))"


@query("q63_best_alleles", f"WITH {ROWS}, k AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS next FROM l WINDOW w AS (PARTITION BY name ORDER BY score DESC, allele)) SELECT name, allele, score - next AS confidence, score - next > 0.2 AS informative FROM k WHERE k = 1")
def best_alleles(spark, d):
    return pileup.best_alleles(_read_rows(spark, d), ["name"], "allele", "score").select("name", "allele", "confidence", "informative")


@query("q63_marginal_alleles", f"WITH {ROWS} SELECT name, CASE WHEN allele = 'A' THEN 'ref' ELSE 'alt' END AS allele, max(score) AS score FROM l GROUP BY ALL")
def marginal_alleles(spark, d):
    return pileup.marginal(_read_rows(spark, d), ["name"], "allele", "score", F.when(F.col("allele") == "A", "ref").otherwise("alt"))


@query("q63_poor_reads", f"WITH {ROWS}, b AS (SELECT name, max(score) AS best, any_value(length) AS length FROM l GROUP BY 1) SELECT name FROM b WHERE best >= least(0.5, ceil(length * 0.01)) * -2.0")
def poor_reads(spark, d):
    kept = pileup.without_poor(_read_rows(spark, d), ["name"], "score", "length", 0.01, 0.5, -2.0)
    return kept.select("name").distinct()


@query(
    "q63_read_annotations",
    f"""WITH {SAM}, {BASES} SELECT contig, base AS allele, count(*) AS ad, count(*) FILTER (mapq = 0) AS mq0, {r('quantile_cont(s + 32.0, 0.5)')} AS mbq, {r('quantile_cont(CAST(mapq AS DOUBLE), 0.5)')} AS mmq, count(DISTINCT start) AS uniq, count(*) FILTER ((flags & 64 > 0) = (flags & 16 = 0)) AS f1r2, count(*) FILTER ((flags & 64 > 0) <> (flags & 16 = 0)) AS f2r1, count(*) FILTER (flags & 16 = 0) AS fwd, count(*) FILTER (flags & 16 > 0) AS rev FROM b WHERE base <> '-' GROUP BY ALL""",
)
def read_annotations(spark, d):
    rows = pileup.bases(_reads(spark, d)).where("base <> '-'").withColumn("allele", F.col("base"))
    out = pileup.read_annotations(rows, ["contig"], ["AD", "MQ0", "MBQ", "MMQ", "UNIQ", "F1R2", "F2R1", "FWD", "REV"])
    return out.withColumn("mbq", rounded(F.col("mbq"))).withColumn("mmq", rounded(F.col("mmq")))


@query("q63_active_regions", f"WITH {SAM}, {BASES}, n AS (SELECT contig, pos, count(*) FILTER (base = '-') / CAST(count(*) AS DOUBLE) AS p FROM b GROUP BY ALL), a AS (SELECT DISTINCT contig, unnest(range(greatest(pos - 3, 1), pos + 4)) AS pos FROM n WHERE p >= 0.2), g AS (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS island FROM a) SELECT contig, min(pos) AS \"start\", max(pos) AS \"end\" FROM g GROUP BY contig, island")
def active_regions(spark, d):
    counts = pileup.pileup(_reads(spark, d)).withColumn("p", F.col("deletions") / (F.col("depth") + F.col("deletions")))
    return pileup.active_regions(counts, "p", 0.2, 3)


@query(
    "q64_banded_combine",
    f"""WITH {REC}, v AS (SELECT * FROM rec), e AS (SELECT contig, start AS pos FROM v UNION SELECT contig, stop + 1 FROM v UNION SELECT DISTINCT contig, m AS pos FROM v, range(1, 3000) t(m) WHERE m % 500 = 0),
  s AS (SELECT contig, pos AS a, lead(pos) OVER (PARTITION BY contig ORDER BY pos) - 1 AS b FROM e)
SELECT s.contig, a AS "start", b AS "end", count(*) AS n, CAST(sum(dp) AS BIGINT) AS dp FROM s JOIN v ON v.contig = s.contig AND v.start <= s.a AND v.stop >= s.b WHERE b IS NOT NULL GROUP BY ALL""",
)
def banded_combine(spark, d):
    return iv.banded(records(spark, d).select("contig", "start", "end", "dp"), ["dp"], 500)
