"""Genomic roles of the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS, LENGTH = 8, 2600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant records: contig, start, end, sample, n_allele, dp."""
    li = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long") + 1
    length = F.col("l_quantity").cast("int")
    return li.select(
        (F.col("l_partkey") % CONTIGS).alias("contig"), start.alias("start"), (start + length - 1).alias("end"), F.col("l_suppkey").alias("sample"),
        (2 + (F.col("l_linenumber") >= 6).cast("int")).alias("n_allele"), length.cast("long").alias("dp"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
    )


REC = """rec AS (
  SELECT l_partkey % 8 AS contig, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS start,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS stop,
    l_suppkey AS sample, 2 + CAST(l_linenumber >= 6 AS INT) AS n_allele, CAST(l_quantity AS BIGINT) AS dp, l_orderkey AS orderkey, l_linenumber AS line
  FROM lineitem)"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals: contig, start, end, key, priority."""
    o = table(spark, sf_dir, "orders")
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long") + 1
    return o.select((F.col("o_custkey") % CONTIGS).alias("contig"), start.alias("start"), (start + F.col("o_orderkey") % 30).alias("end"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"))


REG = """reg AS (
  SELECT o_custkey % 8 AS contig, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 AS start,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS stop, o_orderkey AS key, o_orderpriority AS priority
  FROM orders)"""


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diploid genotype rows: site, sample, pl, dp, strand cell."""
    li = table(spark, sf_dir, "lineitem")
    pl = F.array(F.round(F.col("l_discount") * 1000).cast("int"), F.round(F.col("l_tax") * 1000).cast("int"), (F.col("l_linenumber") * 7).cast("int"))
    return li.select((F.col("l_partkey") % 500).alias("site"), F.col("l_suppkey").alias("sample"), pl.alias("pl"), F.col("l_quantity").cast("long").alias("dp"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("line"))


GT = """gt AS (
  SELECT l_partkey % 500 AS site, l_suppkey AS sample, CAST(round(l_discount * 1000) AS INT) AS p0, CAST(round(l_tax * 1000) AS INT) AS p1, CAST(l_linenumber * 7 AS INT) AS p2,
    CAST(l_quantity AS BIGINT) AS dp, l_returnflag, l_linestatus, CAST(l_linenumber AS BIGINT) AS line
  FROM lineitem)"""


def rounded(column, digits: int = 4):
    """Half up, as both engines do it on doubles."""
    scale = 10.0**digits
    return F.floor(column * scale + 0.5) / scale


def dna(text, length):
    """Bases made of a string's MD5."""
    return F.translate(F.substring(F.md5(text), F.lit(1), length.cast("int") if hasattr(length, "cast") else F.lit(length)), "0123456789abcdef", "ACGTACGTACGTACGT")


def allele_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with alleles: key, contig, pos, ref, alts (three, <NON_REF> last), size."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    second = F.when(size % 4 == 0, "*").when(size % 4 == 1, "<DEL>").otherwise(F.concat(F.lit("G"), dna("p_type", size % 3)))
    return p.select(
        F.col("p_partkey").alias("key"), (F.col("p_partkey") % CONTIGS).alias("contig"), F.floor(F.col("p_partkey") / 40).alias("pos"), F.concat(F.lit("A"), dna("p_name", size % 4)).alias("ref"),
        F.array(F.concat(F.lit("T"), dna("p_brand", F.col("p_partkey") % 4)), second, F.lit("<NON_REF>")).alias("alts"), size.cast("long").alias("size"), F.col("p_brand").alias("brand"),
    )


DNA = "translate(substr(md5({0}), 1, CAST({1} AS INT)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
AL = f"""al AS (SELECT p_partkey AS key, p_partkey % 8 AS contig, p_partkey // 40 AS pos, 'A' || {DNA.format('p_name', 'p_size % 4')} AS ref,
    ['T' || {DNA.format('p_brand', 'p_partkey % 4')}, CASE WHEN p_size % 4 = 0 THEN '*' WHEN p_size % 4 = 1 THEN '<DEL>' ELSE 'G' || {DNA.format('p_type', 'p_size % 3')} END, '<NON_REF>'] AS alts, CAST(p_size AS BIGINT) AS size, p_brand AS brand
  FROM part)"""
