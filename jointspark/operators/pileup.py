"""Reads as tables: SAM text, pileups by position, per-read likelihood rows, and read-based annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import REFERENCE_OPS, consumed

SAM = ("name", "flags", "contig", "start", "mapq", "cigar", "mate_contig", "mate_start", "tlen", "seq", "qual")


def reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads of SAM text with their end, read group and original contig."""
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("p"))
    out = rows.select(*(F.get("p", F.lit(k)).alias(c) for k, c in enumerate(SAM)), F.slice("p", F.lit(12), F.greatest(F.size("p") - 11, F.lit(0))).alias("tags"))
    for c in ("flags", "mapq", "tlen"):
        out = out.withColumn(c, F.col(c).cast("int"))
    out = out.withColumn("start", F.col("start").cast("long")).withColumn("mate_start", F.col("mate_start").cast("long"))
    tag = lambda t: F.get(F.filter("tags", lambda x: x.startswith(t)), F.lit(0))
    out = out.withColumn("mate_contig", F.when(F.col("mate_contig") == "=", F.col("contig")).otherwise(F.col("mate_contig")))
    out = out.withColumn("rg", F.substring(tag("RG:Z:"), 6, 1 << 20)).withColumn("oa_contig", F.split_part(F.substring(tag("OA:Z:"), 6, 1 << 20), F.lit(","), F.lit(1)))
    return out.withColumn("end", F.col("start") + consumed(F.col("cigar"), REFERENCE_OPS) - 1).drop("tags")


def line(name: Column, flags: Column, contig: Column, start: Column, mapq: Column, cigar: Column, seq: Column, qual: Column, rg: Column) -> Column:
    """One SAM line of a read without a mate."""
    return F.concat_ws("\t", name, flags.cast("string"), contig, start.cast("string"), mapq.cast("string"), cigar, F.lit("*"), F.lit("0"), F.lit("0"), seq, qual, F.concat(F.lit("RG:Z:"), rg))


def bases(df: DataFrame) -> DataFrame:
    """One row (read columns, pos, base, quality, offset) for each aligned base; deletions have base "-" and no quality."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    step = "aggregate(_ops, named_struct('r', 0, 's', 0, 'out', cast(array() as array<struct<op:string,n:int,r:int,s:int>>)), (a, x) -> named_struct('r', a.r + if(x.op in ('M','=','X','D','N'), x.n, 0), 's', a.s + if(x.op in ('M','=','X','I','S'), x.n, 0), 'out', array_append(a.out, named_struct('op', x.op, 'n', x.n, 'r', a.r, 's', a.s))), a -> a.out)"
    blocks = df.withColumn("_ops", ops).withColumn("_b", F.explode(F.expr(step))).where(F.col("_b.op").isin("M", "=", "X", "D"))
    each = blocks.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_b.n") - 1)))
    gone = F.col("_b.op") == "D"
    at = F.col("_b.s") + F.col("_k") + 1
    out = each.withColumn("pos", F.col("start") + F.col("_b.r") + F.col("_k")).withColumn("base", F.when(gone, "-").otherwise(F.substring("seq", at, F.lit(1))))
    out = out.withColumn("quality", F.when(~gone, F.ascii(F.substring("qual", at, F.lit(1))) - 33)).withColumn("offset", F.when(~gone, at - 1))
    return out.drop("_ops", "_b", "_k")


def pileup(df: DataFrame) -> DataFrame:
    """(contig, pos, depth, deletions, a, c, g, t, other, mapq0, forward): counts of the reads over each position."""
    b = bases(df)
    counts = [F.count_if(F.col("base") == x).alias(x.lower()) for x in "ACGT"]
    return b.groupBy("contig", "pos").agg(
        F.count_if(F.col("base") != "-").alias("depth"), F.count_if(F.col("base") == "-").alias("deletions"), *counts, F.count_if(F.col("base") == "N").alias("ns"),
        F.count_if(F.col("mapq") == 0).alias("mapq0"), F.count_if(F.col("flags").bitwiseAND(16) == 0).alias("forward"),
    )


def best_alleles(df: DataFrame, read: list[str], allele: str, score: str, margin: float = 0.2) -> DataFrame:
    """(read columns, allele, score, confidence, informative) from (read, allele, log10 likelihood) rows: the best allele of each read.

    A read is informative if its best allele leads the second by more than ``margin``.
    """
    w = Window.partitionBy(*read).orderBy(F.col(score).desc(), allele)
    ranked = df.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).where("_k = 1")
    lead = F.col(score) - F.coalesce("_next", F.lit(float("-inf")))
    return ranked.withColumn("confidence", lead).withColumn("informative", lead > margin).drop("_k", "_next")


def marginal(df: DataFrame, read: list[str], allele: str, score: str, into: Column) -> DataFrame:
    """Rows of coarser alleles: each read's best likelihood among the alleles that map to one."""
    return df.withColumn(allele, into).groupBy(*read, allele).agg(F.max(score).alias(score))


def without_poor(df: DataFrame, read: list[str], score: str, length: str, error: float = 0.02, most: float = 2.0, worst: float = -4.0) -> DataFrame:
    """Rows of reads whose best likelihood is at least what errors in a share of their bases would leave."""
    best = F.max(score).over(Window.partitionBy(*read))
    limit = F.least(F.lit(most), F.ceil(F.col(length) * error)) * worst
    return df.withColumn("_best", best).where(F.col("_best") >= limit).drop("_best")


#: Aggregates of informative reads by allele, each over (allele, mapq, quality, tlen, offset, flags, start, oa_contig, contig).
READ_ANNOTATIONS = {
    "AD": lambda c: F.count("*"),
    "MQ0": lambda c: F.count_if(c("mapq") == 0),
    "MBQ": lambda c: F.percentile(c("quality"), F.lit(0.5)),
    "MMQ": lambda c: F.percentile(c("mapq"), F.lit(0.5)),
    "MFRL": lambda c: F.percentile(F.abs(c("tlen")), F.lit(0.5)),
    "MPOS": lambda c: F.percentile(c("offset"), F.lit(0.5)),
    "UNIQ": lambda c: F.countDistinct(c("start"), c("tlen")),
    "OCM": lambda c: F.count_if(c("oa_contig") != c("contig")),
    "F1R2": lambda c: F.count_if((c("flags").bitwiseAND(64) != 0) == (c("flags").bitwiseAND(16) == 0)),
    "F2R1": lambda c: F.count_if((c("flags").bitwiseAND(64) != 0) != (c("flags").bitwiseAND(16) == 0)),
    "FWD": lambda c: F.count_if(c("flags").bitwiseAND(16) == 0),
    "REV": lambda c: F.count_if(c("flags").bitwiseAND(16) != 0),
}


def read_annotations(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, allele, the named annotations) of a table of reads with their best allele."""
    return df.groupBy(*keys, "allele").agg(*(READ_ANNOTATIONS[n](F.col).alias(n.lower()) for n in names))


def active_regions(df: DataFrame, probability: str, threshold: float, padding: int) -> DataFrame:
    """(contig, start, end): runs of positions whose activity reaches the threshold, padded and merged."""
    from . import intervals

    active = df.where(F.col(probability) >= threshold).select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return intervals.merged(active.select("contig", F.greatest(F.col("start") - padding, F.lit(1)).alias("start"), (F.col("end") + padding).alias("end")))
