"""Scans over many sorted inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.intervals import BIN


def merged_scan(inputs: list[DataFrame], dictionary: DataFrame, order: list[str]) -> DataFrame:
    """All rows in dictionary order with their file number and global rank.

    ``order`` begins with the position.  The rank comes from counts per contig and bin, so no task sorts a whole contig.
    """
    rows = reduce(DataFrame.unionByName, (df.withColumn("file", F.lit(k)) for k, df in enumerate(inputs)))
    rows = rows.join(dictionary.select("contig", "idx"), "contig")
    # Rank in a bin of one contig, after counts of the bins before it: as many tasks as bins, not as contigs.
    rows = rows.withColumn("_bin", F.floor(F.col(order[0]) / BIN))
    sizes = rows.groupBy("idx", "_bin").agg(F.count("*").alias("n"))
    contigs = sizes.groupBy("idx").agg(F.sum("n").alias("m"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = contigs.select("idx", F.coalesce(F.sum("m").over(before(Window.orderBy("idx"))), F.lit(0)).alias("_contig"))  # one row per contig
    at = sizes.select("idx", "_bin", F.coalesce(F.sum("n").over(before(Window.partitionBy("idx").orderBy("_bin"))), F.lit(0)).alias("_inside"))
    ranked = rows.join(at.join(bases, "idx"), ["idx", "_bin"])
    rank = F.col("_contig") + F.col("_inside") + F.row_number().over(Window.partitionBy("idx", "_bin").orderBy(*order))
    return ranked.withColumn("rank", rank).drop("_bin", "_contig", "_inside")


def zipped(inputs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of k inputs that list the same keys, side by side; raises where an input lacks a key."""
    rows = reduce(DataFrame.unionByName, (df.withColumn("file", F.lit(k)) for k, df in enumerate(inputs)))
    value = [c for c in rows.columns if c not in keys and c != "file"]
    out = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("file", *value))).alias("rows"), F.count("*").alias("n"))
    wrong = F.raise_error(F.lit("inputs do not list the same sites"))
    return out.withColumn("rows", F.when(F.col("n") == len(inputs), F.col("rows")).otherwise(wrong)).drop("n")
