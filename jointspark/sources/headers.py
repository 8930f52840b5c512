"""Header lines and sample names of many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(lines: DataFrame) -> DataFrame:
    """One line per (kind, id): that of the first file, with the number of files that declare it."""
    extra = [c for c in lines.columns if c not in ("kind", "id", "file")]
    first = F.min(F.struct("file", *extra)).alias("_first")
    out = lines.groupBy("kind", "id").agg(first, F.countDistinct("file").alias("n_files"))
    return out.select("kind", "id", F.col("_first.file").alias("first_file"), *(F.col(f"_first.{c}").alias(c) for c in extra), "n_files")


def renamed(samples: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Repeated sample names get a suffix: name, name-1, name-2 in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    return samples.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 0, F.concat_ws("-", name, F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def merged_tree(lines: DataFrame, chunk: int = 100) -> DataFrame:
    """As :func:`merged`, first in chunks of files and then over the chunks, and with ``conflict``: whether declarations differ.

    ``lines`` is (file, kind, id, line) with file numbers.  A line declared by many files leaves its chunk once for each form.
    """
    chunks = lines.groupBy("kind", "id", "line", F.floor(F.col("file") / chunk).alias("_chunk")).agg(F.min("file").alias("file"), F.countDistinct("file").alias("n"))
    out = chunks.groupBy("kind", "id").agg(F.min(F.struct("file", "line")).alias("_first"), F.sum("n").alias("n_files"), F.min("line").alias("_a"), F.max("line").alias("_b"))
    return out.select("kind", "id", F.col("_first.file").alias("first_file"), F.col("_first.line").alias("line"), "n_files", (F.col("_a") != F.col("_b")).alias("conflict"))


def sample_columns(samples: DataFrame, strict: bool = False) -> DataFrame:
    """(sample, column, n_files): sorted distinct names; with ``strict`` a name of two files is an error when rows are read."""
    found = samples.groupBy("sample").agg(F.countDistinct("file").alias("n_files"))
    if strict:
        found = found.withColumn("sample", F.when(F.col("n_files") == 1, F.col("sample")).otherwise(F.raise_error(F.concat(F.lit("sample name repeats: "), "sample"))))
    return found.select("sample", (F.row_number().over(Window.orderBy("sample")) - 1).cast("long").alias("column"), "n_files")  # one row for each sample
