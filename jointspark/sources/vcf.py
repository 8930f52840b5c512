"""Variant text files as tables: lists of files, headers, records, genotypes.

Files are read as lines by Spark, compressed ones too, so a scan has as many tasks as the files have splits.
A region keeps what overlaps it; :func:`clustered` writes records so that such a filter prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import BIN

COLUMNS = ("contig", "start", "id", "ref", "alt", "qual", "filter", "info", "format")


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths that a list file names, one a line; an empty list is an error."""
    rows = [r[0].strip() for r in spark.read.text(path).collect()]  # names of inputs, which the driver opens
    found = [r for r in rows if r]
    if not found:
        raise ValueError(f"{path} lists no file")
    return found


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line)."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def header(df: DataFrame) -> DataFrame:
    """(file, kind, id, line) of header lines; lines without an ID have their text for one."""
    rows = df.where(F.col("line").startswith("##"))
    kind = F.regexp_extract("line", r"^##([^=]+)=", 1)
    found = F.regexp_extract("line", r"^##[^=]+=<(?:.*,)?ID=([^,>]+)", 1)
    return rows.select("file", kind.alias("kind"), F.when(found != "", found).otherwise(F.regexp_replace("line", r"^##[^=]+=", "")).alias("id"), "line")


def samples(df: DataFrame) -> DataFrame:
    """(file, names): sample names in column order."""
    return df.where(F.col("line").startswith("#CHROM")).select("file", F.slice(F.split("line", "\t"), F.lit(10), F.greatest(F.size(F.split("line", "\t")) - 9, F.lit(0))).alias("names"))


def info_value(info: Column, key: str) -> Column:
    """A field's text; "" for a flag; null if absent."""
    return F.when(info.rlike(rf"(^|;){key}(=|;|$)"), F.regexp_extract(info, rf"(?:^|;){key}=([^;]*)", 1))


def records(df: DataFrame, file: str | None = None) -> DataFrame:
    """(file, contig, start, end, id, ref, alts, qual, filter, info, format, calls): one row for each record line.

    END is INFO's, else the last base of REF.  "." is null for quality and an empty array for alternates.
    """
    parts = F.split("line", "\t")
    rows = df.where(~F.col("line").startswith("#") & (F.col("line") != "")).select("file", parts.alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    out = rows.select("file", *(at(k).alias(c) for k, c in enumerate(COLUMNS)), F.slice("p", F.lit(10), F.greatest(F.size("p") - 9, F.lit(0))).alias("calls"))
    start = F.col("start").cast("long")
    end = F.coalesce(info_value(F.col("info"), "END").cast("long"), start + F.length("ref") - 1)
    return out.select(
        "file", "contig", start.alias("start"), end.alias("end"), "id", "ref", F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ",")).alias("alts"),
        F.expr("try_cast(qual as double)").alias("qual"), "filter", "info", "format", "calls",
    )


def genotypes(rec: DataFrame, names: DataFrame) -> DataFrame:
    """One row (file, contig, start, end, ref, alts, sample, gt, fields) for each call; ``fields`` maps FORMAT's keys to text."""
    named = rec.join(names, "file")
    each = named.select("file", "contig", "start", "end", "ref", "alts", F.split("format", ":").alias("_keys"), F.explode(F.arrays_zip(F.col("names").alias("name"), F.col("calls").alias("call"))).alias("_c"))
    values = F.split(F.col("_c.call"), ":")
    pairs = F.arrays_zip(F.slice(F.col("_keys"), F.lit(1), F.size(values)).alias("k"), F.slice(values, F.lit(1), F.size("_keys")).alias("v"))
    fields = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["k"], x["v"])))
    out = each.withColumn("fields", fields).withColumn("sample", F.col("_c.name"))
    called = F.transform(F.split(F.element_at("fields", "GT"), "[/|]"), lambda a: F.when(a == ".", -1).otherwise(a.cast("int")))
    return out.select("file", "contig", "start", "end", "ref", "alts", "sample", called.alias("gt"), "fields")


def numbers(text: Column) -> Column:
    """An array of whole numbers from "1,2,."; a missing part is null."""
    return F.transform(F.split(text, ","), lambda x: F.when(x != ".", x.cast("int")))


def in_region(rec: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Records that overlap a region."""
    return rec.where((F.col("contig") == contig) & (F.col("start") <= end) & (F.col("end") >= start))


def after_window_start(rec: DataFrame, start: int) -> DataFrame:
    """Records that begin in a window, not before it."""
    return rec.where(F.col("start") >= start)


def clustered(rec: DataFrame, path: str, files: int) -> None:
    """Writes records sorted by position in ranges, so that the statistics of row groups and files prune a region query."""
    rec.withColumn("bin", F.floor(F.col("start") / BIN)).repartitionByRange(files, "contig", "start").sortWithinPartitions("contig", "start").write.mode("overwrite").parquet(path)
