"""Reference sequences, their dictionaries, interval files, tab-separated tables and pedigrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing

CHUNK = 1 << 16


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(contig, length, idx) of a sequence dictionary or a FASTA index, by the file's own order."""
    rows = spark.read.text(path).select(F.col("value").alias("v"), F.monotonically_increasing_id().alias("_at"))  # such a file is one split
    header = F.col("v").startswith("@")
    name = F.when(header, F.regexp_extract("v", r"\tSN:([^\t]+)", 1)).otherwise(F.split_part("v", F.lit("\t"), F.lit(1)))
    length = F.when(header, F.regexp_extract("v", r"\tLN:(\d+)", 1)).otherwise(F.split_part("v", F.lit("\t"), F.lit(2)))
    found = rows.where(~header | F.col("v").startswith("@SQ")).where(F.col("v") != "").select(name.alias("contig"), length.cast("long").alias("length"), "_at")
    return found.select("contig", "length", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long").alias("idx"))  # one row for each contig


def fasta(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(contig, chunk, bases): upper-case bases in chunks of equal size; chunk k begins at base k * size + 1.

    Each file is read as text split at ">", so a task holds one sequence's text at a time.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    bases = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*[\r\n]+", ""), r"\s", ""))
    whole = rows.select(name.alias("contig"), bases.alias("b"))
    # One pass over the text: a substring by its place would count from the text's start for each chunk.
    pieces = F.regexp_extract_all("b", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    cut = whole.select("contig", F.posexplode(F.when(F.length("b") == 0, F.array(F.lit(""))).otherwise(pieces)).alias("chunk", "bases"))
    return cut.select("contig", F.col("chunk").cast("long").alias("chunk"), "bases")


def bases_at(chunks: DataFrame, regions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``regions(contig, start, end)`` with the bases of each; a stretch beyond the sequence is left out."""
    asked = regions.withColumn("_id", F.monotonically_increasing_id()).withColumn("chunk", F.explode(F.sequence(F.floor((F.col("start") - 1) / chunk), F.floor((F.col("end") - 1) / chunk))))
    joined = asked.join(chunks, ["contig", "chunk"])
    first = F.greatest(F.col("start") - 1 - F.col("chunk") * chunk, F.lit(0))
    last = F.least(F.col("end") - 1 - F.col("chunk") * chunk, F.lit(chunk - 1))
    part = F.substring("bases", (first + 1).cast("int"), (last - first + 1).cast("int"))
    parts = joined.select(*regions.columns, "_id", F.struct("chunk", part.alias("b")).alias("_p"))
    out = parts.groupBy("_id", *regions.columns).agg(F.sort_array(F.collect_list("_p")).alias("_p"))  # as many parts as a region has chunks
    return out.select(*regions.columns, F.array_join("_p.b", "").alias("bases")).where("bases <> ''")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, end) of an interval file: "chr:a-b" lines, BED (0-based, half open) or Picard lists (after an @ header)."""
    rows = spark.read.text(path).select(F.trim("value").alias("v"), F.lower(F.col("_metadata.file_path")).rlike(r"\.bed(\.gz)?(/|$)").alias("bed")).where((F.col("v") != "") & ~F.col("v").rlike("^[@#]|^(track|browser)\\b"))
    tab = F.split("v", "\t")
    listed = F.size(tab) >= 3
    region = parsing.region(F.col("v"))
    begin = F.get(tab, F.lit(1)).cast("long")
    return rows.select(
        F.when(listed, F.get(tab, F.lit(0))).otherwise(region["contig"]).alias("contig"), F.when(F.col("bed"), begin + 1).when(listed, begin).otherwise(region["start"]).alias("start"),
        F.when(listed, F.get(tab, F.lit(2)).cast("long")).otherwise(region["end"]).alias("end"),
    )


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table whose first line that is no comment names the columns."""
    reader = spark.read.option("sep", "\t").option("header", True).option("comment", "#")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(family, sample, father, mother, sex, affected): "0" and "." parents are null; sex is 1 or 2, else null; affected is 2."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where((F.size("p") >= 6) & ~F.get("p", F.lit(0)).startswith("#"))
    known = lambda k: F.when(~F.get("p", F.lit(k)).isin("0", "."), F.get("p", F.lit(k)))
    code = lambda k: F.get("p", F.lit(k))
    return rows.select(code(0).alias("family"), code(1).alias("sample"), known(2).alias("father"), known(3).alias("mother"), F.when(code(4).isin("1", "2"), code(4).cast("int")).alias("sex"), F.when(code(5) == "2", True).when(code(5) == "1", False).alias("affected"))
