"""Call sets as variant text: genotype strings, record lines, headers, windows, one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO")


def genotype_text(gt: Column, phased: Column | None = None) -> Column:
    """Allele numbers joined by "/" or "|"; a negative one is "."."""
    marks = F.transform(gt, lambda a: F.when(a < 0, ".").otherwise(a.cast("string")))
    plain = F.array_join(marks, "/")
    return plain if phased is None else F.when(phased, F.array_join(marks, "|")).otherwise(plain)


def call_text(fields: list[Column]) -> Column:
    """A call's fields joined by ":", missing ones ".", trailing missing ones dropped."""
    joined = F.concat_ws(":", *(F.coalesce(f.cast("string"), F.lit(".")) for f in fields))
    return F.regexp_replace(joined, r"(:\.)+$", "")


def no_call(ploidy: int) -> str:
    return "/".join("." * ploidy)


def format_keys(present: dict[str, Column]) -> Column:
    """Aggregate: FORMAT's keys that any call of the record has, GT first, others in the given order."""
    keys = [F.when(F.bool_or(c.isNotNull()), F.lit(k)) for k, c in sorted(present.items(), key=lambda x: (x[0] != "GT", list(present).index(x[0])))]
    return F.concat_ws(":", *keys)


def record_line(contig: Column, start: Column, id_: Column, ref: Column, alts: Column, qual: Column, filters: Column, info: Column, format_: Column | None = None, calls: Column | None = None) -> Column:
    """A tab-separated record in the order of the format's columns; empty and null parts are "."."""
    text = lambda c: F.when(c.isNull() | (c.cast("string") == ""), ".").otherwise(c.cast("string"))
    whole = [contig, start, id_, ref, F.array_join(alts, ","), qual, filters, info]
    line = F.concat_ws("\t", *(text(c) for c in whole))
    return line if format_ is None else F.concat_ws("\t", line, text(format_), F.array_join(calls, "\t"))


def info_text(fields: dict[str, Column]) -> Column:
    """"KEY=value" of the fields that are not null; a true flag is its key alone."""

    def one(k: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.concat(F.lit(k + "="), c.cast("string")))

    return F.concat_ws(";", *(one(k, c) for k, c in fields.items()))


def header_lines(contigs: list[tuple[str, int]], fields: list[tuple[str, str, str, str, str]], samples: list[str], dropped: tuple[str, ...] = ("GVCFBlock",), extra: list[str] = ()) -> list[str]:
    """Header of a genotyped call set: lines (kind, id, number, type, text), contigs, and sorted sample names."""
    out = ["##fileformat=VCFv4.2"]
    out += [f'##{kind}=<ID={i},Number={n},Type={t},Description="{text}">' for kind, i, n, t, text in fields]
    out += [line for line in extra if not any(line.startswith(f"##{d}") for d in dropped)]
    out += [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    names = sorted(set(samples))
    return [*out, "#" + "\t".join([*FIRST, *(["FORMAT", *names] if names else [])])]


def window_name(contig: str, start: int, end: int, length: int, index: int) -> str:
    """Name of a window's output; a whole contig has no range."""
    return f"result.{contig}.{index}.vcf.gz" if start <= 1 and end >= length else f"result.{contig}_{start}_{end}.{index}.vcf.gz"


def write_windows(lines: DataFrame, path: str, window: str = "window") -> None:
    """``lines(window, contig_idx, start, line)`` as compressed text, a folder for each window, sorted inside it."""
    out = lines.repartition(window).sortWithinPartitions(window, "contig_idx", "start")
    out.select(window, F.col("line").alias("value")).write.mode("overwrite").partitionBy(window).option("compression", "gzip").text(path)


def write_sorted(lines: DataFrame, path: str, header: list[str], files: int | None = None) -> None:
    """``lines(contig_idx, start, line)`` in global order below one header; part files follow one another, one file if asked.

    Gzip members may be joined byte by byte, so part files in name order are one call set.
    """
    spark = lines.sparkSession
    top = spark.createDataFrame([(-1, k, h) for k, h in enumerate(header)], "contig_idx long, start long, line string")
    whole = top.union(lines.select(F.col("contig_idx").cast("long"), F.col("start").cast("long"), "line"))
    ranged = whole.coalesce(1).sortWithinPartitions("contig_idx", "start") if files == 1 else whole.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), "contig_idx", "start").sortWithinPartitions("contig_idx", "start")
    ranged.select(F.col("line").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)
