"""Option and region strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size(text: Column) -> Column:
    """"300M" as 300000000: decimal units k, M and G in either case, null if malformed."""
    number, unit = F.regexp_extract(text, r"^(\d+)([kKmMgG]?)$", 1), F.lower(F.regexp_extract(text, r"^(\d+)([kKmMgG]?)$", 2))
    by = F.when(unit == "k", 1000).when(unit == "m", 1_000_000).when(unit == "g", 1_000_000_000).otherwise(1).cast("long")
    return F.when(number != "", number.cast("long") * by)


_REGION = r"^(.+?)(?::([\d,]+)(?:-([\d,]+)|(\+))?)?$"


def region(text: Column) -> Column:
    """struct(contig, start, end) of "chr:start-end"; a single position is its own end, a bare contig has null ends."""
    part = lambda k: F.nullif(F.replace(F.regexp_extract(text, _REGION, k), F.lit(","), F.lit("")), F.lit("")).cast("long")
    start, end = part(2), part(3)
    stop = F.when(F.regexp_extract(text, _REGION, 4) == "+", F.lit(None)).otherwise(F.coalesce(end, start))
    return F.struct(F.regexp_extract(text, _REGION, 1).alias("contig"), start.alias("start"), stop.alias("end"))
