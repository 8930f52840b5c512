"""Known features beside calls: a register of sources, lookup by start or interval, and values taken from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import intervals

#: Bytes of a site set that is sent to every task; a larger one is joined by shuffling.
BROADCAST_BYTES = 64 << 20
_SITE_BYTES = 32


class Registry:
    """Feature tables by name; a path is read by the form that its end names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.readers = spark, {}, {}
        self.reads(".parquet", lambda path: spark.read.parquet(path))

    def reads(self, suffix: str, reader: Callable[[str], DataFrame]) -> None:
        self.readers[suffix] = reader

    def add(self, name: str, source: DataFrame | str) -> None:
        if name in self.tables:
            raise ValueError(f"a source named {name} is there already")
        if isinstance(source, str):
            known = [s for s in self.readers if source.rstrip("/").lower().endswith(s)]
            if not known:
                raise ValueError(f"no reader for {source}")
            source = self.readers[max(known, key=len)](source)
        self.tables[name] = source

    def get(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no source named {name}; there are {sorted(self.tables)}")
        return self.tables[name]


def lookup(calls: DataFrame, features: DataFrame, start_only: bool = False) -> DataFrame:
    """Calls with each feature (columns suffixed _r) that overlaps them, or that begins where they do; calls without any stay."""
    if not start_only:
        return intervals.overlap_join(calls, features, how="left")
    named = features.select(*(F.col(c).alias(f"{c}_r") for c in features.columns))
    return calls.join(named, (F.col("contig") == F.col("contig_r")) & (F.col("start") == F.col("start_r")), "left")


def on_sites(records: DataFrame, sites: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Records (by contig and start) on a site set, which is broadcast only if its counted size is under ``most`` bytes."""
    small = sites.count() * _SITE_BYTES <= most
    keyed = sites.select("contig", F.col("pos").alias("start")).distinct()
    return records.join(F.broadcast(keyed) if small else keyed, ["contig", "start"], "left_semi")


def expression(calls: DataFrame, resource: DataFrame, field: str, concordant: bool = True) -> DataFrame:
    """Calls (contig, start, ref, alts) with ``field`` of the resource's record at their start, one value for each alternate.

    The resource has (contig, start, ref, alts, rec_no) and an array per alternate.  A value goes to the alternate of the same
    name; one that the resource lacks is null.  With ``concordant`` REF must be the same.  The first record in order counts.
    """
    first = resource.groupBy("contig", "start").agg(F.min_by(F.struct("ref", "alts", field), "rec_no").alias("_r"))
    joined = calls.join(first, ["contig", "start"], "left")
    fits = (F.col("_r.ref") == F.col("ref")) if concordant else F.lit(True)
    at = lambda a: F.nullif(F.array_position(F.col("_r.alts"), a), F.lit(0)) - 1
    values = F.transform("alts", lambda a: F.when(fits, F.get(F.col(f"_r.{field}"), at(a))))
    return joined.withColumn(field, values).drop("_r")


def grouped_on_start(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(contig, start, rows): records that begin at one place, in order.  The rows of one start are gathered."""
    return records.groupBy("contig", "start").agg(F.sort_array(F.collect_list(F.struct(*order, *(k for k in keys if k not in order)))).alias("rows"))


def rightmost(calls: DataFrame, features: DataFrame, order: list[str]) -> DataFrame:
    """Each call with the feature that begins last among those that overlap it, the largest by ``order`` of equal starts.

    That is the last to start up to the call's end, or else the one on top where the call starts after all are painted in their
    order; pairs are not made.  Rows whose end lies before their start are paired, as both tests have to hold for them.
    """
    from . import sites

    plain = F.col("start") <= F.col("end")
    whole = F.struct(F.col("start").alias("start_r"), *(F.col(c).alias(f"{c}_r") for c in [*order, *(c for c in features.columns if c not in ("start", *order))]))
    # Of features on one interval the largest hides the others.
    f = features.where(plain & F.col("contig").isNotNull()).groupBy("contig", "start", "end").agg(F.max(whole).alias("_f"))
    pieces = sites.latest_pieces(f.withColumn("sample", F.lit(0)), ["_f"]).select("contig", F.col("first").alias("pos"), "last", "_f")
    c = calls.where(plain)
    c = intervals.last_before(c, "end", f.select("contig", F.col("start").alias("pos"), "_f"), F.col("_f"), "_by_end")
    c = intervals.last_before(c, "start", pieces, F.struct("pos", "last", "_f"), "_by_start")
    inside = F.when(F.col("_by_end.start_r") >= F.col("start"), F.col("_by_end"))
    under = F.when(F.col("_by_start.last") >= F.col("start"), F.col("_by_start._f"))
    found = c.select(*calls.columns, F.coalesce(inside, under).alias("feature")).where("feature is not null")
    odd = intervals.overlap_join(calls.where(~plain), features).unionByName(intervals.overlap_join(calls.where(plain), features.where(~plain)))
    odd = odd.select(*calls.columns, F.struct("start_r", *(f"{x}_r" for x in [*order, *(c for c in features.columns if c not in ("start", *order))])).alias("feature"))
    return found.union(odd).groupBy(*calls.columns).agg(F.max("feature").alias("feature"))


def spanning(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the interval from the first start to the last end."""
    return df.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def within_margin(a_start: Column, a_end: Column, b_start: Column, b_end: Column, margin: int) -> Column:
    """Whether two intervals of one contig overlap after one is widened at both ends."""
    return (a_start - margin <= b_end) & (b_start <= a_end + margin)


def meet(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct(start, end) that two intervals share; null if none."""
    start, end = F.greatest(a_start, b_start), F.least(a_end, b_end)
    return F.when(start <= end, F.struct(start.alias("start"), end.alias("end")))


def contiguous(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """struct(start, end) of two intervals that overlap or touch, as one; null if they lie apart."""
    return F.when((a_start <= b_end + 1) & (b_start <= a_end + 1), F.struct(F.least(a_start, b_start).alias("start"), F.greatest(a_end, b_end).alias("end")))
