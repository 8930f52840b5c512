"""Interval algebra over (contig, start, end) tables, 1-based and closed.

Joins and merges cut intervals into bins first, so that no task holds a whole contig's raw rows:
equal keys are (contig, bin), and only what is left after merging inside bins meets per contig.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 12


def binned(df: DataFrame, size: int = BIN) -> DataFrame:
    """One row for each bin that an interval touches."""
    return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))


def in_bins(df: DataFrame, at: str = "start", size: int = BIN) -> DataFrame:
    """Adds the bin in which a row starts."""
    return df.withColumn("bin", F.floor(F.col(at) / size))


def carried(df: DataFrame, order: list[str], column: Column, how, output: str, frame: str = "before") -> DataFrame:
    """Adds ``how`` (F.sum, F.max) of ``column`` over a contig's rows before each row of ``df(contig, bin, ..)``, or up to it.

    A window per (contig, bin) and one over the bins' totals, so that no task holds a contig's rows.  ``frame``: "before" is
    all rows before in order, "below" those with a smaller value of the one order column, "upto" includes the row.
    """
    w = Window.partitionBy("contig", "bin").orderBy(*order)
    inside = {"before": w.rowsBetween(Window.unboundedPreceding, -1), "below": w.rangeBetween(Window.unboundedPreceding, -1), "upto": w.rowsBetween(Window.unboundedPreceding, 0)}[frame]
    df = df.withColumn("_value", column)
    totals = df.groupBy("contig", "bin").agg(how("_value").alias("_total"))
    carry = totals.select("contig", "bin", how("_total").over(Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    out = df.join(carry, ["contig", "bin"]).withColumn("_inside", how("_value").over(inside))
    both = F.greatest("_inside", "_carry") if how is F.max else F.coalesce("_inside", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    return out.withColumn(output, both).drop("_value", "_carry", "_inside")


def last_before(points: DataFrame, at: str, events: DataFrame, value: Column, output: str) -> DataFrame:
    """Adds the largest ``value`` of the events(contig, pos, ..) at or before a row's ``at`` on its contig, null if there is none."""
    steps = events.select("contig", "pos", value.alias("_v")).groupBy("contig", "pos").agg(F.max("_v").alias("_v"))
    asked = points.select("contig", F.col(at).alias("pos")).distinct().withColumn("_v", F.lit(None).cast(steps.schema["_v"].dataType))
    both = in_bins(steps.union(asked).where("contig is not null and pos is not null").groupBy("contig", "pos").agg(F.max("_v").alias("_v")), "pos")
    upto = carried(both, ["pos"], F.col("_v"), F.max, output, "upto").select("contig", F.col("pos").alias(at), output)
    return points.join(upto, ["contig", at], "left")


def with_following(df: DataFrame, at: str, output: str, size: int = BIN) -> DataFrame:
    """Adds the next value of ``at`` on the contig, null after the last; rows have distinct values."""
    df = in_bins(df, at, size)
    firsts = df.groupBy("contig", "bin").agg(F.min(at).alias("_first"))
    later = firsts.select("contig", "bin", F.lead("_first").over(Window.partitionBy("contig").orderBy("bin")).alias("_later"))
    inside = F.lead(at).over(Window.partitionBy("contig", "bin").orderBy(at))
    return df.join(later, ["contig", "bin"]).withColumn(output, F.coalesce(inside, "_later")).drop("bin", "_later")


def coverage(sites: DataFrame, records: DataFrame, values: list[str], size: int = BIN) -> DataFrame:
    """(contig, pos, n, values): number and sums of the records over each site, by steps at records' ends instead of pairs."""
    up = records.select("contig", F.col("start").alias("pos"), F.lit(1).cast("long").alias("n"), *values, F.lit(False).alias("_site"))
    down = records.select("contig", (F.col("end") + 1).alias("pos"), F.lit(-1).cast("long").alias("n"), *((-F.col(v)).alias(v) for v in values), F.lit(False).alias("_site"))
    asked = sites.select("contig", "pos", F.lit(0).cast("long").alias("n"), *(F.lit(0).cast(records.schema[v].dataType).alias(v) for v in values), F.lit(True).alias("_site"))
    sums = ["n", *values]
    steps = up.union(down).union(asked).groupBy("contig", "pos").agg(*(F.sum(v).alias(v) for v in sums), F.max("_site").alias("_site"))
    steps = in_bins(steps, "pos", size)
    total = steps.groupBy("contig", "bin").agg(*(F.sum(v).alias(f"_{v}") for v in sums))
    over = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select("contig", "bin", *(F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_{v}") for v in sums))
    inside = Window.partitionBy("contig", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.join(carry, ["contig", "bin"]).select("contig", "pos", "_site", *((F.sum(v).over(inside) + F.col(f"_{v}")).alias(v) for v in sums))
    return out.where("_site").drop("_site")


def _islands(df: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Merges rows of one key whose start is at most ``reach`` beyond every earlier end."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + reach), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def _joined(local: DataFrame, reach: int, size: int) -> DataFrame:
    """Islands of a contig from those of its bins; runs are numbered by bins' totals, not in one task per contig."""
    local = in_bins(local.select("contig", "start", "end"), "start", size)
    marked = carried(local, ["start", "end"], F.col("end"), F.max, "_before")
    new = F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before") + reach), 1).otherwise(0)
    numbered = carried(marked.withColumn("_new", new).drop("_before"), ["start", "end"], F.col("_new"), F.sum, "_island", "upto")
    return numbered.groupBy("contig", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merged(df: DataFrame, abutting: bool = True, size: int = BIN) -> DataFrame:
    """Maximal runs of overlapping (and abutting) intervals per contig."""
    if not abutting:
        # Clipping at bin edges would hide whether intervals overlap across them, so an interval stays whole in its first bin.
        local = _islands(df.select("contig", "start", "end", F.floor(F.col("start") / size).alias("bin")), ["contig", "bin"], 0)
        return _joined(local, 0, size)
    cut = binned(df.select("contig", "start", "end"), size)
    cut = cut.select("contig", "bin", F.greatest("start", F.col("bin") * size).alias("start"), F.least("end", F.col("bin") * size + size - 1).alias("end"))
    local = _islands(cut, ["contig", "bin"], 1)
    # Only what touches a bin's edge can go on in the next one: two runs a bin at most meet per contig.
    touches = (F.col("start") == F.col("bin") * size) | (F.col("end") == F.col("bin") * size + size - 1)
    inner = local.where(~touches).select("contig", "start", "end")
    return inner.union(_islands(local.where(touches).select("contig", "start", "end"), ["contig"], 1))


def swept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Segments (contig, start, end, in_a, in_b) between the ends of both sides' merged intervals."""

    def ends(df: DataFrame, da: int, db: int) -> DataFrame:
        m = merged(df)
        up = m.select("contig", F.col("start").alias("pos"), F.lit(da).alias("da"), F.lit(db).alias("db"))
        return up.union(m.select("contig", (F.col("end") + 1).alias("pos"), F.lit(-da), F.lit(-db)))

    steps = ends(a, 1, 0).union(ends(b, 0, 1)).groupBy("contig", "pos").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy("contig").orderBy("pos")
    state = steps.select("contig", F.col("pos").alias("start"), (F.lead("pos").over(w) - 1).alias("end"), (F.sum("da").over(w) > 0).alias("in_a"), (F.sum("db").over(w) > 0).alias("in_b"))
    return state.where(F.col("end").isNotNull())


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(a.select("contig", "start", "end").union(b.select("contig", "start", "end")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(swept(a, b).where("in_a and in_b"))


def subtraction(a: DataFrame, b: DataFrame) -> DataFrame:
    return merged(swept(a, b).where("in_a and not in_b"))


def covered_size(df: DataFrame) -> DataFrame:
    return merged(df).groupBy("contig").agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def padded(df: DataFrame, by: int, length: Column | int) -> DataFrame:
    """Flanks added, clamped to the contig, merged."""
    length = length if isinstance(length, Column) else F.lit(length)
    return merged(df.select("contig", F.greatest(F.col("start") - by, F.lit(1)).alias("start"), F.least(F.col("end") + by, length).alias("end")))


def segments(df: DataFrame) -> DataFrame:
    """Minimal segments between all ends of possibly overlapping intervals (breakpoint combine)."""
    points = df.select("contig", F.col("start").alias("pos")).union(df.select("contig", F.col("end") + 1)).distinct()
    return with_following(points, "pos", "_next").where("_next is not null").select("contig", F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"))


def split_by_size(df: DataFrame, size: int) -> DataFrame:
    """Windows of a fixed size and a remainder."""
    out = df.select("contig", "end", F.explode(F.sequence("start", "end", F.lit(size).cast("long"))).alias("start"))
    return out.select("contig", "start", F.least(F.col("start") + size - 1, "end").alias("end"))


def split_by_count(df: DataFrame, parts: int) -> DataFrame:
    """Windows of max(floor(length / (0.95 parts)), 1) positions."""
    sized = df.withColumn("_size", F.greatest(F.floor((F.col("end") - F.col("start") + 1) / (0.95 * parts)), F.lit(1)))
    out = sized.select("contig", "end", "_size", F.explode(F.sequence("start", "end", "_size")).alias("start"))
    return out.select("contig", "start", F.least(F.col("start") + F.col("_size") - 1, "end").alias("end"))


def split_balanced(sites: DataFrame, parts: int, least: int) -> DataFrame:
    """Windows of n sites each, from a site to a site; a last one with fewer ends one past its last site.

    n = max(floor(sites / (0.98 parts)), least), per contig.
    """
    ranked = carried(in_bins(sites.select("contig", "pos"), "pos"), ["pos"], F.lit(1), F.sum, "rank")
    totals = sites.groupBy("contig").agg(F.count("*").alias("_sites"))
    n = F.greatest(F.floor(F.col("_sites") / (0.98 * parts)), F.lit(least))
    dealt = ranked.join(totals, "contig").withColumn("_n", n).withColumn("_window", F.floor(F.col("rank") / F.col("_n")))
    out = dealt.groupBy("contig", "_window", "_n").agg(F.min("pos").alias("start"), F.max("pos").alias("_last"), F.count("*").alias("_held"))
    return out.select("contig", "start", F.when(F.col("_held") < F.col("_n"), F.col("_last") + 1).otherwise(F.col("_last")).alias("end"))


def uncovered(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """Sites that no window holds, and windows' overlaps are :func:`disorder`: both are empty for a valid split."""
    return coverage(sites, windows, []).where("n = 0").select("contig", "pos")


def fitting(df: DataFrame) -> int:
    """A bin size near the mean length, so that intervals touch three bins at most on average, of whatever lengths they are."""
    mean = df.agg(F.avg(F.abs(F.col("end") - F.col("start")) + 1)).first()[0]
    return max(16, 1 << math.ceil(math.log2(mean or 1)))


def overlap_join(left: DataFrame, right: DataFrame, size: int = BIN, how: str = "inner") -> DataFrame:
    """Rows of ``left`` and ``right`` (columns suffixed _r) that share a position; each pair once.

    A pair is taken in the first bin both sides touch.  ``left`` keeps unmatched rows if ``how`` is "left".  What meets in a bin
    grows with ``size``, the rows with what does not fit one; :func:`fitting` balances both.
    """
    r = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns))
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_r") / size), F.floor(F.col("end_r") / size))))
    l = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))  # noqa: E741
    meets = (F.col("start") <= F.col("end_r")) & (F.col("start_r") <= F.col("end"))
    if how == "inner":
        once = l["_bin"] == F.floor(F.greatest("start", "start_r") / size)
        return l.join(r, (F.col("contig") == F.col("contig_r")) & (l["_bin"] == r["_bin"]) & meets & once).drop("_bin")
    # A left row is one row for each of its bins: it is lonely if none of them met, which a flag summed per row tells.
    every = left.withColumn("_id", F.monotonically_increasing_id())
    l = every.withColumn("_lbin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))  # noqa: E741
    once = F.col("_lbin") == F.floor(F.greatest("start", "start_r") / size)
    joined = l.join(r.withColumnRenamed("_bin", "_rbin"), (F.col("contig") == F.col("contig_r")) & (F.col("_lbin") == F.col("_rbin")) & meets & once, "left")
    met = F.max(F.col("_rbin").isNotNull()).over(Window.partitionBy("_id"))
    first = F.col("_lbin") == F.floor(F.col("start") / size)
    kept = joined.withColumn("_met", met).where(F.col("_rbin").isNotNull() | (~F.col("_met") & first))
    return kept.drop("_id", "_lbin", "_rbin", "_met")


def overlap_sums(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left`` that share a position with any of ``right``, with n and total: number and sum of ``value`` over those.

    What overlaps is what starts up to a row's end without what ends before its start, so pairs are not made.  Only rows whose
    end lies before their start are paired, as both tests have to hold for them.
    """
    plain = F.col("start") <= F.col("end")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    r = right.where(plain & F.col("contig").isNotNull()).select("contig", "start", "end", F.coalesce(F.col(value), zero).alias("v"))
    up = r.select("contig", F.col("start").alias("pos"), one.alias("up"), F.col("v").alias("vup"), zero.alias("down"), zero.alias("vdown"))
    down = r.select("contig", (F.col("end") + 1).alias("pos"), zero, zero, one, F.col("v"))
    l = left.where(plain & F.col("contig").isNotNull())  # noqa: E741
    asked = l.select("contig", F.col("start").alias("pos"), zero, zero, zero, zero).union(l.select("contig", "end", zero, zero, zero, zero))
    sums = ["up", "vup", "down", "vdown"]
    steps = in_bins(up.union(down).union(asked).groupBy("contig", "pos").agg(*(F.sum(c).alias(c) for c in sums)), "pos")
    total = steps.groupBy("contig", "bin").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    over = Window.partitionBy("contig").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.select("contig", "bin", *(F.coalesce(F.sum(f"_{c}").over(over), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy("contig", "bin").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = steps.join(carry, ["contig", "bin"]).select("contig", "pos", *((F.sum(c).over(inside) + F.col(f"_{c}")).alias(f"_{c}") for c in sums))
    first = upto.select("contig", F.col("pos").alias("start"), "_down", "_vdown")
    last = upto.select("contig", F.col("pos").alias("end"), "_up", "_vup")
    found = l.join(first, ["contig", "start"]).join(last, ["contig", "end"])
    found = found.select(*left.columns, (F.col("_up") - F.col("_down")).alias("n"), (F.col("_vup") - F.col("_vdown")).alias("total")).where("n > 0")
    odd = overlap_join(left.where(~plain), right).unionByName(overlap_join(left.where(plain), right.where(~plain)))
    return found.union(odd.select(*left.columns, one.alias("n"), F.coalesce(F.col(f"{value}_r"), zero).alias("total")))


def overlapping(left: DataFrame, right: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of ``left`` that share a position with any interval of ``right``."""
    cover = merged(right, size=size)
    pairs = overlap_join(left.withColumn("_id", F.monotonically_increasing_id()), cover, size)
    return pairs.dropDuplicates(["_id"]).select(*left.columns)


def reciprocal(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """Pairs (columns of ``b`` suffixed _r) whose intersection is at least ``share`` (in (0, 1]) of both lengths.

    Lengths of a pair differ by ``share`` at most and starts by little more than the length, so rows meet by the power of two of
    ``a``'s length and by starts in bins of that size: those that meet are nearly those that fit, at any mix of lengths.
    """
    length = F.col("end") - F.col("start") + 1
    level = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    size = F.pow(F.lit(2.0), F.col("_level") + 1).cast("long")
    low, near = share * (1 - 1e-9), (1 + 1e-9) / share
    l = a.where(length > 0).withColumn("_level", level(length))  # noqa: E741
    before, after = F.ceil(length * (near - 1)).cast("long") + 1, F.ceil(length * (1 - low)).cast("long") + 1
    l = l.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("start") - before) / size), F.floor((F.col("start") + after) / size))))  # noqa: E741
    r = b.where(length > 0).withColumn("_level", F.explode(F.sequence(F.greatest(level(length * low), F.lit(0)), level(length * near))))
    r = r.withColumn("_bin", F.floor(F.col("start") / size)).select(*(F.col(c).alias(f"{c}_r") for c in b.columns), F.col("_level").alias("_level_r"), F.col("_bin").alias("_bin_r"))
    inter = F.least("end", "end_r") - F.greatest("start", "start_r") + 1
    fits = (inter >= share * (F.col("end") - F.col("start") + 1)) & (inter >= share * (F.col("end_r") - F.col("start_r") + 1))
    same = (F.col("contig") == F.col("contig_r")) & (F.col("_level") == F.col("_level_r")) & (F.col("_bin") == F.col("_bin_r"))
    return l.join(r, same & fits).drop("_level", "_level_r", "_bin", "_bin_r")


def overlap_map(keys: DataFrame, values: DataFrame) -> DataFrame:
    """Each key interval with the sorted list of intervals that overlap it."""
    keys, values = (x.select("contig", "start", "end").distinct() for x in (keys, values))
    pairs = overlap_join(keys, values, max(fitting(keys), fitting(values)))
    return pairs.groupBy("contig", "start", "end").agg(F.sort_array(F.collect_list(F.struct(F.col("start_r"), F.col("end_r")))).alias("hits"))


def disorder(df: DataFrame) -> DataFrame:
    """Intervals that overlap one before them in (start, end) order."""
    return carried(in_bins(df), ["start", "end"], F.col("end"), F.max, "_before").where("_before >= start").drop("_before", "bin")


def _offsets(sizes: DataFrame) -> DataFrame:
    """(contig, covered, base, total): covered size before each contig and of all, from one row per contig."""
    w = Window.orderBy("contig")
    return sizes.withColumn("base", F.coalesce(F.sum("covered").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("covered").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def scattered(df: DataFrame, parts: int) -> DataFrame:
    """Each interval cut so that ``parts`` shares of equal covered size result; adds part (0-based)."""
    m = in_bins(merged(df).withColumn("n", F.col("end") - F.col("start") + 1))
    sizes = m.groupBy("contig").agg(F.sum("n").alias("covered"))
    m = carried(m, ["start"], F.col("n"), F.sum, "_at").join(_offsets(sizes), "contig").withColumn("at", F.col("_at") + F.col("base"))
    m = m.withColumn("share", F.ceil(F.col("total") / parts))
    m = m.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / F.col("share")), F.floor((F.col("at") + F.col("n") - 1) / F.col("share")))))
    a = F.greatest(F.col("part") * F.col("share"), F.col("at"))
    b = F.least((F.col("part") + 1) * F.col("share"), F.col("at") + F.col("n"))
    return m.select("contig", (F.col("start") + a - F.col("at")).alias("start"), (F.col("start") + b - F.col("at") - 1).alias("end"), F.col("part").cast("long").alias("part"))


def scattered_by_contig(df: DataFrame, parts: int) -> DataFrame:
    """(contig, part): whole contigs dealt in order so that each part nears the ideal size."""
    out = _offsets(covered_size(df))
    return out.select("contig", F.least(F.floor(F.col("base") * parts / F.col("total")), F.lit(parts - 1)).cast("long").alias("part"))


def break_points(df: DataFrame, multiple: int) -> DataFrame:
    """Ends of break bands inside [start, end], 0-based: ((start + 1) div m + 1) m - 1 by steps of m."""
    first = (F.floor((F.col("start") + 1) / multiple) + 1) * multiple - 1
    out = df.withColumn("first", first).where("first <= end")
    return out.withColumn("stop", F.explode(F.sequence("first", "end", F.lit(multiple).cast("long")))).drop("first")


def covered_upstream(df: DataFrame, length: str = "deleted") -> DataFrame:
    """Adds covered: whether a deletion that starts strictly earlier reaches a row's start."""
    reach = F.when(F.col(length) > 0, F.col("start") + F.col(length))
    out = carried(in_bins(df), ["start"], reach, F.max, "_reach", "below")
    return out.withColumn("covered", F.coalesce(F.col("_reach") >= F.col("start"), F.lit(False))).drop("_reach", "bin")


def bands(df: DataFrame, keys: list[str], order: list[str], value: str, edges: list[float]) -> DataFrame:
    """Runs of consecutive rows of one key whose value lies in one band: (keys, band, run, n, least value, first and last order)."""
    band = F.lit(0)
    for k, edge in enumerate(edges):
        band = F.when(F.col(value) >= edge, k).otherwise(band)
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("band", band)
    marked = marked.withColumn("_new", F.when(F.lag("band").over(w) == F.col("band"), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "band", "run").agg(F.count("*").alias("n"), F.min(value).alias("least"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def reference_blocks(df: DataFrame, ties: list[str], value: str, edges: list[float], depth: str, pl: str, size: int) -> DataFrame:
    """Blocks (contig, sample, run, start, end, dp, min_dp, gq, pl) of a sample's hom-ref records that follow one another in one band.

    A block has the least value of each of ``size`` likelihoods, the upper median and the least of the depths, and the
    quality of its likelihoods.  A gap, another band or another number of likelihoods begins a new one.  Depths are gathered as counts.
    """
    from .genotypes import upper_median

    band = F.lit(0)
    for k, edge in enumerate(edges):
        band = F.when(F.col(value) >= edge, k).otherwise(band)
    keys = ["contig", "sample"]
    w = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    marked = df.withColumn("_band", band).withColumn("_size", F.size(pl))
    same = (F.lag("_band").over(w) == F.col("_band")) & (F.lag("_size").over(w) == F.col("_size")) & (F.lag("end").over(w) + 1 >= F.col("start"))
    runs = marked.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*keys, "run"]
    least = [F.min(F.get(pl, F.lit(k))).alias(f"_p{k}") for k in range(size)]
    out = runs.groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(depth).alias("min_dp"), *least)
    medians = upper_median(runs.select(*keys, depth), keys, depth).withColumnRenamed("median", "dp")
    whole = F.array(*(F.col(f"_p{k}") for k in range(size)))
    ranked = F.sort_array(whole)
    return out.join(medians, keys).select(*keys, "start", "end", "dp", "min_dp", (F.get(ranked, F.lit(1)) - F.get(ranked, F.lit(0))).alias("gq"), whole.alias("pl"))


def banded(records: DataFrame, values: list[str], multiple: int | None = None) -> DataFrame:
    """(contig, start, end, n, values): stretches between all changes of the set of open records, with their number and sums.

    With ``multiple``, stretches also end before each multiple of it.  Stretches that no record covers are left out.
    """
    cuts = records.select("contig", F.col("start").alias("pos")).union(records.select("contig", F.col("end") + 1))
    if multiple:
        whole = records.groupBy("contig").agg(F.min("start").alias("a"), F.max("end").alias("b"))
        first = F.greatest(F.ceil(F.col("a") / multiple), F.lit(1)) * multiple
        bands = whole.where(first <= F.col("b")).select("contig", F.explode(F.sequence(first, F.col("b"), F.lit(multiple).cast("long"))).alias("pos"))
        cuts = cuts.union(bands)
    points = with_following(cuts.distinct(), "pos", "_next").where("_next is not null")
    sums = coverage(points.select("contig", "pos"), records, values).where("n > 0")
    return sums.join(points, ["contig", "pos"]).select("contig", F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), "n", *values)
