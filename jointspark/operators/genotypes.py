"""Genotype rows: assignment, counts, depths, strand tables, per-site medians and histograms.

Everything that is summed over samples is a column expression with map-side combine; only medians
gather, and those gather counts per distinct value rather than values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(pl: Column) -> Column:
    """Index of the likeliest genotype, the first of equal ones."""
    return (F.array_position(pl, F.array_min(pl)) - 1).cast("int")


def quality(pl: Column) -> Column:
    """Phred distance of the second-best genotype."""
    ranked = F.sort_array(pl)
    return F.get(ranked, F.lit(1)) - F.get(ranked, F.lit(0))


def is_called(pl: Column) -> Column:
    """Whether likelihoods say anything: their log10 values sum to less than -0.1."""
    return F.aggregate(pl, F.lit(0.0), lambda a, x: a - x / 10.0) < -0.1


def copies(genotype: Column) -> Column:
    """Alternate copies of a biallelic diploid genotype."""
    return genotype.cast("long")


def allele_counts(df: DataFrame, keys: list[str], pl: str = "pl") -> DataFrame:
    """(keys, ac, an, af) over called genotypes."""
    called = df.where(is_called(F.col(pl)))
    out = called.groupBy(*keys).agg(F.sum(copies(best(F.col(pl)))).alias("ac"), (2 * F.count("*")).alias("an"))
    return out.withColumn("af", F.col("ac") / F.col("an"))


def hard_counts(df: DataFrame, keys: list[str], pl: str = "pl") -> DataFrame:
    """(keys, n_ref, n_het, n_hom) of the likeliest genotypes."""
    g = best(F.col(pl))
    return df.groupBy(*keys).agg(*(F.count_if(g == k).alias(n) for k, n in enumerate(("n_ref", "n_het", "n_hom"))))


def rounded_counts(df: DataFrame, keys: list[str], pl: str = "pl") -> DataFrame:
    """(keys, n_ref, n_het, n_hom, n): each genotype's share of a sample's likelihood, rounded; a sample that knows none counts in n only."""
    shares = _shares(pl)
    whole = lambda k: F.sum(F.floor(F.get(shares, F.lit(k)) + 0.5))
    return df.groupBy(*keys).agg(*(whole(k).alias(c) for k, c in enumerate(("n_ref", "n_het", "n_hom"))), F.count("*").alias("n"))


def _shares(pl: str) -> Column:
    least = F.array_min(pl)
    linear = F.transform(F.col(pl), lambda x: F.pow(F.lit(10.0), (least - x) / 10.0))
    return F.transform(linear, lambda x: x / F.aggregate(linear, F.lit(0.0), lambda a, y: a + y))


def soft_counts(df: DataFrame, keys: list[str], pl: str = "pl") -> DataFrame:
    """(keys, ref, het, hom, n): summed shares of normalised linear likelihoods, and samples."""
    least = F.array_min(pl)
    linear = F.transform(F.col(pl), lambda x: F.pow(F.lit(10.0), (least - x) / 10.0))
    total = F.aggregate(linear, F.lit(0.0), lambda a, x: a + x)
    sums = (F.sum(F.get("_l", F.lit(k)) / F.col("_t")).alias(n) for k, n in enumerate(("ref", "het", "hom")))
    return df.withColumn("_l", linear).withColumn("_t", total).groupBy(*keys).agg(*sums, F.count("*").alias("n"))


def strand_table(df: DataFrame, keys: list[str], alternate: Column, reverse: Column) -> DataFrame:
    """(keys, rf, rr, af, ar): rows by allele and strand."""
    cells = {"rf": ~alternate & ~reverse, "rr": ~alternate & reverse, "af": alternate & ~reverse, "ar": alternate & reverse}
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))


def _ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with their counts, the counts up to them and the total."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*keys)
    return counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(by))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): element [n div 2] of the sorted values, without a mean of two."""
    ranked = _ranked(df, keys, value)
    return ranked.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def histogram(df: DataFrame, keys: list[str], value: str, bin_size: float = 0.1) -> DataFrame:
    """(keys, bin, n): merged histogram; a hundredth of a bin keeps values on a bin's edge in it."""
    key = F.floor((F.col(value) + 0.01 * bin_size) / bin_size)
    return df.groupBy(*keys, key.alias("bin")).agg(F.count("*").alias("n"))


def histogram_median(bins: DataFrame, keys: list[str], bin_size: float = 0.1) -> DataFrame:
    """(keys, median) of merged histograms: the middle bin, or the mean of the two middle ones."""
    by = Window.partitionBy(*keys)
    upto = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    ranked = bins.select("*", upto.alias("_upto"), F.sum("n").over(by).alias("_all"))
    low = F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + 1) / 2), F.col("bin")))
    high = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col("bin")))
    return ranked.groupBy(*keys).agg(((low + high) / 2.0 * bin_size).alias("median"))


def element_sums(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """(keys, pos, total): element-wise sums of arrays."""
    return df.select(*keys, F.posexplode(values).alias("pos", "_v")).groupBy(*keys, "pos").agg(F.sum("_v").alias("total"))


def site_depth(info: Column, least: Column, own: Column, by_allele: Column) -> Column:
    """A record's depth: the site's if positive, else the block minimum, the genotype's, or the alleles' sum."""
    return F.coalesce(F.when(info > 0, info), least, own, by_allele, F.lit(0))


def rank_sums(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, z): Mann-Whitney with mean ranks, tie and continuity correction; z is null where a side is empty.

    Rows are counted per distinct value first, so a key's window holds values, not rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b")).withColumn("n", F.col("a") + F.col("b"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_rank", before + (F.col("n") + 1) / 2.0)
    tie = F.col("n").cast("double")
    out = ranked.groupBy(*keys).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * F.col("_rank")).alias("r1"), F.sum(tie * tie * tie - tie).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    off = F.col("r1") - n1 * (n1 + 1) / 2 - n1 * n2 / 2
    var = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when((n1 > 0) & (n2 > 0) & (var > 0), (off - F.signum(off) * 0.5) / F.sqrt(var))
    return out.select(*keys, "n1", "n2", z.alias("z"))


def variant_depth(df: DataFrame, keys: list[str], pl: str = "pl", depth: str = "dp") -> DataFrame:
    """(keys, depth) over samples whose likeliest genotype holds an alternate allele."""
    return df.where(best(F.col(pl)) > 0).groupBy(*keys).agg(F.sum(depth).alias("depth"))


def downsampled(df: DataFrame, keys: list[str], k: int, identity: list[str]) -> DataFrame:
    """At most ``k`` rows of each key, those with the smallest MD5 of their identity columns; the same on every run."""
    mark = F.md5(F.concat_ws("|", *identity))
    w = Window.partitionBy(*keys).orderBy("_mark", *identity)
    return df.withColumn("_mark", mark).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k", "_mark")


def mle_frequency(ac: Column, an: Column) -> Column:
    """Likeliest frequency from the likeliest count, at most 1."""
    return F.least(F.lit(1.0), ac / an)


def allele_fractions(ad: Column) -> Column:
    """Share of each alternate allele in the depth, an array without REF; null without depth."""
    total = F.aggregate(ad, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, F.transform(F.slice(ad, F.lit(2), F.size(ad) - 1), lambda x: x / total))


def summed_strands(df: DataFrame, keys: list[str], sb: str, least: int) -> DataFrame:
    """(keys, rf, rr, af, ar) over samples whose four counts sum to more than ``least``; null where none does."""
    total = F.aggregate(F.col(sb), F.lit(0).cast("long"), lambda a, x: a + x)
    used = F.when(total > least, F.col(sb))
    return df.groupBy(*keys).agg(*(F.sum(F.get(used, F.lit(k))).alias(c) for k, c in enumerate(("rf", "rr", "af", "ar"))))


def quality_depth(df: DataFrame, keys: list[str], pl: str, ad: str, dp: str, has_reference: Column | None = None) -> DataFrame:
    """(keys, depth): depth over variant samples, by alleles where known, else as given.

    Samples with an alternate allele in more than one read (and REF, if so asked) are preferred where a site has any.
    """
    total = F.aggregate(F.col(ad), F.lit(0).cast("long"), lambda a, x: a + x)
    supported = F.exists(F.slice(F.col(ad), F.lit(2), F.greatest(F.size(ad) - 1, F.lit(0))), lambda x: x > 1)
    strict = F.sum(F.when(supported & (has_reference if has_reference is not None else F.lit(True)), total))
    loose = F.sum(F.when(F.coalesce(total, F.lit(0)) != 0, total).otherwise(F.col(dp)))
    out = df.where(best(F.col(pl)) > 0).groupBy(*keys).agg(strict.alias("_strict"), loose.alias("_loose"))
    return out.select(*keys, F.when(F.coalesce("_strict", F.lit(0)) > 0, F.col("_strict")).otherwise(F.col("_loose")).alias("depth"))


def allele_quality_by_depth(log10_absent: Column, own: Column, reference: Column) -> Column:
    """An allele's quality over its depth and REF's."""
    return -10 * log10_absent / (own + reference)


def cleaned(df: DataFrame, alleles: int) -> DataFrame:
    """Genotype rows (gt, dp, min_dp, pgt, ad, sb) as they are written.

    A block's least depth becomes the depth, strand counts go, a phased heterozygous mark of a homozygous alternate call
    is mended, and a missing depth by allele is all REF's.
    """
    depth = F.coalesce("min_dp", "dp")
    hom = F.forall("gt", lambda a: (a > 0) & (a == F.get("gt", F.lit(0))))
    pgt = F.when(hom & (F.col("pgt") == "0|1"), "1|1").otherwise(F.col("pgt"))
    ad = F.coalesce(F.col("ad"), F.concat(F.array(depth.cast("long")), F.array_repeat(F.lit(0).cast("long"), alleles - 1)))
    return df.withColumn("pgt", pgt).withColumn("ad", ad).withColumn("dp", depth).drop("min_dp", "sb")


#: Qualities by depth from this on are drawn anew around the next, fixed values.
QD_LIMIT, QD_MEAN, QD_SPREAD = 35.0, 30.0, 3.0


def quality_by_depth(quality: Column, depth: Column, jitter: list[Column] | None = None) -> Column:
    """Quality over depth; with ``jitter``, an implausibly high value is replaced by one near 30, drawn from a hash of the columns."""
    value = quality / depth
    if jitter is None:
        return value
    u, v = (F.pmod(F.xxhash64(*jitter, F.lit(k)), F.lit(1 << 30)) / float(1 << 30) for k in (1, 2))
    normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(v * 6.283185307179586)
    return F.when(value < QD_LIMIT, value).otherwise(QD_MEAN + QD_SPREAD * normal)


def root_mean_square_quality(df: DataFrame, keys: list[str], raw: str, older: str, depth: str, reference_depth: Column) -> DataFrame:
    """(keys, mq): from [sum of squares, reads] where a record has them, else from the older sum over the depth without reference calls'."""
    squares = F.sum(F.coalesce(F.get(F.col(raw), F.lit(0)), F.col(older)))
    reads = F.sum(F.coalesce(F.get(F.col(raw), F.lit(1)), F.when(F.col(older).isNotNull(), F.col(depth) - reference_depth)))
    return df.groupBy(*keys).agg(squares.alias("_s"), reads.alias("_n")).select(*keys, F.when(F.col("_n") > 0, F.sqrt(F.col("_s") / F.col("_n"))).alias("mq"))


#: Rows of either side from which the normal approximation is used.
EXACT_BELOW = 10


def small_rank_sums(df: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, p, z): the exact one-sided test of keys with fewer than ``EXACT_BELOW`` rows on either side."""
    from ..functions.groups import mapped
    from ..functions.statistics import exact_rank_p, normal_quantile

    sizes = df.groupBy(*keys).agg(F.count_if(first).alias("_n1"), F.count_if(~first).alias("_n2"))
    small = sizes.where((F.col("_n1") > 0) & (F.col("_n2") > 0) & (F.col("_n1") < EXACT_BELOW) & (F.col("_n2") < EXACT_BELOW)).select(*keys)
    rows = df.withColumn("_first", first.cast("int")).withColumn("_value", F.col(value).cast("double")).join(small, keys, "left_semi")

    def run(values, own):
        p = exact_rank_p(values, own)
        return int(own.sum()), int(len(own) - own.sum()), p, normal_quantile(p)

    return mapped(rows, keys, run, ["_value", "_first"], "n1 long, n2 long, p double, z double", ["_value", "_first"])
