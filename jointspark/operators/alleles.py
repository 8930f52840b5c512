"""Allele arrays: order, remapping to a longer reference, index maps, trimming, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NON_REF, SPAN_DEL, NO_CALL = "<NON_REF>", "*", "."


def is_symbolic(allele: Column) -> Column:
    return allele.startswith("<") | (allele == SPAN_DEL) | (allele == NO_CALL)


def ordered(alts: Column) -> Column:
    """ALT alleles in merge order: literal by bases, symbolic after them, no-call, <NON_REF> last; duplicates dropped."""
    keyed = F.transform(F.array_distinct(alts), lambda a: F.struct((a == NON_REF).alias("n"), (a == NO_CALL).alias("c"), (a.startswith("<") | (a == SPAN_DEL)).alias("s"), a.alias("a")))
    return F.transform(F.array_sort(keyed), lambda k: k["a"])


def first_seen(df: DataFrame, keys: list[str], alts: str, order: list[str]) -> DataFrame:
    """Union of ALT alleles per key in the order in which rows bring them; what is gathered is one row for each allele."""
    each = df.select(*keys, *order, F.posexplode(alts).alias("_at", "_a"))
    least = each.groupBy(*keys, "_a").agg(F.min(F.struct(*order, "_at")).alias("_o"))
    lists = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", "_a"))).alias("_rows"))
    return lists.select(*keys, F.transform("_rows", lambda x: x["_a"]).alias(alts))


def longest_ref(df: DataFrame, keys: list[str], ref: str) -> DataFrame:
    """The longest REF per key, and how many distinct ones have that length (more than one is an inconsistency)."""
    top = df.groupBy(*keys).agg(F.max(F.length(ref)).alias("_n"))
    at = df.join(top, keys).where(F.length(ref) == F.col("_n"))
    return at.groupBy(*keys).agg(F.min(ref).alias("ref"), F.countDistinct(ref).alias("n_refs"))


def to_longer_ref(alts: Column, ref: Column, longest: Column) -> Column:
    """Literal alleles with the bases that ``longest`` has beyond ``ref``; others unchanged."""
    return F.transform(alts, lambda a: F.when(is_symbolic(a), a).otherwise(F.concat(a, F.expr("''"), F.substring(longest, F.length(ref) + 1, F.length(longest)))))


def spanning(alts: Column, ref: Column) -> Column:
    """Alleles of a record that starts before the site: deletions become ``*``, <NON_REF> stays, others are no-calls."""
    return F.transform(alts, lambda a: F.when(a == NON_REF, a).when(~is_symbolic(a) & (F.length(a) < F.length(ref)), SPAN_DEL).otherwise(NO_CALL))


def index_map(new: Column, old: Column) -> Column:
    """0-based old index of each new allele, REF at 0; an absent one maps to the last (<NON_REF>)."""
    last = F.size(old) - 1
    return F.transform(new, lambda a, i: F.when(i == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(F.array_position(old, a), F.lit(0)) - 1, last)).cast("int"))


def genotype_index_map(alleles: Column) -> Column:
    """Diploid: old genotype index of every new genotype (j <= k, k ascending) under an allele map."""
    n = F.size(alleles)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.sequence(F.lit(0), k), lambda j: F.struct(j.alias("j"), k.alias("k")))))

    def index(p: Column) -> Column:
        a, b = F.get(alleles, p["j"]), F.get(alleles, p["k"])
        hi, lo = F.greatest(a, b), F.least(a, b)
        return (F.expr("0") + hi * (hi + 1) / 2 + lo).cast("int")

    return F.transform(pairs, index)


def remapped(values: Column, indices: Column, absent=None) -> Column:
    """values[i] for each index; ``absent`` out of range."""
    return F.transform(indices, lambda i: F.coalesce(F.get(values, i), F.lit(absent)))


def trimmed(alleles: Column) -> Column:
    """Alleles (REF first) without their common suffix; no literal allele becomes empty."""
    literal = F.filter(alleles, lambda a: ~is_symbolic(a))
    shortest = F.array_min(F.transform(literal, F.length))
    flipped = F.transform(literal, F.reverse)
    fits = lambda n: F.forall(flipped, lambda a: F.substring(a, F.lit(1), n) == F.substring(F.get(flipped, F.lit(0)), F.lit(1), n))
    lengths = F.filter(F.sequence(F.lit(0), F.greatest(shortest - 1, F.lit(0))), fits)
    cut = F.coalesce(F.array_max(lengths), F.lit(0))
    return F.transform(alleles, lambda a: F.when(is_symbolic(a), a).otherwise(F.substring(a, F.lit(1), F.length(a) - cut)))


def biallelic(df: DataFrame, ref: str = "ref", alts: str = "alts") -> DataFrame:
    """One row for each ALT, alleles trimmed."""
    out = df.select("*", F.posexplode(alts).alias("alt_no", "_alt"))
    pair = trimmed(F.array(F.col(ref), F.col("_alt")))
    return out.withColumn("_pair", pair).withColumn("alt_ref", F.get("_pair", F.lit(0))).withColumn("alt", F.get("_pair", F.lit(1))).drop("_pair", "_alt")


def variant_type(ref: Column, alts: Column) -> Column:
    """NO_VARIATION, SNP, INDEL, SYMBOLIC or MIXED; equal lengths over one count as INDEL."""
    one = F.transform(F.filter(alts, lambda a: a != NON_REF), lambda a: F.when(is_symbolic(a), "SYMBOLIC").when((F.length(a) == 1) & (F.length(ref) == 1), "SNP").otherwise("INDEL"))
    kinds = F.array_distinct(one)
    return F.when(F.size(kinds) == 0, "NO_VARIATION").when(F.size(kinds) > 1, "MIXED").otherwise(F.get(kinds, F.lit(0)))


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def is_frameshift(ref: Column, alt: Column) -> Column:
    return F.abs(F.length(ref) - F.length(alt)) % 3 != 0


def likeliest(df: DataFrame, keys: list[str], allele: str, score: str, most: int) -> DataFrame:
    """The ``most`` alleles of each key by summed score, ties to the smaller allele."""
    total = df.groupBy(*keys, allele).agg(F.sum(score).alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), allele)
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def best_alleles_kept(df: DataFrame, keys: list[str], pl: str, alleles: int, most: int) -> DataFrame:
    """(keys, kept): numbers of the ``most`` likeliest alternates of diploid sites, in their own order.

    An alternate scores what each sample's best genotype that holds it gains over the homozygous reference one; ties go to the
    smaller number.  REF, and <NON_REF> where it is last, are kept by whoever applies the numbers.
    """
    best = F.array_position(pl, F.array_min(pl)) - 1
    gain = (F.get(F.col(pl), F.lit(0)) - F.array_min(pl)) / 10.0
    second = F.floor((F.sqrt(8.0 * F.col("_best") + 1) - 1) / 2)
    pair = F.array_distinct(F.array((F.col("_best") - second * (second + 1) / 2).cast("int"), second.cast("int")))
    rows = df.select(*keys, best.alias("_best"), gain.alias("_gain")).select(*keys, "_gain", F.explode(pair).alias("_a")).where("_a > 0")
    sums = rows.groupBy(*keys, "_a").agg(F.sum("_gain").alias("_s"))
    ranked = sums.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_s").desc(), "_a"))).where(F.col("_k") <= most)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_a")).alias("kept"))


def biallelic_calls(df: DataFrame, pl: str, ad: str, genotype: str, alternates: int) -> DataFrame:
    """One row for each alternate (alt_no from 1) of diploid calls: likelihoods of REF and it alone, from 0, and their depths.

    A genotype of two different alternates becomes a no-call (-1, -1); other alternates count as REF's place, 0.
    """
    index = lambda a, b: b * (b + 1) // 2 + a
    two = F.size(F.array_distinct(F.filter(F.col(genotype), lambda a: a > 0))) > 1

    def choice(k: int) -> Column:
        own = F.array(*(F.get(F.col(pl), F.lit(index(*g))) for g in ((0, 0), (0, k), (k, k))))
        call = F.transform(F.col(genotype), lambda a: F.when(a == k, 1).when(a < 0, -1).otherwise(0))
        values = F.transform(own, lambda x: x - F.array_min(own))
        depths = F.array(F.get(F.col(ad), F.lit(0)), F.get(F.col(ad), F.lit(k)))
        return F.struct(F.lit(k).alias("alt_no"), values.alias("pl"), depths.alias("ad"), F.when(two, F.array(F.lit(-1), F.lit(-1))).otherwise(call).alias("gt"))

    rest = [c for c in df.columns if c not in (pl, ad, genotype)]
    return df.select(*rest, F.explode(F.array(*(choice(k) for k in range(1, alternates + 1)))).alias("_c")).select(*rest, "_c.*")
