"""Allele strings: trimming, primitives, repeats, context, tests, and allele-specific fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.alleles import is_symbolic


def forward_trimmed(alleles: Column) -> Column:
    """struct(trimmed, alleles): alleles (REF first) without the leading bases all share, of which each keeps one base."""
    literal = F.filter(alleles, lambda a: ~is_symbolic(a))
    shortest = F.array_min(F.transform(literal, F.length))
    fits = lambda n: F.forall(literal, lambda a: F.substring(a, F.lit(1), n) == F.substring(F.get(literal, F.lit(0)), F.lit(1), n))
    lengths = F.filter(F.sequence(F.lit(0), F.greatest(shortest - 1, F.lit(0))), fits)
    cut = F.coalesce(F.array_max(lengths), F.lit(0))
    return F.struct(cut.alias("trimmed"), F.transform(alleles, lambda a: F.when(is_symbolic(a), a).otherwise(F.substring(a, cut + 1, F.length(a)))).alias("alleles"))


def primitives(df: DataFrame, ref: str, alt: str, pos: str) -> DataFrame:
    """One row (pos, ref, alt of one base) for each base at which a multi-base substitution differs; others stay whole."""
    mnp = (F.length(ref) == F.length(alt)) & (F.length(ref) > 1)
    places = F.when(mnp, F.filter(F.sequence(F.lit(1), F.length(ref)), lambda i: F.substring(F.col(ref), i, F.lit(1)) != F.substring(F.col(alt), i, F.lit(1)))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("_i", F.explode(places))
    base = lambda c: F.when(F.col("_i") > 0, F.substring(F.col(c), F.col("_i"), F.lit(1))).otherwise(F.col(c))
    return out.withColumn("_r", base(ref)).withColumn("_a", base(alt)).withColumn(pos, F.col(pos) + F.greatest(F.col("_i") - 1, F.lit(0))).drop(ref, alt, "_i").withColumnsRenamed({"_r": ref, "_a": alt})


def repeat_unit(bases: Column) -> Column:
    """The shortest unit that a string repeats whole."""
    n = F.length(bases)
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (n % k == 0) & (F.repeat(F.substring(bases, F.lit(1), k), n / k) == bases))
    return F.substring(bases, F.lit(1), F.coalesce(F.get(sizes, F.lit(0)), n))


def repeats_at(unit: Column, bases: Column) -> Column:
    """How many times ``unit`` follows itself from the start of ``bases``."""
    n = F.length(unit)
    most = F.when(n > 0, F.floor(F.length(bases) / n)).otherwise(0)
    hits = F.filter(F.sequence(F.lit(0).cast("long"), most), lambda k: F.repeat(unit, k.cast("int")) == F.substring(bases, F.lit(1), (k * n).cast("int")))
    return F.array_max(hits)


def tandem_repeat(ref: Column, alt: Column, after: Column) -> Column:
    """struct(unit, ref_repeats, alt_repeats) of an insertion or deletion whose first base is shared; null for others.

    ``after`` are the reference bases that follow REF.  Repeats are counted in the bases behind the shared one.
    """
    indel = (F.length(ref) != F.length(alt)) & (F.substring(ref, 1, 1) == F.substring(alt, 1, 1))
    # Bound in turn, as an expression that stands inside another's lambda is evaluated again for each of its elements.
    bound = lambda made, use: F.get(F.transform(F.array(made), use), F.lit(0))
    texts = F.struct(F.substring(ref, F.lit(2), F.length(ref)).alias("a"), F.substring(alt, F.lit(2), F.length(alt)).alias("b"), after.alias("after"))

    def counted(x: Column) -> Column:
        unit = repeat_unit(F.when(F.length(x["a"]) > F.length(x["b"]), x["a"]).otherwise(x["b"]))
        whole = F.struct(unit.alias("unit"), F.concat(x["a"], x["after"]).alias("a"), F.concat(x["b"], x["after"]).alias("b"))
        return bound(whole, lambda y: F.struct(y["unit"].alias("unit"), repeats_at(y["unit"], y["a"]).alias("ref_repeats"), repeats_at(y["unit"], y["b"]).alias("alt_repeats")))

    return F.when(indel, bound(texts, counted))


def context(bases: Column, first: Column, pos: Column, flank: int) -> Column:
    """Bases around a position of a stretch that begins at ``first``, padded with N at both ends."""
    padded = F.concat(F.lit("N" * flank), bases, F.lit("N" * flank))
    return F.rpad(F.substring(padded, (pos - first + 1).cast("int"), F.lit(2 * flank + 1)), 2 * flank + 1, "N")


def allele_fields(text: Column) -> Column:
    """Array (per allele) of arrays of numbers from "a,b|c,d"; empty parts and NaN read as 0."""
    number = lambda x: F.when((x == "") | (F.lower(x) == "nan") | (x == "."), 0.0).otherwise(x.cast("double"))
    return F.transform(F.split(text, r"\|"), lambda part: F.transform(F.split(part, ","), number))


def allele_text(values: Column, digits: int = 2) -> Column:
    """The text of per-allele arrays, numbers with fixed digits."""
    return F.array_join(F.transform(values, lambda part: F.array_join(F.transform(part, lambda x: F.format_string(f"%.{digits}f", x)), ",")), "|")
