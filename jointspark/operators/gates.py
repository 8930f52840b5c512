"""Conditions that records, sites, alleles and genotypes must meet, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alleles import NON_REF, SPAN_DEL, is_symbolic


def _n(alts: Column) -> Column:
    return F.size(alts)


def true_alternate(n_allele: Column) -> Column:
    """Aggregate: whether any record of a site has more alleles than REF and <NON_REF>."""
    return F.max(n_allele) > 2


def regenotyped(alts: Column, depth: Column) -> Column:
    """Whether a merged site is genotyped again: it has an alternate allele and depth."""
    return (_n(alts) > 0) & (F.coalesce(depth, F.lit(0)) > 0)


def properly_polymorphic(alts: Column) -> Column:
    """A site with several alternates, or with one that is neither ``*`` nor symbolic."""
    one = F.get(alts, F.lit(0))
    return F.when(_n(alts) == 0, False).when(_n(alts) == 1, ~is_symbolic(one)).otherwise(True)


def polymorphic_in_samples(genotypes: Column) -> Column:
    """Whether some called genotype, an array of allele numbers (negative if not called), holds an alternate allele."""
    return F.exists(genotypes, lambda g: F.exists(g, lambda a: a > 0))


def only_spanning(alts: Column) -> Column:
    """Whether ``*`` is the one alternate allele; such sites are dropped."""
    return (_n(alts) == 1) & (F.get(alts, F.lit(0)) == SPAN_DEL)


def reference_and_spanning(alleles: Column) -> Column:
    """Whether merged alleles, REF first, are REF and ``*`` (and <NON_REF>) alone."""
    rest = F.array_remove(F.slice(alleles, 2, F.greatest(F.size(alleles) - 1, F.lit(0))), NON_REF)
    return (F.size(rest) == 1) & (F.get(rest, F.lit(0)) == SPAN_DEL)


def too_many_alleles(alts: Column, most: int) -> Column:
    return _n(alts) + 1 > most


def emitted(quality: Column, mle_ac: Column, confidence: float = 30.0) -> Column:
    """Whether a site is written: some alternate copy is likeliest, and its quality reaches the confidence."""
    return (mle_ac > 0) & (quality >= confidence)


def low_quality(quality: Column, confidence: float = 30.0) -> Column:
    return F.when(quality < confidence, "LowQual")


def unmixed_mnp(ref: Column, alts: Column) -> Column:
    """Whether all literal alleles have one length of two or more."""
    literal = F.filter(alts, lambda a: ~is_symbolic(a))
    return (F.length(ref) >= 2) & (F.size(literal) > 0) & F.forall(literal, lambda a: F.length(a) == F.length(ref))


def empty_reference_call(genotype: Column, pl: Column, depth: Column, quality: Column) -> Column:
    """A homozygous reference genotype with likelihoods but neither depth nor quality, which becomes a no-call."""
    return F.forall(genotype, lambda a: a == 0) & pl.isNotNull() & (F.coalesce(depth, F.lit(0)) == 0) & (quality == 0)


def kept_alleles(alts: Column, plausible: Column, covered: Column, force: Column | None = None) -> Column:
    """Alternates that are plausible; ``*`` only where an earlier kept deletion covers the site.

    ``plausible`` is an array beside ``alts``.  <NON_REF> is never kept here.
    """
    keep = F.arrays_zip(alts.alias("a"), plausible.alias("p"))
    chosen = F.filter(keep, lambda x: (x["a"] != NON_REF) & x["p"] & ((x["a"] != SPAN_DEL) | covered))
    return F.transform(chosen, lambda x: x["a"])


def not_symbolic(alts: Column) -> Column:
    return ~F.exists(alts, lambda a: a.startswith("<"))


def passes(filters: Column) -> Column:
    """No filter, or PASS alone."""
    return filters.isNull() | (F.size(filters) == 0) | (filters == F.array(F.lit("PASS")))
