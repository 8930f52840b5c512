"""Discrete and normal distributions as column expressions in log10, and small array arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)
#: Lanczos coefficients (g = 7), fixed values.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def ln_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0 (Lanczos)."""
    z = x - 1.0
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + k)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def log10_factorial(n: Column) -> Column:
    return ln_gamma(n + 1.0) / LN10


def log10_choose(n: Column, k: Column) -> Column:
    return log10_factorial(n) - log10_factorial(k) - log10_factorial(n - k)


def log10_binomial(n: Column, k: Column, log10_p: Column) -> Column:
    """log10 P(k of n), with the probability given as a logarithm; certain and impossible outcomes included."""
    rest = F.log10(1 - F.pow(F.lit(10.0), log10_p))
    return log10_choose(n, k) + F.when(k == 0, 0.0).otherwise(k * log10_p) + F.when(n == k, 0.0).otherwise((n - k) * rest)


def log10_multinomial(counts: Column) -> Column:
    """log10 of the number of orders of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return log10_factorial(total) - F.aggregate(counts, F.lit(0.0), lambda a, x: a + log10_factorial(x))


def log10_multinomial_probability(counts: Column, shares: Column) -> Column:
    terms = F.zip_with(counts, shares, lambda n, p: F.when(n == 0, 0.0).otherwise(n * F.log10(p)))
    return log10_multinomial(counts) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _ln_beta(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b)


def log10_beta_binomial(n: Column, k: Column, alpha: Column, beta: Column) -> Column:
    return log10_choose(n, k) + (_ln_beta(k + alpha, n - k + beta) - _ln_beta(alpha, beta)) / LN10


def log10_dirichlet_multinomial(counts: Column, alpha: Column) -> Column:
    n, a = (F.aggregate(x, F.lit(0.0), lambda s, y: s + y) for x in (counts, alpha))
    each = F.zip_with(counts, alpha, lambda c, p: ln_gamma(c + p) - ln_gamma(p))
    return log10_multinomial(counts) + (ln_gamma(a) - ln_gamma(a + n) + F.aggregate(each, F.lit(0.0), lambda s, y: s + y)) / LN10


def normal_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-0.5 * z * z) / (deviation * math.sqrt(2 * math.pi))


def number_of_genotypes(ploidy: Column, alleles: Column) -> Column:
    """ploidy + alleles - 1 over ploidy, exact where it fits 15 digits."""
    steps = F.sequence(F.lit(1), ploidy.cast("int"))
    return F.aggregate(steps, F.lit(1.0), lambda a, i: F.round(a * (alleles - 1 + i) / i)).cast("long")


def allele_pair(index: Column) -> Column:
    """struct(first, second) of a diploid genotype's index in likelihood order."""
    second = F.floor((F.sqrt(8.0 * index + 1) - 1) / 2)
    return F.struct((index - second * (second + 1) / 2).cast("long").alias("first"), second.cast("long").alias("second"))


def genotype_ways(genotype: Column) -> Column:
    """log10 of the number of orders of a genotype's alleles, an array of allele numbers."""
    kinds = F.array_distinct(genotype)
    counts = F.transform(kinds, lambda a: F.size(F.filter(genotype, lambda x: x == a)).cast("double"))
    return log10_multinomial(counts)


def custom_prior(values: list[float], copies: int) -> list[float]:
    """log10 prior of 0..copies alternate copies from given probabilities of 1, 2, ..; the rest goes to none."""
    if len(values) != copies or any(not 0 <= v <= 1 for v in values) or sum(values) > 1:
        raise ValueError("a prior needs one probability for each number of copies, together at most 1")
    return [math.log10(p) if p > 0 else -math.inf for p in (1 - sum(values), *values)]


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def elementwise(a: Column, b: Column, how) -> Column:
    return F.zip_with(a, b, how)


def root_mean_square(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a))


def index_of_least(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def to_error(quality: Column) -> Column:
    """Probability of error of a phred quality."""
    return F.pow(F.lit(10.0), -quality / 10.0)


def to_quality(error: Column, most: int = 254) -> Column:
    """Whole phred quality of a probability of error, from 1 to ``most``."""
    return F.greatest(F.lit(1), F.least(F.floor(-10 * F.log10(F.greatest(error, F.lit(1e-320))) + 0.5), F.lit(most))).cast("int")
