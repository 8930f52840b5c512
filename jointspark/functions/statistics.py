"""Statistics of variant sites: column expressions where SQL can say it, Arrow functions where not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LN10 = math.log(10)


def log10_sum(values: Column) -> Column:
    """log10 of the sum of 10^x over an array."""
    top = F.array_max(values)
    return top + F.log10(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))


def normalised(values: Column) -> Column:
    """Linear shares of an array of log10 values."""
    top = F.array_max(values)
    linear = F.transform(values, lambda x: F.pow(F.lit(10.0), x - top))
    return F.transform(linear, lambda x: x / F.aggregate(linear, F.lit(0.0), lambda a, y: a + y))


def log10_one_minus(a: Column) -> Column:
    """log10(1 - 10^a) for a < 0, stable at both ends."""
    x = a * LN10
    return F.when(x < -math.log(2), F.log1p(-F.exp(x))).otherwise(F.log(-F.expm1(x))) / LN10


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def genotype_likelihoods(pl: Column) -> Column:
    return F.transform(pl, lambda x: x / -10.0)


def phred_likelihoods(gl: Column) -> Column:
    top = F.array_max(gl)
    return F.transform(gl, lambda x: F.floor(-10 * (x - top) + 0.5).cast("int"))


def informative(gl: Column) -> Column:
    return F.aggregate(gl, F.lit(0.0), lambda a, x: a + x) < -0.1


def strand_odds(rf: Column, rr: Column, af: Column, ar: Column) -> Column:
    """Log of the symmetric odds ratio, scaled by the strand balance of each allele, one added to each cell."""
    a, b, c, d = (x + 1.0 for x in (rf, rr, af, ar))
    ratio = a * d / (b * c)
    return F.log(ratio + 1 / ratio) + F.log(F.least(a, b) / F.greatest(a, b)) - F.log(F.least(c, d) / F.greatest(c, d))


def inbreeding(ref: Column, het: Column, hom: Column, samples: Column) -> Column:
    """1 - observed over expected heterozygotes, from soft counts and the number of samples."""
    p = (2 * ref + het) / (2 * (ref + het + hom))
    return 1 - het / (2 * p * (1 - p) * samples)


def _lgamma(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """P of all tables with these margins that are at most as likely as this one."""
    n, r, k = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0
    lg = _lgamma(n)
    x = np.arange(max(0, r + k - n), min(r, k) + 1)
    logs = lg[r] - lg[x] - lg[r - x] + lg[n - r] - lg[k - x] - lg[n - r - k + x] - (lg[n] - lg[k] - lg[n - k])
    p = np.exp(logs)
    return float(min(1.0, p[p <= p[a - x[0]] * (1 + 1e-7)].sum()))


#: A strand table whose sum is over twice this is shrunk to about it.
TABLE_SUM = 200.0


def scaled_table(a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
    """The table, or if it sums to over twice ``TABLE_SUM`` its cells shrunk in proportion and cut to whole numbers."""
    n = a + b + c + d
    return (a, b, c, d) if n <= 2 * TABLE_SUM else tuple(int(x / (n / TABLE_SUM)) for x in (a, b, c, d))


def fisher_tables(tables: np.ndarray) -> np.ndarray:
    """Two-sided P of many tables (a, b, c, d) at once: every table's margins are laid out beside one another."""
    a, b, c, d = tables.T.astype(np.int64)
    n, r, k = a + b + c + d, a + b, a + c
    low, high = np.maximum(0, r + k - n), np.minimum(r, k)
    size = high - low + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    row = np.repeat(np.arange(len(a)), size)
    x = np.arange(size.sum()) - first[row] + low[row]
    lg = _lgamma(int(n.max(initial=0)))
    logs = (lg[r] + lg[n - r] + lg[k] + lg[n - k] - lg[n])[row] - lg[x] - lg[r[row] - x] - lg[k[row] - x] - lg[(n - r - k)[row] + x]
    p = np.exp(logs)
    own = p[first + a - low]
    return np.minimum(1.0, np.bincount(row, np.where(p <= own[row] * (1 + 1e-7), p, 0.0), len(a)))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided P of strand tables after :func:`scaled_table`; distinct tables of a batch are computed once, in pieces of bounded size."""
    table = np.column_stack([x.to_numpy(np.int64) for x in (a, b, c, d)])
    n = table.sum(axis=1, keepdims=True)
    table = np.where(n <= 2 * TABLE_SUM, table, (table / (np.maximum(n, 1) / TABLE_SUM)).astype(np.int64))
    unique, back = np.unique(table, axis=0, return_inverse=True)
    p = np.concatenate([fisher_tables(unique[k : k + 4096]) for k in range(0, len(unique), 4096)]) if len(unique) else np.zeros(0)
    return pd.Series(p[back.reshape(-1)])


#: Shares of the modal probability below this are dropped, and what has no probability left is reported as this quality.
EXCESS_CUT, EXCESS_MOST = 1e-16, 160.0


def hardy_weinberg_excess(het: int, ref: int, hom: int) -> float:
    """Mid-p of at least ``het`` heterozygotes under exact Hardy-Weinberg proportions.

    Counts of heterozygotes whose probability is under ``EXCESS_CUT`` times that near the mode count as impossible.
    """
    n = het + ref + hom
    rare = 2 * min(ref, hom) + het
    if rare <= 1:
        return 0.5
    h = np.arange(rare % 2, rare + 1, 2)
    lg = _lgamma(n)
    low = (rare - h) // 2
    logs = h * math.log(2) - lg[low] - lg[h] - lg[n - h - low]
    middle = int(rare * (2.0 * n - rare) / (2.0 * n - 1.0))
    middle = min(middle + (middle % 2 != rare % 2), rare)
    p = np.exp(logs - logs[(middle - rare % 2) // 2])
    p[p < EXCESS_CUT] = 0
    return float((p[h > het].sum() + p[h == het].sum() / 2) / p.sum())


@F.pandas_udf(T.DoubleType())
def excess_het_p(het: pd.Series, ref: pd.Series, hom: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    rows = list(zip(map(int, het), map(int, ref), map(int, hom), strict=True))
    for t in set(rows):
        known[t] = hardy_weinberg_excess(*t)
    return pd.Series([known[t] for t in rows])


def excess_het(p: Column) -> Column:
    """Phred quality of :data:`excess_het_p`."""
    return F.when(p < 1e-59, EXCESS_MOST).otherwise(-10 * F.log10(p))


def heterozygosity_prior(theta: float, copies: int) -> np.ndarray:
    """log10 prior of 0..copies alternate copies: theta / i, the rest at 0."""
    if not 0 < theta < 1:
        raise ValueError("heterozygosity must lie inside (0, 1)")
    i = np.arange(1, copies + 1)
    rest = 1 - theta * (1 / i).sum()
    if rest <= 0:
        raise ValueError("the prior of some alternate copy leaves nothing for none")
    return np.concatenate([[math.log10(rest)], math.log10(theta) - np.log10(i)])


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def normal_quantile(p: float) -> float:
    """z below which a standard normal value lies with probability ``p``."""
    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * math.erfc(-middle / math.sqrt(2)) < p else (low, middle)
    return (low + high) / 2


def exact_rank_p(values: np.ndarray, first: np.ndarray) -> float:
    """One-sided exact P of the first group's rank sum: all choices with less, and half of those with as much; nan if a group is empty.

    Ranks of ties are their mean.  Choices are counted by size and doubled rank sum, one value at a time, so none is listed.
    """
    n, n1 = len(values), int(first.sum())
    if not 0 < n1 < n:
        return math.nan
    _, back, often = np.unique(values, return_inverse=True, return_counts=True)
    upto = np.cumsum(often)
    doubled = (2 * upto - often + 1)[back.reshape(-1)]
    ways = np.zeros((n1 + 1, int(doubled.sum()) + 1))
    ways[0, 0] = 1
    for d in doubled.tolist():
        ways[1:, d:] += ways[:-1, : ways.shape[1] - d].copy()
    own = int(doubled[first.astype(bool)].sum())
    return float((ways[n1, :own].sum() + ways[n1, own] / 2) / ways[n1].sum())
