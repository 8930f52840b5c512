"""Contamination, genotype posteriors, orientation artifacts, segments, and down-sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..functions.groups import mapped


def contamination(df: DataFrame, keys: list[str], total: str, opposite: str, other: str, frequency: str) -> DataFrame:
    """(keys, error_rate, contamination, deviation) from homozygous sites.

    ``opposite`` are reads of the allele that the sample lacks, whose population frequency is ``frequency``; ``other`` are
    reads of neither allele, from which the rate of errors follows.
    """
    sums = df.groupBy(*keys).agg(F.sum(other).alias("_o"), F.sum(total).alias("_t"), F.sum(opposite).alias("_opposite"), F.sum(F.col(total) * F.col(frequency)).alias("_expected"))
    error = F.when(F.col("_t") > 0, 1.5 * F.col("_o") / F.col("_t")).otherwise(0.0)
    rows = sums.withColumn("error_rate", error)
    share = F.greatest(F.col("_opposite") - F.floor(F.col("_t") * F.col("error_rate") / 3 + 0.5), F.lit(0)) / F.col("_expected")
    found = rows.withColumn("contamination", F.when(F.col("_expected") > 0, F.least(share, F.lit(1.0))))
    each = df.join(found.select(*keys, F.col("contamination").alias("_c"), F.col("_expected").alias("_e")), keys)
    f, d, c = F.col(frequency), F.col(total), F.col("_c")
    spread = each.groupBy(*keys).agg((F.sqrt(F.sum((1 - f) * d * c * ((1 - c) + f * d * c))) / F.first("_e")).alias("deviation"))
    return found.join(spread, keys).select(*keys, "error_rate", "contamination", "deviation")


def contaminated_likelihoods(depth: Column, alternate: Column, minor: Column, frequency: Column, share: Column, error: float = 0.001) -> Column:
    """Normalised weights of a sample's (hom-ref, alt-minor, alt-major, hom-alt) states under contamination."""
    f = frequency
    states = [((1 - f) * (1 - f), F.lit(error)), (f * (1 - f), minor), (f * (1 - f), 1 - minor), (f * f, F.lit(1 - error))]
    weights = F.array(*(F.log10(prior) + dist.log10_binomial(depth, alternate, F.log10((1 - share) * af + share * f)) for prior, af in states))
    top = F.array_max(weights)
    linear = F.transform(weights, lambda x: F.pow(F.lit(10.0), x - top))
    return F.transform(linear, lambda x: x / dist.array_sum(linear))


def genotype_posteriors(pl: Column, counts: Column) -> Column:
    """Phred posteriors of diploid genotypes under a Dirichlet prior of allele counts, the best at 0 (two alleles)."""
    a, b = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
    n = a + b
    prior = [F.log10(a * (a + 1) / (n * (n + 1))), F.log10(2 * a * b / (n * (n + 1))), F.log10(b * (b + 1) / (n * (n + 1)))]
    values = F.array(*(F.get(pl, F.lit(k)) - 10 * p for k, p in enumerate(prior)))
    return F.transform(values, lambda x: F.floor(x - F.array_min(values) + 0.5).cast("int"))


def panel_counts(df: DataFrame, keys: list[str], ac: str, an: str, snp: float = 0.01, reference: float = 10.0) -> DataFrame:
    """(keys, counts): summed allele counts of call sets and resources with pseudocounts, [REF, ALT]."""
    out = df.groupBy(*keys).agg(F.sum(F.col(an) - F.col(ac)).alias("_r"), F.sum(ac).alias("_a"))
    return out.select(*keys, F.array(F.col("_r") + reference, F.col("_a") + snp).alias("counts"))


def orientation_step(f1: np.ndarray, depth: np.ndarray, alt: np.ndarray, weight: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Responsibilities (site, state) of artifact in F1R2, artifact in F2R1, hom-ref, germline het, somatic het and hom-alt."""
    share = np.array([0.3, 0.3, 0.001, 0.5, 0.2, 0.999])
    way = np.array([0.999, 0.001, 0.5, 0.5, 0.5, 0.5])
    logs = np.log(np.maximum(prior, 1e-12)) + alt[:, None] * np.log(share) + (depth - alt)[:, None] * np.log1p(-share)
    logs += f1[:, None] * np.log(way) + (alt - f1)[:, None] * np.log1p(-way)
    logs -= logs.max(axis=1, keepdims=True)
    p = np.exp(logs)
    return p / p.sum(axis=1, keepdims=True)


def orientation_model(df: DataFrame, keys: list[str], depth: str, alt: str, f1r2: str, most: int = 50, stop: float = 1e-3) -> DataFrame:
    """(keys, n, artifact_f1r2, artifact_f2r1): learned shares of orientation artifacts of each context, by expectation maximisation.

    Sites with equal counts are one row with their number.
    """
    rows = df.groupBy(*keys, depth, alt, f1r2).agg(F.count("*").alias("n"))

    def run(d, a, f, n):
        n, prior = n.astype(float), np.full(6, 1 / 6)
        d, a, f = d.astype(float), a.astype(float), f.astype(float)
        for _ in range(most):
            new = n @ orientation_step(f, d, a, n, prior) / n.sum()
            moved, prior = np.abs(new - prior).max(), new
            if moved < stop:
                break
        return int(n.sum()), float(prior[0]), float(prior[1])

    return mapped(rows, keys, run, [depth, alt, f1r2, "n"], "n long, artifact_f1r2 double, artifact_f2r1 double", [depth, alt, f1r2])


def persistent_minima(values: np.ndarray) -> list[tuple[int, float]]:
    """(index, persistence) of local minima: how far the values rise before a lower one's valley is reached; the least has all."""
    order, root, low = np.argsort(values, kind="stable"), {}, {}
    out: dict[int, float] = {}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in order.tolist():
        near = {find(j) for j in (k - 1, k + 1) if j in root}
        root[k] = k
        if not near:
            low[k] = k
            continue
        least = min(near, key=lambda r: (values[low[r]], low[r]))
        for r in near - {least}:
            if values[k] > values[low[r]]:
                out[low[r]] = float(values[k] - values[low[r]])
            root[r] = least
        root[k] = least
    if len(values):
        out[int(order[0])] = float(values.max() - values.min())
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def changepoints(values: np.ndarray, window: int, most: int, penalty: float) -> list[int]:
    """Last positions of segments: minima of the cost of two windows joined, kept greedily while the cost falls by the penalty."""
    n = len(values)
    if n < 2 * window:
        return []
    total, squares = np.concatenate([[0], np.cumsum(values)]), np.concatenate([[0], np.cumsum(values**2)])

    def cost(a, b):
        return squares[b] - squares[a] - (total[b] - total[a]) ** 2 / np.maximum(b - a, 1)

    at = np.arange(window, n - window + 1)
    gain = cost(at - window, at) + cost(at, at + window) - cost(at - window, at + window)
    candidates = [int(at[k]) for k, _ in persistent_minima(gain)[: 4 * most]]
    chosen: list[int] = []
    while candidates and len(chosen) < most:
        def saved(c: int) -> float:
            a, b = max([0, *(x for x in chosen if x < c)]), min([n, *(x for x in chosen if x > c)])
            return float(cost(a, b) - cost(a, c) - cost(c, b))

        best = max(candidates, key=lambda c: (saved(c), -c))
        if saved(best) <= penalty:
            break
        chosen.append(best)
        candidates.remove(best)
    return sorted(c - 1 for c in chosen)


def segments(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 8, most: int = 50, penalty: float = 0.0) -> DataFrame:
    """(keys, n, n_segments, changes): change points of each key's series in order, as text."""

    def run(v, *_):
        found = changepoints(v.astype(float), window, most, penalty)
        return len(v), len(found) + 1, ",".join(map(str, found))

    return mapped(df, keys, run, [value], "n long, n_segments long, changes string", order)


def levelled(df: DataFrame, keys: list[str], group: str, target: int, identity: list[str]) -> DataFrame:
    """At most ``target`` rows of a key, taken evenly from its groups: the largest groups lose rows first.

    Rows get their place inside their group by MD5; places are filled level by level, so each group keeps its lowest ones.
    """
    mark = F.md5(F.concat_ws("|", *identity))
    placed = df.withColumn("_mark", mark).withColumn("_level", F.row_number().over(Window.partitionBy(*keys, group).orderBy("_mark", *identity)))
    filled = placed.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_level", group)))
    return filled.where(F.col("_k") <= target).drop("_mark", "_level", "_k")


def allele_biased(df: DataFrame, keys: list[str], allele: str, share: float, identity: list[str]) -> DataFrame:
    """Rows without a share of each allele's rows of a key: floor(rows * share), those with the smallest MD5."""
    w = Window.partitionBy(*keys, allele)
    placed = df.withColumn("_k", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", *identity)), *identity))).withColumn("_n", F.count("*").over(w))
    return placed.where(F.col("_k") > F.floor(F.col("_n") * share)).drop("_k", "_n")
