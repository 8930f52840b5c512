"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those that a rule decides.  The trees are fitted on the driver from at most
2 * ``SAMPLE_ROWS`` of them, drawn by hash, and become one column expression, so every
URL is judged in the scan's own stage.  A URL without ``://``, or null, has an empty host and path
and zero counts and is judged by the trees like any other.  Repeated rows are judged alike; of rules that fit with equal
length one is left, since a host has one suffix of a length; null ids stay null; an empty table gives an empty one;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Labelled rows that the trees are fitted on, about, and at most twice as many; also bounds the suffix table.
SAMPLE_ROWS = 20_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "suffix_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for of, prefix, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(of + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    count = lambda of, c: F.length(of) - F.length(F.translate(of, c, ""))
    characters = F.split(text, "", -1)
    entropy = F.aggregate(
        F.transform(F.array_distinct(characters), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n),
        F.lit(0.0),
        lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    return {
        "length": F.length(text).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": count(path, "/").cast("double"),
        "digit_ratio": count(text, "0123456789") / n,
        "entropy": F.round(entropy, 9),
        "parameters": (count(text, "&=").cast("double") + F.when(text.contains("?"), 1.0).otherwise(0.0)),
        "labels": (count(host, ".") + 1).cast("double"),
    }


@dataclass
class Trees:
    """Boosted regression trees for the log odds; a node is (feature, threshold, left, right) or a leaf value."""

    start: float
    trees: list

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
        if not len(y):
            return Trees(-1.0, [])
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
        score, trees = np.full(len(y), start), []

        def grow(rows: np.ndarray, left: int):
            g, h = gradient[rows], hessian[rows]
            total_g, total_h = g.sum(), h.sum()
            best = (1e-6, None)
            for k, c in enumerate(cuts) if left else ():
                sg = np.cumsum(np.bincount(binned[rows, k], g, len(c) + 1))[:-1]
                sh = np.cumsum(np.bincount(binned[rows, k], h, len(c) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(sh < 1) | (total_h - sh < 1)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
            if best[1] is None:
                value = float(rate * total_g / (total_h + 1))
                score[rows] += value
                return value
            k, at = best[1]
            low = binned[rows, k] <= at
            return (k, float(cuts[k][at]), grow(rows[low], left - 1), grow(rows[~low], left - 1))

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = y - p, p * (1 - p)
            trees.append(grow(np.arange(len(y)), depth))
        return Trees(start, trees)

    def column(self, features: list[Column]) -> Column:
        def node(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            k, threshold, low, high = tree
            return F.when(features[k] <= F.lit(threshold), node(low)).otherwise(node(high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + node(tree)
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        def value(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        return np.array([self.start + sum(value(t, row) for t in self.trees) for row in x])


def judged(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row; score is the trees' log odds of block."""
    spark = pages.sparkSession
    parts = pages.select(F.col(id_column).alias("_id"), F.col(url_column).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parts = parts.withColumn("_host", host).withColumn("_path", path)
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    parts = parts.withColumn("_rule", rule).withColumn("_said", verdict)
    parts = parts.select("*", *(c.alias(k) for k, c in lexical(F.col("_url"), F.col("_host"), F.col("_path")).items()))
    parts = parts.withColumn("_suffix", F.substring_index("_host", ".", -1))

    plain = [f for f in FEATURES if f != "suffix_rate"]
    # Rows are drawn by hash with the share that gives about ``sample_rows``; the limit guards against one url that many rows repeat.
    ruled_rows = parts.where("_said is not null")
    share = min(1.0, sample_rows / max(ruled_rows.count(), 1))
    drawn = ruled_rows.where(F.pmod(F.xxhash64("_url", "_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1))
    sample = drawn.select(*plain, "_suffix", (F.col("_said") == "block").cast("double").alias("y")).limit(2 * sample_rows).collect()
    x = np.array([[r[f] for f in plain] for r in sample]).reshape(len(sample), len(plain))
    y = np.array([r["y"] for r in sample])
    average = float(y.mean()) if len(y) else 0.0
    rates: dict[str, list[float]] = {}
    for r in sample:
        entry = rates.setdefault(r["_suffix"], [0.0, 0.0])
        entry[0] += r["y"]
        entry[1] += 1
    # A fitting row sees the rate of its suffix among the other rows, or trees would read its own label from it.
    others = [(rates[r["_suffix"]][0] - r["y"] + 10 * average) / (rates[r["_suffix"]][1] + 9) for r in sample]
    rates = {s: (n + 10 * average) / (m + 10) for s, (n, m) in rates.items()}
    model = Trees.fit(np.column_stack([x, others]) if len(sample) else x, y)

    table = spark.createDataFrame(list(rates.items()), "_suffix string, _rate double")
    scored = parts.join(F.broadcast(table), "_suffix", "left").withColumn("suffix_rate", F.coalesce("_rate", F.lit(average)))
    scored = scored.withColumn("score", model.column([F.col(f) for f in FEATURES]))
    verdict = F.coalesce("_said", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col("_id").alias(id_column), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), "score")
