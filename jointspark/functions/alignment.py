"""Alignment of two strings and likelihoods of reads given haplotypes, as Arrow functions over batches."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Different pairs of strings whose results a worker keeps, so that equal ones are worked out once.
KEPT = 1 << 16

#: Scores of a match, a mismatch, opening and extending a gap, fixed values.
MATCH, MISMATCH, OPEN, EXTEND = 200, -150, -260, -11


def align(ref: str, alt: str, weights: tuple[int, int, int, int] = (MATCH, MISMATCH, OPEN, EXTEND)) -> tuple[int, int, str]:
    """(score, offset in ref, CIGAR) of the best local alignment of all of ``alt``, its ends clipped where that scores more.

    Affine gaps; among equal scores a match is preferred, then a deletion, then the end furthest to the right.
    """
    match, mismatch, opening, extending = weights
    n, m = len(ref), len(alt)
    if not n or not m:
        return 0, 0, f"{m}S" if m else ""
    a, b = np.frombuffer(ref.encode("latin1", "replace"), np.uint8), np.frombuffer(alt.encode("latin1", "replace"), np.uint8)
    low = -(1 << 40)
    h = np.zeros((n + 1, m + 1), np.int64)
    down, right = np.full((n + 1, m + 1), low, np.int64), np.full((n + 1, m + 1), low, np.int64)
    for i in range(1, n + 1):
        down[i] = np.maximum(h[i - 1] + opening, down[i - 1] + extending)
        diagonal = h[i - 1, :-1] + np.where(a[i - 1] == b, match, mismatch)
        row = np.maximum(np.maximum(diagonal, down[i, 1:]), 0)
        for j in range(1, m + 1):
            right[i, j] = max(h[i, j - 1] + opening, right[i, j - 1] + extending)
            h[i, j] = max(row[j - 1], right[i, j])
    best = int(h.max())
    if best <= 0:
        return 0, 0, f"{m}S"
    i, j = (int(x[-1]) for x in np.nonzero(h == best))
    parts, state, end = [], "M", j
    while i > 0 and j > 0 and h[i, j] > 0 or state != "M":
        if state == "M":
            here = h[i, j]
            if here == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                parts.append("M")
                i, j = i - 1, j - 1
            else:
                state = "D" if here == down[i, j] else "I"
        elif state == "D":
            parts.append("D")
            state = "M" if down[i, j] == h[i - 1, j] + opening else "D"
            i -= 1
        else:
            parts.append("I")
            state = "M" if right[i, j] == h[i, j - 1] + opening else "I"
            j -= 1
    whole = ["S"] * j + parts[::-1] + ["S"] * (m - end)
    cigar, at = "", 0
    while at < len(whole):
        stop = at
        while stop < len(whole) and whole[stop] == whole[at]:
            stop += 1
        cigar += f"{stop - at}{whole[at]}"
        at = stop
    return best, i, cigar


@functools.lru_cache(KEPT)
def _align_once(ref: str, alt: str) -> tuple[int, int, str]:
    return align(ref, alt)


@F.pandas_udf(T.StructType([T.StructField("score", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("cigar", T.StringType())]))
def aligned(ref: pd.Series, alt: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_align_once(x or "", y or "") for x, y in zip(ref, alt, strict=True)], columns=["score", "offset", "cigar"])


def read_likelihood(haplotype: str, read: str, qualities: np.ndarray, gap_open: float = 45.0, gap_extend: float = 10.0) -> float:
    """log10 P(read | haplotype) of a pair hidden Markov model with three states, from any start on the haplotype to any end.

    A base's error comes from its quality and is spread over the three other bases; gap qualities are phred values.
    """
    n, m = len(haplotype), len(read)
    if not n or not m:
        return 0.0 if not m else -np.inf
    hap, own = np.frombuffer(haplotype.encode(), np.uint8), np.frombuffer(read.encode(), np.uint8)
    error = 10.0 ** (-np.maximum(qualities, 1) / 10.0)
    opening, extending = 10.0 ** (-gap_open / 10.0), 10.0 ** (-gap_extend / 10.0)
    stay, back = 1 - 2 * opening, 1 - extending
    match, insert, delete = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, 1.0 / n)
    scale = 0.0
    for i in range(m):
        same = (hap == own[i]) | (hap == 78) | (own[i] == 78)
        emit = np.where(same, 1 - error[i], error[i] / 3)
        new_match = np.zeros(n + 1)
        new_match[1:] = emit * (stay * match[:-1] + back * (insert[:-1] + delete[:-1]))
        if i == 0:
            new_match[1:] = emit * delete[:-1]  # a free start: the whole weight lies in front of the read
        new_insert = opening * match + extending * insert
        new_delete = np.zeros(n + 1)
        carry = 0.0
        for j in range(1, n + 1):
            carry = opening * new_match[j - 1] + extending * carry
            new_delete[j] = carry
        match, insert, delete = new_match, new_insert, new_delete
        top = max(match.max(), insert.max(), 1e-300)
        match, insert, delete, scale = match / top, insert / top, delete / top, scale + np.log10(top)
    return float(scale + np.log10((match + insert).sum()))


@functools.lru_cache(KEPT)
def _likelihood_once(haplotype: str, read: str, quality: float) -> float:
    return read_likelihood(haplotype, read, np.full(len(read), quality))


@F.pandas_udf(T.DoubleType())
def read_likelihoods(haplotype: pd.Series, read: pd.Series, quality: pd.Series) -> pd.Series:
    """log10 likelihoods of reads with one quality for all their bases."""
    return pd.Series([_likelihood_once(h or "", r or "", float(q)) for h, r, q in zip(haplotype, read, quality, strict=True)])
