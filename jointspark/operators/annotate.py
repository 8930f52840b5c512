"""Joins of calls with known variants, families and other call sets."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known_ids(calls: DataFrame, known: DataFrame) -> DataFrame:
    """Calls (contig, pos, ref, alts, id) with the id of the first unfiltered known variant at their start that has their REF and an ALT of theirs.

    ``known`` is (contig, pos, ref, alt, id, rec_no, passed).  A call that has an id keeps it and gets the
    new one appended unless it holds it already; ``db`` says whether any was found.
    """
    at = ["contig", "pos", "ref", "alt"]
    first = known.where("passed").groupBy(*at).agg(F.min(F.struct("rec_no", F.col("id").alias("known_id"))).alias("_first"))
    key = ["contig", "pos", "ref"]
    asked = calls.select(*key, "alts").distinct()
    hits = asked.select(*key, "alts", F.explode("alts").alias("alt")).join(first, at).groupBy(*key, "alts").agg(F.min("_first").alias("_first"))
    new = F.col("_first.known_id")
    joined = calls.join(hits, [*key, "alts"], "left")
    kept = F.when(F.col("id").isNull() | (F.col("id") == "."), F.coalesce(new, F.lit("."))).when(new.isNull() | F.array_contains(F.split("id", ";"), new), F.col("id")).otherwise(F.concat_ws(";", "id", new))
    return joined.withColumn("id", kept).withColumn("db", new.isNotNull()).drop("_first")


def trio_violations(genotypes: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(child, child_gt, mother_gt, father_gt, violation): alternate copies 0 to 2 against what the parents can pass on."""
    g = lambda who: genotypes.select(F.col("sample").alias(who), F.col("copies").alias(f"{who}_gt"))
    rows = pedigree.join(g("child"), "child").join(g("mother"), "mother").join(g("father"), "father")

    def passes(of: Column, allele: int) -> Column:
        return of >= 1 if allele else of <= 1

    m, f, c = F.col("mother_gt"), F.col("father_gt"), F.col("child_gt")
    fits = F.when(c == 0, passes(m, 0) & passes(f, 0)).when(c == 2, passes(m, 1) & passes(f, 1)).otherwise((passes(m, 0) & passes(f, 1)) | (passes(m, 1) & passes(f, 0)))
    return rows.select("child", "child_gt", "mother_gt", "father_gt", (~fits).alias("violation"))


def merged_calls(sets: dict[str, DataFrame], order: list[str], keys: list[str], value: str) -> DataFrame:
    """One row per key: the value of the set that comes first in ``order``, and the names of the sets that hold the key."""
    ranked = [sets[n].select(*keys, value, F.lit(k).alias("_rank"), F.lit(n).alias("_set")) for k, n in enumerate(order)]
    rows = reduce(DataFrame.union, ranked)
    picked = rows.groupBy(*keys).agg(F.min(F.struct("_rank", value)).alias("_first"), F.sort_array(F.collect_set(F.struct("_rank", "_set"))).alias("_sets"))
    label = F.when(F.size("_sets") == len(order), F.lit("Intersection")).otherwise(F.array_join(F.col("_sets._set"), "-"))
    return picked.select(*keys, F.col(f"_first.{value}").alias(value), label.alias("set"))


def failed_filters(tests: dict[str, Column]) -> Column:
    """Names of the filters that a row fails, in order."""
    return F.array_compact(F.array(*(F.when(~ok, F.lit(n)) for n, ok in tests.items())))


#: Bits of a read's flag field.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))


def read_filters(flags: Column, mapq: Column) -> dict[str, Column]:
    """Named tests that a good read passes."""
    off = lambda bit: flags.bitwiseAND(bit) == 0
    return {
        "mapped": off(UNMAPPED),
        "primary": off(SECONDARY | SUPPLEMENTARY),
        "not_duplicate": off(DUPLICATE),
        "passes_vendor": off(QC_FAIL),
        "paired": ~off(PAIRED),
        "proper_pair": off(PAIRED) | ~off(PROPER),
        "mapping_quality": (mapq != 0) & (mapq != 255),
    }


def coverage_outliers(df: DataFrame, total: str, low: float, high: float) -> DataFrame:
    """Rows whose total lies above low times the median and below high times the mean of positive totals."""
    bounds = df.where(F.col(total) > 0).agg(F.median(total).alias("_median"), F.avg(total).alias("_mean"))  # one row
    return df.crossJoin(F.broadcast(bounds)).where((F.col(total) > 0) & (F.col(total) > low * F.col("_median")) & (F.col(total) < high * F.col("_mean"))).drop("_median", "_mean")


#: Characters of texts whose windows are counted together before they are shuffled, unless one text is longer.
_COUNTED = 1 << 20


def _window_counts(texts: list[str], k: int) -> tuple[list[str], np.ndarray]:
    """Distinct windows of ``k`` characters of all texts, and how often each occurs."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    start = np.ones(max(len(points) - k + 1, 0), bool)
    for back in range(1, k):  # no window reaches over a text's end
        at = ends[:-1] - back
        start[at[(at >= 0) & (at < len(start))]] = False
    start = np.flatnonzero(start)
    if not len(start):
        return [], start
    mark = np.zeros(len(start), np.uint64)
    for j in range(k):
        mark = (mark ^ points[start + j]) * np.uint64(0x9E3779B97F4A7C15)
        mark ^= mark >> np.uint64(29)
    order = np.argsort(mark, kind="stable")
    mark, start = mark[order], start[order]
    same = mark[1:] == mark[:-1]
    for j in range(k):  # equal marks of other characters are told apart here
        same &= points[start[1:] + j] == points[start[:-1] + j]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    text = points[start[first][:, None] + np.arange(k)].astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + k] for i in range(0, len(text), k)], np.diff(np.append(first, len(start)))


def kmers(df: DataFrame, keys: list[str], text: str, k: int, least: int = 1) -> DataFrame:
    """(keys, kmer, n) of every window of ``k`` characters, counts under ``least`` dropped; a null text has none.

    Windows are counted over about a million characters at a time in Arrow batches, so what is shuffled are partial counts.
    """
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), "kmer string, n long"])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(np.arange(batch.num_rows)))
            groups = table.group_by(keys).aggregate([("_row", "list")]) if keys else None
            rows = groups.column("_row_list").to_pylist() if keys else [list(range(batch.num_rows))]
            column = batch.column(len(keys))
            for g, own in enumerate(rows):
                held, size = [], 0
                for n, row in enumerate(own):
                    held.append(column[row].as_py() or "")
                    size += len(held[-1])
                    if size >= _COUNTED or n == len(own) - 1:
                        found, counts = _window_counts(held, k)
                        given = [pa.array([groups.column(c)[g].as_py()] * len(found), batch.schema.field(c).type) for c in keys]
                        yield pa.RecordBatch.from_arrays([*given, pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=[*keys, "kmer", "n"])
                        held, size = [], 0

    partial = df.select(*keys, text).mapInArrow(run, schema)
    return partial.groupBy(*keys, "kmer").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
