"""Filters of reads, variants and somatic calls by name, their algebra and their counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alleles as al
from .annotate import DUPLICATE, FIRST, MATE_REVERSE, MATE_UNMAPPED, PAIRED, PROPER, QC_FAIL, REVERSE, SECOND, SECONDARY, SUPPLEMENTARY, UNMAPPED


@dataclass(frozen=True)
class Filter:
    """A named test that a good row passes; null counts as failing."""

    name: str
    test: Column

    def __and__(self, other: Filter) -> Filter:
        return Filter(f"({self.name} and {other.name})", self.passed & other.passed)

    def __or__(self, other: Filter) -> Filter:
        return Filter(f"({self.name} or {other.name})", self.passed | other.passed)

    def __invert__(self) -> Filter:
        return Filter(f"not {self.name}", ~self.passed)

    @property
    def passed(self) -> Column:
        return F.coalesce(self.test, F.lit(False))


def counted(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """(filter, n): rows that each filter rejects when they are asked in order, and in the end those that pass all."""
    first = F.lit("passed")
    for f in reversed(filters):
        first = F.when(~f.passed, f.name).otherwise(first)
    return df.groupBy(first.alias("filter")).agg(F.count("*").alias("n"))


#: Operations of an alignment that consume read bases, and reference bases.
READ_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def consumed(cigar: Column, operations: str) -> Column:
    """Bases of the given operations in an alignment string."""
    parts = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{operations}]"), 1)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def good_cigar(cigar: Column) -> Column:
    """Well formed, no insertion beside a deletion, no deletion at either end, clips left out."""
    inner = F.regexp_replace(F.regexp_replace(cigar, r"^(\d+H)?(\d+S)?", ""), r"(\d+S)?(\d+H)?$", "")
    return cigar.rlike(r"^(\d+[MIDNSHP=X])+$") & ~inner.rlike(r"[SH]") & ~inner.rlike(r"\d+I\d+D|\d+D\d+I") & ~inner.rlike(r"^\d+D|\d+D$") & (inner != "")


def read_filters() -> dict[str, Filter]:
    """Filters over (flags, contig, start, end, mapq, cigar, mate_contig, tlen, seq, qual, rg, oa_contig, mate_oa_contig, length)."""
    c = F.col
    on = lambda bit: c("flags").bitwiseAND(bit) != 0
    off = lambda bit: c("flags").bitwiseAND(bit) == 0
    mapped = off(UNMAPPED)
    tests = {
        "all": F.lit(True),
        "no_n_in_cigar": ~c("cigar").contains("N"),
        "first_of_pair": on(PAIRED) & on(FIRST),
        "second_of_pair": on(PAIRED) & on(SECOND),
        "good_cigar": good_cigar(c("cigar")),
        "fragment_length": c("tlen") != 0,
        "bases_match_qualities": F.length("seq") == F.length("qual"),
        "read_group": c("rg").isNotNull(),
        "mapped": mapped,
        "mapping_quality_known": c("mapq") != 255,
        "mapping_quality_not_zero": c("mapq") != 0,
        "mate_on_contig": off(PAIRED) | on(MATE_UNMAPPED) | (mapped & (c("contig") == c("mate_contig"))),
        "mate_on_other_strand": on(PAIRED) & mapped & off(MATE_UNMAPPED) & (on(REVERSE) != on(MATE_REVERSE)),
        "reference_length": consumed(c("cigar"), REFERENCE_OPS) > 0,
        "not_duplicate": off(DUPLICATE),
        "not_secondary": off(SECONDARY),
        "not_supplementary": off(SUPPLEMENTARY),
        "paired": on(PAIRED),
        "passes_vendor": off(QC_FAIL),
        "proper_pair": on(PROPER),
        "primary": off(SECONDARY | SUPPLEMENTARY),
        "length_equals_cigar": ~mapped | (consumed(c("cigar"), READ_OPS) == F.length("seq")),
        "has_bases": F.length("seq") > 0,
        "valid_start": ~mapped | (c("start") > 0),
        "valid_end": ~mapped | (c("end") - c("start") + 1 >= 0),
        "not_chimeric": c("oa_contig").isNull() | c("mate_oa_contig").isNull() | (c("oa_contig") == c("mate_oa_contig")),
        "agrees_with_header": ~mapped | (c("length").isNotNull() & (c("start") <= c("length"))),
    }
    return {n: Filter(n, t) for n, t in tests.items()}


def wellformed() -> Filter:
    f = read_filters()
    out = f["valid_start"]
    for n in ("valid_end", "agrees_with_header", "read_group", "bases_match_qualities", "length_equals_cigar", "has_bases", "no_n_in_cigar"):
        out = out & f[n]
    return Filter("wellformed", out.test)


def between(name: str, value: Column, least: int, most: int | None = None) -> Filter:
    """Mapping quality or read length inside bounds."""
    return Filter(name, (value >= least) & (value <= most if most is not None else F.lit(True)))


def variant_filters(ref: Column, alts: Column, filters: Column) -> dict[str, Filter]:
    tests = {"all": F.lit(True), "not_symbolic": al.variant_type(ref, alts) != "SYMBOLIC", "passes": filters.isNull() | (F.size(filters) == 0) | (filters == F.array(F.lit("PASS")))}
    return {n: Filter(n, t) for n, t in tests.items()}


def validation(ref: Column, reference: Column, id_: Column, known: Column, alts: Column, genotypes: Column, an: Column, ac: Column) -> Column:
    """Names of the strict tests that a record fails: REF against the reference, ID among known ones, unused alleles, counts."""
    copies = F.filter(F.flatten(genotypes), lambda a: a >= 0)
    counts = F.transform(F.sequence(F.lit(1), F.size(alts)), lambda k: F.size(F.filter(copies, lambda a: a == k)))
    tests = {
        "REF": reference.isNull() | (ref == reference), "IDS": (id_ == ".") | F.forall(F.split(id_, ";"), lambda i: F.array_contains(known, i)),
        "ALLELES": F.forall(counts, lambda n: n > 0), "CHR_COUNTS": (an.isNull() | (an == F.size(copies))) & (ac.isNull() | (ac == counts)),
    }
    return F.array_compact(F.array(*(F.when(~t, F.lit(n)) for n, t in tests.items())))


#: Thresholds of somatic filters, fixed values.
SOMATIC = {"lod": 5.3, "base_quality": 20, "mapping_quality": 30, "fragment_length": 10000, "events": 2, "chimeric": 0.85, "lod_by_depth": 0.0035, "germline": 0.1, "contamination": 0.1, "unique_reads": 0, "long_indel": 5}


def somatic_filters(limits: dict[str, float] = SOMATIC) -> Column:
    """Names of the filters that a tumour call fails, from (lods, mbq, mmq, fragment, mpos, indel, ecnt, unique_alt, chimeric_alt, alt_reads, depth, in_panel, forward, reverse)."""
    c = F.col
    best = F.array_position("lods", F.array_max("lods")).cast("int")
    tests = {
        "multiallelic": F.size(F.filter("lods", lambda x: x > limits["lod"])) > 1,
        "panel_of_normals": c("in_panel"),
        "base_quality": F.get("mbq", best) < limits["base_quality"],
        "mapping_quality": F.get("mmq", F.when(c("indel") >= limits["long_indel"], 0).otherwise(best)) < limits["mapping_quality"],
        "fragment_length": F.abs(F.get("fragment", F.lit(1)) - F.get("fragment", F.lit(0))) > limits["fragment_length"],
        "read_position": (c("mpos") > -1) & (c("mpos") < 1),
        "weak_evidence": F.array_max("lods") < limits["lod"],
        "clustered_events": c("ecnt") > limits["events"],
        "duplicate": c("unique_alt") <= limits["unique_reads"],
        "chimeric_original_alignment": c("chimeric_alt") / c("alt_reads") > limits["chimeric"],
        "low_lod_by_depth": (F.size("lods") == 1) & (F.get("lods", F.lit(0)) / c("depth") < limits["lod_by_depth"]),
        "strict_strand": (c("forward") == 0) | (c("reverse") == 0),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the first value in order whose running weight reaches half of all."""
    from pyspark.sql import Window

    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    by = Window.partitionBy(*keys)
    ranked = sums.withColumn("_upto", F.sum("_w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(by))
    return ranked.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*keys).agg(F.min(value).alias("median"))


def false_discovery_threshold(df: DataFrame, keys: list[str], posterior: str, rate: float) -> DataFrame:
    """(keys, threshold, n): the largest value up to which the mean error posterior, taken in order, stays at most ``rate``."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, posterior).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(posterior).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_mean", F.sum(F.col(posterior) * F.col("_n")).over(w) / F.sum("_n").over(w))
    return ranked.where(F.col("_mean") <= rate).groupBy(*keys).agg(F.max(posterior).alias("threshold"), F.max("_upto").alias("n"))


def near_filtered(df: DataFrame, keys: list[str], pos: str, filtered: Column, reach: int) -> DataFrame:
    """Adds near: whether another filtered row of the same key lies within ``reach``, from the nearest ones before and behind."""
    from pyspark.sql import Window

    at = F.when(filtered, F.col(pos))
    w = Window.partitionBy(*keys).orderBy(pos)
    before = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(at).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("near", F.coalesce(F.col(pos) - before <= reach, F.lit(False)) | F.coalesce(behind - F.col(pos) <= reach, F.lit(False)))


def two_pass(calls: DataFrame, keys: list[str], posterior: str, rate: float) -> DataFrame:
    """Calls with ``failed``, learned from all of them: those whose error posterior lies above their key's discovery threshold.

    The first pass aggregates to one threshold per key, the second reads the calls again and joins it.
    """
    learned = false_discovery_threshold(calls, keys, posterior, rate).drop("n")
    joined = calls.join(learned, keys, "left")
    return joined.withColumn("failed", F.col("threshold").isNull() | (F.col(posterior) > F.col("threshold"))).drop("threshold")
