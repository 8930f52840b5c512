"""Combining single-sample records at a site: alleles on one REF, likelihoods and depths on one allele list, merged fields."""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.models import genotype_order
from . import alleles as al

#: Site fields that describe one sample's calling and are dropped when records are merged.
STALE = ("DP", "AC", "AF", "AN", "MLEAC", "MLEAF", "END", "ECNT")


def at_site(start: Column, site: Column, ref: Column, alts: Column, longest: Column) -> Column:
    """A record's alternates as seen at a site: on the longest REF if it starts there, else as what spans it."""
    return F.when(start == site, al.to_longer_ref(alts, ref, longest)).otherwise(al.spanning(alts, ref))


def merged_alleles(df: DataFrame, keys: list[str], alts: str) -> DataFrame:
    """(keys, alts): distinct alternates of all records in merge order; no-calls are left out."""
    each = df.select(*keys, F.explode(alts).alias("_a")).where(F.col("_a") != al.NO_CALL)
    return each.groupBy(*keys).agg(al.ordered(F.collect_set("_a")).alias(alts))


def best_of_equal(alleles: Column, pl: Column) -> Column:
    """For each alternate (from 1, diploid): whether it is the one to keep among equal names.

    That is the one whose homozygous phred value is least, the first of equals.
    """
    hom = F.transform(alleles, lambda _, i: F.get(pl, ((i + 1) * (i + 2) / 2 + i + 1).cast("int")))
    rows = F.transform(alleles, lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get(hom, i), F.lit(1 << 30)).alias("h"), i.alias("i")))
    return F.transform(rows, lambda x: F.get(F.array_sort(F.transform(F.filter(rows, lambda y: y["a"] == x["a"]), lambda y: F.struct(y["h"].alias("h"), y["i"].alias("i")))), F.lit(0))["i"] == x["i"])


def _choose(n: Column, k: int) -> Column:
    """n over k for a small constant k."""
    out = F.lit(1).cast("long")
    for j in range(k):
        out = out * (n - j)
    return (out / factorial(k)).cast("int")


def genotype_index(alleles: list[Column]) -> Column:
    """Index of a genotype of any ploidy in likelihood order, from its allele numbers in any order."""
    ranked = F.sort_array(F.array(*alleles))
    out = F.lit(0)
    for j in range(len(alleles)):
        out = out + _choose(F.get(ranked, F.lit(j)).cast("long") + j, j + 1)
    return out


def genotype_map(allele_map: Column, alleles: int, ploidy: int) -> Column:
    """Old genotype index of every new genotype of ``alleles`` alleles, where allele_map[i] is the old number of new allele i."""
    return F.array(*(genotype_index([F.get(allele_map, F.lit(a)) for a in g]) for g in genotype_order(alleles, ploidy)))


def remapped_pl(pl: Column, allele_map: Column, alleles: int, ploidy: int) -> Column:
    return F.transform(genotype_map(allele_map, alleles, ploidy), lambda i: F.get(pl, i))


def remapped_ad(ad: Column, allele_map: Column, pl: Column) -> Column:
    """Depths by new alleles, 0 for one that the record lacks; null without likelihoods, where they are left out."""
    return F.when(pl.isNotNull(), F.transform(allele_map, lambda i: F.coalesce(F.get(ad, i.cast("int")), F.lit(0))))


def merged_ids(ids: str) -> Column:
    """Aggregate: distinct names other than ".", joined by ";" in order; "." if there are none."""
    found = F.sort_array(F.collect_set(F.when(F.col(ids) != ".", F.col(ids))))
    return F.when(F.size(found) == 0, ".").otherwise(F.array_join(found, ";"))


def merged_filters(filters: str) -> Column:
    """Aggregate: "." if any record passed or says nothing, else all filters joined by ";"."""
    clear = F.coalesce(F.col(filters), F.lit(".")).isin(".", "PASS")
    found = F.sort_array(F.collect_set(F.when(~clear, F.col(filters))))
    return F.when(F.bool_or(clear), ".").otherwise(F.array_join(found, ";"))


def without_stale(info: Column) -> Column:
    """A map of site fields without those of :data:`STALE`."""
    return F.map_filter(info, lambda k, _: ~k.isin(*STALE))


def raw_mapping_quality(raw_and_depth: Column, raw: Column, depth: Column) -> Column:
    """[sum of squares, reads]: the present field, or made of the older one and the depth."""
    return F.coalesce(raw_and_depth, F.when(raw.isNotNull() & depth.isNotNull(), F.array(raw.cast("long"), depth.cast("long"))))


def sites_with_records(sites: DataFrame, records: DataFrame) -> DataFrame:
    """Every site with the records (columns suffixed _r) that cover it; a site without any has one row of nulls."""
    from . import intervals

    points = sites.select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"))
    return intervals.overlap_join(points, records, intervals.fitting(records), how="left").withColumnRenamed("start", "pos").drop("end")


def combined(sites: DataFrame, records: DataFrame) -> DataFrame:
    """(contig, pos, end, ref, alts, is_block, n_samples, depth, id, filter): one row for each site.

    ``records`` is (contig, start, end, sample, ref, alts, dp, id, filter, rec_no) with <NON_REF> among the alternates.  A
    sample's latest record counts.  Without a true alternate the site is a reference block of one base: REF's base,
    <NON_REF>, END at the site.  A site where no record starts has "N" for REF unless a record of one base covers it.
    """
    from pyspark.sql import Window

    joined = sites_with_records(sites, records)
    last = F.row_number().over(Window.partitionBy("contig", "pos", "sample_r").orderBy(F.col("start_r").desc(), F.col("rec_no_r").desc()))
    latest = joined.withColumn("_k", last).where("_k = 1")
    here = F.col("start_r") == F.col("pos")
    longest = F.max(F.when(here, F.struct(F.length("ref_r").alias("n"), F.col("ref_r").alias("ref"))))
    refs = latest.groupBy("contig", "pos").agg(longest.getField("ref").alias("_ref"))
    on = latest.join(refs, ["contig", "pos"]).withColumn("ref", F.coalesce("_ref", F.lit("N")))
    seen = on.withColumn("_alts", at_site(F.col("start_r"), F.col("pos"), F.col("ref_r"), F.col("alts_r"), F.col("ref")))
    each = seen.select("contig", "pos", F.explode_outer("_alts").alias("_a")).where(F.col("_a") != al.NO_CALL)
    union = each.groupBy("contig", "pos").agg(al.ordered(F.collect_set("_a")).alias("alts"))
    true = F.coalesce(F.max(F.exists("_alts", lambda a: ~a.isin(al.NON_REF, al.NO_CALL))), F.lit(False))
    out = seen.groupBy("contig", "pos").agg(
        F.min("ref").alias("ref"), (~true).alias("is_block"), F.count("sample_r").alias("n_samples"), F.coalesce(F.sum("dp_r"), F.lit(0)).alias("depth"),
        F.sort_array(F.collect_set(F.when(here & (F.col("id_r") != "."), F.col("id_r")))).alias("_ids"),
        F.coalesce(F.bool_or(F.when(here, F.col("filter_r").isin(".", "PASS"))), F.lit(True)).alias("_clear"),
        F.sort_array(F.collect_set(F.when(here & ~F.col("filter_r").isin(".", "PASS"), F.col("filter_r")))).alias("_filters"),
    )
    out = out.join(union, ["contig", "pos"], "left")
    return out.select(
        "contig", "pos", F.col("pos").alias("end"), F.when(F.col("is_block"), F.substring("ref", 1, 1)).otherwise(F.col("ref")).alias("ref"),
        F.when(F.col("is_block"), F.array(F.lit(al.NON_REF))).otherwise(F.col("alts")).alias("alts"), "is_block", "n_samples", "depth",
        F.when(F.size("_ids") == 0, ".").otherwise(F.array_join("_ids", ";")).alias("id"), F.when(F.col("_clear"), ".").otherwise(F.array_join("_filters", ";")).alias("filter"),
    )
