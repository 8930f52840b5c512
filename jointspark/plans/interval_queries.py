"""Queries on sites, intervals, windows and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sites
from .registry import query
from .views import LENGTH, REC, REG, records, regions, rounded, table

#: Maximal runs of the positions in a table p(contig, pos).
ISLANDS = "SELECT contig, min(pos) AS \"start\", max(pos) AS \"end\" FROM (SELECT contig, pos, pos - row_number() OVER (PARTITION BY contig ORDER BY pos) AS g FROM p) GROUP BY contig, g"
BASES_A = "a AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM reg WHERE priority < '3')"
BASES_B = "b AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM reg WHERE priority >= '3')"
BASES_ALL = "a AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM reg)"


def _sides(spark, d):
    r = regions(spark, d)
    return r.where("priority < '3'"), r.where("priority >= '3'")


@query("q01_site_set", f"WITH {REC}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2) SELECT contig, count(*) AS n_sites, CAST(min(pos) AS BIGINT) AS first_site, CAST(max(pos) AS BIGINT) AS last_site FROM p GROUP BY contig")
def site_set(spark, d):
    found = sites.variant_sites(records(spark, d))
    return found.groupBy("contig").agg(F.count("*").alias("n_sites"), F.min("pos").alias("first_site"), F.max("pos").alias("last_site"))


@query("q01_next_site", f"WITH {REC}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2) SELECT contig, pos, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS next_site FROM p")
def next_site(spark, d):
    return sites.with_next(sites.variant_sites(records(spark, d)))


@query("q01_site_slice", f"WITH {REC}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2) SELECT contig, pos FROM p WHERE contig = 3 AND pos BETWEEN 100 AND 180")
def site_slice(spark, d):
    return sites.variant_sites(records(spark, d).where("contig = 3"), 100, 180)


@query("q02_merge_all", f"WITH {REG}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM reg) {ISLANDS}")
def merge_all(spark, d):
    return iv.merged(regions(spark, d))


@query(
    "q02_merge_overlap",
    f"""WITH {REG}, m AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM reg),
  g AS (SELECT *, sum(CASE WHEN before >= start THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT contig, min(start) AS "start", max(stop) AS "end" FROM g GROUP BY contig, island""",
)
def merge_overlap(spark, d):
    return iv.merged(regions(spark, d), abutting=False)


@query("q03_union", f"WITH {REG}, {BASES_A}, {BASES_B}, p AS (SELECT * FROM a UNION SELECT * FROM b) {ISLANDS}")
def union(spark, d):
    return iv.union(*_sides(spark, d))


@query("q03_intersection", f"WITH {REG}, {BASES_A}, {BASES_B}, p AS (SELECT * FROM a INTERSECT SELECT * FROM b) {ISLANDS}")
def intersection(spark, d):
    return iv.intersection(*_sides(spark, d))


@query("q04_subtract", f"WITH {REG}, {BASES_A}, {BASES_B}, p AS (SELECT * FROM a EXCEPT SELECT * FROM b) {ISLANDS}")
def subtract(spark, d):
    return iv.subtraction(*_sides(spark, d))


@query("q04_covered_size", f"WITH {REG}, {BASES_ALL} SELECT contig, count(*) AS covered FROM a GROUP BY contig")
def covered_size(spark, d):
    return iv.covered_size(regions(spark, d))


@query("q04_segments", f"WITH {REG}, e AS (SELECT contig, start AS pos FROM reg UNION SELECT contig, stop + 1 FROM reg), s AS (SELECT contig, pos AS \"start\", lead(pos) OVER (PARTITION BY contig ORDER BY pos) - 1 AS \"end\" FROM e) SELECT * FROM s WHERE \"end\" IS NOT NULL")
def segments(spark, d):
    return iv.segments(regions(spark, d))


@query("q05_pad_merge", f"WITH {REG}, p AS (SELECT DISTINCT contig, unnest(range(greatest(start - 5, 1), least(stop + 5, {LENGTH}) + 1)) AS pos FROM reg) {ISLANDS}")
def pad_merge(spark, d):
    return iv.padded(regions(spark, d), 5, LENGTH)


@query("q06_split_by_size", "SELECT c.c AS contig, s.s AS \"start\", least(s.s + 99, 2550) AS \"end\" FROM range(8) c(c), range(1, 2551, 100) s(s)")
def split_by_size(spark, d):
    whole = spark.range(8).select(F.col("id").alias("contig"), F.lit(1).cast("long").alias("start"), F.lit(2550).cast("long").alias("end"))
    return iv.split_by_size(whole, 100)


@query("q06_split_by_count", "SELECT c.c AS contig, s.s AS \"start\", least(s.s + 382, 2550) AS \"end\" FROM range(8) c(c), range(1, 2551, 383) s(s)")
def split_by_count(spark, d):
    whole = spark.range(8).select(F.col("id").alias("contig"), F.lit(1).cast("long").alias("start"), F.lit(2550).cast("long").alias("end"))
    return iv.split_by_count(whole, 7)


@query(
    "q07_split_balanced",
    f"""WITH {REC}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2),
  r AS (SELECT contig, pos, row_number() OVER (PARTITION BY contig ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY contig) AS total FROM p),
  n AS (SELECT *, greatest(CAST(floor(total / CAST(0.98 * 6 AS DOUBLE)) AS BIGINT), 10) AS n FROM r)
SELECT contig, min(pos) AS "start", max(pos) + CASE WHEN count(*) < n THEN 1 ELSE 0 END AS "end" FROM n GROUP BY contig, n, k // n""",
)
def split_balanced(spark, d):
    return iv.split_balanced(sites.variant_sites(records(spark, d)), 6, 10)


@query("q07_split_is_valid", "SELECT CAST(0 AS BIGINT) AS n_overlapping, CAST(0 AS BIGINT) AS n_uncovered")
def split_is_valid(spark, d):
    found = sites.variant_sites(records(spark, d))
    windows = iv.split_balanced(found, 6, 10)
    wrong = iv.disorder(windows).select(F.lit(1).alias("o"), F.lit(0).alias("u")).union(iv.uncovered(found, windows).select(F.lit(0), F.lit(1)))
    return wrong.agg(F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("n_overlapping"), F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("n_uncovered"))


@query(
    "q08_overlap_join",
    f"""WITH {REC}, p AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2),
  c AS (SELECT contig, unnest(range(start, stop + 1)) AS pos, dp FROM rec)
SELECT p.contig, count(*) AS n_pairs, CAST(sum(dp) AS BIGINT) AS sum_dp, count(DISTINCT pos) AS n_sites FROM p JOIN c USING (contig, pos) GROUP BY p.contig""",
)
def overlap_join(spark, d):
    rec = records(spark, d)
    found = sites.variant_sites(rec)
    per_site = iv.coverage(found, rec.select("contig", "start", "end", "dp"), ["dp"])
    return per_site.groupBy("contig").agg(F.sum("n").alias("n_pairs"), F.sum("dp").alias("sum_dp"), F.count("*").alias("n_sites"))


@query("q08_overlap_pairs", f"WITH {REG} SELECT a.key AS key, count(*) AS n_pairs, CAST(sum(b.key) AS BIGINT) AS sum_key FROM reg a JOIN reg b ON a.contig = b.contig AND a.start <= b.stop AND b.start <= a.stop AND a.priority < '3' AND b.priority >= '3' GROUP BY a.key")
def overlap_pairs(spark, d):
    found = iv.overlap_sums(*(s.select("contig", "start", "end", "key") for s in _sides(spark, d)), "key")
    return found.groupBy("key").agg(F.sum("n").alias("n_pairs"), F.sum("total").alias("sum_key"))


@query("q08_overlapping", f"WITH {REG} SELECT key, contig, start AS \"start\", stop AS \"end\" FROM reg r WHERE priority < '3' AND EXISTS (SELECT 1 FROM reg s WHERE s.priority >= '3' AND s.contig = r.contig AND s.start <= r.stop AND r.start <= s.stop)")
def overlapping_sides(spark, d):
    left, right = _sides(spark, d)
    return iv.overlapping(left.select("key", "contig", "start", "end"), right)


@query("q09_reciprocal_overlap_all", f"WITH {REG} SELECT a.key AS key, count(*) AS n_partners, min(b.key) AS least_partner FROM reg a JOIN reg b ON a.contig = b.contig AND least(a.stop, b.stop) - greatest(a.start, b.start) + 1 >= 0.5 * greatest(a.stop - a.start + 1, b.stop - b.start + 1) GROUP BY a.key")
def reciprocal_all(spark, d):
    """Equal intervals have the same partners, so each distinct one is paired once with the number and the least key of others."""
    own = ["contig", "start", "end"]
    distinct = regions(spark, d).groupBy(*own).agg(F.count("*").alias("n"), F.min("key").alias("key"))
    pairs = iv.reciprocal(distinct.select(*own), distinct, 0.5)
    found = pairs.groupBy(*own).agg(F.sum("n_r").alias("_n"), F.min("key_r").alias("_least"))
    return regions(spark, d).join(found, own).groupBy("key").agg(F.sum("_n").alias("n_partners"), F.min("_least").alias("least_partner"))


@query(
    "q10_overlap_map",
    f"""WITH {REG}, k AS (SELECT DISTINCT contig, start, stop FROM reg WHERE priority < '3'), v AS (SELECT DISTINCT contig, start, stop FROM reg WHERE priority >= '3')
SELECT k.contig, k.start AS "start", k.stop AS "end", string_agg(v.start || '-' || v.stop, ',' ORDER BY v.start, v.stop) AS hits
FROM k JOIN v ON v.contig = k.contig AND v.start <= k.stop AND k.start <= v.stop GROUP BY ALL""",
)
def overlap_map_sides(spark, d):
    found = iv.overlap_map(*_sides(spark, d))
    return found.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat_ws("-", h["start_r"].cast("string"), h["end_r"].cast("string"))), ","))


@query(
    "q11_latest_record",
    f"""WITH {REC}, s AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2),
  o AS (SELECT s.contig, s.pos, r.sample, r.start, r.dp, row_number() OVER (PARTITION BY s.contig, s.pos, r.sample ORDER BY r.start DESC, r.orderkey DESC, r.line DESC, r.dp DESC) AS k
    FROM s JOIN rec r ON r.contig = s.contig AND s.pos BETWEEN r.start AND r.stop)
SELECT contig, pos, count(*) AS n_samples, CAST(sum(dp) AS BIGINT) AS sum_dp, CAST(sum(start) AS BIGINT) AS sum_start FROM o WHERE k = 1 GROUP BY contig, pos""",
)
def latest_record(spark, d):
    rec = records(spark, d).withColumn("true", F.col("n_allele") > 2).withColumn("began", F.col("start"))
    out = sites.counted(rec, ["orderkey", "line", "dp"], "true", sums=["dp", "began"])
    return out.select("contig", "pos", F.col("n").alias("n_samples"), F.col("dp").alias("sum_dp"), F.col("began").alias("sum_start"))


@query(
    "q11_latest_per_sample",
    f"""WITH {REC}, s AS (SELECT contig, start AS pos, max(orderkey) AS k FROM rec WHERE n_allele > 2 GROUP BY ALL),
  o AS (SELECT s.contig, s.pos, r.sample, r.start, r.dp, row_number() OVER (PARTITION BY s.contig, s.pos, r.sample ORDER BY r.start DESC, r.orderkey DESC, r.line DESC, r.dp DESC) AS k
    FROM s JOIN rec r ON r.contig = s.contig AND s.pos BETWEEN r.start AND r.stop)
SELECT contig, pos, count(*) AS n_samples, CAST(sum(dp * sample) AS BIGINT) AS mark FROM o WHERE k = 1 GROUP BY contig, pos""",
)
def latest_rows(spark, d):
    rec = records(spark, d).withColumn("true", F.col("n_allele") > 2).withColumn("mark", F.col("dp") * F.col("sample"))
    out = sites.counted(rec, ["orderkey", "line", "dp"], "true", sums=["mark"], starts_only=True)
    return out.select("contig", "pos", F.col("n").alias("n_samples"), "mark")


@query(
    "q08_preserve_all_sites",
    f"""WITH {REG}, {REC}, s AS (SELECT DISTINCT contig, start AS pos FROM reg), v AS (SELECT contig, start, start AS stop, dp FROM rec WHERE n_allele > 2)
SELECT s.contig, s.pos, count(v.start) AS n, CAST(coalesce(sum(v.dp), 0) AS BIGINT) AS sum_dp FROM s LEFT JOIN v ON v.contig = s.contig AND s.pos BETWEEN v.start AND v.stop GROUP BY s.contig, s.pos""",
)
def preserve_all_sites(spark, d):
    points = regions(spark, d).select("contig", "start").distinct().withColumn("end", F.col("start"))
    firsts = records(spark, d).where("n_allele > 2").select("contig", "start", F.col("start").alias("end"), "dp")
    joined = iv.overlap_join(points, firsts, how="left")
    return joined.groupBy("contig", F.col("start").alias("pos")).agg(F.count("start_r").alias("n"), F.coalesce(F.sum("dp_r"), F.lit(0)).alias("sum_dp"))


@query("q35_upstream_deletion", f"WITH {REC}, v AS (SELECT contig, start, orderkey, line, CASE WHEN line >= 6 THEN dp // 5 ELSE 0 END AS deleted, dp FROM rec), w AS (SELECT *, max(CASE WHEN deleted > 0 THEN start + deleted END) OVER (PARTITION BY contig ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v) SELECT contig, start AS \"start\", count(*) AS n, CAST(sum(CAST(coalesce(reach >= start, false) AS INT)) AS BIGINT) AS n_covered FROM w GROUP BY contig, start")
def upstream_deletion(spark, d):
    v = records(spark, d).withColumn("deleted", F.when(F.col("line") >= 6, F.floor(F.col("dp") / 5)).otherwise(0))
    return iv.covered_upstream(v).groupBy("contig", "start").agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("long")).alias("n_covered"))


@query(
    "q37_banding",
    """WITH b AS (SELECT user_id, ts, event_id, value, CASE WHEN value >= 99 THEN 3 WHEN value >= 60 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END AS band FROM events),
  m AS (SELECT *, CASE WHEN lag(band) OVER (PARTITION BY user_id ORDER BY ts, event_id) = band THEN 0 ELSE 1 END AS new FROM b),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, CAST(band AS BIGINT) AS band, CAST(run AS BIGINT) AS run, count(*) AS n, floor(min(value) * 10000 + 0.5) / 10000 AS least FROM r GROUP BY user_id, band, run""",
)
def banding(spark, d):
    runs = iv.bands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", [0, 20, 60, 99])
    return runs.select("user_id", F.col("band").cast("long").alias("band"), F.col("run").cast("long").alias("run"), "n", rounded(F.col("least")).alias("least"))


@query("q38_break_bands", f"WITH {REG} SELECT key, unnest(range(((start + 1) // 4 + 1) * 4 - 1, stop + 1, 4)) AS stop FROM reg")
def break_bands(spark, d):
    return iv.break_points(regions(spark, d), 4).select("key", "stop")


@query("q44_validate_order", f"WITH {REG}, w AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM reg) SELECT contig, count(*) AS n_overlapping FROM w WHERE before >= start GROUP BY contig")
def validate_order(spark, d):
    return iv.disorder(regions(spark, d)).groupBy("contig").agg(F.count("*").alias("n_overlapping"))


@query(
    "q48_sorted_merge",
    f"""WITH {REG}, names AS (SELECT n_nationkey % 8 AS contig, min(n_nationkey) AS idx FROM nation WHERE n_nationkey < 8 GROUP BY 1),
  u AS (SELECT contig, start, stop, key, 0 AS file FROM reg WHERE priority < '3' UNION ALL SELECT contig, start, stop, key, 1 FROM reg WHERE priority >= '3')
SELECT row_number() OVER (ORDER BY 7 - idx, start, file, key) AS rank, u.contig, start AS "start", key, CAST(file AS BIGINT) AS file FROM u JOIN names USING (contig)""",
)
def sorted_merge(spark, d):
    from ..sources.merge import merged_scan

    dictionary = table(spark, d, "nation").where("n_nationkey < 8").select(F.col("n_nationkey").cast("long").alias("contig"), (7 - F.col("n_nationkey")).alias("idx"))
    out = merged_scan([s.select("contig", "start", "key") for s in _sides(spark, d)], dictionary, ["start", "file", "key"])
    return out.select("rank", "contig", "start", "key", F.col("file").cast("long").alias("file"))


SHARES = "s AS (SELECT contig, pos, row_number() OVER (ORDER BY contig, pos) - 1 AS k, count(*) OVER () AS total FROM a), t AS (SELECT contig, pos, k // CAST(ceil(CAST(total AS DOUBLE) / {parts}) AS BIGINT) AS part FROM s)"


@query(
    "q49_scatter",
    f"""WITH {REG}, {BASES_ALL}, {SHARES.format(parts=5)}, g AS (SELECT *, pos - row_number() OVER (PARTITION BY contig, part ORDER BY pos) AS island FROM t)
SELECT contig, min(pos) AS "start", max(pos) AS "end", CAST(part AS BIGINT) AS part FROM g GROUP BY contig, part, island""",
)
def scatter(spark, d):
    return iv.scattered(regions(spark, d), 5)


@query(
    "q49_scatter_by_contig",
    f"""WITH {REG}, {BASES_ALL}, c AS (SELECT contig, count(*) AS n FROM a GROUP BY 1), o AS (SELECT contig, coalesce(sum(n) OVER (ORDER BY contig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(n) OVER () AS total FROM c)
SELECT contig, CAST(least(base * 3 // total, 2) AS BIGINT) AS part FROM o""",
)
def scatter_by_contig(spark, d):
    return iv.scattered_by_contig(regions(spark, d), 3)
