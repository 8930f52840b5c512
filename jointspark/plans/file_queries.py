"""Queries that write files of each format and read them again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sites
from ..sinks import tables as out_tables
from ..sinks import vcf as out
from ..sources import reference, scratch, vcf
from .registry import query
from .views import AL, DNA, REC, REG, allele_rows, dna, records, regions, table


def _lines(spark, d):
    """Record lines with two samples: contig_idx, start, window, line."""
    a = allele_rows(spark, d)
    key, size = F.col("key"), F.col("size")
    first = out.call_text([out.genotype_text(F.array(F.lit(0), (key % 3).cast("int"))), size, F.when(size % 2 == 0, 99)])
    second = out.call_text([out.genotype_text(F.array(F.lit(-1), F.lit(-1))), F.lit(None), F.lit(None)])
    info = out.info_text({"DP": size, "END": F.when(size % 4 == 0, F.col("pos") + 10)})
    line = out.record_line(F.concat(F.lit("chr"), F.col("contig").cast("string")), F.col("pos"), F.concat(F.lit("rs"), key.cast("string")), F.col("ref"), F.col("alts"), F.when(size % 3 == 0, size + 0.5), F.lit("PASS"), info, F.lit("GT:DP:GQ"), F.array(first, second))
    return a.select(F.col("contig").alias("contig_idx"), F.col("pos").alias("start"), (F.col("contig") % 3).alias("window"), "key", line.alias("line"))


HEADER = out.header_lines([(f"chr{k}", 2600) for k in range(8)], [("INFO", "DP", "1", "Integer", "Depth"), ("FORMAT", "GT", "1", "String", "Genotype"), ("FORMAT", "GQ", "1", "Integer", "Quality")], ["s2", "s1"], extra=["##GVCFBlock0-1=minGQ=0", "##source=test"])


@query(
    "q58_vcf_round_trip",
    f"""WITH {AL} SELECT 'rs' || key AS id, 'chr' || contig AS contig, pos AS "start", CASE WHEN size % 4 = 0 THEN pos + 10 ELSE pos + length(ref) - 1 END AS "end", ref, array_to_string(alts, ',') AS alts, CASE WHEN size % 3 = 0 THEN size + CAST(0.5 AS DOUBLE) END AS qual,
  size AS dp, '0/' || key % 3 AS first, CASE WHEN size % 2 = 0 THEN '99' END AS gq, './.' AS second FROM al""",
)
def vcf_round_trip(spark, d):
    folder = scratch.folder(spark)
    out.write_sorted(_lines(spark, d), f"{folder}/calls", HEADER)
    spark.createDataFrame([(f"{folder}/calls",)], "value string").write.text(f"{folder}/list")
    text = vcf.lines(spark, vcf.listed(spark, f"{folder}/list"))
    rec = vcf.records(text)
    # Part files follow one another below the header of the first, so names come from it alone.
    calls = rec.withColumn("first", F.get("calls", F.lit(0))).withColumn("second", F.get("calls", F.lit(1)))
    part = lambda c, k: F.get(F.split(c, ":"), F.lit(k))
    return calls.select(
        "id", "contig", "start", "end", "ref", F.array_join("alts", ",").alias("alts"), "qual", vcf.info_value(F.col("info"), "DP").cast("long").alias("dp"),
        part("first", 0).alias("first"), part("first", 2).alias("gq"), part("second", 0).alias("second"),
    )


@query("q58_genotype_rows", f"WITH {AL} SELECT s.sample AS sample, count(*) AS n, CAST(sum(CASE WHEN s.sample = 's1' THEN key % 3 ELSE -1 END) AS BIGINT) AS second_alleles, CAST(coalesce(sum(CASE WHEN s.sample = 's1' THEN size END), 0) AS BIGINT) AS dp FROM al, (VALUES ('s1'), ('s2')) s(sample) GROUP BY 1")
def genotype_rows(spark, d):
    path = f"{scratch.folder(spark)}/calls"
    out.write_sorted(_lines(spark, d), path, HEADER, files=1)
    text = vcf.lines(spark, path)
    g = vcf.genotypes(vcf.records(text), vcf.samples(text))
    return g.groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.get("gt", F.lit(1))).cast("long").alias("second_alleles"), F.coalesce(F.sum(F.element_at("fields", "DP").cast("long")), F.lit(0)).alias("dp"))


@query("q58_header_lines", "SELECT * FROM (VALUES ('FORMAT', 'GQ'), ('FORMAT', 'GT'), ('INFO', 'DP'), ('contig', 'chr0'), ('contig', 'chr1'), ('contig', 'chr2'), ('contig', 'chr3'), ('contig', 'chr4'), ('contig', 'chr5'), ('contig', 'chr6'), ('contig', 'chr7'), ('fileformat', 'VCFv4.2'), ('source', 'test')) h(kind, id)")
def header_lines(spark, d):
    path = f"{scratch.folder(spark)}/calls"
    out.write_sorted(_lines(spark, d), path, HEADER)
    return vcf.header(vcf.lines(spark, path)).select("kind", "id").distinct()


@query("q58_window_files", f"WITH {AL} SELECT contig % 3 AS \"window\", count(*) AS n, CASE contig % 3 WHEN 0 THEN 'result.c.0.vcf.gz' WHEN 1 THEN 'result.c_5_2600.1.vcf.gz' ELSE 'result.c_1_9.2.vcf.gz' END AS name FROM al GROUP BY 1, 3")
def window_files(spark, d):
    path = f"{scratch.folder(spark)}/windows"
    out.write_windows(_lines(spark, d), path)
    names = {0: out.window_name("c", 1, 2600, 2600, 0), 1: out.window_name("c", 5, 2600, 2600, 1), 2: out.window_name("c", 1, 9, 2600, 2)}
    back = spark.read.text(path).groupBy(F.col("window").cast("long").alias("window")).agg(F.count("*").alias("n"))
    return back.withColumn("name", F.element_at(F.create_map(*(F.lit(x) for k in names.items() for x in k)), F.col("window").cast("int")))


@query("q58_concatenated_order", f"WITH {AL} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_out_of_order, CAST(1 AS BIGINT) AS n_headers FROM al")
def concatenated_order(spark, d):
    """One file: the header first, then records by contig and position."""
    path = f"{scratch.folder(spark)}/one"
    out.write_sorted(_lines(spark, d), path, HEADER, files=1)
    text = vcf.lines(spark, path).withColumn("at", F.monotonically_increasing_id())  # a file that is not split numbers its lines in order
    rec = text.where(~F.col("line").startswith("#")).select("at", F.regexp_extract("line", r"^chr(\d+)\t", 1).cast("long").alias("c"), F.get(F.split("line", "\t"), F.lit(1)).cast("long").alias("s"))
    # Checked per contig: positions by place, and contigs by their first and last place.
    by = rec.withColumn("before", F.lag("s").over(Window.partitionBy("c").orderBy("at")))
    ends = rec.groupBy("c").agg(F.min("at").alias("a"), F.max("at").alias("b")).withColumn("last", F.lag("b").over(Window.orderBy("c")))
    wrong = by.where("before > s").select(F.lit(1).alias("w")).union(ends.where("last > a").select(F.lit(1)))
    counts = text.agg(F.count_if(~F.col("line").startswith("#")).alias("n"), F.count_if(F.col("line").startswith("#CHROM")).alias("n_headers"))
    return counts.crossJoin(wrong.agg(F.count("*").alias("n_out_of_order")))  # one row each


@query("q58_region_query", f"WITH {REC} SELECT contig, start AS \"start\", stop AS \"end\", sample, count(*) AS n FROM rec WHERE contig = 3 AND start <= 600 AND stop >= 500 GROUP BY ALL")
def region_query(spark, d):
    path = f"{scratch.folder(spark)}/records"
    vcf.clustered(records(spark, d), path, 16)
    found = vcf.in_region(spark.read.parquet(path), 3, 500, 600)
    return found.groupBy("contig", "start", "end", "sample").agg(F.count("*").alias("n"))


@query("q58_records_after_start", f"WITH {REC} SELECT contig, count(*) AS n FROM rec WHERE contig IN (1, 2) AND start <= 600 AND stop >= 500 AND start >= 500 GROUP BY contig")
def records_after_start(spark, d):
    rec = records(spark, d)
    both = vcf.in_region(rec, 1, 500, 600).union(vcf.in_region(rec, 2, 500, 600))
    return vcf.after_window_start(both, 500).groupBy("contig").agg(F.count("*").alias("n"))


@query("q58_bitset_round_trip", f"WITH {REC}, s AS (SELECT DISTINCT contig, unnest(range(start, stop + 1)) AS pos FROM rec WHERE n_allele > 2) SELECT contig, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total, max(pos) // 8 + 5 AS file_bytes FROM s GROUP BY contig")
def bitset_round_trip(spark, d):
    path = f"{scratch.folder(spark)}/words"
    found = sites.variant_sites(records(spark, d))
    out_tables.site_words(found).write.parquet(path)
    back = out_tables.sites_of_words(spark.read.parquet(path))
    return back.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"), (F.floor(F.max("pos") / 8) + 5).alias("file_bytes"))


CONTIG_SQL = "c AS (SELECT p_brand AS contig, string_agg(" + DNA.format("p_name", "32") + ", '' ORDER BY p_partkey) AS b FROM part GROUP BY 1)"


def _fasta(spark, d):
    """One sequence for each brand, written in lines of 60 bases; its path."""
    path = f"{scratch.folder(spark)}/fasta"
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", dna("p_name", 32).alias("b")))), lambda x: x["b"]), "").alias("b"))
    rows = p.select(F.concat(F.lit(">"), "p_brand", F.lit(" made of names\n"), F.regexp_replace(F.lower("b"), "(.{60})", "$1\n")).alias("value"))
    rows.write.text(path)
    return path


@query("q58_fasta_access", f"WITH {CONTIG_SQL} SELECT contig, s.s AS \"start\", s.s + 149 AS \"end\", substr(b, CAST(s.s AS INT), 150) AS bases FROM c, (VALUES (1), (50), (100), (101), (257)) s(s) WHERE length(b) >= s.s")
def fasta_access(spark, d):
    chunks = reference.fasta(spark, _fasta(spark, d), 100)
    starts = F.explode(F.array(*(F.lit(k) for k in (1, 50, 100, 101, 257))))
    regions_ = table(spark, d, "part").select(F.col("p_brand").alias("contig")).distinct().select("contig", starts.alias("start")).withColumn("end", F.col("start") + 149)
    return reference.bases_at(chunks, regions_, 100)


@query("q58_sequence_dictionary", f"WITH {CONTIG_SQL} SELECT contig, CAST(length(b) AS BIGINT) AS length, row_number() OVER (ORDER BY contig) - 1 AS idx FROM c")
def sequence_dictionary(spark, d):
    sizes = reference.fasta(spark, _fasta(spark, d)).groupBy("contig").agg(F.sum(F.length("bases")).alias("n"))
    path = f"{scratch.folder(spark)}/dict"
    row = F.concat(F.lit("@SQ\tSN:"), "contig", F.lit("\tLN:"), F.col("n").cast("string"), F.lit("\tM5:x"))
    lines = sizes.select(row.alias("value"), F.lit(1).alias("k"), "contig").union(spark.createDataFrame([("@HD\tVN:1.6", 0, "")], "value string, k int, contig string"))
    lines.coalesce(1).sortWithinPartitions("k", "contig").select("value").write.text(path)  # one row for each contig
    return reference.dictionary(spark, path)


@query("q58_interval_files", f"WITH {REG} SELECT CASE key % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'bed' ELSE 'list' END AS form, 'chr' || contig AS contig, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends FROM reg GROUP BY ALL")
def interval_files(spark, d):
    folder, r = scratch.folder(spark), regions(spark, d)
    contig, start, end = F.concat(F.lit("chr"), F.col("contig").cast("string")), F.col("start").cast("string"), F.col("end").cast("string")
    r.where("key % 3 = 0").select(F.concat(contig, F.lit(":"), start, F.lit("-"), end).alias("value")).write.text(f"{folder}/text")
    r.where("key % 3 = 1").select(F.concat_ws("\t", contig, (F.col("start") - 1).cast("string"), end).alias("value")).coalesce(1).write.text(f"{folder}/b.bed")
    r.where("key % 3 = 2").select(F.concat_ws("\t", contig, start, end, F.lit("+"), F.lit("x")).alias("value")).union(spark.createDataFrame([("@HD\tVN:1.6",)], "value string")).write.text(f"{folder}/list")
    read = lambda name, form: reference.intervals(spark, f"{folder}/{name}").withColumn("form", F.lit(form))
    every = read("text", "text").union(read("b.bed", "bed")).union(read("list", "list"))
    return every.groupBy("form", "contig").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query("q58_tsv_round_trip", "SELECT s_suppkey AS key, s_name AS name, floor(s_acctbal * 100 + 0.5) / 100 AS balance FROM supplier")
def tsv_round_trip(spark, d):
    path = f"{scratch.folder(spark)}/tsv"
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), (F.floor(F.col("s_acctbal") * 100 + 0.5) / 100).alias("balance"))
    out_tables.write_tsv(s, path)
    return reference.tsv(spark, path, "key long, name string, balance double")


@query("q58_pedigree", "SELECT 'f' || c_nationkey AS family, CAST(c_custkey AS VARCHAR) AS sample, CASE WHEN c_custkey % 3 > 0 THEN CAST(2 * c_custkey AS VARCHAR) END AS father, CASE WHEN c_custkey % 5 > 0 THEN CAST(2 * c_custkey + 1 AS VARCHAR) END AS mother, CASE WHEN c_custkey % 4 IN (1, 2) THEN CAST(c_custkey % 4 AS INT) END AS sex, CASE c_custkey % 3 WHEN 2 THEN true WHEN 1 THEN false END AS affected FROM customer")
def pedigree(spark, d):
    path = f"{scratch.folder(spark)}/ped"
    k = F.col("c_custkey")
    parent = lambda test, x: F.when(test, x.cast("string")).otherwise("0")
    row = F.concat_ws("\t", F.concat(F.lit("f"), F.col("c_nationkey").cast("string")), k.cast("string"), parent(k % 3 > 0, 2 * k), parent(k % 5 > 0, 2 * k + 1), (k % 4).cast("string"), (k % 3).cast("string"))
    table(spark, d, "customer").select(row.alias("value")).write.text(path)
    return reference.pedigree(spark, path)


@query(
    "q58_block_lines",
    f"""WITH {REC}, b AS (SELECT sample, contig, start, stop, dp, line, CASE WHEN dp >= 40 THEN 3 WHEN dp >= 20 THEN 2 WHEN dp >= 10 THEN 1 ELSE 0 END AS band, row_number() OVER (PARTITION BY contig, sample ORDER BY start, stop, orderkey, line, dp) AS k FROM rec),
  m AS (SELECT *, CASE WHEN lag(band) OVER w = band AND lag(stop) OVER w + 1 >= start THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY contig, sample ORDER BY k)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY contig, sample ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM m),
  g AS (SELECT contig, sample, run, min(start) AS s, max(stop) AS e, list_sort(list(dp))[len(list(dp)) // 2 + 1] AS d, min(dp) AS least, min(dp) AS p0, min(dp + 1) AS p1, min(dp + line) AS p2 FROM r GROUP BY ALL)
SELECT sample, contig || chr(9) || s || chr(9) || '.' || chr(9) || 'N' || chr(9) || '<NON_REF>' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'END=' || e || chr(9) || 'GT:DP:GQ:MIN_DP:PL' || chr(9) || '0/0:' || d || ':' || list_sort([p0, p1, p2])[2] - list_sort([p0, p1, p2])[1] || ':' || least || ':' || p0 || ',' || p1 || ',' || p2 AS line FROM g""",
)
def block_lines(spark, d):
    rec = records(spark, d).withColumn("pl", F.array("dp", F.col("dp") + 1, F.col("dp") + F.col("line")))
    blocks = iv.reference_blocks(rec, ["orderkey", "line", "dp"], "dp", [0, 10, 20, 40], "dp", "pl", 3)
    return blocks.select("sample", out_tables.block_line(F.col("contig"), F.col("start"), F.col("end"), F.lit("N"), F.col("gq"), F.col("dp"), F.col("min_dp"), F.col("pl")).alias("line"))
