"""Queries over records: scalar functions, reading frames, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import orfs, tiling
from strandloom.plans import views
from strandloom.plans.catalog import query
from strandloom.plans.session import table

G = f"WITH {views.GENOME}"
RC = f"reverse(translate(seq, '{bases.IUPAC[0]}', '{bases.IUPAC[1]}'))"
PLAIN_RC = f"reverse(translate(seq, '{bases.PLAIN[0]}', '{bases.PLAIN[1]}'))"

_ORFS = f"""{G},
both_strands AS (SELECT chrom_id, chrom_index, '+' AS strand, seq, length(seq) AS n FROM genome UNION ALL SELECT chrom_id, chrom_index, '-', {RC}, length(seq) FROM genome),
codon AS (SELECT chrom_id, chrom_index, strand, n, p, p % 3 AS frame, substr(seq, p::INT + 1, 3) AS c FROM (SELECT *, unnest(range(0, n - 2)) AS p FROM both_strands)),
marked AS (SELECT *, c IN ('TAA', 'TAG', 'TGA') AS stop, sum(CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END) OVER (PARTITION BY chrom_id, strand, frame ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM codon),
spans AS (SELECT chrom_id, chrom_index, strand, any_value(n) AS n, min(p) FILTER (c = 'ATG') AS a, max(p) FILTER (stop) + 3 AS b FROM marked GROUP BY chrom_id, chrom_index, strand, frame, coalesce(seen, 0)),
orf AS (SELECT chrom_id, chrom_index, strand, CASE WHEN strand = '+' THEN a ELSE n - b END::BIGINT AS s, CASE WHEN strand = '+' THEN b ELSE n - a END::BIGINT AS e FROM spans WHERE a IS NOT NULL AND b IS NOT NULL AND b - a >= 60),
ranked AS (SELECT *, row_number() OVER (ORDER BY chrom_index, strand, CASE WHEN strand = '+' THEN s ELSE -e END, e, s) AS number FROM orf)"""


@query("slice_orfs", f"{_ORFS} SELECT chrom_id, strand, s, e, (e - s) // 3 AS codons FROM orf")
def slice_orfs(spark, sf_dir):
    return orfs.open_reading_frames(views.genome(spark, sf_dir)).select("chrom_id", "strand", "s", "e", F.expr("(e - s) div 3").alias("codons"))


@query("slice_orf_gff3", f"""{_ORFS}, t AS (SELECT *, 'geneid-' || number AS g, chrom_id || chr(9) || 'strandloom' || chr(9) AS h, chr(9) || (s + 1) || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) AS m FROM ranked)
SELECT number::BIGINT AS number, 0 AS line_rank, h || 'gene' || m || '.' || chr(9) || 'ID=' || g || ';Name=' || g || ';biotype=protein_coding' AS line FROM t
UNION ALL SELECT number, 1, h || 'mRNA' || m || '.' || chr(9) || 'ID=' || g || '.t;Parent=' || g FROM t
UNION ALL SELECT number, 2, h || 'exon' || m || '.' || chr(9) || 'ID=' || g || '.e1;Parent=' || g || '.t' FROM t
UNION ALL SELECT number, 3, h || 'CDS' || m || '0' || chr(9) || 'ID=' || g || '.c1;Parent=' || g || '.t' FROM t""")
def slice_orf_gff3(spark, sf_dir):
    found = orfs.ranked(orfs.open_reading_frames(views.genome(spark, sf_dir)))
    return orfs.gff3_lines(found.withColumn("exons", F.array(F.struct("s", "e")))).select("number", "line_rank", "line")


@query("scl_reverse_complement", f"{G} SELECT chrom_id, md5({RC}) AS iupac, md5({PLAIN_RC}) AS plain FROM genome")
def reverse_complement(spark, sf_dir):
    return views.genome(spark, sf_dir).select("chrom_id", F.md5(F.expr(bases.reverse_complement("seq"))).alias("iupac"), F.md5(F.expr(bases.reverse_complement("seq", bases.PLAIN))).alias("plain"))


@query("scl_non_acgt", f"{G} SELECT chrom_id, length(seq) AS n, length(regexp_replace(seq, '[ACGT]', '', 'g')) AS ambiguous FROM genome")
def non_acgt(spark, sf_dir):
    return views.genome(spark, sf_dir).select("chrom_id", F.length("seq").cast("long").alias("n"), F.expr(bases.non_acgt("seq")).cast("long").alias("ambiguous"))


@query("scl_base_codes", f"""{G}, b AS (SELECT chrom_id, unnest(string_split(seq, '')) AS c FROM genome WHERE seq <> '')
SELECT chrom_id, CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS code, count(*) AS n FROM b GROUP BY ALL""")
def base_codes(spark, sf_dir):
    letters = views.genome(spark, sf_dir).select("chrom_id", F.explode(F.split("seq", "")).alias("b")).filter("b <> ''")
    return letters.groupBy("chrom_id", F.expr(bases.base_code("b")).alias("code")).agg(F.count("*").alias("n"))


@query("scl_codons", f"""{G}, c AS (SELECT chrom_id, regexp_extract_all(seq, '...') AS cs FROM genome)
SELECT chrom_id, len(cs) AS codons, len(list_filter(cs, lambda x: x IN ('TAA', 'TAG', 'TGA'))) AS stops, coalesce(cs[1] = 'ATG', false) AS starts,
    len(list_filter(cs[1:len(cs) - 1], lambda x: x IN ('TAA', 'TAG', 'TGA'))) > 0 AS internal_stop FROM c""")
def codons(spark, sf_dir):
    found = views.genome(spark, sf_dir).select("chrom_id", F.expr(bases.codons("seq")).alias("cs"))
    inner = f"size(filter(slice(cs, 1, greatest(size(cs) - 1, 0)), x -> {bases.is_stop('x')})) > 0"
    return found.select("chrom_id", F.size("cs").cast("long").alias("codons"), F.expr(f"cast(size(filter(cs, x -> {bases.is_stop('x')})) as long)").alias("stops"), F.expr("coalesce(try_element_at(cs, 1) = 'ATG', false)").alias("starts"), F.expr(inner).alias("internal_stop"))


@query("scl_splice_motifs", f"""{G}, c AS (SELECT chrom_id, substr(seq, 1, 2) AS d, substr(seq, greatest(length(seq) - 1, 1)) AS a FROM genome WHERE length(seq) >= 2)
SELECT chrom_id, d, a, (d, a) IN (('GT', 'AG'), ('GC', 'AG'), ('AT', 'AC')) AS supported FROM c""")
def splice_motifs(spark, sf_dir):
    ends = views.genome(spark, sf_dir).filter(F.length("seq") >= 2).select("chrom_id", F.substring("seq", 1, 2).alias("d"), F.substring("seq", -2, 2).alias("a"))
    return ends.withColumn("supported", F.expr(bases.supported_splice("d", "a")))


_PART = "'ID=p%20' || p_partkey || ';Name=' || replace(p_name, ' ', '%20') || ';biotype \"' || p_type || '\"; flag;Name=last' || p_size"


@query("scl_attributes", "SELECT p_partkey, 'p ' || p_partkey AS id, 'last' || p_size AS name, p_type AS biotype, true AS flag FROM part")
def attributes(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PART.replace("\\", "")).alias("text"))
    found = parts.withColumn("a", F.expr(bases.attributes("text")))
    return found.select("p_partkey", F.expr("a['ID']").alias("id"), F.expr("a['Name']").alias("name"), F.expr("a['biotype']").alias("biotype"), F.expr("map_contains_key(a, 'flag')").alias("flag"))


_CODE = "url_encode(v)"
for _code, _plain in bases.PLAIN_IN_ATTRIBUTES:
    _CODE = f"replace({_CODE}, '{_code}', '{_plain}')"


@query("scl_escape_attribute", f"SELECT p_partkey, replace({_CODE}, '%2A', '*') AS escaped, v AS back FROM (SELECT p_partkey, p_name || '; a=b&c,%3A%' || chr(9) || '(\"/\")é漢+:^*$@!?|~._-' AS v FROM part)")
def escape_attribute(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit('; a=b&c,%3A%\t("/")é漢+:^*$@!?|~._-')).alias("v")).withColumn("escaped", F.expr(bases.escape_attribute("v")))
    return parts.select("p_partkey", "escaped", F.expr(bases.decoded("escaped")).alias("back"))


@query("scl_readable_bytes", "SELECT doc_id, CASE WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) ELSE printf('%.2f B', b::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * n_chars * 64 AS b FROM documents)")
def readable_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(bases.readable_bytes("(n_chars * n_chars * 64)")).alias("size"))


@query("scl_integer_arithmetic", "SELECT o_orderkey, (o_orderkey + 25) // 50 * 50 AS aligned, (o_orderkey + 49) // 50 AS bins, lcm(o_custkey, 50) // 50 * 50 AS scan_block, sha256(o_orderkey || ':' || o_custkey) AS digest FROM orders")
def integer_arithmetic(spark, sf_dir):
    gcd = "CASE WHEN o_custkey % 50 = 0 THEN 50 WHEN o_custkey % 25 = 0 THEN 25 WHEN o_custkey % 10 = 0 THEN 10 WHEN o_custkey % 5 = 0 THEN 5 WHEN o_custkey % 2 = 0 THEN 2 ELSE 1 END"
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr(bases.aligned("o_orderkey")).alias("aligned"), F.expr(bases.ceil_div("o_orderkey", "50")).alias("bins"),
        F.expr(f"o_custkey * 50 div ({gcd}) div 50 * 50").alias("scan_block"), F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")), 256).alias("digest"),
    )


#: A small geometry, so that the given records have many windows.
W, FL = 400, 50
C = W - 2 * FL
_PAD = "repeat('N', greatest({f} - cs, 0)::INT) || substr(seq, greatest(cs - {f}, 0)::INT + 1, (least(cs - {f} + {w}, n) - greatest(cs - {f}, 0))::INT) || repeat('N', greatest(cs - {f} + {w} - n, 0)::INT)"
_TILES = f"""{G}, r AS (SELECT *, length(seq)::BIGINT AS n FROM genome WHERE seq <> ''),
tiles AS (SELECT chrom_id, chrom_index, n, seq, unnest(list_concat(list_transform(range(0, greatest(n // {C}, 1)), lambda i: i * {C}), CASE WHEN n > {C} AND n % {C} <> 0 THEN [n - {C}] ELSE [] END)) AS cs FROM r),
win AS (SELECT chrom_id, chrom_index, n AS chrom_length, row_number() OVER (PARTITION BY chrom_id ORDER BY cs) - 1 AS chrom_window_index, cs AS center_start, cs + {C} AS center_end, {_PAD.format(f=FL, w=W)} AS sequence FROM tiles)"""


def windows(spark, sf_dir):
    return tiling.inference_windows(views.genome(spark, sf_dir), W, FL)


@query("til_inference_windows", f"{_TILES} SELECT chrom_id, chrom_index, chrom_length, chrom_window_index, center_start, center_end, md5(sequence) AS sequence, length(sequence) AS window_length FROM win")
def inference_windows(spark, sf_dir):
    return windows(spark, sf_dir).withColumn("window_length", F.length("sequence").cast("long")).withColumn("sequence", F.md5("sequence"))


@query("snk_chunk_index", f"""{_TILES}, g AS (SELECT *, row_number() OVER (ORDER BY chrom_index, chrom_window_index) - 1 AS i FROM win)
SELECT chrom_id, chrom_window_index, i AS global_window_index, i // 500 + 1 AS chunk_id, i % 500 AS chunk_local_index FROM g""")
def chunk_index(spark, sf_dir):
    return tiling.global_index(windows(spark, sf_dir), 500).select("chrom_id", "chrom_window_index", "global_window_index", "chunk_id", "chunk_local_index")


@query("snk_write_intervals", f"""{_TILES}, b AS (SELECT *, coalesce(lag(center_end) OVER (PARTITION BY chrom_id ORDER BY chrom_window_index), 0) AS seen FROM win)
SELECT chrom_id, chrom_window_index, greatest(center_start, seen) AS write_start, least(center_end, chrom_length) AS write_end, center_start <= seen AS follows FROM b""")
def write_intervals(spark, sf_dir):
    return tiling.write_intervals(windows(spark, sf_dir)).select("chrom_id", "chrom_window_index", "write_start", "write_end", "follows")


@query("snk_coverage", f"{G} SELECT chrom_id, length(seq)::BIGINT AS covered, true AS complete, CASE WHEN length(seq) <= {C} THEN 1 ELSE (length(seq) + {C - 1}) // {C} END AS n_windows FROM genome WHERE seq <> ''")
def coverage(spark, sf_dir):
    found = tiling.write_intervals(windows(spark, sf_dir)).groupBy("chrom_id").agg(F.sum(F.col("write_end") - F.col("write_start")).alias("covered"), F.max("chrom_length").alias("n"), F.bool_and("follows").alias("follows"), F.count("*").alias("n_windows"))
    return found.select("chrom_id", "covered", ((F.col("covered") == F.col("n")) & F.col("follows")).alias("complete"), "n_windows")


@query("scl_tokens", f"""{_TILES}, t AS (SELECT chrom_id, chrom_window_index, list_concat([0], list_transform(string_split(sequence, ''), lambda b: CASE b WHEN 'A' THEN 7 WHEN 'C' THEN 8 WHEN 'G' THEN 9 WHEN 'T' THEN 10 ELSE 11 END), [1]) AS ids FROM win)
SELECT chrom_id, chrom_window_index, len(ids) AS n, list_sum(ids)::BIGINT AS total, md5(array_to_string(ids, ' ')) AS digest FROM t""")
def tokens(spark, sf_dir):
    ids = "concat(array(0), transform(filter(split(sequence, ''), b -> b <> ''), b -> CASE b WHEN 'A' THEN 7 WHEN 'C' THEN 8 WHEN 'G' THEN 9 WHEN 'T' THEN 10 ELSE 11 END), array(1))"
    found = windows(spark, sf_dir).select("chrom_id", "chrom_window_index", F.expr(ids).alias("ids"))
    return found.select("chrom_id", "chrom_window_index", F.size("ids").cast("long").alias("n"), F.expr("aggregate(ids, 0L, (a, x) -> a + x)").alias("total"), F.md5(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("digest"))


TW, TF, TO, TA = 400, 40, 80, 30
TC = TW - 2 * TF
TS = min(TW - TO, TC)
_TRAIN = f"""{G}, r AS (SELECT *, length(seq)::BIGINT AS n FROM genome WHERE seq <> ''),
tiles AS (SELECT DISTINCT chrom_id, seq, n, unnest(CASE WHEN n <= {TC} THEN [-{TF}] ELSE list_concat(list_transform(range(0, (n - {TC}) // {TS} + 1), lambda i: i * {TS} - {TF}), [n - {TC} - {TF}]) END)::BIGINT AS ws FROM r),
train AS (SELECT *, ws + {TF} AS cs, length(regexp_replace(substr(seq, (ws + {TF} + 1)::INT, least({TC}, n - ws - {TF})::INT), '[ACGT]', '', 'g')) AS ambiguous FROM tiles)"""


@query("til_training_windows", f"""{_TRAIN} SELECT chrom_id, ws AS window_start, ws + {TW} AS window_end, chrom_id || ':' || ws || '-' || (ws + {TW}) AS window_id, md5({_PAD.format(f=TF, w=TW)}) AS sequence, ambiguous
FROM train WHERE ambiguous <= {TA}""")
def training_windows(spark, sf_dir):
    found = tiling.training_windows(views.genome(spark, sf_dir), TW, TF, TO, TA)
    return found.withColumn("sequence", F.md5("sequence")).withColumn("ambiguous", F.col("ambiguous").cast("long"))


@query("flt_record_length", f"{G} SELECT count(*) AS records, count(*) FILTER (length(seq) >= 500) AS kept, coalesce(sum(length(seq)) FILTER (length(seq) >= 500), 0)::BIGINT AS bases FROM genome")
def record_length(spark, sf_dir):
    n = F.length("seq")
    return views.genome(spark, sf_dir).agg(F.count("*").alias("records"), F.count_if(n >= 500).alias("kept"), F.coalesce(F.sum(F.when(n >= 500, n)), F.lit(0)).cast("long").alias("bases"))


_PLAN = """r AS (SELECT 'k' || o_orderkey AS chrom_id, (o_orderkey * 104729) % 40000000 + 1 AS length FROM orders),
t AS (SELECT *, least(greatest((length + 99) // 100, 512000), 2000000, length) AS target FROM r),
k AS (SELECT *, CASE WHEN target * 5 >= length * 4 THEN 1 ELSE least(greatest((length + 4999999) // 5000000, 16), 64) END AS n FROM t),
i AS (SELECT *, unnest(range(0, n)) AS i, greatest(target // n // 50 * 50, 50) AS width FROM k),
b AS (SELECT *, length * i // n AS lo, length * (i + 1) // n AS hi FROM i),
s AS (SELECT *, CASE WHEN n = 1 THEN 0 ELSE least(greatest(((lo + hi - width) // 2 + 25) // 50 * 50, (lo + 49) // 50 * 50), greatest((hi - width) // 50 * 50, (lo + 49) // 50 * 50)) END AS start FROM b)"""


@query("agg_sampling_plan", f"WITH {_PLAN} SELECT chrom_id, start::BIGINT AS start, CASE WHEN n = 1 THEN length ELSE least(start + width, length) END::BIGINT AS stop FROM s")
def sampling_plan(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey")).alias("chrom_id"), ((F.col("o_orderkey") * 104729) % 40000000 + 1).alias("length"))
    return tiling.sampling_plan(records)


@query("agg_disk_estimate", f"{G} SELECT sum(length(seq))::BIGINT * 60 AS payload, round(sum(length(seq)) * 60 * 1.2, 3)::DOUBLE AS needed FROM genome")
def disk_estimate(spark, sf_dir):
    n = F.sum(F.length("seq"))
    return views.genome(spark, sf_dir).agg((n * 60).cast("long").alias("payload"), F.round(n * 60 * F.lit(1.2), 3).cast("double").alias("needed"))


@query("src_sequence_fetch", f"{G} SELECT chrom_id, substr(seq, 101, 150) AS part FROM genome WHERE length(seq) >= 101")
def sequence_fetch(spark, sf_dir):
    """A range of every record out of a table of blocks: the blocks that the range meets, joined, cut."""
    block, lo, hi = 64, 100, 250
    blocks = views.genome(spark, sf_dir).select("chrom_id", F.posexplode(F.expr(f"regexp_extract_all(seq, '.{{1,{block}}}', 0)")).alias("block_id", "part"))
    met = blocks.filter((F.col("block_id") >= lo // block) & (F.col("block_id") <= (hi - 1) // block))
    joined = met.groupBy("chrom_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "part"))), lambda x: x["part"]), "").alias("s"))
    return joined.select("chrom_id", F.expr(f"substr(s, {lo % block + 1}, {hi - lo})").alias("part")).filter("part <> ''")


@query("prj_center", "SELECT o_orderkey AS start, o_orderkey + 5120 AS center_start, o_orderkey + 40960 - 5120 AS center_end FROM orders")
def center(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("start"), (k + 5120).alias("center_start"), (k + 40960 - 5120).alias("center_end"))
