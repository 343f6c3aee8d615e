"""Queries that write what Spark derives from the tables to the shared folder, and read it back as files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.operators import decode
from strandloom.plans import sequence_queries as sq
from strandloom.plans import track_queries as tq
from strandloom.plans import views
from strandloom.plans.catalog import query
from strandloom.plans.session import shared_dir, table
from strandloom.sources import files, sequences
from strandloom.streaming import ingest, ordered


def _fresh(spark, label):
    return f"{shared_dir(spark)}/strandloom-{label}-{uuid.uuid4().hex}"


@query("src_fasta", f"{sq.G} SELECT chrom_id, length(seq)::BIGINT AS chrom_length, md5(seq) AS digest FROM genome WHERE seq <> ''")
def fasta(spark, sf_dir):
    """Records written as FASTA in lines of 60 and lower case, compressed, and read again."""
    path = _fresh(spark, "fasta")
    records = views.genome(spark, sf_dir).filter("seq <> ''")
    records.select(F.concat(F.lit(">"), "chrom_id", F.lit(" a record\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))).write.option("compression", "gzip").text(path)
    return files.fasta(spark, path).select("chrom_id", "chrom_length", F.md5("seq").alias("digest"))


@query("src_fasta_blocks", f"{sq.G}, b AS (SELECT chrom_id, length(seq)::BIGINT AS length, seq, unnest(range(0, greatest(length(seq) + 999, 1000) // 1000)) AS block FROM genome) SELECT chrom_id, block, length, md5(substr(seq, (block * 1000 + 1)::BIGINT, 1000)) AS digest FROM b")
def fasta_blocks(spark, sf_dir):
    """All records, empty ones too, written as FASTA in lines of 60 and read again in byte ranges, as blocks of 1000 bases."""
    path = _fresh(spark, "fasta-blocks")
    views.genome(spark, sf_dir).select(F.concat(F.lit(">"), "chrom_id", F.lit(" a record\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))).write.text(f"{path}/records.fa")
    return sequences.blocks(spark, f"{path}/records.fa", 1000).select("chrom_id", "block", "length", F.md5("piece").alias("digest"))


@query("src_windows_tsv", f"{sq._TILES}, g AS (SELECT *, row_number() OVER (ORDER BY chrom_index, chrom_window_index) - 1 AS i FROM win) SELECT i AS global_window_index, chrom_id, chrom_length, center_start, i // 500 + 1 AS chunk_id, md5(sequence) AS digest FROM g")
def windows_tsv(spark, sf_dir):
    from strandloom.operators import tiling

    path = _fresh(spark, "windows")
    order = [c.split()[0] for c in files.WINDOW_DDL.split(", ")]
    tiling.global_index(sq.windows(spark, sf_dir), 500).select(*order).write.option("sep", "\t").csv(path)
    return files.windows_tsv(spark, path).select("global_window_index", "chrom_id", "chrom_length", "center_start", "chunk_id", F.md5("sequence").alias("digest"))


def _gff_lines(spark, sf_dir):
    """Genes of orders, transcripts by return flag and line items as coding blocks; every 97th gene line is broken, every 89th block has no transcript line."""
    t = "\t"
    g = views.genes(spark, sf_dir).withColumn("start", F.when(F.col("gid") % 97 == 0, F.lit("x")).otherwise((F.col("gs") + 1).cast("string")))
    gene = g.select(F.concat_ws(t, "seqid", F.lit("s"), F.lit("Gene"), "start", (F.col("gs") + 9000).cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=g"), "gid", F.lit(";Note=a%20b"))).alias("value"))
    b = views.blocks(spark, sf_dir)
    own = lambda kind, first, last, phase, text: F.concat_ws(t, "seqid", F.lit("s"), F.lit(kind), first, last, F.lit("."), "strand", phase, text)
    tx = F.when((F.col("rn") == 1) & (F.col("gid") % 89 != 0), own("mRNA", F.lit("1"), F.lit("2"), F.lit("."), F.concat(F.lit("ID=t"), "tid", F.lit(";Parent=g"), "gid")))
    cds = F.when(F.col("e") > F.col("s"), own("CDS", (F.col("s") + 1).cast("string"), F.col("e").cast("string"), (F.col("rn") % 4).cast("string"), F.concat(F.lit("Parent=t"), "tid")))
    return gene.unionByName(_each(b, tx, cds))


def _each(rows, *lines):
    """(value): those of `lines` that a row has, made in one pass."""
    return rows.select(F.explode(F.array(*lines)).alias("value")).filter("value IS NOT NULL")


_GFF = f"""WITH {views.GENES}, okgene AS (SELECT gid FROM gene WHERE gid % 97 <> 0), cds AS (SELECT * FROM block WHERE e > s),
tx AS (SELECT DISTINCT gid, tid FROM block)"""


@query("src_gff_features", f"{_GFF} SELECT 'gene' AS type, count(*) AS n, sum(gs)::BIGINT AS starts, 0 AS phased FROM gene WHERE gid % 97 <> 0 UNION ALL SELECT 'mrna', count(*), 0, 0 FROM tx WHERE gid % 89 <> 0 UNION ALL SELECT 'cds', count(*), sum(s)::BIGINT, count(*) FILTER (rn % 4 < 3) FROM cds")
def gff_features(spark, sf_dir):
    path = _fresh(spark, "gff")
    _gff_lines(spark, sf_dir).write.option("compression", "gzip").text(path)
    found = files.gff(spark, path)
    return found.groupBy("type").agg(F.count("*").alias("n"), F.sum("s").alias("starts"), F.count("phase").alias("phased"))


@query("src_gff_hierarchy", f"""{_GFF}, own AS (SELECT DISTINCT tid, gid FROM tx WHERE gid % 89 <> 0), made AS (SELECT DISTINCT 't' || tid AS tid, 'gene_for_t' || tid AS gid FROM cds WHERE gid % 89 = 0),
alltx AS (SELECT 't' || tid AS tid, 'g' || gid AS gid FROM own UNION ALL SELECT * FROM made), reach AS (SELECT 't' || tid AS tid, min(s) AS cs, max(e) AS ce, count(*) AS n FROM cds GROUP BY tid)
SELECT a.tid, a.gid, CASE WHEN gid LIKE 'gene_for_%' THEN cs ELSE least(0, coalesce(cs, 0)) END AS s, CASE WHEN gid LIKE 'gene_for_%' THEN ce ELSE greatest(2, coalesce(ce, 2)) END AS e, coalesce(n, 0)::BIGINT AS n FROM alltx a LEFT JOIN reach r ON a.tid = r.tid""")
def gff_hierarchy(spark, sf_dir):
    lines = _gff_lines(spark, sf_dir).withColumn("line_no", F.monotonically_increasing_id())
    parts = files.hierarchy(files.identified(files.features(lines)))
    return parts["transcripts"].select("tid", "gid", "s", "e", F.col("children").alias("n"))


def _gtf_lines(spark, sf_dir):
    """GTF lines: genes and pseudogenes but every fifth, transcripts that name their gene, coding blocks and start codons, and for every 13th gene an exon with the gene as its parent."""
    t, dot = "\t", F.lit(".")
    line = lambda kind, s, e, text: F.concat_ws(t, "seqid", F.lit("s"), kind, (s + 1).cast("string"), e.cast("string"), dot, "strand", dot, text)
    gid, gs, rn, s, e = map(F.col, ("gid", "gs", "rn", "s", "e"))
    named = F.concat(F.lit('gene_id "g'), gid, F.lit('"'))
    gene = F.when(gid % 5 != 0, line(F.when(gid % 7 == 0, "pseudogene").otherwise("gene"), gs, gs + 300, named))
    exon = F.when(gid % 13 == 0, line(F.lit("exon"), gs + 5, gs + 5000, F.concat(F.lit("Parent=g"), gid)))
    begin = s - 500 * rn  # of the gene
    tx = F.when(rn == 1, line(F.lit("transcript"), begin, begin + 200, F.concat(named, F.lit('; transcript_id "t'), "tid", F.lit('"'))))
    own = F.concat(F.lit('transcript_id "t'), F.col("tid"), F.lit('"'))
    cds = F.when(e > s, line(F.lit("CDS"), s, e, own))
    start = F.when(rn == 1, line(F.lit("start_codon"), s, s + 3, own))
    return _each(views.genes(spark, sf_dir), gene, exon).unionByName(_each(views.blocks(spark, sf_dir), tx, cds, start))


@query("src_gtf_hierarchy", f"""WITH {views.GENES}, tx AS (SELECT DISTINCT b.gid, tid, gs FROM block b JOIN gene g ON b.gid = g.gid),
child AS (SELECT tid, s, e FROM block WHERE e > s UNION ALL SELECT tid, s, s + 3 FROM block WHERE rn = 1), reach AS (SELECT tid, min(s) AS cs, max(e) AS ce, count(*) AS n FROM child GROUP BY tid)
SELECT 'transcript' AS kind, 't' || tx.tid AS id, 'g' || gid AS gid, least(gs, coalesce(cs, gs)) AS s, greatest(gs + 200, coalesce(ce, 0)) AS e, coalesce(n, 0)::BIGINT AS n FROM tx LEFT JOIN reach ON tx.tid = reach.tid
UNION ALL SELECT 'transcript', 'g' || gid || CASE WHEN gid % 5 <> 0 THEN '.implicit_transcript' ELSE '' END, CASE WHEN gid % 5 <> 0 THEN 'g' ELSE 'gene_for_g' END || gid, CASE WHEN gid % 5 <> 0 THEN gs ELSE gs + 5 END, gs + 5000, 1 FROM gene WHERE gid % 13 = 0
UNION ALL SELECT 'gene', 'g' || gid, NULL, gs, gs + CASE WHEN gid % 5 <> 0 THEN 300 ELSE 200 END, 0 FROM gene WHERE gid % 5 <> 0 OR gid IN (SELECT gid FROM tx)
UNION ALL SELECT 'gene', 'gene_for_g' || gid, NULL, gs + 5, gs + 5000, 0 FROM gene WHERE gid % 13 = 0 AND gid % 5 = 0""")  # fmt: skip
def gtf_hierarchy(spark, sf_dir):
    lines = _gtf_lines(spark, sf_dir).withColumn("line_no", F.monotonically_increasing_id())
    parts = files.hierarchy(files.identified(files.features(lines)))
    tx = parts["transcripts"].select(F.lit("transcript").alias("kind"), F.col("tid").alias("id"), "gid", "s", "e", F.col("children").alias("n"))
    return tx.unionByName(parts["genes"].select(F.lit("gene").alias("kind"), F.col("gid").alias("id"), F.lit(None).cast("string").alias("gid"), "s", "e", F.lit(0).cast("long").alias("n")))


@query("src_manifest_check", "SELECT 'd' || doc_id AS chrom_id, 'positions don''t cover the record' AS problem FROM documents WHERE doc_id % 50 = 49 AND length(text) > 0")
def manifest_check(spark, sf_dir):
    """A manifest that claims one position too many for some records."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    manifest = docs.filter("length(text) > 0").select(F.concat(F.lit("d"), "doc_id").alias("chrom_id"), (n + F.when(F.col("doc_id") % 50 == 49, 1).otherwise(0)).alias("chrom_length"), F.col("doc_id").alias("chrom_index"), F.lit(1).cast("long").alias("num_windows"))
    track = docs.select(F.concat(F.lit("d"), "doc_id").alias("chrom_id"), n.alias("n")).filter("n > 0").select("chrom_id", F.explode(F.expr("sequence(0L, n - 1)")).alias("pos"))
    return files.manifest_violations(manifest, track)


@query("stm_window_coverage", f"{sq._TILES}, b AS (SELECT *, coalesce(lag(center_end) OVER (PARTITION BY chrom_id ORDER BY chrom_window_index), 0) AS seen FROM win) SELECT chrom_id, chrom_window_index, greatest(center_start, seen) AS write_start, least(center_end, chrom_length) AS write_end, NULL::VARCHAR AS problem FROM b")
def stream_coverage(spark, sf_dir):
    """Window files read as a stream, with the coverage of each record as state."""
    source, sink, marks = _fresh(spark, "stream-in"), _fresh(spark, "stream-out"), _fresh(spark, "stream-marks")
    cols = ["chrom_id", "chrom_length", "chrom_window_index", "center_start", "center_end"]
    sq.windows(spark, sf_dir).select(*cols).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = ingest.covered(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


@query("stm_ordered_windows", f"{sq._TILES}, b AS (SELECT *, coalesce(lag(center_end) OVER (PARTITION BY chrom_id ORDER BY chrom_window_index), 0) AS seen FROM win) SELECT chrom_id, chrom_window_index, greatest(center_start, seen) AS write_start, least(center_end, chrom_length) AS write_end, NULL::VARCHAR AS problem FROM b")
def ordered_windows(spark, sf_dir):
    """Window files in which every record's windows are mixed up, taken in two a trigger; windows wait until they are next."""
    source, target, marks = _fresh(spark, "ordered-in"), _fresh(spark, "ordered-out"), _fresh(spark, "ordered-marks")
    found = sq.windows(spark, sf_dir).select("chrom_id", "chrom_length", "chrom_window_index", "center_start", "center_end")
    found.repartition(4, F.xxhash64("chrom_id", "chrom_window_index")).sortWithinPartitions(F.xxhash64("chrom_window_index", "chrom_id")).write.parquet(source)
    listed = spark.read.parquet(source).groupBy("chrom_id").agg(F.count("*").alias("num_windows"))
    ordered.ingest(spark, source, target, marks, listed, 2)
    return ordered.read(spark, target)


@query("dec_gene_paths")
def gene_paths(spark, sf_dir):
    """Best gene paths over the track, in regions of 250 positions on both strands; bases by the largest of four further values."""
    letters = "element_at(array('A', 'C', 'G', 'T'), cast(array_position(slice(embedding, 31, 4), array_max(slice(embedding, 31, 4))) as int))"
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.expr(letters).alias("base"))
    strand = F.when(F.col("strand") == 0, "+").otherwise("-")
    positions = tq.track(spark, sf_dir).join(base, "pos").select(F.lit("e").alias("chrom_id"), strand.alias("strand"), "pos", "base", "p")
    ends = base.agg((F.max("pos") + 1).alias("n")).select("n", F.explode(F.expr("sequence(0L, n - 1, 250L)")).alias("start"))
    regions = ends.select(F.lit("e").alias("chrom_id"), F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"), F.expr("start div 250").alias("region"), "start", F.expr("least(start + 250, n)").alias("stop"))
    found = decode.decode_regions(decode.region_views(positions, regions), min_cds=9, min_intron=4, least_mean=-100.0, intercept=200.0)
    return found.select("chrom_id", "strand", "region", "gene", F.round("score", 6).alias("score"), F.size("exons").alias("n_exons"), F.expr("aggregate(exons, 0L, (a, x) -> a + x.e - x.s)").alias("cds"))


