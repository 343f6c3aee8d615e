"""Queries over genes, transcripts and their blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import genes as gn
from strandloom.operators import intervals as iv
from strandloom.operators import orfs
from strandloom.plans import views
from strandloom.plans.catalog import query
from strandloom.plans.session import table

B = f"WITH {views.GENES}"
_TX = f"{B}, tx AS (SELECT gid, tid, seqid, strand, min(s) AS s, max(e) AS e, sum(e - s)::BIGINT AS cds, count(*) AS n, max(flagged) AS flagged FROM block GROUP BY ALL)"
_KEEP = "SELECT gid, tid, cds, n, s, e FROM r WHERE r = 1"


@query("jon_gene_hierarchy", f"{_TX} SELECT g.gid, g.seqid, g.strand, count(tid) AS transcripts, coalesce(sum(n), 0)::BIGINT AS blocks, min(s) AS s, max(e) AS e FROM gene g LEFT JOIN tx t ON g.gid = t.gid GROUP BY ALL")
def gene_hierarchy(spark, sf_dir):
    tx = gn.transcripts(views.blocks(spark, sf_dir)).select("gid", "tid", "n", "s", "e")
    return views.genes(spark, sf_dir).join(tx, "gid", "left").groupBy("gid", "seqid", "strand").agg(F.count("tid").alias("transcripts"), F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.min("s").alias("s"), F.max("e").alias("e"))


@query("win_longest_cds", f"{_TX}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY cds DESC, n DESC, s, tid DESC) AS r FROM tx) {_KEEP}")
def longest_cds(spark, sf_dir):
    return gn.representative(gn.transcripts(views.blocks(spark, sf_dir))).select("gid", "tid", "cds", "n", "s", "e")


@query("win_first_transcript", f"{_TX}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY s, e, tid) AS r FROM tx) {_KEEP}")
def first_transcript(spark, sf_dir):
    return gn.representative(gn.transcripts(views.blocks(spark, sf_dir)), "first").select("gid", "tid", "cds", "n", "s", "e")


@query("win_marked_longest", f"""{_TX}, r AS (SELECT *, sum(flagged) OVER (PARTITION BY gid) AS marked, row_number() OVER (PARTITION BY gid ORDER BY flagged DESC, cds DESC, n DESC, s, tid DESC) AS r FROM tx)
SELECT gid, tid, CASE marked WHEN 0 THEN 'none_marked' WHEN 1 THEN 'one_marked' ELSE 'several_marked' END AS note FROM r WHERE r = 1""")
def marked_longest(spark, sf_dir):
    found = gn.representative(gn.transcripts(views.blocks(spark, sf_dir)), "phytozome_longest")
    return found.select("gid", "tid", F.when(F.col("marked") == 0, "none_marked").when(F.col("marked") == 1, "one_marked").otherwise("several_marked").alias("note"))


@query("win_fail_several", f"{_TX}, r AS (SELECT *, count(*) OVER (PARTITION BY gid) AS k, row_number() OVER (PARTITION BY gid ORDER BY s, e, tid) AS r FROM tx) SELECT gid, tid, k > 1 AS several, CASE WHEN k > 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS mask FROM r WHERE r = 1")
def fail_several(spark, sf_dir):
    found = gn.representative(gn.transcripts(views.blocks(spark, sf_dir)), "fail")
    return found.select("gid", "tid", "several", F.when(F.col("several"), 0.0).otherwise(1.0).alias("mask"))


_PHASED = f"""{B}, ph AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY tid ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM block)"""


@query("win_expected_phase", f"{_PHASED} SELECT tid, s, e, (3 - before % 3) % 3 AS phase FROM ph")
def expected_phase(spark, sf_dir):
    return gn.phased(views.blocks(spark, sf_dir)).select("tid", "s", "e", "phase")


@query("win_block_overlap", f"""{B}, o AS (SELECT *, lag(e) OVER w AS before, row_number() OVER w AS r, count(*) OVER (PARTITION BY tid) AS n FROM block WINDOW w AS (PARTITION BY tid ORDER BY s, e))
SELECT tid, coalesce(bool_or(s < before), false) AS overlaps, bool_or(r > 1 AND r < n AND e - s <= 2) AS short_middle FROM o GROUP BY tid""")
def block_overlap(spark, sf_dir):
    return gn.block_checks(views.blocks(spark, sf_dir))


_INTRON = "intron AS (SELECT gid, tid, seqid, strand, e AS s, nxt AS e, nxt - e AS length, nxt <= e AS touches FROM (SELECT *, lead(s) OVER (PARTITION BY tid ORDER BY s, e) AS nxt FROM block) WHERE nxt IS NOT NULL)"


@query("win_introns", f"{B}, {_INTRON} SELECT tid, s, e, length, touches FROM intron")
def introns(spark, sf_dir):
    return gn.introns(views.blocks(spark, sf_dir)).select("tid", "s", "e", "length", "touches")


_QC = f"""{_TX}, {_INTRON}, o AS (SELECT *, lag(e) OVER w AS before, row_number() OVER w AS r, count(*) OVER (PARTITION BY tid) AS n FROM block WINDOW w AS (PARTITION BY tid ORDER BY s, e)),
chk AS (SELECT tid, coalesce(bool_or(s < before), false) AS ovl, bool_or(r > 1 AND r < n AND e - s <= 2) AS short_middle, min(e - s) AS least FROM o GROUP BY tid),
gap AS (SELECT tid, bool_or(length BETWEEN 1 AND 3) AS short, bool_or(length BETWEEN 4 AND 19) AS soft, bool_or(touches) AS touches FROM intron GROUP BY tid),
qc AS (SELECT gid, t.tid, concat_ws(',', CASE WHEN flagged = 1 THEN 'partial_cds_or_gene' END, CASE WHEN least <= 0 THEN 'invalid_CDS_coordinates' END, CASE WHEN ovl THEN 'CDS_blocks_overlap' END, CASE WHEN short_middle THEN 'middle_CDS_length_le_2' END,
    CASE WHEN cds < 60 THEN 'CDS_length_less_than_min' END, CASE WHEN cds % 3 <> 0 THEN 'CDS_length_not_multiple_of_3' END, CASE WHEN touches THEN 'exon_or_CDS_blocks_overlap_or_touch' END, CASE WHEN short THEN 'intron_length_lt_4' END) AS zero_reasons,
    CASE WHEN soft THEN 'intron_length_lt_20' ELSE '' END AS half_reasons FROM tx t JOIN chk USING (tid) LEFT JOIN gap USING (tid)),
masked AS (SELECT *, CASE WHEN zero_reasons <> '' THEN 0.0 WHEN half_reasons <> '' THEN 0.5 ELSE 1.0 END::DOUBLE AS mask FROM qc)"""


def qc(spark, sf_dir):
    found = gn.quality(views.blocks(spark, sf_dir))
    return found.withColumn("zero_reasons", F.array_join("zero_reasons", ",")).withColumn("half_reasons", F.array_join("half_reasons", ","))


@query("qc_transcripts", f"{_QC} SELECT gid, tid, zero_reasons, half_reasons, 'intron_source=cds' AS notes, mask FROM masked")
def qc_transcripts(spark, sf_dir):
    return qc(spark, sf_dir).withColumn("notes", F.array_join("notes", ","))


@query("snk_qc_bed", f"{_QC} SELECT concat_ws(chr(9), seqid, t.s, t.e, t.gid, CASE WHEN mask = 0 THEN 0 ELSE 500 END, strand) AS line FROM masked m JOIN tx t ON m.tid = t.tid WHERE mask < 1")
def qc_bed(spark, sf_dir):
    spans = gn.transcripts(views.blocks(spark, sf_dir)).select("tid", "seqid", "s", "e", "strand")
    found = qc(spark, sf_dir).filter("mask < 1").join(spans, "tid")
    return found.select(F.concat_ws("\t", "seqid", F.col("s").cast("string"), F.col("e").cast("string"), F.col("gid").cast("string"), F.when(F.col("mask") == 0, "0").otherwise("500"), "strand").alias("line"))


@query("snk_qc_summary", f"{_QC} SELECT mask, count(*) AS transcripts, count(DISTINCT gid) AS genes FROM masked GROUP BY mask")
def qc_summary(spark, sf_dir):
    return qc(spark, sf_dir).groupBy("mask").agg(F.count("*").alias("transcripts"), F.countDistinct("gid").alias("genes"))


_CLEAN = "length(regexp_replace({c}, '[ACGT]', '', 'g')) > 0"
_SQ = f"""WITH {views.GENOME}, r AS (SELECT chrom_id AS id, seq AS cds, length(seq) AS n, substr(seq, 1, 3) AS f, right(seq, 3) AS l, regexp_extract_all(seq, '...') AS cs FROM genome)
SELECT id, concat_ws(',', CASE WHEN n < 60 THEN 'CDS_length_less_than_min' END, CASE WHEN n % 3 <> 0 THEN 'CDS_length_not_multiple_of_3' END, CASE WHEN {_CLEAN.format(c='cds')} THEN 'CDS_contains_ambiguous_base' END,
    CASE WHEN n < 3 THEN 'missing_start_codon' END, CASE WHEN n < 3 THEN 'missing_stop_codon' END,
    CASE WHEN n >= 3 AND {_CLEAN.format(c='f')} THEN 'start_codon_contains_ambiguous_base' END, CASE WHEN n >= 3 AND NOT {_CLEAN.format(c='f')} AND f <> 'ATG' THEN 'noncanonical_start_codon' END,
    CASE WHEN n >= 3 AND {_CLEAN.format(c='l')} THEN 'stop_codon_contains_ambiguous_base' END, CASE WHEN n >= 3 AND NOT {_CLEAN.format(c='l')} AND l NOT IN ('TAA', 'TAG', 'TGA') THEN 'missing_or_noncanonical_stop_codon' END,
    CASE WHEN n >= 3 AND n % 3 = 0 AND len(list_filter(cs[1:len(cs) - CASE WHEN l IN ('TAA', 'TAG', 'TGA') THEN 1 ELSE 0 END], lambda c: c IN ('TAA', 'TAG', 'TGA'))) > 0 THEN 'internal_stop' END) AS zero_reasons FROM r"""


@query("qc_sequences", _SQ)
def qc_sequences(spark, sf_dir):
    found = gn.sequence_quality(views.genome(spark, sf_dir).select(F.col("chrom_id").alias("id"), F.col("seq").alias("cds")))
    return found.select("id", F.array_join("zero_reasons", ",").alias("zero_reasons"))


_PAIRS = "pairs AS (SELECT a.tid AS a, b.tid AS b, a.gid AS gid, b.gid AS g2 FROM tx a JOIN tx b ON a.seqid = b.seqid AND a.strand = b.strand AND a.tid < b.tid AND a.gid <> b.gid AND a.s < b.e AND b.s < a.e)"


@query("jon_same_strand_overlap", f"{_TX}, {_PAIRS} SELECT a, b FROM pairs")
def same_strand_overlap(spark, sf_dir):
    return gn.same_strand_conflicts(gn.spans(views.blocks(spark, sf_dir, flagged=False))).select("a", "b")


@query("lbl_conflict_masks", f"""{_QC}, {_PAIRS}, hit AS (SELECT DISTINCT unnest([gid, g2]) AS gid FROM pairs)
SELECT m.gid, m.tid, CASE WHEN h.gid IS NULL THEN zero_reasons ELSE concat_ws(',', CASE WHEN zero_reasons <> '' THEN zero_reasons END, 'same_strand_label_overlap') END AS zero_reasons, CASE WHEN h.gid IS NULL THEN mask ELSE 0.0 END::DOUBLE AS mask FROM masked m LEFT JOIN hit h ON m.gid = h.gid""")
def conflict_masks(spark, sf_dir):
    hit = gn.conflicting_genes(gn.transcripts(views.blocks(spark, sf_dir))).withColumn("hit", F.lit(True))
    found = gn.quality(views.blocks(spark, sf_dir)).join(hit, "gid", "left")
    reasons = F.when(F.col("hit"), F.array_union("zero_reasons", F.array(F.lit("same_strand_label_overlap")))).otherwise(F.col("zero_reasons"))
    return found.select("gid", "tid", F.array_join(reasons, ",").alias("zero_reasons"), F.when(F.col("hit"), 0.0).otherwise(F.col("mask")).alias("mask"))


_LABELS = f"""{_PHASED}, num AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END) AS r, sum(e - s) OVER (PARTITION BY tid) AS total FROM ph),
each1 AS (SELECT *, unnest(range(0, e - s)) AS k FROM num),
coding AS (SELECT tid, CASE WHEN strand = '+' THEN s + k ELSE e - 1 - k END AS pos, CASE WHEN before + k = 0 THEN 7 WHEN before + k = total - 1 THEN 14 WHEN k = 0 AND r > 1 THEN 11 + (before + k) % 3 WHEN k = e - s - 1 THEN 8 + (before + k) % 3 ELSE 4 + (before + k) % 3 END AS label FROM each1)"""


@query("lbl_coding_labels", f"{_LABELS} SELECT label::INT AS label, count(*) AS n, sum(pos)::BIGINT AS checksum FROM coding GROUP BY label")
def coding_labels(spark, sf_dir):
    found = gn.labels(views.blocks(spark, sf_dir)).filter("label >= 4")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.sum("pos").alias("checksum"))


@query("lbl_intron_runs", f"""{_PHASED}, nx AS (SELECT *, lead(s) OVER w AS ns, lead(e) OVER w AS ne FROM ph WINDOW w AS (PARTITION BY tid ORDER BY CASE WHEN strand = '+' THEN s ELSE -s END, CASE WHEN strand = '+' THEN e ELSE -e END))
SELECT tid, CASE WHEN strand = '+' THEN e ELSE ne END AS s, CASE WHEN strand = '+' THEN ns ELSE s END AS e, ((before + e - s - 1) % 3 + 1)::INT AS label FROM nx WHERE ns IS NOT NULL AND CASE WHEN strand = '+' THEN ns > e ELSE s > ne END""")
def intron_runs(spark, sf_dir):
    return gn.label_runs(views.blocks(spark, sf_dir))


@query("til_masked_windows", f"""{_QC}, span AS (SELECT t.seqid, t.strand, t.s, t.e, mask AS w FROM masked m JOIN tx t ON m.tid = t.tid), bound AS (SELECT seqid, max(e) AS hi FROM span GROUP BY seqid),
win AS (SELECT seqid, strand, unnest(range(0, hi, 10000)) AS ws FROM bound, (SELECT unnest(['+', '-']) AS strand)),
cov AS (SELECT w.seqid, w.strand, w.ws, count(*) AS n, min(x.w) AS least FROM win w JOIN span x ON w.seqid = x.seqid AND w.strand = x.strand AND x.s < w.ws + 10000 AND w.ws < x.e GROUP BY ALL)
SELECT w.seqid, w.strand, w.ws, coalesce(n, 0)::BIGINT AS n, coalesce(least, 1.0)::DOUBLE AS least FROM win w LEFT JOIN cov c USING (seqid, strand, ws)""")
def masked_windows(spark, sf_dir):
    tx = gn.transcripts(views.blocks(spark, sf_dir))
    span = tx.join(gn.quality(views.blocks(spark, sf_dir)).select("tid", "mask"), "tid").select("seqid", "strand", F.col("s").alias("rs"), F.col("e").alias("re"), F.col("mask").alias("w"))
    bound = span.groupBy("seqid").agg(F.max("re").alias("hi")).select("seqid", "hi", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    win = bound.select("seqid", "strand", F.explode(F.expr("sequence(0L, hi - 1, 10000L)")).alias("s"))
    met = iv.overlapping(win.withColumn("e", F.col("s") + 10000), span, ["seqid", "strand"], 10000).groupBy("seqid", "strand", "s").agg(F.count("*").alias("n"), F.min("w").alias("least"))
    return win.join(met, ["seqid", "strand", "s"], "left").select("seqid", "strand", F.col("s").alias("ws"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("least", F.lit(1.0)).alias("least"))


_SELECTED = f"{_TX}, r AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY cds DESC, n DESC, s, tid DESC) AS r FROM tx), sel AS (SELECT * FROM r WHERE r = 1)"


@query("snk_gene_gff3", f"""{_SELECTED}, num AS (SELECT *, row_number() OVER (ORDER BY seqid, strand, CASE WHEN strand = '+' THEN s ELSE -e END, CASE WHEN strand = '+' THEN e ELSE s END, tid) AS number FROM sel)
SELECT gid, tid, seqid || chr(9) || 'strandloom' || chr(9) || 'gene' || chr(9) || (s + 1) || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || '.' || chr(9) || 'ID=gene-' || gid || ';biotype=protein_coding' AS line,
    row_number() OVER (PARTITION BY seqid, strand ORDER BY CASE WHEN strand = '+' THEN s ELSE -e END, CASE WHEN strand = '+' THEN e ELSE s END, tid) AS rank FROM num""")
def gene_gff3(spark, sf_dir):
    found = gn.representative(gn.transcripts(views.blocks(spark, sf_dir)))
    plus = F.col("strand") == "+"
    order = Window.partitionBy("seqid", "strand").orderBy(F.when(plus, F.col("s")).otherwise(-F.col("e")), F.when(plus, F.col("e")).otherwise(F.col("s")), "tid")
    line = F.concat_ws("\t", "seqid", F.lit("strandloom"), F.lit("gene"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=gene-"), "gid", F.lit(";biotype=protein_coding")))
    return found.select("gid", "tid", line.alias("line"), F.row_number().over(order).cast("long").alias("rank"))


@query("snk_block_gff3", f"""{_PHASED} SELECT tid, seqid || chr(9) || 'strandloom' || chr(9) || 'CDS' || chr(9) || (s + 1) || chr(9) || e || chr(9) || '.' || chr(9) || strand || chr(9) || ((3 - before % 3) % 3) || chr(9) || 'ID=' || tid || '.c' || row_number() OVER (PARTITION BY tid ORDER BY s, e) || ';Parent=' || tid AS line FROM ph""")
def block_gff3(spark, sf_dir):
    found = gn.phased(views.blocks(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("tid").orderBy("s", "e")))
    return found.select("tid", F.concat_ws("\t", "seqid", F.lit("strandloom"), F.lit("CDS"), (F.col("s") + 1).cast("string"), F.col("e").cast("string"), F.lit("."), "strand", F.col("phase").cast("string"), F.format_string("ID=%s.c%d;Parent=%s", "tid", "k", "tid")).alias("line"))


@query("flt_confidence", f"{_TX} SELECT tid, round(cds / (e - s), 6) AS density FROM tx WHERE e > s AND cds / (e - s) >= 0.05")
def confidence(spark, sf_dir):
    density = F.col("cds") / (F.col("e") - F.col("s"))
    return gn.transcripts(views.blocks(spark, sf_dir)).filter("e > s").filter(density >= 0.05).select("tid", F.round(density, 6).alias("density"))


@query("flt_protein_coding", """SELECT p_partkey, p_size % 3 AS n_cds, CASE WHEN lower(CASE p_partkey % 4 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'lncRNA' WHEN 2 THEN 'Gene' ELSE '' END) = 'protein_coding' THEN true
    ELSE p_size % 3 > 0 AND lower(CASE WHEN p_partkey % 4 = 2 THEN 'Gene' ELSE '' END) IN ('', 'gene') END AS coding FROM part""")
def protein_coding(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "biotype=protein_coding").when(k == 1, "biotype=lncRNA").when(k == 2, "gbkey=Gene").otherwise("note=none")
    found = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 3).alias("n_cds"), text.alias("t")).withColumn("attributes", F.expr(bases.attributes("t")))
    return gn.protein_coding(found).select("p_partkey", "n_cds", "coding")


@query("scl_spliced_cds", f"""WITH {views.GENOME}, b AS (SELECT chrom_id, seq, length(seq) AS n, unnest([[0, 9], [20, 27], [40, 52]]) AS x FROM genome WHERE length(seq) >= 60)
SELECT chrom_id, string_agg(substr(seq, (x[1] + 1)::INT, (x[2] - x[1])::INT), '' ORDER BY x[1]) AS plus, string_agg(reverse(translate(substr(seq, (x[1] + 1)::INT, (x[2] - x[1])::INT), '{bases.IUPAC[0]}', '{bases.IUPAC[1]}')), '' ORDER BY x[1] DESC) AS minus FROM b GROUP BY chrom_id""")
def spliced_cds(spark, sf_dir):
    each = views.genome(spark, sf_dir).filter(F.length("seq") >= 60).select("chrom_id", "seq", F.explode(F.expr("array(struct(0 AS a, 9 AS b), struct(20 AS a, 27 AS b), struct(40 AS a, 52 AS b))")).alias("x"))
    parts = each.select("chrom_id", F.col("x.a").alias("a"), F.expr("substr(seq, x.a + 1, x.b - x.a)").alias("p"))
    grouped = parts.groupBy("chrom_id").agg(F.array_sort(F.collect_list(F.struct("a", "p"))).alias("ps"))
    return grouped.select("chrom_id", F.expr("array_join(transform(ps, x -> x.p), '')").alias("plus"), F.expr(f"array_join(transform(reverse(ps), x -> {bases.reverse_complement('x.p')}), '')").alias("minus"))


@query("prj_exon_mapping", f"{B} SELECT tid, CASE WHEN strand = '+' THEN 1000 + s ELSE {views.SPAN * 2} - (1000 + e) END AS gs, CASE WHEN strand = '+' THEN 1000 + e ELSE {views.SPAN * 2} - (1000 + s) END AS ge FROM block")
def exon_mapping(spark, sf_dir):
    plus, n = F.col("strand") == "+", F.lit(views.SPAN * 2).cast("long")
    return views.blocks(spark, sf_dir).select("tid", F.when(plus, 1000 + F.col("s")).otherwise(n - (1000 + F.col("e"))).alias("gs"), F.when(plus, 1000 + F.col("e")).otherwise(n - (1000 + F.col("s"))).alias("ge"))


def exon_lines(spark, sf_dir):
    """Selected genes with all of their lines, for writing."""
    chosen = gn.representative(gn.transcripts(views.blocks(spark, sf_dir))).select("gid", "tid")
    exons = views.blocks(spark, sf_dir).join(chosen, ["gid", "tid"], "left_semi").groupBy("gid", "seqid", "strand").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("exons"))
    return orfs.gff3_lines(exons.select(F.col("seqid").alias("chrom_id"), "strand", F.col("gid").alias("number"), "exons"))


@query("snk_gene_lines", f"""{_SELECTED}, b AS (SELECT k.* FROM block k JOIN sel USING (tid)), c AS (SELECT gid, count(*) AS n, sum(e - s)::BIGINT AS cds FROM b GROUP BY gid)
SELECT gid AS number, 2 + 2 * n AS lines, n AS cds_lines FROM c""")
def gene_lines(spark, sf_dir):
    return exon_lines(spark, sf_dir).groupBy("number").agg(F.count("*").alias("lines"), F.count_if(F.split("line", "\t")[2] == "CDS").alias("cds_lines"))


@query("lbl_ownership", f"""WITH {views.GENES}, t AS (SELECT seqid, strand, tid, min(s) AS s, max(e) AS e FROM block GROUP BY ALL), p AS (SELECT seqid, strand, at_, sum(d) AS d FROM (SELECT seqid, strand, unnest([s, e]) AS at_, unnest([1, -1]) AS d FROM t) GROUP BY ALL),
o AS (SELECT *, sum(d) OVER (PARTITION BY seqid, strand ORDER BY at_) AS owners FROM p) SELECT seqid, strand, at_ AS at, owners::BIGINT AS owners FROM o WHERE owners > 1 AND d > 0""")
def ownership(spark, sf_dir):
    """Where a base comes to belong to more than one transcript of a strand, by a sweep in stripes."""
    spans = views.blocks(spark, sf_dir).groupBy("seqid", "strand", "tid").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return gn.ownership_violations(spans, ["seqid", "strand"], 1 << 16)
