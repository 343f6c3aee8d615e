"""Genes, transcripts and coding blocks: hierarchy, representative transcripts, phases, introns, labels, conflicts, quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import intervals as iv


def in_transcript_order(*keys: str) -> object:
    """A window over the blocks (s, e, strand) of each of `keys` in transcript direction."""
    minus = F.col("strand") == "-"
    return Window.partitionBy(*keys).orderBy(F.when(minus, -F.col("s")).otherwise(F.col("s")), F.when(minus, -F.col("e")).otherwise(F.col("e")))


def transcripts(blocks: DataFrame) -> DataFrame:
    """(gid, tid, seqid, strand, s, e, cds, n): span, coding length and number of blocks of each transcript."""
    return blocks.groupBy("gid", "tid", "seqid", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("cds"), F.count("*").alias("n"), F.max("flagged").alias("flagged"))


def spans(blocks: DataFrame) -> DataFrame:
    """(gid, tid, seqid, strand, s, e): from the first to the last base of each transcript's blocks."""
    return blocks.groupBy("gid", "tid", "seqid", "strand").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def representative(found: DataFrame, policy: str = "longest_cds") -> DataFrame:
    """One transcript a gene: longest_cds, first, phytozome_longest (those marked as longest first) or fail (first; `several` tells that the gene has more)."""
    best = [F.desc("cds"), F.desc("n"), F.asc("s"), F.desc("tid")]
    order = {"longest_cds": best, "first": [F.asc("s"), F.asc("e"), F.asc("tid")], "fail": [F.asc("s"), F.asc("e"), F.asc("tid")], "phytozome_longest": [F.desc("flagged"), *best]}[policy]
    gene = Window.partitionBy("gid")
    marked = found.withColumn("several", F.count("*").over(gene) > 1).withColumn("marked", F.sum("flagged").over(gene))
    return marked.withColumn("__r", F.row_number().over(gene.orderBy(*order))).filter("__r = 1").drop("__r")


def phased(blocks: DataFrame) -> DataFrame:
    """`blocks` with the phase that each has when reading goes on from the blocks before it."""
    order = in_transcript_order("tid")
    before = F.coalesce(F.sum(F.col("e") - F.col("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("before", before).withColumn("phase", F.expr(bases.first_phase("before")))


def introns(blocks: DataFrame) -> DataFrame:
    """(tid, s, e, length, touches): what lies between neighbouring blocks; touches where nothing does."""
    order = Window.partitionBy("tid").orderBy("s", "e")
    gaps = blocks.withColumn("next", F.lead("s").over(order)).filter("next IS NOT NULL")
    return gaps.select("gid", "tid", "seqid", "strand", F.col("e").alias("s"), F.col("next").alias("e"), (F.col("next") - F.col("e")).alias("length"), (F.col("next") <= F.col("e")).alias("touches"))


def block_checks(blocks: DataFrame) -> DataFrame:
    """(tid, overlaps, short_middle): whether sorted blocks overlap, and whether an inner one has two bases at most."""
    order = Window.partitionBy("tid").orderBy("s", "e")
    numbered = blocks.withColumn("r", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("tid"))).withColumn("before", F.lag("e").over(order))
    inner = (F.col("r") > 1) & (F.col("r") < F.col("n")) & (F.col("e") - F.col("s") <= 2)
    return numbered.groupBy("tid").agg(F.coalesce(F.bool_or(F.col("s") < F.col("before")), F.lit(False)).alias("overlaps"), F.bool_or(inner).alias("short_middle"))


def same_strand_conflicts(spans: DataFrame, bucket: int = 1 << 10) -> DataFrame:
    """Pairs (a, b) of transcripts of different genes on one strand whose spans overlap. spans: (gid, tid, seqid, strand, s, e).

    Of two that overlap, the later one (by begin, then tid) begins inside the other. So each span goes
    to the bucket of its begin and meets those that reach into it; a pair is made once, not in both
    orders and not in every bucket that it shares.
    """
    late = spans.select("seqid", "strand", F.col("gid").alias("g2"), F.col("tid").alias("t2"), F.col("s").alias("rs"), F.col("e").alias("re"), F.expr(f"s div {bucket}").alias("__bucket"))
    early = spans.withColumn("__bucket", F.explode(F.sequence(F.expr(f"s div {bucket}"), F.expr(f"greatest(e - 1, s) div {bucket}"))))
    met = early.join(late, ["seqid", "strand", "__bucket"]).filter("rs < e AND s < re AND (s < rs OR s = rs AND tid < t2) AND gid <> g2 AND tid <> t2")
    own, other = F.struct(F.col("tid").alias("t"), F.col("gid").alias("g")), F.struct(F.col("t2").alias("t"), F.col("g2").alias("g"))
    first, second = F.when(F.col("tid") < F.col("t2"), own).otherwise(other), F.when(F.col("tid") < F.col("t2"), other).otherwise(own)
    return met.select(first["t"].alias("a"), second["t"].alias("b"), first["g"].alias("gid"), second["g"].alias("g2"))


def conflicting_genes(spans: DataFrame, stripe: int = 1 << 16) -> DataFrame:
    """(gid) of the genes in same_strand_conflicts of spans that hold a base, without listing the pairs. spans: (gid, seqid, strand, s, e).

    A gene's spans on a strand are made one where they overlap, so what then overlaps is of two genes:
    inside a stripe a span meets another if one begun before it ends behind its begin, or the next one
    begins before its end.
    """
    keys = ["seqid", "strand"]
    order = Window.partitionBy(*keys, "gid").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.filter("e > s").select(*keys, "gid", "s", "e").withColumn("__fresh", F.when(F.col("s") < reach, 0).otherwise(1))
    own = own.withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.groupBy(*keys, "gid", "__run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    along = Window.partitionBy(*keys, "__stripe").orderBy("s", "e", "gid")
    before = F.max("e").over(along.rowsBetween(Window.unboundedPreceding, -1)) > F.col("s")
    behind = F.lead("s").over(along) < F.col("e")
    met = iv.in_stripes(own, stripe).withColumn("__met", F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False)))
    return met.filter("__met").select("gid").distinct()


def ownership_violations(spans: DataFrame, keys: list[str], stripe: int = iv.STRIPE) -> DataFrame:
    """(keys, at, owners): where a base gets more than one owner. spans: (keys, s, e), half open.

    A sweep over the ends of all spans: begins count one up, ends one down, both at once where they meet.
    """
    from strandloom.operators.splicing import running

    ends = spans.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    points = ends.groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d"))
    return running(points, keys, "at", "d", "owners", stripe=stripe).filter("owners > 1 AND d > 0").select(*keys, "at", "owners")


def quality(blocks: DataFrame, least_cds: int = 60, hard_intron: int = 4, soft_intron: int = 20) -> DataFrame:
    """(gid, tid, zero_reasons, half_reasons, notes, mask) by the rules on structure; reasons keep the order of the rules.

    mask is 0 with a zero reason, else 0.5 with a half reason, else 1.
    """
    size = F.col("e") - F.col("s")
    sums = blocks.groupBy("gid", "tid").agg(F.sum(size).alias("cds"), F.min(size).alias("least"), F.max("flagged").alias("flagged"))
    length = F.col("length")
    short, soft = (length > 0) & (length < hard_intron), (length >= hard_intron) & (length < soft_intron)
    gaps = introns(blocks).groupBy("tid").agg(F.bool_or(short).alias("short"), F.bool_or(soft).alias("soft"), F.bool_or("touches").alias("touches"))
    known = sums.join(block_checks(blocks), "tid").join(gaps, "tid", "left")
    zero = [
        ("partial_cds_or_gene", F.col("flagged") == 1), ("invalid_CDS_coordinates", F.col("least") <= 0), ("CDS_blocks_overlap", F.col("overlaps")), ("middle_CDS_length_le_2", F.col("short_middle")),
        ("CDS_length_less_than_min", F.col("cds") < least_cds), ("CDS_length_not_multiple_of_3", F.col("cds") % 3 != 0), ("exon_or_CDS_blocks_overlap_or_touch", F.coalesce("touches", F.lit(False))),
        (f"intron_length_lt_{hard_intron}", F.coalesce("short", F.lit(False))),
    ]
    half = [(f"intron_length_lt_{soft_intron}", F.coalesce("soft", F.lit(False)))]
    named = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))
    out = known.withColumn("zero_reasons", named(zero)).withColumn("half_reasons", named(half)).withColumn("notes", F.array(F.lit("intron_source=cds")))
    mask = F.when(F.size("zero_reasons") > 0, 0.0).when(F.size("half_reasons") > 0, 0.5).otherwise(1.0)
    return out.select("gid", "tid", "zero_reasons", "half_reasons", "notes", mask.alias("mask"))


def listed(rules: list[tuple[str, Column]]) -> Column:
    """The names of those (name, condition) that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules]))


def sequence_rules(cds: str, least: int = 60) -> list[tuple[str, Column]]:
    """(name, whether the spliced coding sequence in column `cds` breaks it) of each rule."""
    n = F.length(cds)
    clean = lambda c: c.rlike("[^ACGT]")
    first, last = F.substring(cds, 1, 3), F.substring(cds, -3, 3)
    stop_last = last.isin(*bases.STOPS)
    inner = F.col(cds).rlike(f"^(?:...)*?(?:{'|'.join(bases.STOPS)})...")  # a stop that another codon follows
    return [
        ("CDS_length_less_than_min", n < least), ("CDS_length_not_multiple_of_3", n % 3 != 0), ("CDS_contains_ambiguous_base", clean(F.col(cds))),
        ("missing_start_codon", n < 3), ("missing_stop_codon", n < 3),
        ("start_codon_contains_ambiguous_base", (n >= 3) & clean(first)), ("noncanonical_start_codon", (n >= 3) & ~clean(first) & (first != "ATG")),
        ("stop_codon_contains_ambiguous_base", (n >= 3) & clean(last)), ("missing_or_noncanonical_stop_codon", (n >= 3) & ~clean(last) & ~stop_last), ("internal_stop", (n >= 3) & (n % 3 == 0) & inner),
    ]


def sequence_quality(records: DataFrame, least: int = 60) -> DataFrame:
    """(id, zero_reasons) by the rules on a spliced coding sequence. records: (id, cds)."""
    return records.select("id", listed(sequence_rules("cds", least)).alias("zero_reasons"))


def labels(blocks: DataFrame) -> DataFrame:
    """(tid, pos, label) of every base of a transcript's blocks and introns, without the exceptions for blocks of one or two bases.

    7 the first base, 14 the last; 11 to 13 the first base of a later block; 8 to 10 the last base of
    a block that another follows; else 4 to 6, by the reading frame. Introns have 1 to 3, by the frame
    of the base before them.
    """
    order = in_transcript_order("tid")
    size = F.col("e") - F.col("s")
    numbered = phased(blocks).withColumn("r", F.row_number().over(order)).withColumn("total", F.sum(size).over(Window.partitionBy("tid")))
    each = numbered.select("tid", "strand", "s", "e", "r", "before", "total", F.explode(F.expr("sequence(0L, e - s - 1)")).alias("k"))
    seen, p = F.col("before") + F.col("k"), (F.col("before") + F.col("k")) % 3
    label = (
        F.when(seen == 0, 7).when(seen == F.col("total") - 1, 14).when((F.col("k") == 0) & (F.col("r") > 1), 11 + p)
        .when((F.col("k") == F.col("e") - F.col("s") - 1), 8 + p).otherwise(4 + p)
    )
    pos = F.when(F.col("strand") == "+", F.col("s") + F.col("k")).otherwise(F.col("e") - 1 - F.col("k"))
    coding = each.select("tid", pos.alias("pos"), label.cast("int").alias("label"))
    after = F.lead("s").over(order)
    gaps = numbered.select("tid", "strand", "s", "e", ((F.col("before") + size - 1) % 3 + 1).cast("int").alias("label"), after.alias("ns"), F.lead("e").over(order).alias("ne")).filter("ns IS NOT NULL")
    lo, hi = F.when(F.col("strand") == "+", F.col("e")).otherwise(F.col("ne")), F.when(F.col("strand") == "+", F.col("ns")).otherwise(F.col("s"))
    between = gaps.select("tid", "label", lo.alias("lo"), hi.alias("hi")).filter("hi > lo").select("tid", F.explode(F.expr("sequence(lo, hi - 1)")).alias("pos"), "label")
    return coding.unionByName(between)


def label_runs(blocks: DataFrame) -> DataFrame:
    """(tid, s, e, label): intron labels as intervals, which is how windows keep them until the last step."""
    order = in_transcript_order("tid")
    size = F.col("e") - F.col("s")
    numbered = phased(blocks)
    gaps = numbered.select("tid", "strand", "s", "e", ((F.col("before") + size - 1) % 3 + 1).cast("int").alias("label"), F.lead("s").over(order).alias("ns"), F.lead("e").over(order).alias("ne")).filter("ns IS NOT NULL")
    plus = F.col("strand") == "+"
    return gaps.select("tid", F.when(plus, F.col("e")).otherwise(F.col("ne")).alias("s"), F.when(plus, F.col("ns")).otherwise(F.col("s")).alias("e"), "label").filter("e > s")


def protein_coding(found: DataFrame, key: str = "gene_biotype", values: tuple[str, ...] = ("protein_coding", "protein-coding")) -> DataFrame:
    """`found` (attributes, n_cds) with `coding`: the first biotype attribute or gene_biotype is one of `values`, or there is coding sequence and gbkey says nothing else."""
    a = lambda k: F.nullif(F.coalesce(F.col("attributes")[k], F.lit("")), F.lit(""))
    wanted = [v.lower() for v in values]
    biotype = F.lower(F.coalesce(*[a(k) for k in (key, "biotype", "gene_type", "gbkey")], F.lit("")))
    match = biotype.isin(*wanted) | F.lower(F.coalesce(a("gene_biotype"), F.lit(""))).isin(*wanted)
    fallback = (F.col("n_cds") > 0) & F.lower(F.coalesce(a("gbkey"), F.lit(""))).isin("", "gene")
    return found.withColumn("coding", match | fallback)


#: The attributes that may name a biotype.
BIOTYPES = ("gene_biotype", "gene_type", "transcript_biotype", "transcript_type", "biotype")


def coding_evidence(found: DataFrame) -> DataFrame:
    """`found` (gene_attributes, attributes, n_cds) with coding_evidence: biotype where any named one is protein_coding, inferred_from_cds where none is named and there are coding blocks, else none."""
    values = " , ".join(f"nullif({a}['{k}'], '')" for a in ("gene_attributes", "attributes") for k in BIOTYPES)
    named = F.expr(f"transform(array_compact(array({values})), v -> replace(lower(v), '-', '_'))")
    return found.withColumn("coding_evidence", F.when(F.array_contains(named, "protein_coding"), "biotype").when((F.size(named) == 0) & (F.col("n_cds") > 0), "inferred_from_cds").otherwise("none"))
