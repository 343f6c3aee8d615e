"""Quality of genes: which transcript stands for a gene, what the rules say of it, and which genes labels must leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import genes as gn
from strandloom.operators import quality as rules
from strandloom.plans.session import written

POLICIES = ("longest_cds", "phytozome_longest", "first", "fail")


@dataclass(frozen=True)
class Rules:
    """What the quality of genes goes by."""

    biotype_key: str = "gene_biotype"
    biotypes: tuple[str, ...] = ("protein_coding", "protein-coding")
    policy: str = "longest_cds"
    least_cds: int = 60
    hard_intron: int = 4
    soft_intron: int = 20
    intron_source: str = "exon"
    low_quality: str = "half"
    allow_partial: bool = False
    allow_exceptions: bool = False

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"no policy {self.policy!r}; known are {POLICIES}")
        if self.intron_source not in ("exon", "cds", "gff", "auto") or self.low_quality not in ("hard", "half", "keep"):
            raise ValueError("intron_source must be exon, cds, gff or auto; low_quality hard, half or keep")
        if not self.biotypes or self.least_cds < 1 or not 1 <= self.hard_intron <= self.soft_intron:
            raise ValueError("biotypes must not be empty, least_cds 1 or more, hard_intron between 1 and soft_intron")


def gathered_genes(genes: DataFrame, transcripts: DataFrame, children: DataFrame) -> DataFrame:
    """(gid, seqid, strand, s, e, attributes, transcripts) of every gene: transcripts is an array of (tid, seqid, strand, s, e, parse_index, marked as longest, what is said of them and their children, cds, exon, intron)."""
    marked = F.trim(F.coalesce(F.try_element_at("attributes", F.lit("longest")), F.lit(""))) == "1"
    own = rules.with_children(transcripts.select("gid", "tid", "seqid", "strand", "s", "e", "parse_index", marked.alias("marked"), "attributes"), children)
    met = genes.select("gid", "seqid", "strand", "s", "e", "attributes").join(own.groupBy("gid").agg(F.collect_list(F.struct(*[c for c in own.columns if c != "gid"])).alias("transcripts")), "gid", "left")
    return met.withColumn("transcripts", F.coalesce("transcripts", F.expr(f"cast(array() as {dict(met.dtypes)['transcripts']})")))


def chosen_transcripts(genes: DataFrame, policy: str = "longest_cds") -> DataFrame:
    """`genes` (transcripts as gathered_genes gives them, ...) with chosen, evidence, selection_notes and several instead of transcripts: one transcript of each gene that has any.

    Only transcripts with coding blocks count, or all where a gene has none. Of several, longest_cds
    takes the most coding bases, then blocks, the first begin and the last name; first the first span
    and name; fail the first line, `several` telling whether the gene must be left out;
    phytozome_longest the one marked as longest, or the longest of the marked ones, or of all.
    """
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; known are {POLICIES}")
    coding = F.filter("transcripts", lambda x: F.size(x["cds"]) > 0)
    own = genes.withColumn("__with_cds", F.size(coding)).withColumn("__own", F.when(F.col("__with_cds") > 0, coding).otherwise(F.col("transcripts"))).drop("transcripts")
    own = own.withColumn("__total", F.size("__own")).withColumn("__marked", F.size(F.filter("__own", lambda x: x["marked"])))
    sums = lambda x: F.when(F.size(x["cds"]) > 0, F.aggregate(x["cds"], F.lit(0).cast("long"), lambda a, b: a + b["e"] - b["s"]))
    longest = lambda x: [sums(x).alias("bases"), F.size(x["cds"]).alias("blocks"), x["s"].isNull().alias("placeless"), (-x["s"]).alias("begin"), x["tid"].alias("name")]
    order = {
        "longest_cds": longest, "phytozome_longest": lambda x: [x["marked"].alias("marked"), *longest(x)], "first": lambda x: [x["s"].alias("begin"), x["e"].alias("end"), x["tid"].alias("name")],
        "fail": lambda x: [x["parse_index"].alias("line"), x["tid"].alias("name")],
    }[policy]
    best = F.array_max if policy in ("longest_cds", "phytozome_longest") else F.array_min
    place = best(F.transform("__own", lambda x, i: F.struct(*order(x), i.alias("at"))))["at"]
    several, one = F.col("__total") > 1, F.col("__marked") == 1
    notes = [F.when(several, F.concat(F.lit("multiple_transcripts="), "__total"))]
    evidence = F.lit(policy)
    if policy == "phytozome_longest":
        evidence = F.when(one, policy).otherwise("longest_cds")
        notes.append(F.when(several, F.when(one, "selected_phytozome_longest").when(F.col("__marked") > 1, F.concat(F.lit("multiple_phytozome_longest="), "__marked")).otherwise("phytozome_longest_not_marked_fallback_longest_cds")))
        notes.append(F.when(several & ~one, "selected_longest_cds"))
    elif policy == "longest_cds":
        notes.append(F.when(several, "selected_longest_cds"))
    elif policy == "fail":
        notes.append(F.when(several & (F.col("__with_cds") > 1), "multiple_transcripts"))
    failed = F.lit(policy == "fail") & (F.col("__with_cds") > 1)
    said = {"chosen": F.get("__own", place), "evidence": F.when(several, evidence).otherwise("single"), "selection_notes": F.array_compact(F.array(*notes)), "several": failed}
    return own.withColumns(said).drop("__with_cds", "__own", "__total", "__marked")


def judged_genes(genes: DataFrame, records: DataFrame, by: Rules | None = None) -> DataFrame:
    """All genes with their chosen transcript and what the rules say of it, a row each; genes as gathered_genes gives them.

    (gid, coding, tid, seqid, strand, s, e, cds_length, cds_blocks, mask, selected, evidence,
    zero_reasons, half_reasons, notes). A protein-coding gene without a transcript has mask 0 and
    `no_transcript`; one that isn't protein coding has no transcript, mask 1, and nothing is said of it.
    A gene without a transcript stands in its own place.
    """
    by = by or Rules()
    marked = gn.protein_coding(genes.withColumn("n_cds", F.size(F.filter("transcripts", lambda x: F.size(x["cds"]) > 0))), by.biotype_key, by.biotypes)
    nothing = F.expr(f"cast(array() as {dict(genes.dtypes)['transcripts']})")
    chosen = chosen_transcripts(marked.withColumn("transcripts", F.when(F.col("coding"), F.col("transcripts")).otherwise(nothing)), by.policy)
    of_gene = dict(zip(rules.MARKS, rules.markers("attributes"), strict=True))
    x = F.col("chosen")
    rows = chosen.select(
        "gid", "coding", F.struct("seqid", "strand", "s", "e").alias("own"), x["tid"].alias("tid"), x["seqid"].alias("seqid"), x["strand"].alias("strand"), x["s"].alias("s"), x["e"].alias("e"), "evidence", "selection_notes", "several",
        F.col("seqid").alias("gene_seqid"), *[(x[m] | of_gene[m]).alias(m) for m in rules.MARKS], *[x[k].alias(k) for k in rules.KINDS],
    )
    kinds = dict(rows.dtypes)
    rows = rows.withColumns({k: F.coalesce(k, F.expr(f"cast(array() as {kinds[k]})")) for k in rules.KINDS})
    found = rules.judged(rows, records, by.least_cds, by.hard_intron, by.soft_intron, by.intron_source, by.low_quality, by.allow_partial, by.allow_exceptions)
    some, coding, own = F.col("tid").isNotNull(), F.col("coding"), F.col("own")
    none = F.expr("cast(array() as array<string>)")
    zero = F.when(F.col("several"), F.array_append("zero_reasons", F.lit("multiple_transcripts"))).otherwise(F.col("zero_reasons"))
    said = lambda of_transcript, of_none: F.when(some, of_transcript).when(coding, of_none)
    return found.select(
        "gid", "coding", "tid", *[F.when(some, F.col(c)).otherwise(own[c]).alias(c) for c in ("seqid", "strand", "s", "e")],
        said(F.col("cds_length"), F.lit(0).cast("long")).alias("cds_length"), said(F.col("cds_blocks"), F.lit(0).cast("long")).alias("cds_blocks"),
        F.when(some, F.when(F.col("several"), 0.0).otherwise(F.col("mask"))).when(coding, 0.0).otherwise(1.0).alias("mask"), said(~F.col("several"), F.lit(False)).alias("selected"), said(F.col("evidence"), F.lit("gene_biotype")).alias("evidence"),
        said(zero, F.array(F.lit("no_transcript"))).alias("zero_reasons"), said(F.col("half_reasons"), none).alias("half_reasons"), said(F.concat("selection_notes", "notes"), none).alias("notes"),
    )


def gene_quality(genes: DataFrame, transcripts: DataFrame, children: DataFrame, records: DataFrame, by: Rules | None = None) -> tuple[DataFrame, DataFrame]:
    """The judged transcripts, and all genes with what becomes of them.

    genes: (gid, seqid, strand, s, e, attributes); transcripts: (gid, tid, seqid, strand, s, e,
    attributes, parse_index); children and records as transcript_quality takes them.

    The first: (gid, tid, seqid, strand, s, e, cds_length, cds_blocks, mask, selected, evidence,
    zero_reasons, half_reasons, notes), one for each protein-coding gene: its chosen transcript, or an
    empty name and `no_transcript` where it has none. The second: (gid, tid, mask, seqid, strand, s, e,
    judged) of every gene; one that isn't protein coding has no transcript and mask 1.
    """
    every = written(judged_genes(gathered_genes(genes, transcripts, children), records, by), "gene-quality")
    found = every.filter("coding").drop("coding").withColumn("tid", F.coalesce("tid", F.lit("")))
    columns = ("gid", "tid", "seqid", "strand", "s", "e", "cds_length", "cds_blocks", "mask", "selected", "evidence", "zero_reasons", "half_reasons", "notes")
    return found.select(*columns), every.select("gid", "tid", "mask", "seqid", "strand", "s", "e", F.col("coding").alias("judged"))


def label_safe(found: DataFrame, children: DataFrame) -> DataFrame:
    """The judged transcripts (of gene_quality) as labels may use them: genes whose coding spans overlap on one strand get mask 0, aren't selected and say so.

    A channel of labels can't hold two genes at once. Genes that have mask 0 already are in nobody's way.
    """
    spans = children.filter("type = 'cds'").groupBy("tid").agg(F.min("s").alias("cs"), F.max("e").alias("ce"))
    live = found.filter("mask > 0 AND tid <> ''").select("gid", "tid", "seqid", "strand").join(spans, "tid")
    clash = gn.conflicting_genes(live.select("gid", "seqid", "strand", F.col("cs").alias("s"), F.col("ce").alias("e")))
    lost = clash.withColumn("clash", F.lit(True))
    out = found.join(lost, "gid", "left")
    reasons = F.when(F.col("clash"), F.array_union("zero_reasons", F.array(F.lit("same_strand_label_overlap")))).otherwise(F.col("zero_reasons"))
    return out.withColumns({"mask": F.when(F.col("clash"), 0.0).otherwise(F.col("mask")), "selected": F.col("selected") & F.col("clash").isNull(), "zero_reasons": reasons}).drop("clash")
