"""What a run leaves for people: tables of quality and selection, a summary, metrics and failures."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the two tables, in order.
QUALITY = ("gene_id", "transcript_id", "seqid", "strand", "start", "end", "cds_length", "cds_blocks", "mask", "selected", "coding_evidence", "zero_reasons", "half_reasons", "notes")
SELECTED = ("gene_id", "selected_transcript_id", "mask", "seqid", "start", "end", "strand")


def quality_table(quality: DataFrame, transcripts: DataFrame, selected: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """A row for each judged transcript: quality (gid, tid, ...) with its place from transcripts, whether selected (tid) has it, and evidence (tid, coding_evidence). Lists are joined by commas."""
    place = transcripts.select("tid", "seqid", "strand", F.col("s").alias("start"), F.col("e").alias("end"))
    chosen = selected.select("tid", F.lit(True).alias("selected")).distinct()
    rows = quality.join(place, "tid", "left").join(chosen, "tid", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    rows = rows.join(evidence.select("tid", "coding_evidence"), "tid", "left") if evidence is not None else rows.withColumn("coding_evidence", F.lit("biotype"))
    for name in ("zero_reasons", "half_reasons", "notes"):
        rows = rows.withColumn(name, F.array_join(name, ","))
    return rows.withColumnRenamed("gid", "gene_id").withColumnRenamed("tid", "transcript_id").select(*QUALITY)


def selected_table(genes: DataFrame, quality: DataFrame) -> DataFrame:
    """A row for each gene (gid, seqid, strand, s, e): its judged transcript, or none, and the mask; a gene without one has mask 0."""
    own = quality.groupBy("gid").agg(F.min_by("tid", "tid").alias("selected_transcript_id"), F.min("mask").alias("mask"))
    rows = genes.join(own, "gid", "left").withColumn("mask", F.coalesce("mask", F.lit(0.0))).withColumn("selected_transcript_id", F.coalesce("selected_transcript_id", F.lit("")))
    return rows.select(F.col("gid").alias("gene_id"), "selected_transcript_id", "mask", "seqid", F.col("s").alias("start"), F.col("e").alias("end"), "strand")


def judged_table(quality: DataFrame) -> DataFrame:
    """The table of judged transcripts, from what gene_quality says of them."""
    rows = quality.select("*", F.col("s").alias("start"), F.col("e").alias("end")).withColumnsRenamed({"gid": "gene_id", "tid": "transcript_id", "evidence": "coding_evidence"})
    for name in ("zero_reasons", "half_reasons", "notes"):
        rows = rows.withColumn(name, F.array_join(name, ","))
    return rows.select(*QUALITY)


def gene_table(every: DataFrame) -> DataFrame:
    """The table of all genes with their transcripts, from what gene_quality says becomes of them."""
    return every.select(F.col("gid").alias("gene_id"), F.coalesce("tid", F.lit("")).alias("selected_transcript_id"), "mask", "seqid", F.col("s").alias("start"), F.col("e").alias("end"), "strand")


def masked_genes(every: DataFrame) -> DataFrame:
    """(seqid, start, end, gene_id, score, strand) of judged genes that training leaves out (score 0) or trusts by half (500)."""
    some = every.filter("judged AND mask IN (0.0, 0.5)")
    return some.select("seqid", F.col("s").alias("start"), F.col("e").alias("end"), F.col("gid").alias("gene_id"), F.when(F.col("mask") == 0, 0).otherwise(500).alias("score"), "strand")


def summary(genes: DataFrame, quality: DataFrame) -> DataFrame:
    """One row: genes with a judged transcript, judged transcripts, and genes by mask (that of their worst transcript)."""
    masks = quality.groupBy("gid").agg(F.min("mask").alias("mask"), F.count("*").alias("n")).join(genes.select("gid").distinct(), "gid")
    of = lambda m: F.count_if(F.col("mask") == m).alias(str(m))
    return masks.agg(F.count("*").alias("genes_with_protein_coding_transcripts"), F.coalesce(F.sum("n"), F.lit(0)).alias("transcripts"), F.struct(of(0.0), of(0.5), of(1.0)).alias("gene_mask_counts"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Rows as tab-separated files with a header each; tabs and line ends in texts are cleaned away, nulls are empty."""
    clean = [F.translate(F.col(c).cast("string"), "\t\r\n", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.option("sep", "\t").option("header", "true").option("quote", "").option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


def best(metrics: DataFrame, score: str, step: str) -> DataFrame:
    """The row of the best score; of equal scores the first step's. Rows whose score is null or NaN don't count."""
    known = metrics.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return known.agg(F.max_by(F.struct(*known.columns), F.struct(score, -F.col(step))).alias("x")).filter("x IS NOT NULL").select("x.*")


def each_species(spark: SparkSession, names: Iterable[str], work: Callable[[str], None], path: str, stop: bool = False) -> DataFrame:
    """Calls work(name) for each species and writes (name, problem) of those that failed to `path`; a failure ends the batch only if `stop`."""
    failed = []
    for name in names:
        try:
            work(name)
        except Exception as problem:
            if stop:
                raise
            failed.append((name, f"{type(problem).__name__}: {problem}"))
    rows = spark.createDataFrame(failed, "name string, problem string")
    write_tsv(rows.coalesce(1), path)
    return rows
