"""Whole dataflows in one call: prediction, decoding, and preparation of training windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import track as tk
from strandloom.operators import candidates, decode, genes, intervals, orfs, tiling, training
from strandloom.operators import gene_quality as gq
from strandloom.plans.session import written
from strandloom.sources import files, reports

Scorer = Callable[[list[str]], list[list[list[float]]]]


def predict(records: DataFrame, scorer: Scorer, window: int = 40_960, flank: int = 5_120) -> DataFrame:
    """(chrom_id, strand, pos, base, p): the track that `scorer` gives. It takes sequences and gives 30 logits for each of their bases.

    Windows keep their keys, so nothing has to be put in order; each position comes from one window.
    """
    tiles = tiling.write_intervals(tiling.inference_windows(records, window, flank))
    chosen = tiles.select("chrom_id", "center_start", "write_start", "write_end", "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r, z in zip(rows, scorer([r["sequence"] for r in rows]), strict=True):
                at = range(r["write_start"], r["write_end"])
                shift = flank - r["center_start"]
                yield pa.RecordBatch.from_arrays([pa.array([r["chrom_id"]] * len(at)), pa.array(at, pa.int64()), pa.array([r["sequence"][i + shift] for i in at]), pa.array([z[i + shift] for i in at], pa.list_(pa.float64()))], names=["chrom_id", "pos", "base", "z"])

    logits = chosen.mapInArrow(run, "chrom_id string, pos bigint, base string, z array<double>")
    both = logits.select("chrom_id", "pos", "base", F.explode(F.create_map(F.lit("+"), F.slice("z", 1, 15), F.lit("-"), F.slice("z", 16, 15))).alias("strand", "z"))
    return both.select("chrom_id", "strand", "pos", "base", F.expr(tk.softmax("z")).alias("p"))


def candidate_regions(track: DataFrame, step: int = 50) -> DataFrame:
    """(chrom_id, strand, region, start, stop) where genes may lie. Thresholds come from the sampling plan of each record."""
    keys = ["chrom_id", "strand"]
    length = written(track.groupBy(*keys).agg((F.max("pos") + 1).alias("length")), "lengths")
    plan = tiling.sampling_plan(length.groupBy("chrom_id").agg(F.max("length").alias("length")), step=step)
    bins = written(candidates.binned(track, keys, step, plan), "bins")
    found = intervals.merge(intervals.extended(intervals.regions(bins, keys, step), bins, keys, step), keys).join(length, keys)
    return found.select(*keys, F.xxhash64("chrom_id", "strand", "s").alias("region"), F.col("s").alias("start"), F.least("e", "length").alias("stop"))


def annotate(track: DataFrame, records: DataFrame, min_cds: int = 60, min_intron: int = 20, least_mean: float = 0.5, calibration: tk.Calibration | None = None) -> DataFrame:
    """(chrom_id, number, line_rank, line): GFF3 lines of the genes that a track (chrom_id, strand, pos, base, p) decodes to. records give the order of chromosomes."""
    regions = candidate_regions(track)
    found = decode.decode_regions(decode.region_views(track, regions), min_cds, min_intron, least_mean, calibration=calibration)
    exons = F.array_sort("exons")
    sided = found.join(records.select("chrom_id", "chrom_index"), "chrom_id").select("chrom_id", "chrom_index", "strand", exons.alias("exons"), F.array_min(F.transform("exons", lambda x: x["s"])).alias("s"), F.array_max(F.transform("exons", lambda x: x["e"])).alias("e"))
    return orfs.gff3_lines(orfs.ranked(sided))


def prepare(records: DataFrame, features: DataFrame, window: int = 40_960, flank: int = 4_096, overlap: int = 8_192, most_ambiguous: int = 327, by: gq.Rules | None = None) -> dict[str, DataFrame]:
    """From records (chrom_id, seq) and GFF features to windows with labels: hierarchy, choice of transcripts, all quality rules, conflicts, labelled windows.

    quality is what the rules say of the chosen transcripts and genes what becomes of every gene;
    labelling is quality with the genes masked whose labels would collide; windows are made from it.
    """
    parts = files.hierarchy(written(files.identified(features), "features"))  # attributes are parsed once
    parts = {name: written(df, name) for name, df in parts.items()}
    quality, every = gq.gene_quality(parts["genes"], parts["transcripts"], parts["children"], records, by)
    labelling = written(gq.label_safe(quality, parts["children"]), "labelling")
    cds = parts["children"].filter("type = 'cds'").select("tid", "s", "e", F.col("phase").alias("raw"))
    # genes without a transcript are masked where they stand, others where their transcript does
    masks = labelling.filter("mask < 1").select(F.col("seqid").alias("chrom_id"), "strand", "s", "e", F.col("mask").alias("weight"))
    painted = cds.join(labelling.filter("mask > 0").select("tid", "gid", F.col("seqid").alias("chrom_id"), "strand"), "tid")
    owned = written(painted.groupBy("chrom_id", "strand", "tid").agg(F.min("s").alias("s"), F.max("e").alias("e")), "owners")
    files.require(genes.ownership_violations(owned, ["chrom_id", "strand"]), "labels")
    tiles = tiling.training_windows(records, window, flank, overlap, most_ambiguous).join(records.select("chrom_id", F.length("seq").cast("long").alias("chrom_length")), "chrom_id")
    return {"quality": quality, "genes": every, "labelling": labelling, "windows": training.labelled_windows(tiles, painted, masks, flank)}


def write_prepared(prepared: dict[str, DataFrame], records: DataFrame, path: str, settings: object, overwrite: bool = False) -> None:
    """What prepare gave, below `path`: the dataset, tables of quality and selection, masked genes, a summary, the settings as they were resolved, and a manifest of counts.

    The manifest comes last, so a folder without it is incomplete.
    """
    spark = records.sparkSession
    files.write_dataset(prepared["windows"], f"{path}/dataset", overwrite=overwrite)
    quality, every = prepared["quality"], prepared["genes"]
    reports.write_tsv(reports.judged_table(quality), f"{path}/qc/transcripts")
    reports.write_tsv(reports.gene_table(every), f"{path}/qc/selected")
    reports.write_tsv(reports.masked_genes(every), f"{path}/qc/masked")
    reports.write_json(reports.summary(every.filter("judged"), quality), f"{path}/qc/summary")
    reports.write_json(spark.createDataFrame([(json.dumps(asdict(settings), sort_keys=True),)], "settings string"), f"{path}/settings")
    counts = [records.agg(F.count("*").alias("fasta_records")), every.agg(F.count("*").alias("parsed_genes")), spark.read.parquet(f"{path}/dataset").agg(F.count("*").alias("rows"))]
    found = {k: v for c in counts for k, v in c.first().asDict().items()}
    reports.write_json(spark.createDataFrame([(1, *found.values())], f"format_version int, {', '.join(f'{k} long' for k in found)}"), f"{path}/manifest")
