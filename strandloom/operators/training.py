"""Training windows with labels and weights for both strands.

Blocks, introns and masks meet windows as intervals; only the last step, in a task and window by
window, writes arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.genes import in_transcript_order
from strandloom.operators.intervals import overlapping

# Donor states of a first block of two bases by annotated phase, and the ids of bases.
SHORT_DONOR = {0: 9, 1: 10, 2: 8}
IDS = {"A": 7, "C": 8, "G": 9, "T": 10}
DDL = "input_ids array<int>, labels array<array<tinyint>>, weights array<array<float>>"


def block_states(blocks: DataFrame) -> DataFrame:
    """`blocks` (tid, strand, s, e, raw phase) with what labels need of the rest of the transcript.

    entry is the reading frame at the block's first base. A first block of one or two bases takes its
    frame from the annotated phase, and what follows goes on from there.
    """
    order, whole = in_transcript_order("tid"), Window.partitionBy("tid")
    size = F.col("e") - F.col("s")
    out = blocks.withColumn("k", F.row_number().over(order)).withColumn("n_blocks", F.count("*").over(whole)).withColumn("total", F.sum(size).over(whole))
    out = out.withColumn("before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first = F.first(F.struct(size.alias("size"), F.coalesce("raw", F.lit(0)).alias("raw"))).over(order)
    out = out.withColumn("head", first)
    short = (F.col("n_blocks") > 1) & (F.col("head.size") < 3)
    entry = F.when(short & (F.col("k") > 1), F.col("head.raw") + 2 + F.col("before") - F.col("head.size")).otherwise(F.col("before")) % 3
    out = out.withColumn("entry", entry.cast("int"))
    left = F.when(short & (F.col("k") == 1), (F.col("head.raw") + 1) % 3).otherwise((F.col("entry") + size - 1) % 3)
    return out.withColumn("left_phase", left.cast("int")).drop("head")


def block_labels(size: int, entry: int, first: bool, last: bool, alone: bool, raw: int) -> np.ndarray:
    """Labels of a block's bases in transcript direction."""
    phase = (entry + np.arange(size)) % 3
    out = 4 + phase
    if not last:
        out[-1] = 8 + phase[-1]
    if not first:
        out[0] = 11 + phase[0]
    if first and size == 2 and not alone:
        out[1] = SHORT_DONOR.get(raw, 9)
    if last and size == 2 and not alone:
        out[0] = 5
    if last:
        out[-1] = 14
    if first:
        out[0] = 7
    return out.astype(np.int8)


def features(blocks: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(chrom_id, strand, rs, re, kind, entry, first, last, alone, raw, weight): blocks, introns and masks as intervals. masks: (chrom_id, strand, s, e, weight)."""
    known = block_states(blocks)
    order = in_transcript_order("tid")
    none = lambda t: F.lit(None).cast(t)
    coding = known.select(
        "chrom_id", "strand", F.col("s").alias("rs"), F.col("e").alias("re"), F.lit("block").alias("kind"), "entry", (F.col("k") == 1).alias("first"),
        (F.col("k") == F.col("n_blocks")).alias("last"), (F.col("n_blocks") == 1).alias("alone"), F.coalesce("raw", F.lit(0)).alias("raw"), none("double").alias("weight"),
    )
    gaps = known.withColumn("ns", F.lead("s").over(order)).withColumn("ne", F.lead("e").over(order)).filter("ns IS NOT NULL")
    plus = F.col("strand") == "+"
    gaps = gaps.select(
        "chrom_id", "strand", F.when(plus, F.col("e")).otherwise(F.col("ne")).alias("rs"), F.when(plus, F.col("ns")).otherwise(F.col("s")).alias("re"), F.lit("intron").alias("kind"),
        (1 + F.col("left_phase")).alias("entry"), F.lit(False).alias("first"), F.lit(False).alias("last"), F.lit(False).alias("alone"), F.lit(0).alias("raw"), none("double").alias("weight"),
    ).filter("re > rs")
    out = coding.unionByName(gaps)
    if masks is not None:
        sides = masks.withColumn("strand", F.explode(F.when(F.col("strand").isin("+", "-"), F.array("strand")).otherwise(F.array(F.lit("+"), F.lit("-")))))
        out = out.unionByName(sides.select("chrom_id", "strand", F.col("s").alias("rs"), F.col("e").alias("re"), F.lit("mask").alias("kind"), F.lit(0).alias("entry"), F.lit(False).alias("first"), F.lit(False).alias("last"), F.lit(False).alias("alone"), F.lit(0).alias("raw"), F.col("weight").cast("double").alias("weight")))
    return out


def paint(start: int, sequence: str, record_length: int, marks: list[dict], reset: bool) -> tuple[np.ndarray, np.ndarray]:
    """(labels, weights), two rows each, of one window. Padding weighs nothing; labels first, then masks by the least weight."""
    n = len(sequence)
    labels, weights = np.zeros((2, n), np.int8), np.ones((2, n), np.float32)
    weights[:, : max(0, -start)] = 0
    weights[:, max(0, min(n, record_length - start)) :] = 0
    for m in sorted(marks, key=lambda m: m["kind"] == "mask"):
        row = 0 if m["strand"] == "+" else 1
        lo, hi = max(m["rs"], start), min(m["re"], start + n)
        at = slice(lo - start, hi - start)
        if m["kind"] == "mask":
            weights[row, at] = np.minimum(weights[row, at], np.float32(m["weight"]))
            if reset and m["weight"] == 0:
                labels[row, at] = 0
        elif m["kind"] == "intron":
            labels[row, at] = m["entry"]
        else:
            own = block_labels(m["re"] - m["rs"], m["entry"], m["first"], m["last"], m["alone"], m["raw"])
            labels[row, at] = (own if row == 0 else own[::-1])[lo - m["rs"] : hi - m["rs"]]
    return labels, weights


def labelled_windows(windows: DataFrame, blocks: DataFrame, masks: DataFrame | None = None, flank: int = 4_096, reset: bool = True) -> DataFrame:
    """`windows` (chrom_id, window_start, window_end, window_id, chrom_length, sequence) with input_ids, labels and weights.

    blocks: those of the selected transcripts that may be painted. A window is dropped where the center
    of either strand weighs nothing.
    """
    marks = features(blocks, masks)
    spans = windows.select("chrom_id", "window_id", F.col("window_start").alias("s"), F.col("window_end").alias("e"))
    met = overlapping(spans, marks, ["chrom_id"], 16_384)
    fields = ["strand", "rs", "re", "kind", "entry", "first", "last", "alone", "raw", "weight"]
    met = met.groupBy("window_id").agg(F.collect_list(F.struct(*fields)).alias("marks"))
    joined = windows.join(met, "window_id", "left").select("chrom_id", "window_start", "window_end", "window_id", "chrom_length", "sequence", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, ids, labels, weights = [], [], [], []
            for k, r in enumerate(batch.to_pylist()):
                y, w = paint(r["window_start"], r["sequence"], r["chrom_length"], r["marks"] or [], reset)
                center = slice(flank, len(r["sequence"]) - flank)
                if not (w[:, center] == 0).all(axis=1).any():
                    keep.append(k)
                    ids.append([0, *(IDS.get(b, 11) for b in r["sequence"]), 1])
                    labels.append(y.tolist())
                    weights.append(w.tolist())
            head = [batch.column(c).take(pa.array(keep, pa.int64())) for c in range(4)]
            tail = [pa.array(ids, pa.list_(pa.int32())), pa.array(labels, pa.list_(pa.list_(pa.int8()))), pa.array(weights, pa.list_(pa.list_(pa.float32())))]
            yield pa.RecordBatch.from_arrays([*head, *tail], names=["chrom_id", "window_start", "window_end", "window_id", "input_ids", "labels", "weights"])

    return joined.mapInArrow(run, f"chrom_id string, window_start bigint, window_end bigint, window_id string, {DDL}")
