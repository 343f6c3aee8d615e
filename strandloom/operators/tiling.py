"""Fixed windows over records, sampled windows, and the checks on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import ranks


#: Records are cut into pieces of this many bases before windows are taken, so that a window costs its own length and not that of its record.
PIECE = 1 << 14


def pieces(seq: str) -> str:
    """SQL: `seq` as an array of pieces, in order; all but the last have PIECE bases."""
    return f"regexp_extract_all({seq}, '(?s).{{1,{PIECE}}}', 0)"


def part(held: str, at: str, n: str) -> str:
    """SQL: `n` bases from 0-based `at` of the record whose pieces are `held`; `at` and `n` are 0 or more, and what lies behind the record is left out."""
    return f"substr(array_join(slice({held}, cast(({at}) div {PIECE} as int) + 1, cast((({at}) % {PIECE} + ({n})) div {PIECE} as int) + 1), ''), cast(({at}) % {PIECE} as int) + 1, cast({n} as int))"


def padded(held: str, size: str, start: str, length: int) -> str:
    """SQL: `length` bases from 0-based `start`, which may be negative, of a record of `size` bases in the pieces `held`, with N beyond both ends."""
    at = f"greatest({start}, 0)"
    n = f"greatest(least({start} + {length}, {size}) - {at}, 0)"
    before = f"least(greatest(-({start}), 0), {length})"
    return f"concat(repeat('N', cast({before} as int)), {part(held, at, n)}, repeat('N', cast(greatest({length} - {n} - {before}, 0) as int)))"


def inference_windows(records: DataFrame, window: int = 40_960, flank: int = 5_120, min_length: int = 1) -> DataFrame:
    """(chrom_id, chrom_index, chrom_length, chrom_window_index, center_start, center_end, sequence).

    Centers of window - 2 flank bases follow one another; a rest gets one more center that ends with
    the record. A record shorter than a center has one, whose end lies beyond the record.
    """
    center = window - 2 * flank
    starts = f"transform(sequence(0L, greatest(chrom_length div {center} - 1, 0L)), i -> i * {center}L)"
    terminal = f"CASE WHEN chrom_length > {center} AND chrom_length % {center} <> 0 THEN array(chrom_length - {center}) ELSE cast(array() as array<bigint>) END"
    sized = records.withColumn("chrom_length", F.length("seq").cast("long")).filter(F.col("chrom_length") >= max(min_length, 1))
    tiles = sized.select("chrom_id", "chrom_index", "chrom_length", F.expr(pieces("seq")).alias("held"), F.expr(f"concat({starts}, {terminal})").alias("starts"))
    tiles = tiles.select("chrom_id", "chrom_index", "chrom_length", "held", F.posexplode("starts").alias("chrom_window_index", "center_start"))
    return tiles.select(
        "chrom_id", "chrom_index", "chrom_length", F.col("chrom_window_index").cast("long").alias("chrom_window_index"), "center_start",
        (F.col("center_start") + center).alias("center_end"), F.expr(padded("held", "chrom_length", f"(center_start - {flank})", window)).alias("sequence"),
    )


def training_starts(length: str, window: int, flank: int, overlap: int) -> str:
    """SQL: the starts of training windows, the first one negative by the flank, the last one ending its center with the record."""
    center = window - 2 * flank
    step = min(window - overlap, center)
    return (
        f"CASE WHEN {length} <= {center} THEN array(cast(-{flank} as bigint)) ELSE array_distinct(concat("
        f"transform(sequence(0L, ({length} - {center}) div {step}), i -> i * {step}L - {flank}), array({length} - {center} - {flank}))) END"
    )


def training_windows(records: DataFrame, window: int = 40_960, flank: int = 4_096, overlap: int = 8_192, most_ambiguous: int = 327, min_length: int = 1) -> DataFrame:
    """(chrom_id, window_start, window_end, window_id, sequence, ambiguous) of windows whose center has few enough ambiguous bases."""
    center = window - 2 * flank
    sized = records.withColumn("length", F.length("seq").cast("long")).filter(F.col("length") >= max(min_length, 1))
    tiles = sized.select("chrom_id", "length", F.expr(pieces("seq")).alias("held"), F.expr(training_starts("length", window, flank, overlap)).alias("starts"))
    tiles = tiles.select("chrom_id", "length", "held", F.explode("starts").alias("window_start"))
    real = part("held", f"window_start + {flank}", f"least({center}, length - window_start - {flank})")
    tiles = tiles.withColumn("ambiguous", F.expr(f"length(regexp_replace({real}, '[ACGT]', ''))")).filter(F.col("ambiguous") <= most_ambiguous)
    return tiles.select(
        "chrom_id", "window_start", (F.col("window_start") + window).alias("window_end"),
        F.format_string("%s:%d-%d", "chrom_id", "window_start", F.col("window_start") + window).alias("window_id"), F.expr(padded("held", "length", "window_start", window)).alias("sequence"), "ambiguous",
    )


def sampling_plan(records: DataFrame, least: int = 512_000, most: int = 2_000_000, stratum: int = 5_000_000, strata: tuple[int, int] = (16, 64), step: int = 50) -> DataFrame:
    """(chrom_id, start, stop): about a hundredth of each record in aligned windows, one in the middle of each stratum; all of a short record."""
    target = f"least(greatest((length + 99) div 100, {least}L), {most}L, length)"
    n = f"least(greatest((length + {stratum - 1}) div {stratum}, {strata[0]}L), {strata[1]}L)"
    plan = records.withColumn("target", F.expr(target)).withColumn("n", F.expr(f"CASE WHEN target * 5 >= length * 4 THEN 1L ELSE {n} END"))
    plan = plan.withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
    plan = plan.withColumn("width", F.expr(f"greatest(target div n div {step} * {step}, {step}L)"))
    plan = plan.withColumn("lo", F.expr("length * i div n")).withColumn("hi", F.expr("length * (i + 1) div n"))
    middle = f"((lo + hi - width) div 2 + {step // 2}) div {step} * {step}"
    plan = plan.withColumn("start", F.expr(f"CASE WHEN n = 1 THEN 0L ELSE least(greatest({middle}, (lo + {step - 1}) div {step} * {step}), greatest((hi - width) div {step} * {step}, (lo + {step - 1}) div {step} * {step})) END"))
    return plan.select("chrom_id", "start", F.expr("CASE WHEN n = 1 THEN length ELSE least(start + width, length) END").alias("stop"))


def write_intervals(windows: DataFrame) -> DataFrame:
    """`windows` with the part of its center that no window before it has: (write_start, write_end), and whether it follows on."""
    from pyspark.sql import Window

    order = Window.partitionBy("chrom_id").orderBy("chrom_window_index")
    before = F.coalesce(F.lag("center_end").over(order), F.lit(0))
    return windows.withColumn("write_start", F.greatest("center_start", before)).withColumn("write_end", F.least("center_end", "chrom_length")).withColumn("follows", F.col("center_start") <= before)


def global_index(windows: DataFrame, chunk_size: int = 50_000) -> DataFrame:
    """`windows` with global_window_index, chunk_id from 1 and chunk_local_index. Records are numbered by ranges."""
    counts = windows.groupBy("chrom_index").agg(F.count("*").alias("n"))
    counts = ranks.sums_before(counts, "chrom_index", "n", "first").drop("n")
    at = F.col("first") + F.col("chrom_window_index")
    return windows.join(counts, "chrom_index").withColumn("global_window_index", at).withColumn("chunk_id", F.expr(f"(first + chrom_window_index) div {chunk_size} + 1")).withColumn("chunk_local_index", at % chunk_size).drop("first")
