"""A stored track: one folder with its header, its manifest and its chunks, complete once its status says so.

A track is written below a staged name and takes its own name only after it has passed all checks, so a
reader never sees half of one. Header, manifest and status are small tables; chunks are Parquet files
that any number of tasks write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.sources import files

#: What the header of every track must say.
HEADER = {"format": "strandloom-track", "version": "1", "states": "15", "strands": "2", "coordinates": "0-based half-open", "normalization": "softmax per strand", "gaps": "none"}
MANIFEST_DDL = "chrom_id string, group_name string, chrom_length bigint, chrom_index bigint, num_windows bigint"


def manifest(windows: DataFrame) -> DataFrame:
    """(chrom_id, group_name, chrom_length, chrom_index, num_windows) of the windows of all records."""
    found = windows.groupBy("chrom_id").agg(F.max("chrom_length").alias("chrom_length"), F.max("chrom_index").alias("chrom_index"), F.count("*").alias("num_windows"))
    return found.select("chrom_id", F.expr(bases.group_name("chrom_id")).alias("group_name"), "chrom_length", "chrom_index", "num_windows")


def staged(spark: SparkSession, path: str) -> str:
    """The name below which the track of `path` is written. What an earlier run left there, finished or not, is removed."""
    for old in (path, f"{path}.staged"):
        fs, where = files.folder(spark, old)
        fs.delete(where, True)
    return f"{path}.staged"


def _status(spark: SparkSession, path: str, status: str, windows: int | None = None) -> None:
    spark.range(1).select(F.lit(status).alias("status"), F.lit(windows).cast("long").alias("num_windows")).write.mode("overwrite").parquet(f"{path}/status")


def initialise(spark: SparkSession, path: str, listed: DataFrame) -> None:
    """An empty track at `path` with its header and the manifest `listed`, marked incomplete. A manifest without records is an error."""
    if listed.isEmpty():
        raise files.Violation("a track needs at least one record")
    spark.createDataFrame(list(HEADER.items()), "name string, value string").coalesce(1).write.parquet(f"{path}/header")
    listed.write.parquet(f"{path}/manifest")
    _status(spark, path, "incomplete")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Adds rows (chrom_id, global_window_index, write_start, write_end, ...) to the track, whole files at a time."""
    chunks.write.mode("append").parquet(f"{path}/chunks")


def header_violations(header: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """(name, problem): entries that miss, aren't known, stand twice or have another value than `expected`."""
    want = header.sparkSession.createDataFrame(list((expected or HEADER).items()), "name string, wanted string")
    held = header.groupBy("name").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    both = want.join(held, "name", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("n") > 1, "stands twice").when(~F.col("value").eqNullSafe(F.col("wanted")), "another value")
    return both.select("name", problem.alias("problem")).filter("problem IS NOT NULL")


def naming_violations(listed: DataFrame) -> DataFrame:
    """(chrom_id, problem) of records without an id, with a length below 1, without a window, or whose group name isn't that of their id."""
    problem = (
        F.when(F.coalesce(F.length("chrom_id"), F.lit(0)) == 0, "no id").when(F.coalesce("chrom_length", F.lit(0)) < 1, "no length").when(F.coalesce("num_windows", F.lit(0)) < 1, "no windows")
        .when(~F.col("group_name").eqNullSafe(F.expr(bases.group_name("chrom_id"))), "group name isn't that of the id")
    )
    return listed.select("chrom_id", problem.alias("problem")).filter("problem IS NOT NULL")


def coverage_violations(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chrom_id, problem): records whose windows, in their order, leave a gap, overlap, don't end with the record, or aren't as many as listed; and windows of records that aren't listed."""
    order = Window.partitionBy("chrom_id").orderBy("write_start", "write_end")
    joint = chunks.select("chrom_id", "write_start", "write_end", F.coalesce(F.lag("write_end").over(order), F.lit(0)).alias("before"))
    held = joint.groupBy("chrom_id").agg(F.count("*").alias("n"), F.max("write_end").alias("last"), F.bool_or(F.col("write_start") != F.col("before")).alias("torn"))
    both = listed.join(held, "chrom_id", "full")
    problem = (
        F.when(F.col("chrom_length").isNull(), "not in the manifest").when(F.col("n").isNull(), "no windows written").when(F.col("torn"), "gap or overlap")
        .when(F.col("last") != F.col("chrom_length"), "not covered to its end").when(F.col("n") != F.col("num_windows"), "another number of windows")
    )
    return both.select("chrom_id", problem.alias("problem")).filter("problem IS NOT NULL")


def order_violations(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chrom_id, problem): window numbers that stand twice or lie outside 0 to the number of listed windows - 1."""
    total = listed.agg(F.coalesce(F.sum("num_windows"), F.lit(0)).alias("total")).first().total
    numbers = chunks.groupBy("global_window_index").agg(F.count("*").alias("n"), F.min("chrom_id").alias("chrom_id"))
    problem = F.when(F.col("n") > 1, "window number stands twice").when(F.col("global_window_index").isNull() | ~F.col("global_window_index").between(0, total - 1), "window number out of range")
    return numbers.select("chrom_id", problem.alias("problem")).filter("problem IS NOT NULL")


def sequence_violations(listed: DataFrame, records: DataFrame) -> DataFrame:
    """(chrom_id, problem) of listed records that the FASTA records (chrom_id, seq) lack or have with another length."""
    lengths = records.groupBy("chrom_id").agg(F.max(F.length("seq")).cast("long").alias("length"))
    problem = F.when(F.col("length").isNull(), "absent from the sequences").when(F.col("length") != F.col("chrom_length"), "another length")
    return listed.join(lengths, "chrom_id", "left").select("chrom_id", problem.alias("problem")).filter("problem IS NOT NULL")


def validate(spark: SparkSession, path: str, records: DataFrame | None = None, status: str = "complete") -> None:
    """Raises if the track's header, status, manifest, chunks, or lengths against `records`, are not as they must be."""
    listed, chunks = spark.read.parquet(f"{path}/manifest"), spark.read.parquet(f"{path}/chunks")
    said = [r.status for r in spark.read.parquet(f"{path}/status").limit(2).collect()]
    if said != [status]:
        raise files.Violation(f"status is {said}, not {status}")
    files.require(header_violations(spark.read.parquet(f"{path}/header")), "header")
    files.require(naming_violations(listed), "manifest")
    files.require(files.manifest_order_violations(listed), "manifest")
    files.require(coverage_violations(listed, chunks), "coverage")
    files.require(order_violations(listed, chunks), "order of windows")
    if records is not None:
        files.require(sequence_violations(listed, records), "sequences")


def finalise(spark: SparkSession, path: str, target: str) -> None:
    """Checks the track at `path`, marks it complete and gives it the name `target`. A track that fails stays incomplete and where it is."""
    validate(spark, path, status="incomplete")
    _status(spark, path, "complete", spark.read.parquet(f"{path}/chunks").count())
    fs, where = files.folder(spark, path)
    if not fs.rename(where, files.folder(spark, target)[1]):
        raise files.Violation(f"{path} can't be renamed to {target}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of a complete track with chrom_length and chrom_index of its manifest. An incomplete one is an error."""
    said = spark.read.parquet(f"{path}/status").filter("status = 'complete'")
    if said.isEmpty():
        raise files.Violation(f"{path} is incomplete")
    listed = spark.read.parquet(f"{path}/manifest").select("chrom_id", "chrom_length", "chrom_index")
    return spark.read.parquet(f"{path}/chunks").drop("chrom_length", "chrom_index").join(listed, "chrom_id")
