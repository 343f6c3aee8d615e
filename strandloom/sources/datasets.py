"""Collections of training datasets: found below a folder, checked, and read as one table of the needed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.sources.files import Violation, require

COLUMNS = ("input_ids", "labels", "loss_mask")
#: Lengths must be multiples of what the model halves them by.
FACTOR = 16


def discover(spark: SparkSession, root: str) -> list[str]:
    """The folders below `root` that hold Parquet files, sorted. What lies below such a folder belongs to it; Spark skips hidden ones.

    Only names are read. The list is one of folders, not of files or rows.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    found: list[str] = []
    for row in names.orderBy("folder").toLocalIterator():
        if not any(row.folder.startswith(f"{f}/") for f in found):
            found.append(row.folder)
    if not found:
        raise Violation(f"no dataset below {root}")
    return found


def geometry_violations(rows: DataFrame) -> DataFrame:
    """(problem, n): how many rows break a rule of input_ids (first 0, last 1, a multiple of 16 between) or of labels (two strands of that length)."""
    n = F.size("input_ids") - 2
    ids = F.col("input_ids")
    problem = (
        F.when(F.coalesce(n, F.lit(0)) < 1, "too few ids").when(n % FACTOR != 0, f"length is no multiple of {FACTOR}").when((F.get(ids, F.lit(0)) != 0) | (F.element_at(ids, -1) != 1), "first or last id")
        .when((F.size("labels") != 2) | F.exists("labels", lambda x: F.coalesce(F.size(x), F.lit(-1)) != n), "labels of another length")
    )
    return rows.select(problem.alias("problem")).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def collection(spark: SparkSession, root: str, every_row: bool = False) -> DataFrame:
    """(source, input_ids, labels, loss_mask) of all datasets below `root`, which must agree in length.

    The first row of each dataset is checked, or with `every_row` all of them. A dataset that is empty
    or lacks a column is an error.
    """
    parts, lengths = [], set()
    for source in discover(spark, root):
        rows = spark.read.parquet(source)
        missing = [c for c in COLUMNS if c not in rows.columns]
        if missing:
            raise Violation(f"{source} lacks {missing}")
        first = rows.select("input_ids", "labels").limit(1)
        said = first.select(F.size("input_ids").alias("n")).collect()
        if not said:
            raise Violation(f"{source} is empty")
        require(geometry_violations(rows if every_row else first), source)
        lengths.add(said[0].n - 2)
        parts.append(rows.select(F.lit(source.rsplit("/", 1)[-1]).alias("source"), *COLUMNS))
    if len(lengths) > 1:
        raise Violation(f"datasets have the lengths {sorted(lengths)}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def shares(rows: DataFrame) -> DataFrame:
    """(source, rows, share): how much of a collection each source is."""
    counts = rows.groupBy("source").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))  # a row for each source


def split(rows: DataFrame, world: int, key: str) -> DataFrame:
    """`rows` with `rank` 0 to world - 1, by the hash of `key`: rows stay with their rank when others come or go."""
    return rows.withColumn("rank", F.pmod(F.xxhash64(key), F.lit(world)).cast("int"))


def window_violations(windows: DataFrame, window: int, flank: int) -> DataFrame:
    """(chrom_id, chrom_window_index, problem) of inference windows whose numbers, center or sequence don't fit together."""
    size = window - 2 * flank
    problem = (
        F.when(F.col("chrom_id").isNull() | F.col("chrom_window_index").isNull() | F.col("center_start").isNull() | F.col("center_end").isNull(), "null")
        .when((F.col("chrom_window_index") < 0) | (F.col("center_start") < 0), "negative").when(F.col("center_end") - F.col("center_start") != size, "center of another size")
        .when(F.col("center_start") >= F.col("chrom_length"), "behind the record").when(F.coalesce(F.length("sequence"), F.lit(0)) != window, "sequence of another length")
    )
    return windows.select("chrom_id", "chrom_window_index", problem.alias("problem")).filter("problem IS NOT NULL")
