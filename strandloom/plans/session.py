"""Reading the given tables and cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 250_000) -> DataFrame:
    """`df` (a table, or a plain selection of one) in partitions of about `rows` rows by `key`, as many as the table asks for: what follows by this key and others beside it stays there.

    The count is read from the footers of the files.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), key)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
