"""A corpus made ready for training: the stages of strandloom.llm one after another over `documents`.

Every stage takes (spark, docs, sf_dir), and its rows are written as Parquet and read again as the
next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, fertility, jaccard_join, packing, pii
from strandloom.plans.session import table, written

#: The stages count tokens and walk link graphs, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """`name`, or one like it that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _own(docs: DataFrame) -> list[Column]:
    """The columns of `docs`, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the tokenizers' bands keep, with all their columns.

    The verdict is one of text and language, and only what is rejected is written and taken away.
    Null and empty texts go; rows with null ids or languages are judged like others; repeated rows are
    kept or go together. Other columns may have any names.
    """
    key = _free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    judged = fertility.judged(keyed.select(F.col(key).alias("__key"), "text", "lang"), carried=["__key", "lang"]).filter("NOT __kept")
    rejected = written(judged.select(F.col("__key").alias("rejected"), F.col("lang").alias("of")).distinct(), "rejected")
    gone = (keyed[key] == rejected.rejected) & keyed.lang.eqNullSafe(rejected.of)
    return keyed.join(rejected, gone, "left_anti").select(*_own(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that of the smallest id; rows without an id come after all others.

    Rows are told apart by id and text: an id with several texts, or rows without an id, are as many
    documents, each kept or not by its own component. Of rows with equal id and text one is kept. A
    text without words is near to nothing. Other columns may have any names.
    """
    row = _free(docs, "document")
    keyed = docs.withColumn(row, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")))
    found = jaccard_join.near_duplicates(keyed.select(F.col(row).alias("__row"), "text"), doc="__row")
    kept = found.select(F.col("component_id").alias(row)).distinct()
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, as they are: a text's rows are kept or go together, null and empty ones are kept. Other columns may have any names."""
    key = _free(docs, "text_key")
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaked = found.filter("n_hit > 0").select(F.col("text_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed.join(leaked, key, "left_anti").select(*_own(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; n_chars is that of the new text.

    Null texts stay null with n_chars 0, repeated rows and rows without an id stay. Other columns may have any names.
    """
    clean = pii.redacted(docs.select("doc_id", "text", F.struct(*_own(docs)).alias("row")))
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}
    return clean.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, and where they lie in which sequence."""
    return packing.pack(written(packing.pieces(docs, packing.vocabulary_path()), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
