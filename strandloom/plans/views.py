"""Domain tables derived by Spark from the driver's tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.session import dealt, table

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Letters stand for bases in turn; four rare ones for ambiguous bases.
_AMBIGUOUS = {"q": "N", "x": "N", "j": "R", "z": "Y"}
_BASES = "".join(_AMBIGUOUS.get(c, "ACGT"[i % 4]) for i, c in enumerate(_LETTERS))
TRANSLATED = (_LETTERS + _LETTERS.upper(), _BASES * 2)

GENOME = f"""genome AS (SELECT 'd' || doc_id AS chrom_id, doc_id AS chrom_index,
    translate(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g'), '{TRANSLATED[0]}', '{TRANSLATED[1]}') AS seq FROM documents)"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom_id, chrom_index, seq): a record for each document."""
    seq = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""), *TRANSLATED)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("chrom_id"), F.col("doc_id").alias("chrom_index"), seq.alias("seq"))


INTERVALS = """intervals AS (SELECT user_id AS chrom, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 AS e, event_id AS id FROM events)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, s, e, id): an hour from each event on, users as chromosomes."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("chrom"), s.alias("s"), (s + 3600).alias("e"), F.col("event_id").alias("id"))


SPAN = 2_000_000
GENES = f"""gene AS (SELECT o_orderkey AS gid, 'c' || (o_custkey % 8) AS seqid, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
    (o_orderkey * 7919) % {SPAN} AS gs FROM orders),
numbered AS (SELECT l_orderkey AS gid, l_orderkey || '.' || l_returnflag AS tid, l_quantity, l_linenumber, l_linestatus,
    row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus, l_shipdate) AS rn FROM lineitem),
block AS (SELECT n.gid, tid, seqid, strand, rn, gs + 500 * rn AS s, gs + 500 * rn + (3 * l_quantity)::BIGINT - (l_linenumber % 2) AS e,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS flagged FROM numbered n JOIN gene g ON n.gid = g.gid)"""


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gid, seqid, strand, gs)."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("gid"), F.concat(F.lit("c"), (F.col("o_custkey") % 8).cast("string")).alias("seqid"),
        F.when(key % 2 == 0, "+").otherwise("-").alias("strand"), ((key * 7919) % SPAN).alias("gs"),
    )


def blocks(spark: SparkSession, sf_dir: str, flagged: bool = True) -> DataFrame:
    """(gid, tid, seqid, strand, rn, s, e, flagged): coding blocks of up to three transcripts a gene, dealt by gene. Without flags fewer columns of line items are moved."""
    found = numbered_lines(spark, sf_dir, *(["l_linestatus"] if flagged else []), "l_quantity", "l_linenumber").join(genes(spark, sf_dir), "gid")
    return found.select(
        "gid", F.concat_ws(".", F.col("gid").cast("string"), "l_returnflag").alias("tid"), "seqid", "strand", "rn", (F.col("gs") + 500 * F.col("rn")).alias("s"),
        (F.col("gs") + 500 * F.col("rn") + (3 * F.col("l_quantity")).cast("long") - F.col("l_linenumber") % 2).alias("e"), *([F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("flagged")] if flagged else []),
    )


#: What line items of an order and return flag are numbered by. Of line items that are equal up to the last of the columns asked for, either may come first.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")


def numbered_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(gid, l_returnflag, rn, columns) of every line item, dealt by order; rn counts the line items of an order and return flag."""
    from pyspark.sql import Window

    by = _needed(columns)
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("gid"), "l_returnflag", *by), "gid")
    order = Window.partitionBy("gid", "l_returnflag").orderBy(*by)
    return lines.select("gid", "l_returnflag", F.row_number().over(order).cast("long").alias("rn"), *columns)


def _needed(columns: tuple[str, ...]) -> tuple[str, ...]:
    """What of LINE_ORDER tells line items apart that differ in `columns`, or stand before one that does."""
    return LINE_ORDER[: max((LINE_ORDER.index(c) + 1 for c in columns), default=1)]


#: Logits are embeddings, stretched, with the background state of each strand raised.
LOGITS = """logits AS (SELECT vec_id AS pos, strand, list_transform(range(1, 16), lambda i: 12.0::DOUBLE * embedding[strand * 15 + i] + CASE WHEN i = 1 THEN 3.0 ELSE 0.0 END) AS z
    FROM embeddings, (SELECT unnest([0, 1]) AS strand)),
track AS (SELECT pos, strand, list_transform(x, lambda v: v / list_sum(x)) AS p FROM
    (SELECT pos, strand, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM logits))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, strand, z): 15 state logits for each position and strand."""
    both = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("strand"))
    z = "transform(slice(embedding, strand * 15 + 1, 15), (v, i) -> 12.0D * cast(v as double) + CASE WHEN i = 0 THEN 3.0D ELSE 0.0D END)"
    return both.select("pos", "strand", F.expr(z).alias("z"))
