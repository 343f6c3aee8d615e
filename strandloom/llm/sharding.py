"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in source blocks. How many rows each block sends to each shard is drawn first, exactly as
a uniform random permutation of all rows would give it: block by block and shard by shard, each
count is hypergeometric in what is left. Rows are then permuted inside their block and cut at the
drawn counts, exchanged, and permuted again inside the shard. No global sort takes place.

Only the counts, at most MAX_BLOCKS times the number of shards, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.plans.session import table, written

MAX_BLOCKS = 4096
SQL = None


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!), exact to double precision: a table below 16, Stirling's series above."""
    y = f"cast(greatest({x}, 16L) as double)"
    return (
        f"CASE WHEN {x} < 16 THEN ln(cast(factorial(cast({x} as int)) as double)) ELSE ({y} + 0.5) * ln({y}) - {y} + 0.9189385332046727"
        f" + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) END"
    )


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - ({_ln_factorial(k)}) - ({_ln_factorial(f'({n} - {k})')}))"


def hypergeometric(pool: str, marked: str, drawn: str, u: str) -> str:
    """SQL for a hypergeometric variate: the marked ones among `drawn` of `pool`, of which `marked` are marked.

    Inversion of the uniform `u`, outward from the mode, by the ratios of neighbouring probabilities.
    The walk spans nine standard deviations; beyond lies less than 1e-18.
    """
    start = (
        f"struct({pool} AS p, {marked} AS m, {drawn} AS d, {u} AS u, "
        f"least(greatest(cast(floor((cast({drawn} as double) + 1) * ({marked} + 1) / ({pool} + 2)) as bigint), {drawn} - ({pool} - {marked}), 0L), {drawn}, {marked}) AS mode)"
    )
    first = f"exp({_ln_choose('z.m', 'z.mode')} + {_ln_choose('(z.p - z.m)', '(z.d - z.mode)')} - {_ln_choose('z.p', 'z.d')})"
    steps = "cast(20 + 9 * sqrt(cast(z.d as double) * z.m / z.p * (z.p - z.m) / z.p * (z.p - z.d) / greatest(z.p - 1, 1L)) as int)"
    up = "w.up * (cast(z.m - w.a as double) * (z.d - w.a)) / (cast(w.a + 1 as double) * greatest(z.p - z.m - z.d + w.a + 1, 1L))"
    down = "w.down * (cast(w.b as double) * (z.p - z.m - z.d + w.b)) / (cast(z.m - w.b + 1 as double) * (z.d - w.b + 1))"
    walk = f"""aggregate(sequence(1, {steps}),
        struct(z.u - f AS rest, z.mode AS a, f AS up, z.mode AS b, f AS down, CASE WHEN z.u < f THEN z.mode ELSE -1L END AS k),
        (w, i) -> CASE WHEN w.k >= 0 THEN w ELSE
            struct(w.rest - ({up}) - ({down}) AS rest, w.a + 1 AS a, {up} AS up, w.b - 1 AS b, {down} AS down,
                CASE WHEN w.rest < ({up}) THEN w.a + 1 WHEN w.rest < ({up}) + ({down}) THEN w.b - 1 ELSE -1L END AS k) END,
        w -> CASE WHEN w.k >= 0 THEN w.k ELSE z.mode END)"""
    drawn_k = f"element_at(transform(array({first}), f -> {walk}), 1)"
    return f"element_at(transform(array({start}), z -> CASE WHEN z.d = 0 OR z.m = 0 THEN 0L WHEN z.m = z.p THEN z.d ELSE {drawn_k} END), 1)"


def communication_matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(block, n) -> (block, upto), upto[s] rows of the block going to the shards 0 to s. Shards get equal totals, at most one apart."""
    draw = hypergeometric(
        "i.pool", "element_at(o.left, s + 1)", "i.need",
        f"((shiftrightunsigned(xxhash64({seed}L, b.block, s), 11) + 0.5D) / 9007199254740992D)",
    )
    inner = f"""aggregate(sequence(0, {n_shards - 1}),
        struct(b.n AS need, aggregate(o.left, 0L, (x, y) -> x + y) AS pool, cast(array() as array<bigint>) AS taken),
        (i, s) -> element_at(transform(array({draw}), k -> struct(i.need - k AS need, i.pool - element_at(o.left, s + 1) AS pool, concat(i.taken, array(k)) AS taken)), 1),
        i -> i.taken)"""
    outer = f"""aggregate(blocks,
        struct(transform(sequence(0, {n_shards - 1}), s -> total div {n_shards} + CASE WHEN s < total % {n_shards} THEN 1L ELSE 0L END) AS left,
               cast(array() as array<struct<block:bigint,taken:array<bigint>>>) AS rows),
        (o, b) -> element_at(transform(array({inner}), t -> struct(zip_with(o.left, t, (x, y) -> x - y) AS left, concat(o.rows, array(struct(b.block AS block, t AS taken))) AS rows)), 1),
        o -> o.rows)"""
    whole = counts.agg(F.sort_array(F.collect_list(F.struct("block", "n"))).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    rows = whole.select(F.explode(F.expr(outer)).alias("r")).select("r.block", "r.taken")
    return rows.select(
        "block",
        F.expr("transform(taken, (x, i) -> aggregate(slice(taken, 1, i + 1), 0L, (p, q) -> p + q))").alias("upto"),
    )


def hypergeometric_shards(rows: DataFrame, n_shards: int = 40, seed: int = 17, rows_per_block: int = 250_000, least_blocks: int = 64) -> DataFrame:
    """`rows` with shard and slot (gapless from 0 inside each shard), a uniform random shuffle under `seed`.

    rows: what identifies a record, without its payload (it is written to the shared folder twice).
    Columns named shard or slot are replaced. Repeated rows are kept, each in a place of its own; an
    empty table gives an empty one; nulls are values like any other.
    """
    own = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    rows = rows.select(*own)
    placed = written(rows.withColumn("__part", F.spark_partition_id()), "shard-keys")
    n = placed.count()
    n_blocks = min(MAX_BLOCKS, max(least_blocks, -(-n // rows_per_block)))
    identity: list[Column] = [F.col(f"`{c}`") for c in own]
    block = F.pmod(F.xxhash64(F.lit(seed), "__part", *identity), F.lit(n_blocks))
    placed = placed.withColumn("__block", block)
    matrix = communication_matrix(placed.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")), n_shards, seed)
    local = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 1), "__part", *identity), "__part", *identity)
    sent = (
        placed.withColumn("__rank", F.row_number().over(local) - 1)
        .join(F.broadcast(matrix.withColumnRenamed("block", "__block")), "__block")  # MAX_BLOCKS rows at most
        .withColumn("shard", F.expr("size(filter(upto, x -> x <= __rank))"))
        .withColumn("__order", F.xxhash64(F.lit(seed + 2), "__block", "__rank"))
        .withColumn("__bin", F.pmod("__order", F.lit(n_blocks)))
        .drop("upto")
    )
    sent = written(sent, "shard-sent")
    first = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sent.groupBy("shard", "__bin").agg(F.count("*").alias("__n"))
    bins = bins.withColumn("__first", F.coalesce(F.sum("__n").over(first), F.lit(0))).drop("__n")
    again = Window.partitionBy("shard", "__bin").orderBy("__order", "__block", "__rank")
    return (
        sent.withColumn("__at", F.row_number().over(again) - 1)
        .join(F.broadcast(bins), ["shard", "__bin"])  # MAX_BLOCKS x n_shards rows at most
        .select(*identity, F.col("shard"), (F.col("__first") + F.col("__at")).alias("slot"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards under the law `rows`."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    out = hypergeometric_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
