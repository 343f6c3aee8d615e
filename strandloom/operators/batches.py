"""Batches for several ranks, all full: rows in a reproducible order, and padding rows that weigh nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import ranks


def batches(rows: DataFrame, key: str, world: int, size: int, seed: int | None = None, mask: str | None = None, weightless: Column | None = None) -> DataFrame:
    """`rows` with step, rank and slot: batch `step` of each of `world` ranks has the slots 0 to size - 1.

    key: a column that is different in all rows. Rows are ordered by it, or by its hash under `seed`.
    The last step is filled up with rows from the beginning, again and again if there are few, which
    `padding` marks and whose column `mask` becomes `weightless` (which finds the columns in `row`). An empty table gives no rows. Rows
    are numbered in ranges, so no task orders them all; the number of rows is the only thing collected.
    """
    if world < 1 or size < 1 or (mask is None) != (weightless is None):
        raise ValueError("world and size must be 1 or more; mask and weightless come together")
    order = F.struct(F.xxhash64(F.lit(seed), key), F.col(key)) if seed is not None else F.struct(F.col(key))
    keyed = rows.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]).alias("row"), order.alias("__order"), F.lit(1).alias("__one"))
    numbered = ranks.sums_before(keyed, "__order", "__one", "n")
    total, whole = rows.count(), world * size
    missing = -total % whole
    every = F.expr(f"sequence(n, {total + missing - 1}L, {max(total, 1)}L)")  # the row itself, and where it stands again as padding
    placed = numbered.withColumn("n", F.explode(every)).withColumn("padding", F.col("n") >= total)
    fields = [F.col("row").getField(c) for c in rows.columns]
    if mask is not None:
        fields = [F.when(F.col("padding"), weightless).otherwise(f) if c == mask else f for c, f in zip(rows.columns, fields, strict=True)]
    at = F.col("n") % whole
    return placed.select(*[f.alias(c) for c, f in zip(rows.columns, fields, strict=True)], F.expr(f"n div {whole}").alias("step"), (at % world).cast("int").alias("rank"), F.expr(f"cast((n % {whole}) div {world} as int)").alias("slot"), "padding")
