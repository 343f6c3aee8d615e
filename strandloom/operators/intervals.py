"""Interval algebra: merging, gaps and islands, bucketed range joins, overlays. Intervals are half open.

What has to be in order is put in order inside stripes of fixed length, so that a chromosome is as many
tasks as it has stripes. Only islands that touch a stripe's border, two a stripe at most, are then put
together along the chromosome.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a stripe: of bases, and of bins.
STRIPE, BINS = 1 << 22, 1 << 18


def stripe_of(at: Column | str, stripe: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return ((at - F.pmod(at, F.lit(stripe))) / stripe).cast("long")


def in_stripes(intervals: DataFrame, stripe: int) -> DataFrame:
    """`intervals` (s, e, ...) cut at the borders of stripes, with the stripe of each piece as __stripe."""
    every = F.sequence(stripe_of("s", stripe), stripe_of(F.greatest(F.col("e") - 1, F.col("s")), stripe))
    cut = intervals.withColumn("__stripe", F.explode(every))
    return cut.withColumn("s", F.greatest(F.col("s"), F.col("__stripe") * stripe)).withColumn("e", F.least(F.col("e"), (F.col("__stripe") + 1) * stripe))


def _across(parts: DataFrame, keys: list[str], stripe: int, goes_on, totals: list[Column]) -> DataFrame:
    """Pieces (keys, __stripe, s, e, ...) put together over the borders of stripes, where `goes_on(order)` says so; others stay alone."""
    border = (F.pmod("s", F.lit(stripe)) == 0) | (F.pmod("e", F.lit(stripe)) == 0)
    alone = parts.withColumn("__in", F.when(~border, F.col("__stripe")))
    order = Window.partitionBy(*keys, "__in").orderBy("s", "e")
    fresh = F.when(F.col("__in").isNull() & F.coalesce(goes_on(order), F.lit(False)), 0).otherwise(1)
    numbered = alone.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__in", "__run").agg(F.min("s").alias("s"), F.max("e").alias("e"), *totals).drop("__in", "__run")


def merge(intervals: DataFrame, keys: list[str], stripe: int = STRIPE) -> DataFrame:
    """(keys, s, e): overlapping and touching intervals made one."""
    order = Window.partitionBy(*keys, "__stripe").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = in_stripes(intervals.select(*keys, "s", "e"), stripe).withColumn("fresh", F.when(F.col("s") <= reach, 0).otherwise(1))
    numbered = numbered.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = numbered.groupBy(*keys, "__stripe", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")
    return _across(inside, keys, stripe, lambda order: F.col("s") <= F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), [])


def islands(points: DataFrame, keys: list[str], at: str = "bin", flags: Iterable[str] = (), stripe: int = BINS) -> DataFrame:
    """(keys, first, last, flags): maximal runs of consecutive positions, which are distinct; a flag is set where any of the run's positions has it."""
    inside = Window.partitionBy(*keys, "__stripe").orderBy(at)
    striped = points.select(*keys, at, *flags, stripe_of(at, stripe).alias("__stripe"))
    any_of = [F.bool_or(f).alias(f) for f in flags]
    parts = striped.withColumn("__g", F.col(at) - F.row_number().over(inside)).groupBy(*keys, "__stripe", "__g").agg(F.min(at).alias("s"), (F.max(at) + 1).alias("e"), *any_of)
    found = _across(parts, keys, stripe, lambda order: F.lag("e").over(order) == F.col("s"), any_of)
    return found.select(*keys, F.col("s").alias("first"), (F.col("e") - 1).alias("last"), *flags)


def runs(bins: DataFrame, keys: list[str], flag: str, at: str = "bin", stripe: int = BINS) -> DataFrame:
    """(keys, first, last, flag): maximal runs of equal `flag` over consecutive positions."""
    return islands(bins, [*keys, flag], at, stripe=stripe).select(*keys, "first", "last", flag)


def gaps_filled(bins: DataFrame, keys: list[str], most: int = 10, stripe: int = BINS) -> DataFrame:
    """`bins` (keys, bin, seed, support) with `filled`: support, or a gap of at most `most` bins between two supported ones.

    A stripe borrows the supported bins around it that such a gap may end at.
    """
    near = F.when(F.col("support"), F.sequence(stripe_of(F.col("bin") - most - 1, stripe), stripe_of(F.col("bin") + most + 1, stripe))).otherwise(F.array(stripe_of("bin", stripe)))
    striped = bins.withColumn("__stripe", F.explode(near))
    order = Window.partitionBy(*keys, "__stripe").orderBy("bin")
    before = F.last(F.when(F.col("support"), F.col("bin")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(F.when(F.col("support"), F.col("bin")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = striped.withColumn("filled", F.col("support") | F.coalesce(behind - before - 1 <= most, F.lit(False)))
    return found.filter(F.col("__stripe") == stripe_of("bin", stripe)).drop("__stripe")


def regions(bins: DataFrame, keys: list[str], step: int = 50, length: Column | None = None, most_gap: int = 10, stripe: int = BINS) -> DataFrame:
    """(keys, s, e): filled runs that have a seed, in bases."""
    filled = gaps_filled(bins, keys, most_gap, stripe).filter("filled")
    found = islands(filled, keys, "bin", ["seed"], stripe).filter("seed")
    stop = (F.col("last") + 1) * step
    return found.select(*keys, (F.col("first") * step).alias("s"), (F.least(stop, length) if length is not None else stop).alias("e"))


def extended(found: DataFrame, bins: DataFrame, keys: list[str], step: int = 50, least: int = 2_000, quiet: int = 1_000, most: int = 10_000, stripe: int = BINS) -> DataFrame:
    """Regions (keys, s, e) grown at both sides: at least `least` bases, on until `quiet` bases without support, `most` at most.

    Each side is bounded by `most`, so a region meets the bins of that reach only, by an equi-join on buckets.
    """
    reach = most + step
    near = bins.filter("NOT support").select(*keys, F.col("bin"))
    width = reach // step
    quiet_bins = quiet // step
    spans = islands(near, keys, "bin", stripe=stripe).select(*keys, F.col("first").alias("a"), F.col("last").alias("b")).filter(F.col("b") - F.col("a") + 1 >= quiet_bins)
    spans = spans.select(*keys, "a", "b").withColumn("__bucket", F.explode(F.sequence(F.expr(f"a div {width}"), F.expr(f"b div {width}"))))
    numbered = found.withColumn("__id", F.concat_ws(":", *[F.col(k).cast("string") for k in keys], "s"))
    sided = numbered.withColumn("__bucket", F.explode(F.expr(f"array_distinct(concat(sequence(greatest(s - {reach}, 0) div {step * width}, s div {step * width}), sequence(e div {step * width}, (e + {reach}) div {step * width})))")))
    met = sided.join(spans, [*keys, "__bucket"]).select("__id", "s", "e", (F.col("a") * step).alias("qs"), ((F.col("b") + 1) * step).alias("qe"))
    # leftwards the quiet stretch ends at most `least` before the region or later; it is used from its near end on
    left = F.least(F.col("qe"), F.col("s") - least)
    left = F.when((left - quiet >= F.col("qs")) & (F.col("qs") < F.col("s")), F.least(F.col("qe") - quiet, F.col("s") - least))
    right = F.greatest(F.col("qs"), F.col("e") + least)
    right = F.when((right + quiet <= F.col("qe")) & (F.col("qe") > F.col("e")), F.greatest(F.col("qs") + quiet, F.col("e") + least))
    ends = met.groupBy("__id").agg(F.max(left).alias("l"), F.min(right).alias("r"))
    joined = numbered.join(ends, "__id", "left")
    s = F.greatest(F.coalesce("l", F.col("s") - most), F.col("s") - most, F.lit(0))
    e = F.least(F.coalesce("r", F.col("e") + most), F.col("e") + most)
    return joined.select(*keys, s.alias("s"), e.alias("e"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 4096) -> DataFrame:
    """Pairs of rows of `left` (keys, s, e, …) and `right` (keys, rs, re, …) that overlap, once each.

    Both sides go to every bucket they touch; a pair counts in the first bucket that it shares, so no
    distinct is needed.
    """
    a = left.withColumn("__bucket", F.explode(F.sequence(F.expr(f"s div {bucket}"), F.expr(f"greatest(e - 1, s) div {bucket}"))))
    b = right.withColumn("__bucket", F.explode(F.sequence(F.expr(f"rs div {bucket}"), F.expr(f"greatest(re - 1, rs) div {bucket}"))))
    first = F.expr(f"greatest(s, rs) div {bucket}")
    return a.join(b, [*keys, "__bucket"]).filter((F.col("s") < F.col("re")) & (F.col("rs") < F.col("e")) & (F.col("__bucket") == first)).drop("__bucket")


def least_weight(intervals: DataFrame, keys: list[str], weight: str = "w", stripe: int = STRIPE) -> DataFrame:
    """(keys, s, e, w): elementary intervals between ends, each with the least weight that covers it; neighbours of equal weight are made one."""
    pieces = in_stripes(intervals.select(*keys, "s", "e", F.col(weight).alias("w")), stripe)
    ends = pieces.select(*keys, "__stripe", F.explode(F.array("s", "e")).alias("x")).distinct()
    order = Window.partitionBy(*keys, "__stripe").orderBy("x")
    parts = ends.select(*keys, "__stripe", F.col("x").alias("s"), F.lead("x").over(order).alias("e")).filter("e IS NOT NULL")
    over = overlapping(parts, pieces.select(*keys, "__stripe", F.col("s").alias("rs"), F.col("e").alias("re"), "w"), [*keys, "__stripe"])
    found = over.groupBy(*keys, "__stripe", "s", "e").agg(F.min("w").alias("w"))
    follows = lambda order: (F.lag("e").over(order) == F.col("s")) & (F.lag("w").over(order) == F.col("w"))
    sides = Window.partitionBy(*keys, "__stripe").orderBy("s")
    numbered = found.withColumn("fresh", F.when(follows(sides), 0).otherwise(1)).withColumn("island", F.sum("fresh").over(sides.rowsBetween(Window.unboundedPreceding, 0)))
    inside = numbered.groupBy(*keys, "__stripe", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("w").alias("w")).drop("island")
    return _across(inside, keys, stripe, follows, [F.first("w").alias("w")])
