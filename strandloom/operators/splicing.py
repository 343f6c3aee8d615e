"""Introns: each acceptor's best donor of all that lie far enough before it, without listing the pairs.

A donor's score and an acceptor's are independent of each other, so the best donor for an acceptor is a
running best along the record, among donors of the same phase, with a motif that the acceptor's goes
with, and with split bases that make no stop codon with the acceptor's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.bases import STOPS
from strandloom.operators.intervals import STRIPE, stripe_of

#: What an acceptor makes of a donor's motif.
ENDS = {"GT": "AG", "GC": "AG", "AT": "AC"}


def running(rows: DataFrame, keys: list[str], at: str, value: str, name: str, total: Callable[[Column | str], Column] = F.sum, behind: tuple[str, ...] = (), stripe: int = STRIPE) -> DataFrame:
    """`rows` with `name`, the total of `value` over all rows of their keys up to their own, ordered by `at` and `behind`.

    Rows are put in order inside stripes only; of each stripe one total goes along the record. Totals of
    numbers are sums, others (F.max, F.min) take what compares.
    """
    striped = rows.withColumn("__stripe", stripe_of(at, stripe))
    inside = Window.partitionBy(*keys, "__stripe").orderBy(at, *behind).rowsBetween(Window.unboundedPreceding, 0)
    whole = striped.groupBy(*keys, "__stripe").agg(total(value).alias("__all"))
    earlier = Window.partitionBy(*keys).orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__stripe").alias("__s"), total("__all").over(earlier).alias("__before"))
    own = striped.withColumn("__own", total(value).over(inside))
    same = F.col("__s") == F.col("__stripe")
    for k in keys:
        same = same & (F.col(f"__k_{k}") == F.col(k))
    both = own.join(whole, same, "left")
    if total is F.sum:
        found = F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0))
    else:
        found = total_of(total, "__before", "__own")
    return both.withColumn(name, found).drop("__stripe", "__own", "__s", "__before", *[f"__k_{k}" for k in keys])


def total_of(total: Callable, a: str, b: str) -> Column:
    """The larger (for F.max) or smaller (for F.min) of two columns; a null counts as nothing."""
    first = F.col(a) >= F.col(b) if total is F.max else F.col(a) <= F.col(b)
    return F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull() | first, F.col(a)).otherwise(F.col(b))


def split_group(phase: Column, split: Column) -> Column:
    """What of a donor's split bases matters: T in phase 0, TA and TG in phase 1, nothing else."""
    return F.when((phase == 0) & (split == "T"), "T").when((phase == 1) & split.isin("TA", "TG"), split).otherwise("")


def groups_taken(phase: Column, ahead: Column) -> Column:
    """The groups of donors that an acceptor of a phase may follow; ahead: its base and the next."""
    stops = lambda head: ahead.substr(1, 3 - len(head)).isin(*[s[len(head) :] for s in STOPS if s.startswith(head)])
    safe = lambda head: F.when(~F.coalesce(stops(head), F.lit(False)), F.lit(head))
    return F.array_compact(F.array(F.lit(""), F.when(phase == 0, safe("T")), F.when(phase == 1, safe("TA")), F.when(phase == 1, safe("TG"))))


def best_donors(donors: DataFrame, acceptors: DataFrame, keys: list[str], min_intron: int = 20, stripe: int = STRIPE) -> DataFrame:
    """`acceptors` with donor and donor_score: the place and score of the best donor, of equal ones the first; acceptors without one are left out.

    donors: (keys, phase, motif, split, pos, score), pos being the last base before the intron; acceptors:
    (keys, phase, motif, ahead, pos, ...), pos being the first base behind it, one row for each phase that
    they may have. A donor counts from pos + min_intron + 1 on. Motifs are GT, GC or AT, and AG or AC.
    A donor whose split bases would lie before the record (null) is none.
    """
    ends = F.element_at(F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair]), F.col("motif"))
    sent = donors.filter("split IS NOT NULL").select(
        *keys, "phase", ends.alias("__end"), split_group(F.col("phase"), F.col("split")).alias("__group"), (F.col("pos") + min_intron + 1).alias("__at"), F.lit(0).alias("__kind"),
        F.struct("score", (-F.col("pos")).alias("back")).alias("__value"),
    ).filter("__end IS NOT NULL")
    asked = acceptors.select(
        *keys, "phase", F.col("motif").alias("__end"), F.explode(groups_taken(F.col("phase"), F.col("ahead"))).alias("__group"), F.col("pos").alias("__at"), F.lit(1).alias("__kind"),
        F.lit(None).cast(sent.schema["__value"].dataType).alias("__value"),
    )
    found = running(sent.union(asked), [*keys, "phase", "__end", "__group"], "__at", "__value", "__best", F.max, ("__kind",), stripe).filter("__kind = 1")
    best = found.groupBy(*keys, "phase", F.col("__end").alias("motif"), F.col("__at").alias("pos")).agg(F.max("__best").alias("__best")).filter("__best IS NOT NULL")
    return acceptors.join(best, [*keys, "phase", "motif", "pos"]).withColumns({"donor": -F.col("__best.back"), "donor_score": F.col("__best.score")}).drop("__best")
