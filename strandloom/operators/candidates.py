"""From a probability track to bins with thresholds, and metrics of labels against predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import track as tk


def masses(track: DataFrame) -> DataFrame:
    """`track` (…, p) with its coding, intron and genic mass, the last clipped to 0 to 1."""
    out = track.withColumn("coding", F.expr(tk.mass("p", 4, 14))).withColumn("intron", F.expr(tk.mass("p", 1, 3)))
    return out.withColumn("genic", F.least(F.greatest(F.col("coding") + F.col("intron"), F.lit(0.0)), F.lit(1.0)))


#: Bases of a block: what thresholds sum up at a time, and what a window of a plan is looked up by.
BLOCK = 1 << 16


def sampled(track: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """The positions of `track` (chrom_id, pos, ...) that lie in the windows (chrom_id, start, stop) of a plan.

    Windows don't overlap; they go to the blocks that they touch, so both sides meet by blocks.
    """
    parts = plan.select("chrom_id", "start", "stop", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))).alias("__block"))
    met = track.withColumn("__block", F.expr(f"pos div {block}")).join(parts, ["chrom_id", "__block"])
    return met.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("stop"))).drop("__block", "start", "stop")


def moments(values: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """(keys, n, mean, m2) of `value`: moments of each block of positions, merged. A value that isn't finite is an error."""
    v = F.col(value)
    sound = F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{value} isn't finite")).cast("double")).otherwise(v)
    parts = values.groupBy(*keys, F.expr(f"pos div {block}").alias("__block")).agg(F.count("*").alias("n"), F.avg(sound).alias("mean"), F.var_pop(sound).alias("var"))
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sum"), F.collect_list(F.struct("n", "mean", "var")).alias("parts"))
    mean = F.col("sum") / F.col("n")
    m2 = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["n"] * (x["var"] + (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean"))))
    return sums.withColumn("mean", mean).select(*keys, "n", "mean", m2.alias("m2"))


def thresholds(track: DataFrame, keys: list[str], plan: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, n, mean, sd, t1, t2, t3) of the coding mass: what seeds a bin alone, in the mean, and what supports it.

    With a plan (chrom_id, start, stop) only the positions of its windows count; track then has chrom_id.
    """
    some = track if plan is None else sampled(track, plan, block)
    m = moments(masses(some), keys, "coding", block).withColumn("sd", F.sqrt(F.col("m2") / F.col("n")))
    mean, sd = F.col("mean"), F.col("sd")
    t1, t2, t3 = F.greatest(F.lit(0.5), mean + 1.5 * sd), F.greatest(F.lit(0.2), mean + 0.5 * sd), F.greatest(F.lit(0.05), mean - 0.5 * sd)
    return m.select(*keys, "n", "mean", "sd", t1.alias("t1"), t2.alias("t2"), t3.alias("t3"))


def binned(track: DataFrame, keys: list[str], step: int = 50, plan: DataFrame | None = None) -> DataFrame:
    """(keys, bin, mean_coding, max_coding, mean_genic, seed, support). Thresholds are one row for each of `keys`, over the windows of `plan` if there is one."""
    found = masses(track).groupBy(*keys, F.expr(f"pos div {step}").alias("bin")).agg(F.avg("coding").alias("mean_coding"), F.max("coding").alias("max_coding"), F.avg("genic").alias("mean_genic"))
    marked = found.join(thresholds(track, keys, plan).select(*keys, "t1", "t2", "t3"), keys)
    seed = (F.col("max_coding") >= F.col("t1")) | (F.col("mean_coding") >= F.col("t2"))
    support = seed | (F.col("mean_genic") >= F.col("t3")) | (F.col("max_coding") >= 0.25)
    return marked.withColumn("seed", seed).withColumn("support", support).drop("t1", "t2", "t3")


def confusion(labelled: DataFrame) -> DataFrame:
    """(strand, truth, pred, n) over positions whose weight isn't 0."""
    return labelled.filter("weight <> 0").groupBy("strand", "truth", "pred").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(strand, class, tp, actual, predicted, precision, recall, f1) per strand and over both (strand null); 0 where nothing divides."""
    both = matrix.select("strand", "truth", "pred", "n").unionByName(matrix.select(F.lit(None).cast("int").alias("strand"), "truth", "pred", "n"))
    sides = both.select("strand", F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("x"), "truth", "pred", "n")
    sums = sides.groupBy("strand", F.col("x.c").alias("class")).agg(
        F.sum(F.when((F.col("truth") == F.col("pred")) & (F.col("x.a") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("x.a")).alias("actual"), F.sum(F.col("n") * F.col("x.p")).alias("predicted")
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return sums.withColumn("precision", ratio(tp, F.col("predicted"))).withColumn("recall", ratio(tp, F.col("actual"))).withColumn("f1", ratio(2 * tp, F.col("predicted") + F.col("actual")))


def grouped_scores(matrix: DataFrame) -> DataFrame:
    """(part, f1) of introns, coding frames and boundaries, where a mistake inside the part counts as right."""
    part = lambda c: F.when(F.col(c).between(1, 3), "intron").when(F.col(c).between(4, 6), "cds").when(F.col(c).between(7, 14), "boundary").otherwise("none")
    m = matrix.select(part("truth").alias("t"), part("pred").alias("q"), "n")
    sides = m.select(F.explode(F.array(F.struct(F.col("t").alias("part"), F.lit(1).alias("a")), F.struct(F.col("q").alias("part"), F.lit(0).alias("a")))).alias("x"), "t", "q", "n")
    sums = sides.groupBy(F.col("x.part").alias("part")).agg(F.sum(F.when((F.col("t") == F.col("q")) & (F.col("x.a") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("total"))
    return sums.filter("part <> 'none'").select("part", F.when(F.col("total") > 0, 2 * F.col("tp") / F.col("total")).otherwise(0.0).alias("f1"))


def state_rows(labelled: DataFrame, gate: float = 0.2) -> DataFrame:
    """(sample, pos, cls, p, lp, gate, truth, m): a row for each position and state. labelled: (sample, pos, z, label, m)."""
    known = labelled.withColumn("label", F.when(F.col("m") > 0, F.col("label")).otherwise(0)).withColumn("p", F.expr(tk.softmax("z"))).withColumn("g", F.expr(tk.softmax("z", gate)))
    rows = known.select("sample", "pos", "m", "label", F.posexplode(F.arrays_zip("p", "g")).alias("cls", "x"))
    return rows.select("sample", "pos", "m", "label", "cls", F.col("x.p").alias("p"), F.col("x.g").alias("g"), (F.col("cls") == F.col("label")).cast("double").alias("t"))


def focal_f1_loss(labelled: DataFrame, eps: float = 1e-5) -> DataFrame:
    """(focal, state_f1, intron_f1, cds_f1, loss): means over the samples that have supervised positions."""
    rows = state_rows(labelled)
    w = F.col("m") * F.when(F.col("label") == 7, 2.0).otherwise(1.0)
    own = rows.filter("cls = label").groupBy("sample").agg((F.sum((1 - F.col("p")) ** 2 * -F.log("p") * w) / F.greatest(F.sum(w), F.lit(eps))).alias("focal"), F.sum("m").alias("length"))
    m, p, t, g = (F.col(c) for c in "mptg")
    sums = [F.sum(p * t * m).alias("i"), F.sum(p * m).alias("q"), F.sum(t * m).alias("a")]
    states = rows.filter("cls > 0").groupBy("sample", "cls").agg(*sums, F.sum(p * g * m).alias("fp"), F.sum(g * m).alias("fw"))
    present = 1 - (2 * F.col("i") + eps) / (F.col("q") + F.col("a") + eps)
    state = states.groupBy("sample").agg(F.sum(F.when(F.col("a") > 0, present).otherwise(F.col("fp") / (F.col("fw") + eps))).alias("state"))
    parts = rows.filter("cls > 0").groupBy("sample", "pos", (F.col("cls") < 4).alias("intron")).agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.first("m").alias("m")).groupBy("sample", "intron").agg(*sums)
    lengths = own.select("sample", F.greatest("length", F.lit(eps)).alias("norm"))
    parts = parts.join(lengths, "sample").withColumn("v", F.when(F.col("a") > 0, present).otherwise(F.col("q") / F.col("norm")))
    parts = parts.groupBy("sample").agg(F.sum(F.when(F.col("intron"), F.col("v"))).alias("intron"), F.sum(F.when(~F.col("intron"), F.col("v"))).alias("cds"))
    each = own.filter("length > 0").join(state, "sample").join(parts, "sample")
    means = each.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("focal", "focal"), ("state", "state_f1"), ("intron", "intron_f1"), ("cds", "cds_f1"))])
    return means.withColumn("loss", F.col("focal") + 0.5 * (F.col("state_f1") + F.col("intron_f1") + F.col("cds_f1")))


def entropy_f1_loss(labelled: DataFrame, factor: float = 2.0, first: int = 4, eps: float = 1e-6) -> DataFrame:
    """(cce, f1, false_positive, loss): means over all samples."""
    rows = state_rows(labelled)
    m, p, t = (F.col(c) for c in "mpt")
    own = rows.filter("cls = label").groupBy("sample").agg((F.sum(-F.log("p") * m) / F.greatest(F.sum("m"), F.lit(eps))).alias("cce"), F.greatest(F.sum("m"), F.lit(eps)).alias("norm"))
    c = rows.filter(F.col("cls") >= first).groupBy("sample", "cls").agg(F.sum(p * t * m).alias("tp"), F.sum(p * m).alias("q"), F.sum(t * m).alias("a"))
    c = c.withColumn("pr", F.col("tp") / (F.col("q") + eps)).withColumn("re", F.col("tp") / (F.col("a") + eps))
    f1 = 2 * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re") + eps)
    c = c.groupBy("sample").agg(F.sum(F.when(F.col("a") > 0, 1 - f1).otherwise(0.0)).alias("f1"), F.sum(F.when(F.col("a") > 0, 0.0).otherwise(F.col("q"))).alias("fp"))
    means = own.join(c, "sample").agg(F.avg("cce").alias("cce"), F.avg("f1").alias("f1"), F.avg(F.col("fp") / F.col("norm")).alias("false_positive"))
    return means.withColumn("loss", F.col("cce") + factor * (F.col("f1") + F.col("false_positive")))


#: Losses by name.
LOSSES = {"masked_focal_f1": focal_f1_loss, "cce_f1": entropy_f1_loss}


def loss(labelled: DataFrame, name: str = "masked_focal_f1", **options: float) -> DataFrame:
    """The loss of that name; an unknown name is an error that lists the known ones."""
    if name not in LOSSES:
        raise ValueError(f"no loss {name!r}; known are {sorted(LOSSES)}")
    return LOSSES[name](labelled, **options)
