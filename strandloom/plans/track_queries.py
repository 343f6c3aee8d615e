"""Queries over the probability track."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import track as tk
from strandloom.operators import candidates as cd
from strandloom.operators import splicing, tiling
from strandloom.plans import views
from strandloom.plans.catalog import query
from strandloom.plans.session import table

T = f"WITH {views.LOGITS}"
_MASS = f"""{T}, mass AS (SELECT pos, strand, p, list_sum(p[5:15]) AS coding, list_sum(p[2:4]) AS intron, least(greatest(list_sum(p[5:15]) + list_sum(p[2:4]), 0.0), 1.0)::DOUBLE AS genic FROM track)"""
_THRESH = f"""{_MASS}, mom AS (SELECT strand, avg(coding) AS mean, stddev_pop(coding) AS sd FROM mass GROUP BY strand),
thr AS (SELECT *, greatest(0.5, mean + 1.5 * sd) AS t1, greatest(0.2, mean + 0.5 * sd) AS t2, greatest(0.05, mean - 0.5 * sd) AS t3 FROM mom)"""


def track(spark, sf_dir):
    return views.logits(spark, sf_dir).select("pos", "strand", "z", F.expr(tk.softmax("z")).alias("p"))


@query("trk_softmax", f"{T}, e AS (SELECT pos, strand, unnest(range(0, 15)) AS state, p FROM track) SELECT pos, strand, state::INT AS state, round(p[state + 1], 6) AS p FROM e")
def softmax(spark, sf_dir):
    return track(spark, sf_dir).select("pos", "strand", F.posexplode("p").alias("state", "p")).withColumn("p", F.round("p", 6))


@query("trk_log_odds", f"{T}, e AS (SELECT pos, strand, unnest(range(0, 15)) AS state, p FROM track) SELECT pos, strand, state::INT AS state, round(ln(greatest(p[state + 1], 1e-7)) - ln(greatest(p[1], 1e-7)), 5) AS odds FROM e")
def log_odds(spark, sf_dir):
    return track(spark, sf_dir).select("pos", "strand", F.posexplode(F.expr(tk.log_odds("p"))).alias("state", "odds")).withColumn("odds", F.round("odds", 5))


@query("trk_masses", f"{_MASS} SELECT pos, strand, round(coding, 6) AS coding, round(intron, 6) AS intron, round(genic, 6) AS genic FROM mass")
def masses(spark, sf_dir):
    return cd.masses(track(spark, sf_dir)).select("pos", "strand", *[F.round(c, 6).alias(c) for c in ("coding", "intron", "genic")])


@query("agg_strand_thresholds", f"{_THRESH} SELECT strand, round(mean, 6) AS mean, round(sd, 6) AS sd, round(t1, 6) AS t1, round(t2, 6) AS t2, round(t3, 6) AS t3 FROM thr")
def strand_thresholds(spark, sf_dir):
    return cd.thresholds(track(spark, sf_dir), ["strand"]).select("strand", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "t1", "t2", "t3")])


@query("agg_bins", f"""{_THRESH}, b AS (SELECT strand, pos // 10 AS bin, avg(coding) AS mc, max(coding) AS xc, avg(genic) AS mg FROM mass GROUP BY ALL)
SELECT b.strand, bin, round(mc, 6) AS mean_coding, round(xc, 6) AS max_coding, round(mg, 6) AS mean_genic, xc >= t1 OR mc >= t2 AS seed, (xc >= t1 OR mc >= t2) OR mg >= t3 OR xc >= 0.25 AS support FROM b JOIN thr ON b.strand = thr.strand""")
def bins(spark, sf_dir):
    found = cd.binned(track(spark, sf_dir), ["strand"], 10)
    return found.select("strand", "bin", *[F.round(c, 6).alias(c) for c in ("mean_coding", "max_coding", "mean_genic")], "seed", "support")


@query("win_prefix_sums", f"""{T}, e AS (SELECT pos, strand, unnest([1, 2, 3]) AS state, p FROM track), o AS (SELECT pos, strand, state, ln(greatest(p[state + 1], 1e-7)) - ln(greatest(p[1], 1e-7)) AS v FROM e)
SELECT pos, strand, state, round(sum(v) OVER (PARTITION BY strand, state, pos // 100 ORDER BY pos), 4) AS total FROM o""")
def prefix_sums(spark, sf_dir):
    rows = track(spark, sf_dir).select("pos", "strand", F.posexplode(F.expr(tk.log_odds("p"))).alias("state", "v")).filter("state BETWEEN 1 AND 3")
    order = Window.partitionBy("strand", "state", F.expr("pos div 100")).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("pos", "strand", "state", F.round(F.sum("v").over(order), 4).alias("total"))


@query("srt_best_state", f"{T} SELECT pos, strand, (list_position(p, list_max(p)) - 1)::BIGINT AS state FROM track")
def best_state(spark, sf_dir):
    return track(spark, sf_dir).select("pos", "strand", F.expr(tk.best_state("p")).alias("state"))


@query("prj_center_crop", "SELECT vec_id, round(list_sum(list_transform(embedding[17:48], lambda v: v::DOUBLE)), 6) AS total, 32 AS n FROM embeddings")
def center_crop(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(tk.center_crop("embedding", 32)).alias("c"))
    return found.select("vec_id", F.round(F.expr("aggregate(c, 0.0D, (a, x) -> a + cast(x as double))"), 6).alias("total"), F.size("c").alias("n"))


@query("scl_finite_check", f"{T} SELECT strand, count(*) FILTER (len(list_filter(p, lambda v: isnan(v) OR isinf(v) OR v < 0)) > 0) AS bad, count(*) FILTER (abs(list_sum(p) - 1) > 1e-9) AS not_one FROM track GROUP BY strand")
def finite_check(spark, sf_dir):
    bad = F.expr("exists(p, v -> isnan(v) OR v < 0 OR v = double('infinity'))")
    return track(spark, sf_dir).groupBy("strand").agg(F.count_if(bad).alias("bad"), F.count_if(F.abs(F.expr("aggregate(p, 0.0D, (a, x) -> a + x)") - 1) > 1e-9).alias("not_one"))


_PATH = """p AS (SELECT vec_id, label, lag(label) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) AS before FROM embeddings),
m AS (SELECT * FROM (VALUES (0,0),(0,7),(1,1),(1,12),(2,2),(2,13),(3,3),(3,11),(4,5),(4,9),(5,6),(5,10),(5,14),(6,4),(6,8),(7,5),(8,1),(9,2),(10,3),(11,5),(12,6),(13,4),(14,0)) t(a, b))"""


@query("dec_grammar_violations", f"WITH {_PATH} SELECT vec_id, before, label FROM p WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE a = before AND b = label)")
def grammar_violations(spark, sf_dir):
    moves = [(a, b) for a, bs in tk.MOVES.items() for b in bs]
    allowed = F.array(*[F.lit(a * 16 + b) for a, b in moves])  # the grammar's 23 moves
    order = Window.partitionBy(F.expr("vec_id div 50")).orderBy("vec_id")
    path = table(spark, sf_dir, "embeddings").select("vec_id", F.lag("label").over(order).alias("before"), "label").filter("before IS NOT NULL")
    return path.filter(~F.array_contains(allowed, F.col("before") * 16 + F.col("label")))


@query("jon_donor_acceptor", f"""WITH {views.GENOME}, d AS (SELECT chrom_id, unnest(range(0, length(seq) - 1)) AS i, seq FROM genome), s AS (SELECT chrom_id, i, substr(seq, (i + 1)::INT, 2) AS m FROM d),
don AS (SELECT chrom_id, i // 200 AS w, min(i) AS don FROM s WHERE m = 'GT' GROUP BY ALL), acc AS (SELECT chrom_id, i // 200 AS w, max(i) + 2 AS acc FROM s WHERE m = 'AG' GROUP BY ALL)
SELECT don.chrom_id, don.w, don, acc FROM don JOIN acc ON don.chrom_id = acc.chrom_id AND don.w = acc.w AND acc >= don + 20""")
def donor_acceptor(spark, sf_dir):
    """In every window of 200 bases the first donor and the last acceptor that leave an intron of 20."""
    out = []
    for m in ("GT", "AG"):
        gaps = views.genome(spark, sf_dir).select("chrom_id", F.expr(f"aggregate(split(seq, '{m}', -1), struct(0 AS at, cast(array() as array<int>) AS out), (a, g) -> struct(a.at + length(g) + 2 AS at, concat(a.out, array(a.at + length(g))) AS out), a -> slice(a.out, 1, size(a.out) - 1))").alias("ps"))
        at = gaps.select("chrom_id", F.explode("ps").alias("i")).select("chrom_id", F.col("i").cast("long").alias("i")).withColumn("w", F.expr("i div 200"))
        out.append(at.groupBy("chrom_id", "w").agg((F.min("i") if m == "GT" else F.max("i") + 2).alias("don" if m == "GT" else "acc")))
    return out[0].join(out[1], ["chrom_id", "w"]).filter("acc >= don + 20")


#: Four windows of each hundred positions, each at most a quarter of its stratum.
_SAMPLED = f"""{_MASS}, size AS (SELECT max(vec_id) + 1 AS length FROM embeddings), tgt AS (SELECT length, least(greatest((length + 99) // 100, 120), 2000, length) AS target FROM size),
pl AS (SELECT length, target, CASE WHEN target * 5 >= length * 4 THEN 1 ELSE least(greatest((length + 99) // 100, 4), 40) END AS n FROM tgt), ix AS (SELECT *, unnest(range(0, n)) AS i FROM pl),
st AS (SELECT *, greatest(target // n // 10 * 10, 10) AS width, length * i // n AS lo, length * (i + 1) // n AS hi FROM ix),
plan AS (SELECT CASE WHEN n = 1 THEN 0 ELSE least(greatest(((lo + hi - width) // 2 + 5) // 10 * 10, (lo + 9) // 10 * 10), greatest((hi - width) // 10 * 10, (lo + 9) // 10 * 10)) END AS a, n, width, length FROM st),
win AS (SELECT a, CASE WHEN n = 1 THEN length ELSE least(a + width, length) END AS b FROM plan),
chosen AS (SELECT strand, coding FROM mass JOIN win ON pos >= a AND pos < b), mom AS (SELECT strand, count(*) AS n, avg(coding) AS mean, stddev_pop(coding) AS sd FROM chosen GROUP BY strand)"""


@query("agg_sampled_thresholds", f"{_SAMPLED} SELECT strand, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(greatest(0.5, mean + 1.5 * sd), 6) AS t1, round(greatest(0.2, mean + 0.5 * sd), 6) AS t2, round(greatest(0.05, mean - 0.5 * sd), 6) AS t3 FROM mom")
def sampled_thresholds(spark, sf_dir):
    """Thresholds over the windows of a sampling plan; moments of blocks of 64 positions are merged."""
    positions = track(spark, sf_dir).withColumn("chrom_id", F.lit("e"))
    length = table(spark, sf_dir, "embeddings").select(F.lit("e").alias("chrom_id"), (F.col("vec_id") + 1).alias("length")).groupBy("chrom_id").agg(F.max("length").alias("length"))
    plan = tiling.sampling_plan(length, least=120, most=2_000, stratum=100, strata=(4, 40), step=10)
    found = cd.thresholds(positions, ["strand"], plan, 64)
    return found.select("strand", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "t1", "t2", "t3")])


#: Log odds in millionths: sums of whole numbers come out the same in any order, so equal donors are equal.
_ORIENTED = f"""{T}, size AS (SELECT max(vec_id) + 1 AS n FROM embeddings), letter AS (SELECT vec_id AS pos, substr('ACGT', list_position(embedding[31:34], list_max(embedding[31:34]))::INT, 1) AS base FROM embeddings),
o AS (SELECT strand, CASE WHEN strand = 0 THEN track.pos ELSE n - 1 - track.pos END AS i, CASE WHEN strand = 0 THEN base ELSE translate(base, 'ACGT', 'TGCA') END AS base, list_transform(p, lambda v: floor((ln(greatest(v, 1e-7)) - ln(greatest(p[1], 1e-7))) * 1000000.0::DOUBLE + 0.5::DOUBLE)::BIGINT) AS odds
    FROM track JOIN letter ON letter.pos = track.pos, size),
s AS (SELECT *, sum(odds[2]) OVER w AS c0, sum(odds[3]) OVER w AS c1, sum(odds[4]) OVER w AS c2, lag(base) OVER w AS b1, lag(base, 2) OVER w AS b2, lead(base) OVER w AS f1, lead(base, 2) OVER w AS f2 FROM o WINDOW w AS (PARTITION BY strand ORDER BY i)),
ph AS (SELECT s.*, phase, [c0, c1, c2][phase + 1] AS c FROM s, (SELECT unnest([0, 1, 2]) AS phase)),
don AS (SELECT strand, phase, f1 || f2 AS motif, i, odds[9 + phase] - c AS v, CASE phase WHEN 0 THEN base WHEN 1 THEN b1 || base ELSE '' END AS split FROM ph WHERE f1 || f2 IN ('GT', 'GC', 'AT')),
acc AS (SELECT strand, phase, b2 || b1 AS motif, i, odds[[13, 14, 12][phase + 1]] + c - odds[phase + 2] AS v, base || coalesce(f1, '') AS ahead FROM ph WHERE b2 || b1 IN ('AG', 'AC')),
pairs AS (SELECT a.strand, a.phase, a.motif, a.i AS acceptor, d.i AS donor, d.v AS dv, a.v + d.v AS score FROM don d JOIN acc a ON a.strand = d.strand AND a.phase = d.phase AND a.i >= d.i + 21
    AND a.motif = CASE d.motif WHEN 'AT' THEN 'AC' ELSE 'AG' END AND split || left(ahead, 3 - length(split)) NOT IN ('TAA', 'TAG', 'TGA'))"""


@query("jon_best_introns", f"{_ORIENTED} SELECT strand, phase, acceptor, -max({{'v': dv, 'back': -donor}}).back AS donor, floor((max(score) + 5) / 10.0::DOUBLE) / 100000.0::DOUBLE AS score FROM pairs GROUP BY strand, phase, acceptor")
def best_introns(spark, sf_dir):
    """Each acceptor's best intron in each phase, scored by the track, on both strands, in millionths; of equal donors the first. The twin lists all pairs."""
    letters = "element_at(array('A', 'C', 'G', 'T'), cast(array_position(slice(embedding, 31, 4), array_max(slice(embedding, 31, 4))) as int))"
    found = table(spark, sf_dir, "embeddings")
    n = found.agg(F.max("vec_id").alias("last")).scalar()
    base = found.select(F.col("vec_id").alias("pos"), F.expr(letters).alias("base"))
    plus = F.col("strand") == 0
    o = track(spark, sf_dir).join(base, "pos").select("strand", F.when(plus, F.col("pos")).otherwise(n - F.col("pos")).alias("i"), F.when(plus, F.col("base")).otherwise(F.translate("base", "ACGT", "TGCA")).alias("base"), F.expr(f"transform({tk.log_odds('p')}, v -> floor(v * 1000000.0D + 0.5D))").alias("odds"))
    # neighbours come by equal numbers, not by a window over the record
    near = o.select("strand", F.col("i").alias("at"), F.explode(F.array(*[F.struct((F.col("i") - k).alias("i"), F.lit(k).alias("k"), "base") for k in (-2, -1, 1, 2)])).alias("x")).groupBy("strand", F.col("x.i").alias("i")).agg(
        *[F.max(F.when(F.col("x.k") == k, F.col("x.base"))).alias(name) for k, name in ((-2, "b2"), (-1, "b1"), (1, "f1"), (2, "f2"))]
    )
    each = o.join(near, ["strand", "i"]).select("*", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("phase")).withColumn("intron", F.element_at("odds", F.col("phase") + 2))
    summed = splicing.running(each, ["strand", "phase"], "i", "intron", "c", stripe=256)
    donors = summed.select("strand", "phase", F.concat("f1", "f2").alias("motif"), F.col("i").alias("pos"), (F.element_at("odds", F.col("phase") + 9) - F.col("c")).alias("score"), F.expr("CASE phase WHEN 0 THEN base WHEN 1 THEN b1 || base ELSE '' END").alias("split")).filter("motif IN ('GT', 'GC', 'AT')")
    own = F.element_at("odds", F.element_at(F.array(F.lit(13), F.lit(14), F.lit(12)), F.col("phase") + 1)) + F.col("c") - F.col("intron")
    acceptors = summed.select("strand", "phase", F.concat("b2", "b1").alias("motif"), F.col("i").alias("pos"), own.alias("own"), F.concat("base", F.coalesce("f1", F.lit(""))).alias("ahead")).filter("motif IN ('AG', 'AC')")
    best = splicing.best_donors(donors, acceptors, ["strand"], 20, 256)
    return best.select("strand", "phase", F.col("pos").alias("acceptor"), "donor", (F.floor((F.col("own") + F.col("donor_score") + 5) / F.lit(10.0)) / F.lit(100000.0)).alias("score"))
