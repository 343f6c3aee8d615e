"""Queries over intervals and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import intervals as iv
from strandloom.plans import views
from strandloom.plans.catalog import query
from strandloom.plans.session import table, written

V = f"WITH {views.INTERVALS}"


@query("ivl_merge", f"""{V}, o AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
n AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT chrom, min(s) AS s, max(e) AS e FROM n GROUP BY chrom, g""")
def merge(spark, sf_dir):
    return iv.merge(views.intervals(spark, sf_dir), ["chrom"])


#: Bins of six hours over each user's events: support where there is one, a seed where it is a purchase.
_BINS = f"""{V}, hit AS (SELECT user_id % 50 AS chrom, floor(epoch(ts))::BIGINT // 1200 AS bin, bool_or(event_type = (SELECT min(event_type) FROM events)) AS seed FROM events GROUP BY ALL),
ext AS (SELECT chrom, min(bin) AS lo, max(bin) AS hi FROM hit GROUP BY chrom), grid AS (SELECT chrom, unnest(range(lo, hi + 1)) AS bin FROM ext),
bins AS (SELECT g.chrom, g.bin, coalesce(h.seed, false) AS seed, h.bin IS NOT NULL AND h.bin % 3 <> 0 AS support FROM grid g LEFT JOIN hit h ON g.chrom = h.chrom AND g.bin = h.bin)"""


def bins(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = events.agg(F.min("event_type").alias("k"))
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    hit = events.groupBy((F.col("user_id") % 50).alias("chrom"), F.floor(at / 1200).cast("long").alias("b"), (F.col("event_type") == kind.scalar()).alias("is")).agg(F.count("*").alias("n"))
    hit = hit.groupBy("chrom", "b").agg(F.bool_or("is").alias("seed"))
    hit = hit.select("chrom", F.col("b").alias("bin"), "seed")
    grid = hit.groupBy("chrom").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select("chrom", F.explode(F.sequence("lo", "hi")).alias("bin"))
    found = grid.join(hit.withColumn("there", F.lit(True)), ["chrom", "bin"], "left")
    return found.select("chrom", "bin", F.coalesce("seed", F.lit(False)).alias("seed"), (F.coalesce("there", F.lit(False)) & (F.col("bin") % 3 != 0)).alias("support"))


_FILLED = f"""{_BINS}, f AS (SELECT *, max(CASE WHEN support THEN bin END) OVER (PARTITION BY chrom ORDER BY bin) AS before, min(CASE WHEN support THEN bin END) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS behind FROM bins),
filled AS (SELECT chrom, bin, seed, support, support OR coalesce(behind - before - 1 <= 10, false) AS filled FROM f)"""


@query("ivl_gap_fill", f"{_FILLED} SELECT chrom, count(*) AS bins, count(*) FILTER (support) AS supported, count(*) FILTER (filled) AS filled, coalesce(sum(bin) FILTER (filled), 0)::BIGINT AS checksum FROM filled GROUP BY chrom")
def gap_fill(spark, sf_dir):
    return iv.gaps_filled(bins(spark, sf_dir), ["chrom"]).groupBy("chrom").agg(
        F.count("*").alias("bins"), F.count_if("support").alias("supported"), F.count_if("filled").alias("filled"), F.coalesce(F.sum(F.when(F.col("filled"), F.col("bin"))), F.lit(0)).alias("checksum")
    )


_REGIONS = f"""{_FILLED}, isl AS (SELECT *, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS g FROM filled WHERE filled),
reg AS (SELECT chrom, min(bin) * 50 AS s, (max(bin) + 1) * 50 AS e FROM isl GROUP BY chrom, g HAVING bool_or(seed))"""


@query("ivl_regions", f"{_REGIONS} SELECT chrom, s, e FROM reg")
def regions(spark, sf_dir):
    return iv.regions(bins(spark, sf_dir), ["chrom"])


@query("ivl_support_runs", f"""{_BINS}, c AS (SELECT *, CASE WHEN lag(support) OVER w IS DISTINCT FROM support THEN 1 ELSE 0 END AS fresh FROM bins WINDOW w AS (PARTITION BY chrom ORDER BY bin)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY bin) AS g FROM c)
SELECT chrom, min(bin) AS first, max(bin) AS last, any_value(support) AS support FROM n GROUP BY chrom, g""")
def support_runs(spark, sf_dir):
    return iv.runs(bins(spark, sf_dir), ["chrom"], "support")


_EXTENDED = f"""{_REGIONS}, q0 AS (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS g FROM bins WHERE NOT support),
quiet AS (SELECT chrom, min(bin) * 50 AS qs, (max(bin) + 1) * 50 AS qe FROM q0 GROUP BY chrom, g HAVING count(*) >= 20),
lft AS (SELECT r.chrom, r.s, max(least(qe - 1000, r.s - 2000)) AS l FROM reg r JOIN quiet q ON r.chrom = q.chrom AND qs < r.s AND least(qe, r.s - 2000) - 1000 >= qs GROUP BY ALL),
rgt AS (SELECT r.chrom, r.s, min(greatest(qs + 1000, r.e + 2000)) AS r2 FROM reg r JOIN quiet q ON r.chrom = q.chrom AND qe > r.e AND greatest(qs, r.e + 2000) + 1000 <= qe GROUP BY ALL),
ext2 AS (SELECT r.chrom, greatest(coalesce(l, r.s - 10000), r.s - 10000, 0) AS s, least(coalesce(r2, r.e + 10000), r.e + 10000) AS e FROM reg r LEFT JOIN lft USING (chrom, s) LEFT JOIN rgt USING (chrom, s))"""


@query("ivl_extended_regions", f"{_EXTENDED} SELECT chrom, s::BIGINT AS s, e::BIGINT AS e FROM ext2")
def extended_regions(spark, sf_dir):
    b = written(bins(spark, sf_dir), "bins")
    return iv.extended(iv.regions(b, ["chrom"]), b, ["chrom"])


@query("ivl_candidate_regions", f"""{_EXTENDED}, o AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ext2),
n AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT chrom, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM n GROUP BY chrom, g""")
def candidate_regions(spark, sf_dir):
    return iv.merge(extended_regions(spark, sf_dir), ["chrom"])


_WINDOWS = f"""{V}, span AS (SELECT chrom, min(s) AS lo, max(e) AS hi FROM intervals GROUP BY chrom),
win AS (SELECT chrom, unnest(range(lo, hi, 86400)) AS ws FROM span)"""


@query("jon_window_overlap", f"{_WINDOWS} SELECT w.chrom, ws, count(*) AS n, sum(least(e, ws + 86400) - greatest(s, ws))::BIGINT AS covered FROM win w JOIN intervals i ON w.chrom = i.chrom AND i.s < ws + 86400 AND i.e > ws GROUP BY ALL")
def window_overlap(spark, sf_dir):
    i = views.intervals(spark, sf_dir)
    win = i.groupBy("chrom").agg(F.min("s").alias("lo"), F.max("e").alias("hi")).select("chrom", F.explode(F.expr("sequence(lo, hi - 1, 86400L)")).alias("s"))
    met = iv.overlapping(win.withColumn("e", F.col("s") + 86400), i.select("chrom", F.col("s").alias("rs"), F.col("e").alias("re")), ["chrom"], 86400)
    return met.groupBy("chrom", F.col("s").alias("ws")).agg(F.count("*").alias("n"), F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("covered"))


@query("agg_least_weight", f"""{V}, iv AS (SELECT chrom, s, e, CASE WHEN id % 2 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS w FROM intervals),
ends AS (SELECT DISTINCT chrom, unnest([s, e]) AS x FROM iv), parts AS (SELECT chrom, x AS s, lead(x) OVER (PARTITION BY chrom ORDER BY x) AS e FROM ends),
cov AS (SELECT p.chrom, p.s, p.e, min(w) AS w FROM parts p JOIN iv i ON p.chrom = i.chrom AND i.s < p.e AND p.s < i.e WHERE p.e IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN lag(e) OVER o = s AND lag(w) OVER o = w THEN 0 ELSE 1 END AS fresh FROM cov WINDOW o AS (PARTITION BY chrom ORDER BY s)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY s) AS g FROM f)
SELECT chrom, min(s) AS s, max(e) AS e, any_value(w) AS w FROM n GROUP BY chrom, g""")
def least_weight(spark, sf_dir):
    i = views.intervals(spark, sf_dir).withColumn("w", F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.5))
    return iv.least_weight(i, ["chrom"])


@query("win_early_stopping", """WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events),
g AS (SELECT *, CASE WHEN best IS NULL OR value > best THEN 1 ELSE 0 END AS better, sum(CASE WHEN best IS NULL OR value > best THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id) - 1 AS waited FROM g)
SELECT user_id, min(event_id) FILTER (waited >= 5) AS stopped_at, max(waited) AS longest FROM p GROUP BY user_id""")
def early_stopping(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    best = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(best.isNull() | (F.col("value") > best), 1).otherwise(0).alias("better"))
    e = e.withColumn("epoch", F.sum("better").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    waited = F.row_number().over(Window.partitionBy("user_id", "epoch").orderBy("event_id")) - 1
    return e.withColumn("waited", waited.cast("long")).groupBy("user_id").agg(F.min(F.when(F.col("waited") >= 5, F.col("event_id"))).alias("stopped_at"), F.max("waited").alias("longest"))
