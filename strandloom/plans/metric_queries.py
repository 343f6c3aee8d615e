"""Queries over predictions, losses and dataset shares."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.operators import batches
from strandloom.operators import candidates as cd
from strandloom.plans import track_queries as tq
from strandloom.plans.catalog import query
from strandloom.plans.session import table

_LAB = f"""{tq.T}, lab AS (SELECT t.pos, t.strand, ((label * 3 + t.pos + t.strand) % 15)::INT AS truth, (list_position(p, list_max(p)) - 1)::INT AS pred, CASE t.pos % 7 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM track t JOIN embeddings e ON e.vec_id = t.pos),
cm AS (SELECT strand, truth, pred, count(*) AS n FROM lab WHERE weight <> 0 GROUP BY ALL)"""


def labelled(spark, sf_dir):
    from strandloom.functions import track as tk

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "label")
    found = tq.track(spark, sf_dir).join(e, "pos")
    weight = F.when(F.col("pos") % 7 == 0, 0.0).when(F.col("pos") % 7 == 1, 0.5).otherwise(1.0)
    return found.select("pos", "strand", "z", ((F.col("label") * 3 + F.col("pos") + F.col("strand")) % 15).cast("int").alias("truth"), F.expr(tk.best_state("p")).cast("int").alias("pred"), weight.alias("weight"))


@query("agg_confusion", f"{_LAB} SELECT strand, truth, pred, n, truth * 15 + pred AS pair FROM cm")
def confusion(spark, sf_dir):
    return cd.confusion(labelled(spark, sf_dir)).withColumn("pair", F.col("truth") * 15 + F.col("pred"))


_SCORES = f"""{_LAB}, both_s AS (SELECT * FROM cm UNION ALL SELECT NULL, truth, pred, n FROM cm), act AS (SELECT strand, truth AS c, sum(n) AS actual, sum(CASE WHEN truth = pred THEN n ELSE 0 END) AS tp FROM both_s GROUP BY ALL),
prd AS (SELECT strand, pred AS c, sum(n) AS predicted FROM both_s GROUP BY ALL),
sc AS (SELECT coalesce(a.strand, p.strand) AS strand, coalesce(a.c, p.c) AS class, coalesce(tp, 0)::BIGINT AS tp, coalesce(actual, 0)::BIGINT AS actual, coalesce(predicted, 0)::BIGINT AS predicted FROM act a FULL JOIN prd p ON a.strand IS NOT DISTINCT FROM p.strand AND a.c = p.c)"""


@query("agg_class_scores", f"{_SCORES} SELECT *, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN actual > 0 THEN tp / actual ELSE 0 END, 6) AS recall, round(CASE WHEN predicted + actual > 0 THEN 2 * tp / (predicted + actual) ELSE 0 END, 6) AS f1 FROM sc")
def class_scores(spark, sf_dir):
    found = cd.class_scores(cd.confusion(labelled(spark, sf_dir)))
    return found.select("strand", "class", "tp", "actual", "predicted", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("agg_macro_f1", f"{_SCORES} SELECT strand, round(avg(CASE WHEN predicted + actual > 0 THEN 2 * tp / (predicted + actual) END), 6) AS macro_f1, round(sum(tp) / sum(actual), 6) AS accuracy FROM sc GROUP BY strand")
def macro_f1(spark, sf_dir):
    found = cd.class_scores(cd.confusion(labelled(spark, sf_dir)))
    return found.groupBy("strand").agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum("tp") / F.sum("actual"), 6).alias("accuracy"))


_G = "CASE WHEN {c} BETWEEN 1 AND 3 THEN 'intron' WHEN {c} BETWEEN 4 AND 6 THEN 'cds' WHEN {c} BETWEEN 7 AND 14 THEN 'boundary' ELSE 'none' END"


@query("agg_grouped_f1", f"{_LAB}, g AS (SELECT {_G.format(c='truth')} AS t, {_G.format(c='pred')} AS q, n FROM cm), k AS (SELECT unnest(['intron', 'cds', 'boundary']) AS part) SELECT part, round(2 * sum(CASE WHEN t = q AND t = part THEN n ELSE 0 END) / sum(CASE WHEN t = part THEN n ELSE 0 END + CASE WHEN q = part THEN n ELSE 0 END), 6) AS f1 FROM k, g GROUP BY part")
def grouped_f1(spark, sf_dir):
    return cd.grouped_scores(cd.confusion(labelled(spark, sf_dir))).withColumn("f1", F.round("f1", 6))


_ROWS = f"""{_LAB}, tr AS (SELECT t.pos, t.strand, z, p, CASE WHEN weight > 0 THEN truth ELSE 0 END AS label, weight AS m, (t.pos // 25) * 2 + t.strand AS sample FROM track t JOIN lab USING (pos, strand) JOIN logits USING (pos, strand)),
gate AS (SELECT *, list_transform(z, lambda v: exp((v - list_max(z)) / 0.2)) AS gx FROM tr),
sr AS (SELECT sample, pos, m, label, cls, p[cls + 1] AS p, gx[cls + 1] / list_sum(gx) AS g, CASE WHEN cls = label THEN 1.0 ELSE 0.0 END::DOUBLE AS t FROM gate, (SELECT unnest(range(0, 15)) AS cls))"""
_FOCAL = f"""{_ROWS}, own AS (SELECT sample, sum((1 - p) ** 2 * -ln(p) * m * CASE WHEN label = 7 THEN 2 ELSE 1 END) / greatest(sum(m * CASE WHEN label = 7 THEN 2 ELSE 1 END), 1e-5) AS focal, sum(m) AS len FROM sr WHERE cls = label GROUP BY sample),
st AS (SELECT sample, cls, sum(p * t * m) AS i, sum(p * m) AS q, sum(t * m) AS a, sum(p * g * m) AS fp, sum(g * m) AS fw FROM sr WHERE cls > 0 GROUP BY ALL),
state AS (SELECT sample, sum(CASE WHEN a > 0 THEN 1 - (2 * i + 1e-5) / (q + a + 1e-5) ELSE fp / (fw + 1e-5) END) AS state FROM st GROUP BY sample),
pp AS (SELECT sample, pos, cls < 4 AS intron, sum(p) AS p, sum(t) AS t, any_value(m) AS m FROM sr WHERE cls > 0 GROUP BY ALL),
ps AS (SELECT sample, intron, sum(p * t * m) AS i, sum(p * m) AS q, sum(t * m) AS a FROM pp GROUP BY ALL),
pv AS (SELECT ps.sample, intron, CASE WHEN a > 0 THEN 1 - (2 * i + 1e-5) / (q + a + 1e-5) ELSE q / greatest(len, 1e-5) END AS v FROM ps JOIN own USING (sample)),
pt AS (SELECT sample, sum(v) FILTER (intron) AS intron, sum(v) FILTER (NOT intron) AS cds FROM pv GROUP BY sample),
mean AS (SELECT avg(focal) AS focal, avg(state) AS state_f1, avg(intron) AS intron_f1, avg(cds) AS cds_f1 FROM own JOIN state USING (sample) JOIN pt USING (sample) WHERE len > 0)"""


def samples(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.expr("(pos div 25) * 2 + strand").alias("sample"), "pos", "z", F.col("truth").alias("label"), F.col("weight").alias("m"))


@query("los_focal_f1", f"{_FOCAL} SELECT round(focal, 5) AS focal, round(state_f1, 5) AS state_f1, round(intron_f1, 5) AS intron_f1, round(cds_f1, 5) AS cds_f1, round(focal + 0.5 * (state_f1 + intron_f1 + cds_f1), 5) AS loss FROM mean")
def focal_f1(spark, sf_dir):
    return cd.focal_f1_loss(samples(spark, sf_dir)).select(*[F.round(c, 5).alias(c) for c in ("focal", "state_f1", "intron_f1", "cds_f1", "loss")])


@query("los_entropy_f1", f"""{_ROWS}, own AS (SELECT sample, sum(-ln(p) * m) / greatest(sum(m), 1e-6) AS cce, greatest(sum(m), 1e-6) AS norm FROM sr WHERE cls = label GROUP BY sample),
c AS (SELECT sample, cls, sum(p * t * m) AS tp, sum(p * m) AS q, sum(t * m) AS a FROM sr WHERE cls >= 4 GROUP BY ALL), d AS (SELECT *, tp / (q + 1e-6) AS pr, tp / (a + 1e-6) AS re FROM c),
s AS (SELECT sample, sum(CASE WHEN a > 0 THEN 1 - 2 * pr * re / (pr + re + 1e-6) ELSE 0 END) AS f1, sum(CASE WHEN a > 0 THEN 0 ELSE q END) AS fp FROM d GROUP BY sample)
SELECT round(avg(cce), 5) AS cce, round(avg(f1), 5) AS f1, round(avg(fp / norm), 5) AS false_positive, round(avg(cce) + 2 * (avg(f1) + avg(fp / norm)), 5) AS loss FROM own JOIN s USING (sample)""")
def entropy_f1(spark, sf_dir):
    return cd.entropy_f1_loss(samples(spark, sf_dir)).select(*[F.round(c, 5).alias(c) for c in ("cce", "f1", "false_positive", "loss")])


@query("los_strand_average", f"{tq.T}, s AS (SELECT pos // 25 AS sample, strand, avg(-ln(p[1])) AS l FROM track GROUP BY ALL) SELECT sample, round(0.5 * sum(l), 6) AS loss FROM s GROUP BY sample")
def strand_average(spark, sf_dir):
    each = tq.track(spark, sf_dir).groupBy(F.expr("pos div 25").alias("sample"), "strand").agg(F.avg(-F.log(F.col("p")[0])).alias("l"))
    return each.groupBy("sample").agg(F.round(0.5 * F.sum("l"), 6).alias("loss"))


@query("agg_weighted_loss", "SELECT user_id, round(sum(value * (event_id % 5)) / nullif(sum(event_id % 5), 0), 6) AS loss FROM events GROUP BY user_id HAVING sum(event_id % 5) > 0")
def weighted_loss(spark, sf_dir):
    n = F.col("event_id") % 5
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.col("value") * n).alias("v"), F.sum(n).alias("n")).filter("n > 0")
    return found.select("user_id", F.round(F.col("v") / F.col("n"), 6).alias("loss"))


@query("snk_collection_shares", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM documents GROUP BY source")
def collection_shares(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


@query("dst_split", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('split-7-' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, r <= greatest(least(round_even(n * 0.1, 0), n - 1), 1) AS validation FROM r""")
def split(spark, sf_dir):
    order = Window.partitionBy("source").orderBy(F.md5(F.concat(F.lit("split-7-"), F.col("doc_id").cast("string"))), "doc_id")
    r = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(order).alias("r"), F.count("*").over(Window.partitionBy("source")).alias("n"))
    return r.select("doc_id", "source", (F.col("r") <= F.greatest(F.least(F.bround(F.col("n") * 0.1), F.col("n") - 1), F.lit(1))).alias("validation"))


@query("dst_padding", "WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, (16 - n % 16) % 16 AS padding, n + (16 - n % 16) % 16 AS total FROM s")
def padding(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("padding", F.expr("pmod(-n, 16)")).withColumn("total", F.col("n") + F.col("padding"))


@query("set_union_all", "SELECT source, count(*) AS n FROM (SELECT 'document' AS source FROM documents UNION ALL SELECT 'page' FROM pages UNION ALL SELECT 'event' FROM events) GROUP BY source")
def union_all(spark, sf_dir):
    part = lambda t, s: table(spark, sf_dir, t).select(F.lit(s).alias("source"))
    return part("documents", "document").unionByName(part("pages", "page")).unionByName(part("events", "event")).groupBy("source").agg(F.count("*").alias("n"))


@query("set_manifest_difference", "SELECT doc_id, 'unlabelled' AS side FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unknown' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)")
def manifest_difference(spark, sf_dir):
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).withColumn("side", F.lit("unlabelled")).unionByName(b.exceptAll(a).withColumn("side", F.lit("unknown")))


@query("set_missing_rows", "SELECT i AS doc_id FROM (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM labels))) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def missing_rows(spark, sf_dir):
    seen = table(spark, sf_dir, "labels").select("doc_id")
    wanted = seen.agg(F.max("doc_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("doc_id"))
    return wanted.join(seen, "doc_id", "left_anti")


@query("jon_first_occurrence", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_occurrence(spark, sf_dir):
    order = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(order)).filter("r = 1").select("user_id", "event_type", "event_id")



@query("dst_batches", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS total FROM documents), p AS (SELECT doc_id, unnest(range(k, ((total + 20) // 21) * 21, total)) AS k, total FROM n)
SELECT doc_id, k // 21 AS step, (k % 21 % 3)::INT AS rank, (k % 21 // 3)::INT AS slot, k >= total AS padding FROM p""")
def full_batches(spark, sf_dir):
    """Documents in batches of seven for each of three ranks, the last ones filled up."""
    return batches.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3, 7)
