"""Running totals and best donors in stripes against all pairs, and thresholds over a plan."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from strandloom.functions.bases import STOPS
from strandloom.operators import candidates, splicing


@pytest.mark.parametrize("stripe", [1, 3, 40, 1 << 30])
def test_running(spark, stripe):
    rng = random.Random(stripe)
    rows = [(k, x, rng.randrange(-50, 50)) for k in "ab" for x in rng.sample(range(300), 80)] + [("c", 5, None), ("c", 9, 4)]
    frame = spark.createDataFrame(rows, "k string, x long, v long")
    for total, plain in ((F.sum, sum), (F.max, max), (F.min, min)):
        got = {(r.k, r.x): r.t for r in splicing.running(frame, ["k"], "x", "v", "t", total, stripe=stripe).collect()}
        for k, x, _ in rows:
            some = [v for j, y, v in rows if j == k and y <= x and v is not None]
            assert got[(k, x)] == (plain(some) if some else 0 if total is F.sum else None)


@pytest.mark.parametrize("stripe", [1, 7, 1 << 30])
def test_best_donors(spark, stripe):
    rng = random.Random(9)
    seq = "".join(rng.choice("ACGT") for _ in range(260))
    donors, acceptors = [], []
    for i in range(2, len(seq) - 2):
        for phase in range(3):
            if seq[i + 1 : i + 3] in splicing.ENDS:
                split = (seq[i], seq[i - 1 : i + 1], "")[phase]
                donors.append(("r%d" % (i % 2), phase, seq[i + 1 : i + 3], split, i, rng.choice([0.5, 1.0, rng.random()])))
            if seq[i - 2 : i] in ("AG", "AC"):
                acceptors += [("r0", phase, seq[i - 2 : i], seq[i : i + 2], i), ("r1", phase, seq[i - 2 : i], seq[i : i + 2], i)]
    d = spark.createDataFrame(donors, "rec string, phase int, motif string, split string, pos long, score double")
    a = spark.createDataFrame(acceptors, "rec string, phase int, motif string, ahead string, pos long")
    got = {(r.rec, r.phase, r.pos): (r.donor_score, r.donor) for r in splicing.best_donors(d, a, ["rec"], 6, stripe).collect()}
    want = {}
    for rec, phase, end, ahead, pos in acceptors:
        pairs = [(-v, at) for r, p, m, split, at, v in donors if r == rec and p == phase and splicing.ENDS[m] == end and pos >= at + 7 and (not split or split + ahead[: 3 - len(split)] not in STOPS)]
        if pairs:
            v, at = min(pairs)
            want[(rec, phase, pos)] = (-v, at)
    assert got == want and len(got) > 20


def test_donors_without_their_split_bases(spark):
    d = spark.createDataFrame([("r", 1, "GT", None, 0, 9.0), ("r", 1, "GT", "CA", 5, 1.0)], "rec string, phase int, motif string, split string, pos long, score double")
    a = spark.createDataFrame([("r", 1, "AG", "AC", 40)], "rec string, phase int, motif string, ahead string, pos long")
    assert [(r.donor, r.donor_score) for r in splicing.best_donors(d, a, ["rec"]).collect()] == [(5, 1.0)]


def test_equal_introns_far_into_a_track(spark, tmp_path):
    """The query over vectors that repeat, where sums of fractions would tell equal donors apart, against its SQL."""
    import duckdb

    from strandloom.plans import catalog

    catalog.load()
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").createOrReplaceTempView("some_vectors")
    spark.sql("SELECT row_number() OVER (ORDER BY k, vec_id) - 1L AS vec_id, embedding FROM (SELECT vec_id, embedding FROM some_vectors WHERE vec_id < 150), (SELECT explode(sequence(1, 20)) AS k)").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog.QUERIES["jon_best_introns"](spark, f"file://{tmp_path}").select("strand", "phase", "acceptor", "donor", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT strand, phase, acceptor, donor, score FROM ({catalog.ORACLE['jon_best_introns']})").fetchall()
    assert len(want) > 1000 and sorted(map(tuple, found)) == sorted(want)


def test_thresholds_over_a_plan(spark):
    rng = random.Random(5)
    p = lambda: [0.3, 0.1] + [rng.random() / 20 for _ in range(13)]
    rows = [(c, s, x, p()) for c in "ab" for s in "+-" for x in range(120)]
    track = spark.createDataFrame(rows, "chrom_id string, strand string, pos long, p array<double>")
    plan = [("a", 0, 10), ("a", 55, 90), ("b", 119, 120)]
    frame = spark.createDataFrame(plan, "chrom_id string, start long, stop long")
    for block in (1, 16, 1 << 16):
        got = {(r.chrom_id, r.strand): r for r in candidates.thresholds(track, ["chrom_id", "strand"], frame, block).collect()}
        for c in "ab":
            for s in "+-":
                some = [sum(q[4:15]) for d, t, x, q in rows if (d, t) == (c, s) and any(d == e and lo <= x < hi for e, lo, hi in plan)]
                mean, sd = statistics.mean(some), statistics.pstdev(some)
                r = got[(c, s)]
                assert r.n == len(some) and (r.mean, r.sd) == pytest.approx((mean, sd), abs=1e-12)
                assert (r.t1, r.t2, r.t3) == pytest.approx((max(0.5, mean + 1.5 * sd), max(0.2, mean + 0.5 * sd), max(0.05, mean - 0.5 * sd)))
    bad = spark.createDataFrame([("a", "+", 3, [0.5] * 14 + [math.nan])], track.schema)
    with pytest.raises(Exception, match="isn't finite"):
        candidates.thresholds(bad, ["chrom_id", "strand"], frame).collect()
