"""Islands, gaps, regions and overlays in stripes of any length against plain versions over whole chromosomes."""

import random

import pytest

from strandloom.operators import genes
from strandloom.operators import intervals as iv

STRIPES = [1, 2, 7, 50, 1 << 30]


def collected(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def plain_merge(rows):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
        else:
            out.append([c, s, e])
    return sorted(map(tuple, out))


def plain_islands(points):
    """points: {(chrom, at): flag} -> (chrom, first, last, any flag)."""
    out = []
    for (c, x), f in sorted(points.items()):
        if out and out[-1][0] == c and out[-1][2] == x - 1:
            out[-1][2], out[-1][3] = x, out[-1][3] or f
        else:
            out.append([c, x, x, f])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("stripe", STRIPES)
def test_merge(spark, stripe):
    rng = random.Random(1)
    rows = [(c, s, s + rng.choice([0, 1, 3, 20, 90])) for c in "ab" for s in (rng.randrange(600) for _ in range(60))] + [("c", 50, 100), ("c", 100, 150), ("c", 7, 7), ("c", 14, 14), ("c", 200, 207), ("c", 207, 207)]
    frame = spark.createDataFrame(rows, "chrom string, s long, e long")
    assert collected(iv.merge(frame, ["chrom"], stripe), "chrom", "s", "e") == plain_merge(rows)
    assert iv.merge(frame.limit(0), ["chrom"], stripe).count() == 0


@pytest.mark.parametrize("stripe", STRIPES)
def test_islands_and_gaps(spark, stripe):
    rng = random.Random(2)
    bins = {(c, x): (rng.random() < 0.05, rng.random() < (0.15 if x % 90 < 60 else 0.9)) for c in "ab" for x in range(400) if not 150 < x < 170}
    frame = spark.createDataFrame([(c, x, seed, sup) for (c, x), (seed, sup) in bins.items()], "chrom string, bin long, seed boolean, support boolean")
    assert collected(iv.islands(frame.filter("support"), ["chrom"], "bin", ["seed"], stripe), "chrom", "first", "last", "seed") == plain_islands({k: v[0] for k, v in bins.items() if v[1]})
    want = [r[:3] + (sup,) for sup in (True, False) for r in plain_islands({k: v[0] for k, v in bins.items() if v[1] == sup})]
    assert collected(iv.runs(frame, ["chrom"], "support", stripe=stripe), "chrom", "first", "last", "support") == sorted(want)
    filled = {}
    for (c, x), (seed, sup) in bins.items():
        before = max((y for (d, y), v in bins.items() if d == c and y <= x and v[1]), default=None)
        behind = min((y for (d, y), v in bins.items() if d == c and y >= x and v[1]), default=None)
        if sup or (before is not None and behind is not None and behind - before - 1 <= 4):
            filled[(c, x)] = seed
    assert {(r.chrom, r.bin) for r in iv.gaps_filled(frame, ["chrom"], 4, stripe).filter("filled").collect()} == set(filled)
    assert iv.gaps_filled(frame, ["chrom"], 4, stripe).count() == len(bins)
    regions = [(c, a * 50, (b + 1) * 50) for c, a, b, seeded in plain_islands(filled) if seeded]
    assert collected(iv.regions(frame, ["chrom"], most_gap=4, stripe=stripe), "chrom", "s", "e") == sorted(regions)
    whole = iv.extended(iv.regions(frame, ["chrom"], most_gap=4), frame, ["chrom"], least=200, quiet=150, most=1_000)
    assert collected(iv.extended(iv.regions(frame, ["chrom"], most_gap=4, stripe=stripe), frame, ["chrom"], least=200, quiet=150, most=1_000, stripe=stripe), "chrom", "s", "e") == collected(whole, "chrom", "s", "e")


@pytest.mark.parametrize("stripe", STRIPES)
def test_least_weight(spark, stripe):
    rng = random.Random(3)
    rows = [(c, s, s + rng.choice([1, 5, 40]), rng.choice([0.0, 0.5, 1.0])) for c in "ab" for s in (rng.randrange(200) for _ in range(25))]
    over = {}
    for c, s, e, w in rows:
        for x in range(s, e):
            over[(c, x)] = min(over.get((c, x), w), w)
    ends = {(c, x) for c, s, e, _ in rows for x in (s, e)}
    want = []
    for (c, x), w in sorted(over.items()):
        if want and want[-1][0] == c and want[-1][2] == x and want[-1][3] == w:
            want[-1][2] = x + 1
        else:
            want.append([c, x, x + 1, w])
    assert ends and collected(iv.least_weight(spark.createDataFrame(rows, "chrom string, s long, e long, w double"), ["chrom"], stripe=stripe), "chrom", "s", "e", "w") == sorted(map(tuple, want))


@pytest.mark.parametrize("bucket", [1, 7, 1 << 10])
def test_same_strand_pairs_are_made_once(spark, bucket):
    """All pairs once, by buckets of any length: equal begins, spans in many buckets, empty spans and repeated rows."""
    rng = random.Random(bucket)
    rows = [(rng.randrange(12), f"t{k % 55:02d}", "c", rng.choice("+-"), s, s + rng.choice((0, 1, 3, 20, 90))) for k in range(60) for s in [rng.randrange(100)]]
    got = genes.same_strand_conflicts(spark.createDataFrame(rows, "gid long, tid string, seqid string, strand string, s long, e long"), bucket).collect()
    want = [(a[1], b[1], a[0], b[0]) for a in rows for b in rows if a[2:4] == b[2:4] and a[1] < b[1] and a[0] != b[0] and a[4] < b[5] and b[4] < a[5]]
    assert sorted(map(tuple, got)) == sorted(want)
