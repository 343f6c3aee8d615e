"""Full batches and owners of bases against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import genes
from strandloom.operators.batches import batches


@pytest.mark.parametrize(("n", "world", "size", "seed"), [(0, 2, 3, 1), (1, 2, 3, 1), (5, 4, 8, None), (64, 4, 8, 7), (65, 4, 8, 7), (33, 1, 10, None)])
def test_batches(spark, n, world, size, seed):
    frame = spark.createDataFrame([(k, [1.0, 2.0], k) for k in range(n)], "id long, `m.x` array<double>, n int").repartition(3)
    make = lambda: batches(frame, "id", world, size, seed, "m.x", F.transform(F.col("row").getField("m.x"), lambda v: v * 0))
    rows = make().collect()
    steps = -(-n // (world * size))
    assert collections.Counter((r.step, r.rank, r.slot) for r in rows) == collections.Counter((a, b, c) for a in range(steps) for b in range(world) for c in range(size))
    real = [r for r in rows if not r.padding]
    assert sorted(r.id for r in real) == list(range(n)) and all(r["m.x"] == ([0.0, 0.0] if r.padding else [1.0, 2.0]) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, make().collect()))
    if seed is None and n:
        assert [r.id for r in sorted(rows, key=lambda r: (r.step, r.slot, r.rank))] == [k % n for k in range(len(rows))]


@pytest.mark.parametrize("stripe", [1, 9, 1 << 30])
def test_owners(spark, stripe):
    rng = random.Random(6)
    spans = [("c%d" % rng.randrange(2), rng.choice("+-"), s, s + rng.choice([1, 4, 30])) for s in (rng.randrange(200) for _ in range(30))] + [("d", "+", 0, 10), ("d", "+", 10, 20)]
    over = collections.Counter((c, t, x) for c, t, s, e in spans for x in range(s, e))
    got = {(r.chrom_id, r.strand, r.at): r.owners for r in genes.ownership_violations(spark.createDataFrame(spans, "chrom_id string, strand string, s long, e long"), ["chrom_id", "strand"], stripe).collect()}
    assert got == {k: n for k, n in over.items() if n > 1 and n > over[(k[0], k[1], k[2] - 1)]}
