"""Worked examples: windows, plans, thresholds, gaps, GFF files, streaming state."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import candidates, genes, intervals, quality, ranks, tiling
from strandloom.sources import files
from strandloom.streaming import ingest


def records(spark, *lengths):
    return spark.createDataFrame([(f"r{n}", i, "ACGT" * (n // 4) + "A" * (n % 4)) for i, n in enumerate(lengths)], "chrom_id string, chrom_index long, seq string")


def test_inference_windows(spark):
    got = tiling.inference_windows(records(spark, 100, 90, 20), 40, 5).orderBy("chrom_index", "chrom_window_index").collect()
    spans = {n: [(r.center_start, r.center_end) for r in got if r.chrom_length == n] for n in (100, 90, 20)}
    assert spans == {100: [(0, 30), (30, 60), (60, 90), (70, 100)], 90: [(0, 30), (30, 60), (60, 90)], 20: [(0, 30)]}
    assert all(len(r.sequence) == 40 for r in got)
    short = next(r for r in got if r.chrom_length == 20)
    assert short.sequence == "N" * 5 + "ACGT" * 5 + "N" * 15
    written = tiling.write_intervals(tiling.inference_windows(records(spark, 100), 40, 5)).orderBy("center_start").collect()
    assert [(r.write_start, r.write_end) for r in written] == [(0, 30), (30, 60), (60, 90), (90, 100)]


def test_training_windows(spark):
    got = tiling.training_windows(records(spark, 100), 40, 5, 10, 100).orderBy("window_start").collect()
    assert [r.window_start for r in got] == [-5, 25, 55, 65]
    assert tiling.training_windows(records(spark, 0), 40, 5, 10, 100).count() == 0


def test_sampling_plan(spark):
    plan = lambda n: [(r.start, r.stop) for r in tiling.sampling_plan(spark.createDataFrame([("a", n)], "chrom_id string, length long")).orderBy("start").collect()]
    assert plan(100_000) == [(0, 100_000)]
    big = plan(10_000_000)
    assert len(big) == 16 and big[0] == (296_500, 328_500)


@pytest.mark.parametrize(("mean", "want"), [(0.4, (0.70, 0.50, 0.30)), (0.1, (0.50, 0.20, 0.05))])
def test_thresholds(spark, mean, want):
    rows = [(0, i, [1 - c] + [0.0] * 3 + [c] + [0.0] * 10) for i, c in enumerate((mean - 0.2, mean + 0.2))]
    r = candidates.thresholds(spark.createDataFrame(rows, "strand int, pos long, p array<double>"), ["strand"]).first()
    assert (r.t1, r.t2, r.t3) == pytest.approx(want)


@pytest.mark.parametrize(("gap", "want"), [(10, [(0, 700)]), (11, [(0, 100)])])
def test_gap_fill(spark, gap, want):
    support = [True, True] + [False] * gap + [True, True]
    bins = spark.createDataFrame([("c", i, i == 0, s) for i, s in enumerate(support)], "chrom string, bin long, seed boolean, support boolean")
    assert [(r.s, r.e) for r in intervals.regions(bins, ["chrom"]).collect()] == want


def test_merge(spark):
    got = intervals.merge(spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 21, 30)], "k string, s long, e long"), ["k"]).orderBy("s").collect()
    assert [(r.s, r.e) for r in got] == [(0, 20), (21, 30)]


def test_phases_and_selection(spark):
    rows = [("g", "t", "q", "+", 1, 0, 5, 0), ("g", "t", "q", "+", 2, 10, 14, 0), ("g", "t", "q", "+", 3, 20, 23, 0)]
    b = spark.createDataFrame(rows, "gid string, tid string, seqid string, strand string, rn long, s long, e long, flagged int")
    assert [r.phase for r in genes.phased(b).orderBy("s").collect()] == [0, 1, 0]
    turned = genes.phased(b.withColumn("strand", F.lit("-"))).orderBy(F.desc("s")).collect()
    assert [r.phase for r in turned] == [0, 0, 2]
    tx = spark.createDataFrame([("g", "a", 300, 2, 50, 900, 0), ("g", "b", 300, 2, 40, 900, 0)], "gid string, tid string, cds long, n long, s long, e long, flagged int")
    assert genes.representative(tx).first().tid == "b"


def test_attributes_and_complements(spark):
    f = spark.createDataFrame([('ID=g%201;Note="x"',), ('gene_id "g1"; flag',), ("a=%zz;a=2;.;",)], "t string").select(F.expr(bases.attributes("t")).alias("a"))
    assert [r.a for r in f.collect()] == [{"ID": "g 1", "Note": '"x"'}, {"gene_id": "g1", "flag": ""}, {"a": "2"}]
    one = spark.createDataFrame([("ACGTRYKMN",)], "s string").select(F.expr(bases.reverse_complement("s")), F.expr(bases.reverse_complement("s", bases.PLAIN))).first()
    assert tuple(one) == ("NKMRYACGT", "NMKYRACGT")


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.fa").write_text(">one first\nacgt\n\nAC\n>two\nNN\n")
    (tmp_path / "a" / "x.gff3").write_text("##gff\nq\ts\tCDS\t1\t9\t.\t+\t0\tParent=t1\nq\ts\tgene\t5\t2\t.\t+\t.\tID=g\nbad line\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "y.fna").write_text(">y\nA\n")
    got = files.fasta(spark, f"{tmp_path}/a/x.fa").orderBy("chrom_id").collect()
    assert [(r.chrom_id, r.seq) for r in got] == [("one", "ACGTAC"), ("two", "NN")]
    assert files.fasta_violations(files.fasta(spark, f"{tmp_path}/a/x.fa")).count() == 0
    parts = files.hierarchy(files.identified(files.gff(spark, f"{tmp_path}/a/x.gff3")))
    assert [(r.tid, r.gid, r.s, r.e) for r in parts["transcripts"].collect()] == [("t1", "gene_for_t1", 0, 9)]
    (tmp_path / "a" / "y.txt").write_text("ACGT\n>one\nAC\n")
    assert [r.problem for r in files.fasta_problems(spark, f"{tmp_path}/a/y.txt").collect()] == ["sequence before the first header"]
    assert files.fasta_problems(spark, f"{tmp_path}/a/x.fa").count() == 0
    assert {r.name: r.problem for r in files.species(spark, str(tmp_path)).collect()} == {"a": None, "b": "0 GFF files"}
    with pytest.raises(files.Violation):
        files.require(files.species(spark, str(tmp_path)).filter("problem IS NOT NULL"), "species")


def test_hierarchy_of_gtf_and_pseudogenes(spark):
    text = [
        'c\ts\ttranscript\t11\t50\t.\t+\t.\tgene_id "G1"; transcript_id "T1"', 'c\ts\tCDS\t5\t60\t.\t+\t0\ttranscript_id "T1"', 'c\ts\tstart_codon\t1\t3\t.\t+\t.\ttranscript_id "T1"',
        "c\ts\tpseudogene\t1\t99\t.\t-\t.\tID=P1", "c\ts\texon\t20\t30\t.\t-\t.\tParent=P1", "c\ts\trRNA\t1\t9\t.\t+\t.\tID=r1", "c\ts\tmRNA\t7\t9\t.\t+\t.\tNote=x", "c\ts\tCDS\t4\t9\t.\t+\t0\tParent=U1",
    ]
    parts = files.hierarchy(files.identified(files.features(spark.createDataFrame(list(enumerate(text, 1)), "line_no long, value string"))))
    got = {(r.tid, r.gid, r.s, r.e) for r in parts["transcripts"].collect()}
    assert got == {("T1", "G1", 0, 60), ("P1.implicit_transcript", "P1", 0, 99), ("transcript@7", "gene_for_transcript@7", 6, 9), ("U1", "gene_for_U1", 3, 9)}
    assert {(r.gid, r.s, r.e) for r in parts["genes"].collect()} == {("G1", 10, 50), ("P1", 0, 99), ("gene_for_transcript@7", 6, 9), ("gene_for_U1", 3, 9)}
    order = [r.gid for r in parts["genes"].orderBy("parse_index").collect()]
    assert order == ["P1", "G1", "gene_for_transcript@7", "gene_for_U1"]


def test_hierarchy_meets_once_by_name(spark):
    """Children are counted and reached over where their transcripts' lines are, without joins; an implicit transcript and a line or parent of its name are one."""
    text = [
        "c\ts\tgene\t1\t99\t.\t+\t.\tID=G1", "c\ts\texon\t20\t30\t.\t+\t.\tParent=G1", "c\ts\texon\t90\t120\t.\t+\t.\tParent=G1.implicit_transcript",
        "c\ts\tgene\t1\t9\t.\t-\t.\tID=G2", "d\ts\tmRNA\t4\t5\t.\t+\t.\tID=G2.implicit_transcript;Parent=G3", "c\ts\tCDS\t2\t3\t.\t-\t0\tParent=G2,T4", "c\ts\tCDS\t7\t8\t.\t-\t0\tParent=T4",
        "c\ts\tmRNA\t40\t50\t.\t+\t.\tID=T5;Parent=G1",
    ]
    parts = files.hierarchy(files.identified(files.features(spark.createDataFrame(list(enumerate(text, 1)), "line_no long, value string"))))
    plan = parts["transcripts"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(") == 1
    got = {(r.tid, r.gid, r.seqid, r.s, r.e, r.children) for r in parts["transcripts"].collect()}
    assert got == {("G1.implicit_transcript", "G1", "c", 0, 120, 2), ("G2.implicit_transcript", "G3", "d", 1, 5, 1), ("T4", "gene_for_T4", "c", 1, 8, 2), ("T5", "G1", "c", 39, 50, 0)}
    assert sorted((r.tid, r.s) for r in parts["children"].collect()) == [("G1.implicit_transcript", 19), ("G1.implicit_transcript", 89), ("G2.implicit_transcript", 1), ("T4", 1), ("T4", 6)]
    assert {(r.gid, r.s, r.e) for r in parts["genes"].collect()} == {("G1", 0, 99), ("G2", 0, 9), ("G3", 3, 5), ("gene_for_T4", 1, 3)}


def test_sums_before(spark):
    rows = [(k * 3 % 101, k % 7) for k in range(101)]
    got = {r.k: r.before for r in ranks.sums_before(spark.createDataFrame(rows, "k long, n long"), "k", "n", "before").collect()}
    assert got == {k: sum(n for j, n in rows if j < k) for k, _ in rows}


def test_every_short_intron_counts(spark):
    rows = [("g", "t", "c", "+", s, e, 0) for s, e in ((0, 30), (30, 60), (62, 92), (102, 132))]
    found = genes.quality(spark.createDataFrame(rows, "gid string, tid string, seqid string, strand string, s long, e long, flagged int")).first()
    assert {"exon_or_CDS_blocks_overlap_or_touch", "intron_length_lt_4"} <= set(found.zero_reasons) and found.half_reasons == ["intron_length_lt_20"]


def test_ranges_over_sequence_blocks(spark):
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1000))
    blocks = quality.sequence_blocks(spark.createDataFrame([("c", seq), ("d", None)], "chrom_id string, seq string"), 64)
    ranges = [(k, "c", s, e) for k, (s, e) in enumerate([(0, 1), (63, 65), (10, 900), (0, 1000), (999, 1000), (990, 1001), (64, 128)])]
    got = {r.k: r.seq for r in quality.looked_up(spark.createDataFrame(ranges, "k int, seqid string, s long, e long"), blocks, ["k"], 64).collect()}
    assert got == {k: seq[s:e] for k, _, s, e in ranges if e <= 1000}


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_stream_state_tells_gaps():
    state = State()
    frame = lambda *rows: pd.DataFrame(rows, columns=["chrom_id", "chrom_length", "chrom_window_index", "center_start", "center_end"])
    first = next(ingest.follow(("c",), iter([frame(("c", 100, 1, 30, 60), ("c", 100, 0, 0, 30))]), state))
    assert first.problem.tolist() == [None, None] and state.get == (60, 1)
    later = next(ingest.follow(("c",), iter([frame(("c", 100, 2, 70, 100))]), state))
    assert later.problem.tolist() == ["gap"] and state.get == (60, 1)


@pytest.mark.parametrize("stripe", [1, 7, 64, 1 << 20])
def test_conflicting_genes_without_pairs(spark, stripe):
    import random

    from strandloom.operators import genes

    rng = random.Random(stripe)
    rows = []
    for k in range(160):
        s = rng.randrange(900)
        rows.append((k // 2, f"t{k}", rng.choice("xy") if k % 9 == 0 else "x", "+-"[k // 2 % 2], s, s + rng.choice((1, 2, 5, 30))))
    frame = spark.createDataFrame(rows, "gid long, tid string, seqid string, strand string, s long, e long")
    want = {g for a in rows for b in rows if a[0] != b[0] and a[2:4] == b[2:4] and a[4] < b[5] and b[4] < a[5] for g in (a[0], b[0])}
    got = genes.conflicting_genes(frame, stripe)
    assert sorted(r.gid for r in got.collect()) == sorted(want) and 5 < len(want) < 80
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
