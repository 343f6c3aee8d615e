"""Rules of transcripts and genes: against brute force, and what the queries on them move."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import genes, quality
from strandloom.plans import catalog, quality_queries, views

SF = "/root/testdata/sf0.001"
catalog.load()


def judged_by_brute_force(seqs, tx, children, source, hard=4, soft=20):
    """What test_rules_against_brute_force expects: {tid: (cds_length, zero reasons, half reasons)} by the rules on blocks, sequence and introns."""
    turned = lambda q: q[::-1].translate(str.maketrans(*bases.IUPAC))
    out = {}
    for tid, seqid, strand in tx:
        own = {k: sorted((s, e, p) for t, kind, s, e, p in children if t == tid and kind == k) for k in ("cds", "exon", "intron")}
        cds, exon, seq, zero, half = own["cds"], own["exon"], seqs.get(seqid), set(), set()
        clash = lambda x: any(b[0] < a[1] for a, b in zip(x, x[1:]))
        zero |= {n for n, c in (("no_CDS", not cds), ("CDS_blocks_overlap", clash(cds)), ("exon_blocks_overlap", clash(exon)), ("middle_CDS_length_le_2", any(e - s <= 2 for s, e, _ in cds[1:-1])), ("cds_seqid_not_in_fasta", bool(cds) and seq is None)) if c}
        zero |= {f"invalid_{n}_coordinates" for n, x in (("CDS", cds), ("exon", exon)) if any(s < 0 or e <= s for s, e, _ in x)}
        out_of = seq is not None and any(s < 0 or e > len(seq) for s, e, _ in cds)
        zero |= {"cds_coordinates_out_of_bounds"} if out_of else set()
        q = "" if seq is None or out_of else "".join(seq[s:e].upper() for s, e, _ in cds)
        q = turned(q) if strand == "-" else q
        if cds:
            zero |= {n for n, c in (("CDS_length_less_than_min", len(q) < 60), ("CDS_length_not_multiple_of_3", len(q) % 3 != 0), ("missing_start_codon", len(q) < 3), ("missing_stop_codon", len(q) < 3)) if c}
            stops = [q[i : i + 3] in bases.STOPS for i in range(0, len(q), 3)]
            if len(q) >= 3:
                zero |= {"noncanonical_start_codon"} if q[:3] != "ATG" else set()
                zero |= {"missing_or_noncanonical_stop_codon"} if q[-3:] not in bases.STOPS else set()
                zero |= {"internal_stop"} if len(q) % 3 == 0 and any(stops[:-1]) else set()
        between = lambda x: [(a[1], b[0]) for a, b in zip(x, x[1:])]
        kind = source if source != "auto" else "exon" if len(exon) >= 2 else "gff" if own["intron"] else "cds"
        gaps = [x[:2] for x in own["intron"]] if kind == "gff" else between(exon) if kind == "exon" and len(exon) >= 2 else between(cds)
        for s, e in gaps:
            n, inside = e - s, seq is not None and s >= 0 and e <= len(seq)
            piece = seq[s:e].upper() if inside and n > 0 else ""
            piece = turned(piece) if strand == "-" else piece
            zero |= {k for k, c in (("exon_or_CDS_blocks_overlap_or_touch", n <= 0), ("intron_length_lt_4", 0 < n < hard), ("intron_seqid_not_in_fasta", n > 0 and seq is None), ("intron_coordinates_out_of_bounds", n > 0 and seq is not None and not inside), ("splice_motif_missing", len(piece) == 1)) if c}
            zero |= {"splice_pair_not_supported_by_decoder"} if len(piece) > 1 and (piece[:2], piece[-2:]) not in bases.SPLICE_PAIRS else set()
            half |= {"intron_length_lt_20"} if hard <= n < soft else set()
        out[tid] = (len(q), zero, half)
    return out


@pytest.mark.parametrize(("size", "source"), [(7, "auto"), (64, "exon"), (quality.BLOCK, "gff"), (13, "cds")])
def test_rules_against_brute_force(spark, size, source):
    """Blocks of any size, records that are missing or too short, children of every kind in any order, genes and transcripts without any."""
    rng = random.Random(size)
    seqs = {"c": "".join(rng.choice("ACGTacgt") for _ in range(400)), "d": "ACG" * 20, "e": ""}
    tx = [(f"t{k}", rng.choice(("c", "c", "c", "d", "e", "lost")), rng.choice("+-")) for k in range(60)]
    children = []
    for tid, *_ in tx:
        at = rng.randrange(-2, 60)
        for _ in range(rng.randrange(7)):
            n = rng.choice((1, 2, 3, 6, 30, 60))
            children += [(tid, kind, at, at + n, rng.choice((0, 1, 2, None))) for kind in ("cds", "exon", "intron") if rng.random() < 0.6]
            at += n + rng.choice((-1, 0, 2, 5, 25, 40))
    rng.shuffle(children)
    plain = lambda *c: [*c, F.expr("cast(map() as map<string,string>)").alias("attributes")]
    frame = spark.createDataFrame([("g" + t, t, s, d) for t, s, d in tx], "gid string, tid string, seqid string, strand string")
    rows = quality.gathered(
        frame.select(*plain("gid", "seqid")), frame.select(*plain("*")), spark.createDataFrame(children, "tid string, type string, s long, e long, phase int").select(*plain("*"))
    )
    got = quality.judged(rows, spark.createDataFrame(list(seqs.items()), "chrom_id string, seq string"), source=source, size=size).collect()
    skipped = {"phase_missing_or_invalid"}
    assert {r.tid: (r.cds_length, set(r.zero_reasons) - skipped, set(r.half_reasons)) for r in got} == judged_by_brute_force(seqs, tx, children, source)
    assert all(len(r.zero_reasons) == len(set(r.zero_reasons)) and r.mask == (0.0 if r.zero_reasons else 0.5 if r.half_reasons else 1.0) for r in got)


def test_internal_stops_of_a_long_sequence(spark):
    """The rule goes through a sequence codon by codon without a stack that grows with it."""
    long = "ATG" + "GCA" * 200_000
    rows = [("whole", long + "TAA"), ("stop", long + "TAGTAA"), ("other frame", long + "CTAACC" + "TGA"), ("short", "TAA"), ("two", "TAATAA"), ("open", long)]
    got = genes.sequence_quality(spark.createDataFrame(rows, "id string, cds string")).collect()
    assert {r.id for r in got if "internal_stop" in r.zero_reasons} == {"stop", "two"}


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


@pytest.mark.parametrize("name", ["qc_all_rules", "qc_genes", "qc_genes_marked_longest", "qc_genes_first_span", "qc_genes_several_fail"])
def test_rules_move_only_what_lies_in_several_blocks(spark, name):
    """Line items meet once by order, and what is judged stays where it is written, but for transcripts in several blocks."""
    gathered = quality_queries.gathered(spark, SF)
    assert exchanges(gathered) <= 2 and gathered._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
    assert exchanges(catalog.QUERIES[name](spark, SF)) <= 3


def test_gathered_annotation_is_the_annotation(spark):
    """Rows made from line items are those that genes, transcripts and children make."""
    g, tx, children = quality_queries.annotation(spark, SF)
    want = quality.transcript_quality(g, tx, children, views.genome(spark, SF), source="auto")
    columns = ("gid", "tid", "cds_length", "cds_blocks", "zero_reasons", "half_reasons", "notes", "mask")
    got = quality_queries.judged(spark, SF)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_line_items_are_told_apart_by_what_is_needed(spark):
    """Only columns up to the last one asked for are sorted by and moved."""
    assert "l_shipdate" not in views.numbered_lines(spark, SF, "l_quantity")._jdf.queryExecution().executedPlan().toString()
    whole = views.numbered_lines(spark, SF, *views.LINE_ORDER).select("gid", "l_returnflag", "rn", "l_partkey", "l_quantity")
    some = views.numbered_lines(spark, SF, "l_partkey", "l_quantity")
    assert whole.exceptAll(some).isEmpty() and some.exceptAll(whole).isEmpty()


def test_overlapping_spans_move_no_flags(spark):
    plan = catalog.QUERIES["jon_same_strand_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_linestatus" not in plan and "l_extendedprice" not in plan and "l_quantity" in plan
