"""Stored tracks, dataset collections, reports, calibration and settings: what they give, and what they refuse."""

import json
import math

import pytest

import strandloom
from strandloom.functions import track as tk
from strandloom.operators import candidates, decode, orfs, tiling
from strandloom.plans import config
from strandloom.sources import datasets, reports, tracks
from strandloom.sources.files import Violation

MANIFEST = "chrom_id string, group_name string, chrom_length long, chrom_index long, num_windows long"
CHUNKS = "chrom_id string, global_window_index long, write_start long, write_end long"


def found(frame):
    return sorted((r[0], r[-1]) for r in frame.collect())


def track(spark, path, chunks):
    manifest = spark.createDataFrame([("a b", "a%20b", 30, 0, 2), ("c", "c", 10, 1, 1)], MANIFEST)
    tracks.initialise(spark, path, manifest)
    tracks.write_chunks(spark.createDataFrame(chunks, CHUNKS), path)


def test_track_is_complete_only_after_all_checks(spark, tmp_path):
    path = f"file://{tmp_path}/track"
    stage = tracks.staged(spark, path)
    track(spark, stage, [("a b", 0, 0, 20), ("a b", 1, 20, 30), ("c", 2, 0, 10)])
    with pytest.raises(Violation, match="incomplete"):
        tracks.read(spark, stage)
    tracks.finalise(spark, stage, path)
    assert tracks.read(spark, path).count() == 3
    tracks.validate(spark, path, spark.createDataFrame([("a b", "A" * 30), ("c", "C" * 10)], "chrom_id string, seq string"))
    with pytest.raises(Violation, match="another length"):
        tracks.validate(spark, path, spark.createDataFrame([("a b", "A" * 30), ("c", "C" * 11)], "chrom_id string, seq string"))
    assert tracks.staged(spark, path) == stage
    assert not (tmp_path / "track").exists()


@pytest.mark.parametrize(
    ("chunks", "problem"),
    [
        ([("a b", 0, 0, 20), ("c", 2, 0, 10)], "not covered to its end"),
        ([("a b", 0, 0, 20), ("a b", 1, 21, 30), ("c", 2, 0, 10)], "gap or overlap"),
        ([("a b", 0, 0, 20), ("a b", 1, 20, 30)], "no windows written"),
        ([("a b", 0, 0, 20), ("a b", 1, 20, 30), ("c", 2, 0, 10), ("d", 3, 0, 5)], "not in the manifest"),
        ([("a b", 0, 0, 10), ("a b", 1, 10, 20), ("a b", 3, 20, 30), ("c", 2, 0, 10)], "another number of windows"),
        ([("a b", 0, 0, 20), ("a b", 0, 20, 30), ("c", 2, 0, 10)], "stands twice"),
        ([("a b", 0, 0, 20), ("a b", 7, 20, 30), ("c", 2, 0, 10)], "out of range"),
    ],
)
def test_broken_tracks_stay_incomplete(spark, tmp_path, chunks, problem):
    stage = f"file://{tmp_path}/track.staged"
    track(spark, stage, chunks)
    with pytest.raises(Violation, match=problem):
        tracks.finalise(spark, stage, f"file://{tmp_path}/track")
    assert not (tmp_path / "track").exists()


def test_headers_and_names(spark):
    header = spark.createDataFrame([(k, v) for k, v in tracks.HEADER.items() if k != "gaps"] + [("states", "15"), ("more", "x"), ("version", None)], "name string, value string")
    assert found(tracks.header_violations(header)) == [("gaps", "missing"), ("more", "unknown"), ("states", "stands twice"), ("version", "stands twice")]
    other = spark.createDataFrame([*{**tracks.HEADER, "states": "14"}.items()], "name string, value string")
    assert found(tracks.header_violations(other)) == [("states", "another value")]
    manifest = spark.createDataFrame([("", "", 5, 0, 1), ("a/b", "a/b", 5, 1, 1), ("é~*", "%C3%A9~%2A", 5, 2, 1), ("x", "x", 0, 3, 1), ("y", "y", 3, 4, 0)], MANIFEST)
    assert found(tracks.naming_violations(manifest)) == [("", "no id"), ("a/b", "group name isn't that of the id"), ("x", "no length"), ("y", "no windows")]
    with pytest.raises(Violation, match="at least one record"):
        tracks.initialise(spark, "unused", manifest.limit(0))


ROWS = "input_ids array<bigint>, labels array<array<int>>, loss_mask array<array<double>>"


def row(n, first=0, last=1, strands=2, size=None):
    return ([first, *[7] * n, last], [[0] * (n if size is None else size)] * strands, [[1.0] * n] * 2)


def test_collections(spark, tmp_path):
    spark.createDataFrame([row(16), row(16)], ROWS).write.parquet(f"{tmp_path}/root/b")
    spark.createDataFrame([row(16)], ROWS).write.parquet(f"{tmp_path}/root/deep/a")
    spark.createDataFrame([row(16)], ROWS).write.parquet(f"{tmp_path}/root/b/inner")
    assert [p.rsplit("/", 2)[-2:] for p in datasets.discover(spark, f"{tmp_path}/root")] == [["root", "b"], ["deep", "a"]]
    spark.createDataFrame([row(32)], ROWS).write.parquet(f"{tmp_path}/other/a")
    spark.createDataFrame([row(16)], ROWS).write.parquet(f"{tmp_path}/other/b")
    with pytest.raises(Violation, match="lengths"):
        datasets.collection(spark, f"{tmp_path}/other")
    spark.createDataFrame([row(16)], ROWS).drop("labels").write.parquet(f"{tmp_path}/bare/a")
    with pytest.raises(Violation, match="labels"):
        datasets.collection(spark, f"{tmp_path}/bare")
    (tmp_path / "none").mkdir()
    with pytest.raises(Violation, match="no dataset"):
        datasets.discover(spark, f"{tmp_path}/none")
    bad = spark.createDataFrame([row(16), row(15), row(16, first=2), row(16, last=0), row(16, strands=1), row(16, size=15), row(0), (None, None, None)], ROWS)
    assert {r.problem: r.n for r in datasets.geometry_violations(bad).collect()} == {"length is no multiple of 16": 1, "first or last id": 2, "labels of another length": 2, "too few ids": 2}
    ranked = datasets.split(spark.range(1000), 4, "id").groupBy("rank").count().collect()
    assert len(ranked) == 4 and sum(r["count"] for r in ranked) == 1000


def test_windows_are_checked(spark):
    records = spark.createDataFrame([("c", 0, "ACGT" * 30), ("d", 1, "A")], "chrom_id string, chrom_index long, seq string")
    windows = tiling.inference_windows(records, 60, 10)
    assert datasets.window_violations(windows, 60, 10).isEmpty()
    assert {r.problem for r in datasets.window_violations(windows, 60, 5).collect()} == {"center of another size"}


def test_windows_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(tiling, "PIECE", 7)
    seqs = ["ACGTNACGGT" * 9 + "AC", "", "A", "ACGTACG"]
    records = spark.createDataFrame([(f"c{i}", i, s) for i, s in enumerate(seqs)], "chrom_id string, chrom_index long, seq string")
    for r in tiling.inference_windows(records, 40, 10).collect():
        whole = "N" * 10 + seqs[r.chrom_index] + "N" * 200
        assert r.sequence == whole[r.center_start : r.center_start + 40]
    rows = tiling.training_windows(records, 40, 10, 15, 40).collect()
    assert rows
    for r in rows:
        seq = seqs[int(r.chrom_id[1:])]
        assert r.sequence == ("N" * 10 + seq + "N" * 200)[r.window_start + 10 : r.window_start + 50]
        assert r.ambiguous == sum(b not in "ACGT" for b in seq[r.window_start + 10 : r.window_start + 30])


def test_reading_frames_of_one_long_record(spark):
    gene = "ATG" + "GCA" * 20 + "TAA"
    records = spark.createDataFrame([("c", 0, ("C" + gene) * 400), ("d", 1, ""), ("e", 2, "ATGTAA")], "chrom_id string, chrom_index long, seq string")
    got = [(r.s, r.e) for r in orfs.open_reading_frames(records).filter("strand = '+'").orderBy("s").collect()]
    assert got == [(k * 67 + 1, k * 67 + 67) for k in range(400)]


def test_reports(spark, tmp_path):
    quality = spark.createDataFrame([("g1", "t1", 90, 2, ["x", "y"], [], ["n"], 0.0), ("g1", "t2", 60, 1, [], ["h"], [], 0.5), ("g2", "t3", 60, 1, [], [], [], 1.0)], "gid string, tid string, cds_length long, cds_blocks long, zero_reasons array<string>, half_reasons array<string>, notes array<string>, mask double")
    genes = spark.createDataFrame([("g1", "c", "+", 0, 100), ("g2", "c", "-", 5, 50), ("g3", "c\td", "+", 1, 2)], "gid string, seqid string, strand string, s long, e long")
    tx = spark.createDataFrame([("t1", "c", "+", 0, 90), ("t2", "c", "+", 0, 60), ("t3", "c", "-", 5, 50)], "tid string, seqid string, strand string, s long, e long")
    table = {r.transcript_id: r for r in reports.quality_table(quality, tx, tx.filter("tid <> 't2'")).collect()}
    assert (table["t1"].zero_reasons, table["t1"].selected, table["t2"].selected, table["t3"].end) == ("x,y", True, False, 50)
    chosen = reports.selected_table(genes, quality)
    assert {r.gene_id: (r.selected_transcript_id, r.mask) for r in chosen.collect()} == {"g1": ("t1", 0.0), "g2": ("t3", 1.0), "g3": ("", 0.0)}
    reports.write_tsv(chosen.coalesce(1), f"{tmp_path}/tsv")
    lines = next((tmp_path / "tsv").glob("*.csv")).read_text().splitlines()
    assert lines[0].split("\t") == list(reports.SELECTED) and "g3\t\t0.0\tc d\t1\t2\t+" in lines
    reports.write_json(reports.summary(genes, quality), f"{tmp_path}/json")
    said = json.loads(next((tmp_path / "json").glob("*.json")).read_text())
    assert said == {"genes_with_protein_coding_transcripts": 2, "transcripts": 3, "gene_mask_counts": {"0.0": 1, "0.5": 0, "1.0": 1}}
    steps = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, None), (5, math.nan)], "step long, score double")
    assert [tuple(r) for r in reports.best(steps, "score", "step").collect()] == [(2, 0.9)]
    assert reports.best(steps.limit(0), "score", "step").isEmpty()

    def work(name):
        if name == "bad":
            raise ValueError("no\tgenome")

    assert [tuple(r) for r in reports.each_species(spark, ["good", "bad", "fine"], work, f"{tmp_path}/failed").collect()] == [("bad", "ValueError: no\tgenome")]
    with pytest.raises(ValueError, match="no\tgenome"):
        reports.each_species(spark, ["bad"], work, f"{tmp_path}/stopped", stop=True)


@pytest.mark.parametrize("wrong", [{"scale": (1.0,)}, {"bias": (math.inf,) * 15}, {"scale": (-1.0,) * 15}, {"epsilon": 0.0}, {"gene_intercept": math.nan}, {"version": ""}])
def test_calibration_is_checked(wrong):
    with pytest.raises(ValueError):
        tk.Calibration(**wrong)


def test_calibrated_scores(spark):
    p = [0.4, 0.3, 0.0] + [0.025] * 12
    odd = tk.Calibration(scale=tuple(0.1 * k for k in range(15)), bias=tuple(float(k) for k in range(15)), epsilon=1e-3)
    want = [(math.log(max(v, 1e-3)) - math.log(0.4)) * 0.1 * k + k for k, v in enumerate(p)]
    assert decode.label_odds([p], odd)[0] == pytest.approx(want)
    row = spark.createDataFrame([(p,)], "p array<double>").selectExpr(f"{tk.log_odds('p', calibration=odd)} AS x", f"{tk.bad_probabilities('p')} AS bad").first()
    assert list(row.x) == pytest.approx(want) and not row.bad
    for bad in ([0.1] * 14, [-0.1] * 15, [math.nan] * 15):
        with pytest.raises(ValueError):
            decode.label_odds([bad], odd)
        assert spark.createDataFrame([(bad,)], "p array<double>").selectExpr(tk.bad_probabilities("p")).first()[0]
    assert decode.label_odds([], odd).shape == (0, 15)


def test_crops_and_losses_refuse(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>")
    assert rows.selectExpr(f"{tk.flank_crop('x', 2)} AS y").first().y == [3]
    with pytest.raises(Exception, match="too long"):
        rows.selectExpr(f"{tk.flank_crop('x', 3)} AS y").collect()
    with pytest.raises(ValueError, match="known are"):
        candidates.loss(rows, "other")


def test_settings(tmp_path):
    assert config.strict(config.Preparation, {"window": 100, "flank": 10, "overlap": 0}).window == 100
    assert config.strict(config.Preparation, {"biotypes": ["mRNA"], "low_quality": "keep"}).rules().biotypes == ("mRNA",)
    for wrong in ({"windows": 1}, {"window": "100"}, {"window": True}, {"window": 10, "flank": 5}, {"policy": "best"}, {"overlap": -1}, {"biotypes": "coding"}, {"intron_source": "rna"}, {"hard_intron": 30}):
        with pytest.raises(ValueError):
            config.strict(config.Preparation, wrong)
    (tmp_path / "x.json").write_text('{"least_mean": 1, "min_cds": 30}')
    assert config.load(f"{tmp_path}/x.json", config.Prediction).min_cds == 30
    (tmp_path / "y.json").write_text("[]")
    with pytest.raises(ValueError, match="no settings"):
        config.load(f"{tmp_path}/y.json", config.Prediction)


def test_public_names():
    assert strandloom.Calibration is tk.Calibration and callable(strandloom.annotate)
    with pytest.raises(AttributeError):
        strandloom.nothing
