"""FASTA in byte ranges against a plain reader."""

import gzip
import random

import pytest

from strandloom.sources import sequences
from strandloom.sources.files import Violation


def plain(text):
    out, name = {}, None
    for line in text.replace("\r\n", "\n").split("\n"):
        if line.startswith(">"):
            name = line[1:].split()[0]
            out[name] = ""
        else:
            out[name] = out.get(name, "") + "".join(line.split()).upper()
    return out


def fasta(rng, names):
    parts = []
    for k, name in enumerate(names):
        n = rng.choice([0, 1, 5, 99, 100, 101, 700, 2500])
        seq = "".join(rng.choice("acgtN") for _ in range(n))
        width = rng.choice([7, 60, 10_000])
        parts.append(f">{name} about {k}\n" + "".join(seq[i : i + width] + rng.choice(["\n", "\r\n", "\n\n"]) for i in range(0, n, width)))
    return "".join(parts)


@pytest.mark.parametrize("most", ["67", "500", "128m"])
def test_blocks(spark, tmp_path, most):
    rng = random.Random(most)
    texts = {f"f{k}.{'fa' if k % 2 else 'fasta'}": fasta(rng, [f"c{k}.{j}" for j in range(6)]) for k in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "zipped.fna.gz").write_bytes(gzip.compress(b">z1\nACGTAC\nGT\n") + gzip.compress(b"AC\n>z2 x\n\n>z3\nTT"))
    (tmp_path / "hidden.fna").write_bytes(gzip.compress(b">h1\nACGTAC\nGT\nA") + gzip.compress(b"CC\n>h2\n>h3\nTT" + b"ACGTN\n" * 90))
    (tmp_path / "notes.txt").write_text("nothing")
    want = {k: v for t in texts.values() for k, v in plain(t).items()} | {"z1": "ACGTACGTAC", "z2": "", "z3": "TT", "h1": "ACGTACGTACC", "h2": "", "h3": "TT" + "ACGTN" * 90}
    conf, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(conf, most)
    try:
        held = sequences.blocks(spark, f"file://{tmp_path}", 100).cache()
        rows = held.collect()
        assert {r.chrom_id: (r.chrom_length, r.seq) for r in sequences.records(held).collect()} == {k: (len(v), v) for k, v in want.items()}
        assert sorted((r.chrom_id, r.block, r.piece, r.length) for r in rows) == sorted((k, b, v[100 * b : 100 * b + 100], len(v)) for k, v in want.items() for b in range(max(1, -(-len(v) // 100))))
        long = max(want, key=lambda k: len(want[k]))
        ranges = spark.createDataFrame([(1, long, 0, 100), (2, long, 95, 305), (3, long, 50, 50), (4, "h1", 2, 11)], "k int, seqid string, s long, e long")
        assert {r.k: r.seq for r in sequences.fetched(ranges, held, ["k"], 100).collect()} == {1: want[long][:100], 2: want[long][95:305], 3: "", 4: "GTACGTACC"}
        for bad in ((5, "none", 0, 1), (6, "h1", 5, 12), (7, "h1", -1, 3)):
            with pytest.raises(Violation):
                sequences.fetched(spark.createDataFrame([bad], ranges.schema), held, ["k"], 100)
    finally:
        spark.conf.set(conf, old)


@pytest.mark.parametrize(("text", "problem"), [("ACGT\n>a\nC", "before the first header"), (">\nACGT", "empty header"), (">a\nC\n>a b\nG", "duplicate id"), ("\n \n>a\nC", None)])
def test_problems(spark, tmp_path, text, problem):
    (tmp_path / "x.fa").write_text(text)
    if problem is None:
        assert [r.piece for r in sequences.blocks(spark, f"file://{tmp_path}/x.fa").collect()] == ["C"]
        return
    with pytest.raises(Violation, match=problem):
        sequences.blocks(spark, f"file://{tmp_path}")
    assert sequences.blocks(spark, f"file://{tmp_path}", strict=False).count() >= 1


def test_false_gzip(spark, tmp_path):
    (tmp_path / "x.fa.gz").write_text(">a\nACGT\n")
    with pytest.raises(Violation, match="not gzip"):
        sequences.blocks(spark, f"file://{tmp_path}")
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "cut.fa").write_bytes(gzip.compress(b">a\nACGT\n" * 99)[:-20])
    with pytest.raises(Exception, match="gzip|Error -|ends inside"):
        sequences.blocks(spark, f"file://{tmp_path}/y").collect()
