"""Written GFF3 against a plain writer, and datasets that are whole or not there."""

import glob
import random

import pytest

from strandloom.sources import files


def text(path):
    return "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_gff3(spark, tmp_path, parts):
    rng = random.Random(4)
    records = [(f"c{k}", k, 1000 + k) for k in range(9)]
    genes, number = [], 0
    for name, _, _ in records:
        for _ in range(rng.choice([0, 0, 1, 4])):
            number += 1
            genes.append((name, number, [f"{name}\tgene {number} line {j}" for j in range(rng.randint(2, 5))]))
    want = "##gff-version 3\n"
    for name, _, length in records:
        want += f"##sequence-region {name} 1 {length}\n"
        want += "".join(("###\n" if n > 1 else "") + "".join(x + "\n" for x in lines) for of, n, lines in genes if of == name)
    rows = [(of, n, j, x) for of, n, lines in genes for j, x in enumerate(lines)]
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "chrom_id string, number long, line_rank int, line string")
    listed = spark.createDataFrame(records, "chrom_id string, chrom_index int, chrom_length long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        files.write_gff3(lines, f"{tmp_path}/with", listed)
        files.write_gff3(lines, f"{tmp_path}/without")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert text(f"{tmp_path}/with") == want
    assert text(f"{tmp_path}/without") == "##gff-version 3\n" + "###\n".join("".join(x + "\n" for x in own) for _, _, own in genes)


def test_datasets(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    files.write_dataset(spark.range(10), path, 4)
    files.write_dataset(spark.range(3), path)
    assert spark.read.parquet(path).count() == 10
    files.write_dataset(spark.range(3), path, overwrite=True)
    assert spark.read.parquet(path).count() == 3 and not (tmp_path / "set.staged").exists()
    with pytest.raises(files.Violation, match="no rows"):
        files.write_dataset(spark.range(0), f"{path}-empty")
    assert not (tmp_path / "set-empty").exists()
    (tmp_path / "set" / "_SUCCESS").unlink()
    with pytest.raises(files.Violation, match="incomplete"):
        files.write_dataset(spark.range(3), path)
    files.write_dataset(spark.range(7), path, overwrite=True)
    assert spark.read.parquet(path).count() == 7
