"""Window files in any order, over several triggers, against what one batch of them gives."""

import random

import pytest

from strandloom.sources.files import Violation
from strandloom.streaming import ordered

DDL = "chrom_id string, chrom_length long, chrom_window_index long, center_start long, center_end long"


def windows(records):
    """{name: (length, step)} -> rows, and what they write."""
    rows, want = [], []
    for name, (length, step) in records.items():
        for i, start in enumerate(range(0, length, step)):
            rows.append((name, length, i, max(0, start - 3), start + step))
            want.append((name, i, start, min(start + step, length), None))
    return rows, want


def collected(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_files_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    rows, want = windows({"a": (100, 10), "b": (95, 10), "c": (7, 10), "d": (61, 20)})
    rng.shuffle(rows)
    listed = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), ("d", 4)], "chrom_id string, num_windows long")
    source, target, marks = (f"file://{tmp_path}/{k}" for k in ("in", "out", "marks"))
    for k in range(0, 12, 6):
        spark.createDataFrame(rows[k : k + 6], DDL).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Violation, match="incomplete"):
        ordered.ingest(spark, source, target, marks, listed, 2)
    early = collected(ordered.read(spark, target))
    assert set(early) <= set(want) and not (tmp_path / "out" / "complete").exists()
    for k in range(12, len(rows), 5):
        spark.createDataFrame(rows[k : k + 5], DDL).coalesce(1).write.mode("append").parquet(source)
    ordered.ingest(spark, source, target, marks, listed, 2)
    assert collected(ordered.read(spark, target)) == sorted(want, key=str)
    assert spark.read.parquet(f"{target}/complete").count() == 4


def test_missing_and_repeated_windows(spark, tmp_path):
    rows, _ = windows({"a": (60, 10)})
    listed = spark.createDataFrame([("a", 6)], "chrom_id string, num_windows long")
    source, target, marks = (f"file://{tmp_path}/{k}" for k in ("in", "out", "marks"))

    def send(*numbers):
        spark.createDataFrame([rows[k] for k in numbers], DDL).coalesce(1).write.mode("append").parquet(source)
        with pytest.raises(Violation):
            ordered.ingest(spark, source, target, marks, listed, 9, most_waiting=1)
        return [r[1:] for r in collected(ordered.read(spark, target))]

    assert send(0, 0, 3)[-1] == (0, 0, 10, None)
    after = send(4)  # one window may wait, not two: what is missing is told, and the others go on
    assert (1, 10, 10, "missing") in after and (2, 10, 10, "missing") in after and (3, 27, 40, "gap") in after and (4, 40, 50, None) in after
    last = send(1, 5)
    assert (1, 7, 20, "came before or too late") in last and (5, 50, 60, None) in last


def test_state_is_kept_by_groups_of_records(spark, tmp_path):
    """More records than groups, over two triggers: keys of the state are groups, and results those of one batch."""
    rows, want = windows({f"r{k}": (50, 10) for k in range(1500)})
    random.Random(3).shuffle(rows)
    source, target, marks = (f"file://{tmp_path}/{k}" for k in ("in", "out", "marks"))
    spark.createDataFrame(rows, DDL).repartition(2).write.parquet(source)
    listed = spark.createDataFrame([(f"r{k}", 5) for k in range(1500)], "chrom_id string, num_windows long")
    ordered.ingest(spark, source, target, marks, listed, 1)
    assert collected(ordered.read(spark, target)) == sorted(want, key=str)
    state = spark.read.format("statestore").option("stateVarName", "at").load(marks)
    assert 0 < state.select("key").distinct().count() <= ordered.BUCKETS
