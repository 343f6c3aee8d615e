"""Every query of the library against its SQL twin on the smallest tables, and the contract."""

import glob
import os

import duckdb
import pytest

from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, tmp_path, name):
    frame = catalog.QUERIES[name](spark, SF)
    frame.write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TABLE want AS {catalog.ORACLE[name]}")
    columns = sorted(frame.columns)
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    got = f"SELECT {listed} FROM '{tmp_path}/out/*.parquet'"
    for a, b in ((got, f"SELECT {listed} FROM want"), (f"SELECT {listed} FROM want", got)):
        assert duck.execute(f"{a} EXCEPT ALL {b} LIMIT 3").fetchall() == []


def test_decoded_genes_have_whole_codons(spark):
    rows = catalog.QUERIES["dec_gene_paths"](spark, SF).collect()
    assert rows and all(r.cds % 3 == 0 and r.cds >= 9 for r in rows)


@pytest.mark.parametrize("name", ["win_longest_cds", "win_first_transcript", "win_marked_longest", "win_fail_several", "jon_gene_hierarchy", "snk_gene_lines"])
def test_blocks_are_dealt_once(spark, name):
    """Line items go to their gene's task once, and nothing that follows there moves them."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    times = 2 if name == "snk_gene_lines" else 1
    assert plan.count("REPARTITION_BY_NUM") == times and plan.count("Exchange hashpartitioning(") <= (6 if times == 2 else 2)


def test_annotation_lines_are_numbered_once(spark):
    """Children and transcripts are read from what is written, so line items are not sorted again for each kind."""
    from strandloom.plans import quality_queries

    _, transcripts, children = quality_queries.annotation(spark, SF)
    for frame in (transcripts, children):
        assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()


def test_partitions_follow_the_rows(spark):
    from strandloom.plans.session import dealt

    assert dealt(spark.range(10_000), "id", 100).rdd.getNumPartitions() == 100 and dealt(spark.range(10), "id").rdd.getNumPartitions() == 4


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = sorted(map(tuple, catalog.QUERIES["ivl_candidate_regions"](spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == sorted(map(tuple, catalog.QUERIES["ivl_candidate_regions"](spark, SF).collect()))
