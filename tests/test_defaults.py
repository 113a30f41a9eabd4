"""A choice of queries with code generation as Spark has it; the other tests run without, which is faster on few rows."""

import duckdb
import pytest

from plumbline.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = ["column_profile_precise_numbers", "tampered_precise_load", "timing_stats_outlier", "run_rows", "corrected_mapping", "digest_tree_differences"]


@pytest.fixture(scope="module")
def compiled(spark):
    off = {name: spark.conf.get(name) for name in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    for name, value in zip(off, ("true", "FALLBACK")):
        spark.conf.set(name, value)
    yield spark
    for name, value in off.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_sql_with_code_generation(compiled, name):
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    rows = QUERIES[name](compiled, SF_DIR).collect()
    assert sorted(repr(tuple(r[n] for n in names)) for r in rows) == sorted(map(repr, cursor.fetchall()))
