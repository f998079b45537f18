"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from simgrove import queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(frame[columns].astype(str).itertuples(index=False, name=None))


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_agrees_with_itself(spark, name):
    one, two = (rows(queries.QUERIES[name](spark, SF).toPandas()) for _ in range(2))
    assert one == two and one[1]


@needs_data
def test_distance_matrix_holds_all_pairs(spark):
    n = queries.vector_keys(spark, SF).count()
    assert queries.QUERIES["distance_matrix"](spark, SF).count() == n * n


def test_distance_matrix_of_several_blocks(spark, tmp_path):
    """Repeated and missing ids, three blocks: all rows, over several tasks, in files of under a byte a row."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    vectors = np.random.default_rng(5).normal(size=(2500, 64)).astype(np.float32)
    ids = [None, 7, 7, *range(10, 2507)]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": vectors.tolist(), "label": pa.array([1] * 2500, pa.int32())}), tmp_path / "embeddings.parquet")
    queries.QUERIES["distance_matrix"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    files = glob.glob(f"{tmp_path}/out/*.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    c.sql(f"CREATE TABLE found AS SELECT a, b, distance, count(*) AS n FROM '{tmp_path}/out/*.parquet' GROUP BY ALL")
    c.sql(f"CREATE TABLE wanted AS SELECT a, b, distance, count(*) AS n FROM ({queries.ORACLES['distance_matrix']}) GROUP BY ALL")
    assert c.sql("SELECT sum(n) FROM found").fetchall() == [(2500 * 2500,)]
    assert not c.sql("(FROM found EXCEPT FROM wanted) UNION ALL (FROM wanted EXCEPT FROM found)").fetchall()
    assert len(files) > 1 and sum(map(os.path.getsize, files)) < 2500 * 2500


def test_distance_matrix_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.QUERIES["distance_matrix"](spark, str(tmp_path)).count() == 0


@needs_data
def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "similarity" in found.columns


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
