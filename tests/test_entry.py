"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _rows(df):
    names = sorted(df.columns)

    def plain(v):
        if v is None or v != v:
            return "null"
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)

    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.to_dict("records"))


@needs_data
def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    wrong = [n for n in sql if _rows(queries[n](spark, DATA).toArrow().to_pandas(types_mapper=None)) != _rows(con.sql(sql[n]).df())]
    assert not wrong


@needs_data
def test_queries_without_sql_run(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in set(queries) - set(sql):
        assert queries[name](spark, DATA).count() >= 0
    assert entry.entry(spark).count() > 0


@needs_data
def test_index_files_stay_off_the_driver(spark, monkeypatch, tmp_path):
    """No path of a written index comes to the driver, and indexes are written beside sources named by a URI."""
    from pyspark.sql.classic.dataframe import DataFrame

    from chronoframe.operators import grouping
    from chronoframe.sources.frames import read_frames

    def refuse(self, *_):
        raise AssertionError("rows are gathered on the driver")

    expected = entry.queries()["index_files"](spark, DATA).count()
    for name in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(DataFrame, name, refuse)
    assert entry.queries()["index_files"](spark, DATA).count() == expected > 0
    spark.read.parquet(f"{DATA}/frames.parquet").where("source_id is not null").limit(1).select("raw").coalesce(1).write.format("chronoframe").mode("append").save(str(tmp_path / "a%2Fb"))
    index = grouping.time_index(read_frames(spark, f"file://{tmp_path}"))
    assert grouping.write_indexes(index).count() == 1
