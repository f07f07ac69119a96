"""Every query against its SQL on the smallest tables, in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from plinth import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    columns = [[tuple(x) if isinstance(x, list) else x for x in table.column(n).to_pylist()] for n in names]
    return names, sorted(map(repr, zip(*columns, strict=True)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert rows(catalogue.queries()[name](spark, SF).toArrow()) == rows(duck.sql(SQL[name]).to_arrow_table())


def test_queries_without_sql_are_few():
    assert set(catalogue.queries()) - set(SQL) == {"hash_embed_blake2b", "chunks_packed", "chunk_ids"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
