"""Every registered query that has SQL gives DuckDB's rows."""

import os

import duckdb
import pytest
from pyspark.errors import ArithmeticException

from millrace.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = in_order([tuple(r) for r in df.select(*columns).collect()])
    assert rows
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        assert sorted(want.columns) == columns
        assert rows == in_order(want.select(*(f'"{c}"' for c in columns)).fetchall())


def embeddings(duck, folder, lists):
    rows = ", ".join(f"({k}, {v}::FLOAT[])" for k, v in enumerate(lists))
    duck.execute(f"COPY (SELECT k::BIGINT AS vec_id, v AS embedding FROM (VALUES {rows}) t(k, v)) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return registry.ORACLES["higher_order"].replace("FROM embeddings", f"FROM '{folder}/embeddings.parquet'")


@pytest.mark.parametrize("lists", [["[0.4235]", "[-0.4235, 2.5]", "[8388.609]", "[-8388.609, 0]"], ["[NULL, 3, -0.0005]", "[NULL, 1]", "[NULL]", "[]", "NULL"], ["[9e15, 9e15, -9e15]", "[-9.223372e15]"]], ids=["rounding", "nulls", "large"])
def test_higher_order_gives_the_sums_of_its_sql(spark, duck, tmp_path, lists):
    sql = embeddings(duck, tmp_path, lists)
    got = registry.QUERIES["higher_order"](spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == duck.sql(sql).order("vec_id").fetchall()


@pytest.mark.parametrize("floats", ["['nan']", "['inf']", "[1, 9.223372e15]", "[1, -1e16]", "[9e15, 9e15]"])
def test_higher_order_refuses_what_is_no_bigint(spark, duck, tmp_path, floats):
    sql = embeddings(duck, tmp_path, [floats])
    with pytest.raises(duckdb.ConversionException):
        duck.sql(sql).fetchall()
    with pytest.raises(ArithmeticException):
        registry.QUERIES["higher_order"](spark, str(tmp_path)).collect()
