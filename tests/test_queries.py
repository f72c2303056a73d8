"""Every query with a statement against DuckDB, on the smallest tables; the others' rows."""

import math
import os

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equal_to_statement(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    rows = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted(repr(tuple(_plain(r[c]) for c in order)) for r in df.collect())
    theirs = sorted(repr(tuple(_plain(r[names.index(c)]) for c in order)) for r in rows)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_filling_capacity_reads_no_titles(spark):
    df = catalog.queries()["capacity_fill"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "title" not in plan.replace("concat_ws( , p_name", "") and df.count() > 0  # standard or not is settled beside the part


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_all_mixed_script_tokens(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, " ".join(f"{chr(97 + i)}ж{chr(97 + i)}" for i in range(25)), "ru", "src0", 99)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(catalog.oracle_sql()["mixed_script_tokens"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["mixed_script_tokens"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 25
