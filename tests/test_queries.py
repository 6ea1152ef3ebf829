"""Every query of the catalog against its SQL on the smallest driver data."""

import duckdb
import pytest

from loomlint import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(cols).collect())) == plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "line_no", "rule_id", "severity", "category", "confidence"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
