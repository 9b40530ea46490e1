"""Every query of the catalogue against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from tidemark import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)

    return sorted(tuple(one(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    got = con.execute(catalogue.SQL[name])
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.columns, rows) == canon(columns, got.fetchall())
