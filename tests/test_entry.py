"""Every registered query against its DuckDB SQL on the smallest tables; row order and float rounding don't count."""

import duckdb
import pytest

import __spark_entry__ as entry
from redactra.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def canonical(rows):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, sf_dir, tables, name):
    df = own.queries()[name](spark, sf_dir)
    rows, names = df.collect(), sorted(df.columns)
    if name in own.oracle_sql():
        r = tables.execute(own.oracle_sql()[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == names
        assert canonical(tuple(x[n] for n in names) for x in rows) == canonical(tuple(x[cols.index(n)] for n in names) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(own.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
