"""Every registered query with SQL against DuckDB on the same tables."""

import decimal

import duckdb
import pytest

from timbra.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf():
    """The scale of the driver's comparison: sums and ties show there that smaller tables hide."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "None" if v != v else f"{float(v) + 0.0:.6f}"
    return f"{v:.6f}" if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    frame = QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in frame.collect())
    assert got
    if name in SQL:
        cur = con.execute(SQL[name])
        have = [x[0] for x in cur.description]
        assert sorted(have) == names
        want = sorted(tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall())
        assert got == want
