"""Every registered query against its DuckDB oracle (count, columns, values)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import digest, duck

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    assert len(cols) == len(set(cols))
    if key not in ORACLES:           # one row for each document or page, or for those kept
        inputs = [con.execute(f"select count(*) from {t}").fetchone()[0] for t in ("documents", "pages")]
        assert 0 < len(rows) <= max(inputs)
        assert key == "pipeline" or len(rows) in inputs
        return
    res = con.execute(ORACLES[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["day", "search_count", "unique_users", "avg_tokens", "avg_latency",
                          "cache_hit_rate"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
