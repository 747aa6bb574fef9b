"""Events at the price band equal their SQL where keys are past a thousand and past ten thousand."""

import shutil

import duckdb
import pytest

import __spark_entry__ as entry

SHIFTS = (0, 8_000, 60_000)


@pytest.fixture(scope="module")
def copies(sf_dir, tmp_path_factory):
    """The small tables three times, the copies with keys of their own."""
    folder = tmp_path_factory.mktemp("copies")
    shifted = {"lineitem": "l_orderkey + k AS l_orderkey, l_partkey + k AS l_partkey, l_suppkey + k AS l_suppkey", "supplier": "s_suppkey + k AS s_suppkey"}
    for name, keys in shifted.items():
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({keys}) FROM '{sf_dir}/{name}.parquet' t, (SELECT unnest({list(SHIFTS)}) AS k)) TO '{folder}/{name}.parquet' (FORMAT PARQUET)")
    for name in ("nation", "region"):
        shutil.copy(f"{sf_dir}/{name}.parquet", folder)
    return str(folder)


@pytest.mark.parametrize("name", ["factor_LIMIT_DOWN_EVENT", "factor_LIMIT_STREAK", "factor_LIMIT_UP_CNT_20", "factor_LIMIT_UP_EVENT"])
def test_events_of_large_keys(spark, copies, name):
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "nation", "region"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{copies}/{table}.parquet'")
    want = {(s, d): v for s, d, v in con.sql(entry.oracle_sql()[name]).fetchall()}
    got = {(r.sym, str(r.dt)): r.value for r in entry.queries()[name](spark, copies).collect()}
    assert any(v for (s, _), v in want.items() if s >= 2_000)
    assert got.keys() == want.keys() and not [k for k in want if got[k] != want[k]]
