"""Every registered query of the transaction state against its SQL in another engine."""

import duckdb
import pytest

from ledgerloom.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    assert name in ORACLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    out = con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in out.description], out.fetchall())
