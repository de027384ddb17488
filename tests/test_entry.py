import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioforge.plans import registry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def tidy(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(tidy, v))
    return tidy(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    df = entry.queries()[name](spark, small)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(tidy(row[names.index(c)]) for c in sorted(names))) for row in r.fetchall())
    assert sorted(repr(tuple(tidy(row[c]) for c in sorted(names))) for row in df.collect()) == want
