import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [q for q in entry.plans.QUERIES]


def key(v):
    return repr(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = sorted(tuple(key(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert rows == sorted(tuple(key(x[i]) for i in order) for x in r.fetchall())
