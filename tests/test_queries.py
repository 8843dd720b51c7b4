"""Every query of the engine against its SQL."""

import duckdb
import pytest

from dimweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([float(r[i]) if isinstance(r[i], float) else r[i] for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir)
    want = db.execute(registry.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["event_id", "usersid", "dateid", "value"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
