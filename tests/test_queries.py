"""Every registered query against its SQL, and none of them empty."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__
from lorekeep import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return made


def tidy(rows):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    rows = tidy(map(tuple, got.select(*columns).collect()))
    assert rows == tidy(cursor.fetchall())
    assert rows or name in ("contradiction_scan", "audit_breaks")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
