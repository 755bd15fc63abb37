"""Every query with an SQL twin gives the twin's rows, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from verify import rows
from weft.plans import general, reference, surface

QUERIES, ORACLE = general.QUERIES | reference.QUERIES | surface.QUERIES, general.ORACLE | reference.ORACLE | surface.ORACLE


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for p in Path(small).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, small, con, name):
    got, want = QUERIES[name](spark, small).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
