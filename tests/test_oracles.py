"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from colonnade.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("typed_selection_") or n.endswith("_25")])
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    assert got == sorted((tuple(r) for r in want.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
