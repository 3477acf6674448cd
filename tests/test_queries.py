"""Every query against its SQL, and invariants of those that SQL can't express."""

import math

import pytest

import __spark_entry__ as entry_module
from quantloom.queries import catalog

CATALOG = catalog()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def near(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)


@pytest.mark.parametrize("name", sorted(CATALOG.sql))
def test_matches_sql(spark, duck, sf_dir, name):
    df = CATALOG.queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = duck.execute(CATALOG.sql[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    if not all(near(x, y) for a, b in zip(got, want) for x, y in zip(a, b)):  # rounding may have moved a row in the order
        key = lambda r: repr([x if not isinstance(x, float) else round(x, 4) for x in r])
        got, want = sorted(got, key=key), sorted(want, key=key)
        assert all(near(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries) - set(CATALOG.sql)))
def test_runs(spark, sf_dir, name):
    """Rows with values; what the values are is tested in test_values.py and test_invariants.py."""
    df = CATALOG.queries[name](spark, sf_dir)
    rows = df.collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    assert not rows or any(r[c] is not None for r in rows for c in df.columns)
    assert rows or name in {"implied_density", "stack_oos", "hmm_regimes", "ols_factor_table", "component_factors", "sector_forecast", "peer_projection"}  # too little data at the smallest size


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert rows and {r.location for r in rows} <= {"above value", "inside value", "below value"}
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
