"""Every registered query against its DuckDB oracle on sf0.001."""
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace("T", " ")
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, round(x, 3)) if isinstance(x, (int, float)) and not isinstance(x, bool)
                 else (2, str(x)) for x in row)


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if a == b:
        return True
    if isinstance(a, tuple):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    return a == b


def test_every_query_registered_has_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert "stock_features" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    assert sorted(cols) == sorted(ocols)
    order = sorted(cols)
    a = sorted((tuple(r[cols.index(c)] for c in order) for r in rows), key=_key)
    b = sorted((tuple(r[ocols.index(c)] for c in order) for r in orows), key=_key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if not _close(x, y)]
    assert not bad, bad[:3]
