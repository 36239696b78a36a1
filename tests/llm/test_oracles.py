"""The queries of this package that have SQL, against DuckDB."""
import pytest

from tests.test_oracle import _close, _key, _norm
from tsq.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_llm_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=_key)
    res = con.execute(Q.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == order
    want = sorted((tuple(_norm(r[names.index(c)]) for c in order) for r in res.fetchall()), key=_key)
    assert len(rows) == len(want)
    bad = [(x, y) for x, y in zip(rows, want) if not _close(x, y)]
    assert not bad, bad[:3]
