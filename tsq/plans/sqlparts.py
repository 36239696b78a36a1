"""Shared DuckDB SQL fragments (CTE bodies) of the fixture views.

They mirror :mod:`tsq.sources.tables` so each oracle starts from the raw
parquet views exactly as the Spark plan does.
"""

PANEL = """
SELECT c.c_mktsegment AS ticker, CAST(o.o_orderdate AS DATE) AS date,
       arg_min(o.o_totalprice, o.o_orderkey) AS open, max(o.o_totalprice) AS high,
       min(o.o_totalprice) AS low, arg_max(o.o_totalprice, o.o_orderkey) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2
"""

# panel with close_used and row position per ticker
PANEL_T = """
SELECT *, close AS close_used,
       row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS t
FROM panel
"""

DAILY = """
SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n_orders,
       avg(o_totalprice) AS avg_price, sum(o_totalprice) / 1000.0 AS OT, 'all' AS series_id
FROM orders GROUP BY 1
"""

EVENT_SERIES = """
SELECT CAST(user_id AS VARCHAR) AS series_id,
       ['Yearly','Quarterly','Monthly','Weekly','Daily','Hourly'][CAST(user_id % 6 AS INTEGER) + 1] AS grp,
       ts, event_id, value, CAST(event_type = 'error' AS INTEGER) AS label
FROM events
"""

HOURLY = """
SELECT date_trunc('hour', ts) AS ts,
       sum(value) FILTER (WHERE event_type = 'click') AS click,
       sum(value) FILTER (WHERE event_type = 'error') AS error,
       sum(value) FILTER (WHERE event_type = 'purchase') AS purchase,
       sum(value) FILTER (WHERE event_type = 'signup') AS signup,
       sum(value) FILTER (WHERE event_type = 'view') AS "view"
FROM events GROUP BY 1
"""

SEQUENCES = """
SELECT vec_id AS sample_id, label, CAST(u.pos - 1 AS INTEGER) AS t, CAST(u.v AS DOUBLE) AS value
FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)
"""

NEWS = """
SELECT doc_id,
       ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][CAST(doc_id % 5 AS INTEGER) + 1] AS ticker,
       CAST(DATE '1995-01-01' + CAST(doc_id % 2399 AS INTEGER) AS DATE) AS date,
       array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 1, 8), ' ') AS headline,
       array_to_string(list_slice(regexp_split_to_array(trim(text), '\\s+'), 9, 1073741824), ' ') AS summary,
       source, lang
FROM documents
"""


def gram(rel: str, group: str) -> str:
    """Products of the lists ``v`` of ``rel`` summed for each series, as a list of rows."""
    return f"""(SELECT {group}, list(row ORDER BY i) AS m FROM (
    SELECT {group}, i, list(s ORDER BY j) AS row FROM (
      SELECT {group}, i, j, sum(v[i] * v[j]) AS s FROM {rel}, unnest(range(1, len(v) + 1)) a(i), unnest(range(1, len(v) + 1)) b(j) GROUP BY ALL)
    GROUP BY ALL) GROUP BY ALL)"""


# m after the k-th variable is swept (left alone if it depends on those before)
SWEPT = """CASE WHEN m[k][k] <= 1e-10 * g[k][k] OR g[k][k] <= 0 THEN m ELSE
      [[CASE WHEN i = k AND j = k THEN 1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN -m[i][k] / m[k][k]
             ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END for j in range(1, len(m) + 1)] for i in range(1, len(m) + 1)] END"""
