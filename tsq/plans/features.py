"""Queries: the panel feature table and its single window features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tsq.operators import features as fe
from tsq.plans import sqlparts as S
from tsq.plans.registry import dbl, query, r, rounded
from tsq.sources import tables as tb

# Output precision: means of cent prices over <= 30 rows are exact at 6
# decimals; irrational price-scale values (std, EMA, bands) are compared at 4.
PRICE_COLS = (
    ["macd", "macd_signal", "macd_hist", "bb_std20", "bb_upper", "bb_lower"]
    + [f"rolling_std_{n}" for n in range(1, 8)]
)


def _stock_sql() -> str:
    a12, a26, a9 = (fe.ema_alpha(s) for s in (fe.MACD_FAST, fe.MACD_SLOW, fe.MACD_SIGNAL))
    A = {k: dbl(v) for k, v in dict(a12=a12, a26=a26, a9=a9).items()}
    R = {k: dbl(1.0 - v) for k, v in dict(a12=a12, a26=a26, a9=a9).items()}

    def tr(fn, x, n):
        return f"{fn}({x}) OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    feats = []
    feats += [f"lag(log_return, {k}) OVER (PARTITION BY ticker ORDER BY t) AS lag_{k}" for k in range(1, 8)]
    for n in range(1, 8):
        feats += [f"{tr('avg', 'close_used', n)} AS rolling_mean_{n}", f"{tr('stddev_pop', 'close_used', n)} AS rolling_std_{n}"]
        feats += [f"{tr('avg', 'log_return', n)} AS his_avg_{n}", f"{tr('stddev_pop', 'log_return', n)} AS his_std_{n}"]
    feats += [f"{tr('avg', 'log_return', 30)} AS prior_history_avg", f"{tr('stddev_pop', 'log_return', 30)} AS prior_history_std"]
    feats += [f"{tr('avg', 'close_used', s)} AS sma_{s}" for s in fe.SMA_SPANS]
    feats += [f"{tr('avg', 'close_used', 20)} AS bb_sma20", f"{tr('stddev_pop', 'close_used', 20)} AS bb_std20",
              f"{tr('stddev_pop', 'log_return', 20)} * sqrt(252.0) AS volatility_20_ann"]
    rsi_fr = "OVER (PARTITION BY ticker ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    feats += [f"""100.0 - 100.0 / (1.0 + (CASE WHEN count(delta) {rsi_fr} = 14 THEN avg(CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0.0 END) {rsi_fr} END)
               / nullif(CASE WHEN count(delta) {rsi_fr} = 14 THEN avg(CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0.0 END) {rsi_fr} END, 0.0)) AS rsi_14"""]
    out_cols = ["ticker", "strftime(date, '%Y-%m') AS Month", "CAST(NULL AS DOUBLE) AS Exports",
                "CAST(NULL AS DOUBLE) AS Imports", "CAST(NULL AS DOUBLE) AS OT",
                "(SELECT strftime(min(date), '%Y-%m-%d') FROM panel) AS start_date",
                "strftime(date, '%Y-%m-%d') AS date",
                "(SELECT strftime(max(date), '%Y-%m-%d') FROM panel) AS end_date",
                "CAST(NULL AS VARCHAR) AS Final_Search_2", "CAST(NULL AS VARCHAR) AS Final_Search_4",
                "CAST(NULL AS VARCHAR) AS Final_Search_6", "CAST(NULL AS DOUBLE) AS adj_close"]
    dcols = (["open", "high", "low", "close", "close_used", "volume", "log_return", "pct_change"]
             + [f"lag_{k}" for k in range(1, 8)]
             + [f"{a}_{n}" for n in range(1, 8) for a in ("rolling_mean", "rolling_std", "his_avg", "his_std")]
             + ["prior_history_avg", "prior_history_std"] + [f"sma_{s}" for s in fe.SMA_SPANS]
             + ["bb_sma20", "bb_std20", "volatility_20_ann", "rsi_14", "macd", "macd_signal"])
    out_cols += [f"{r(c, 4 if c in PRICE_COLS else 6)} AS {c}" for c in dcols]
    out_cols += [f"{r('macd - macd_signal', 4)} AS macd_hist",
                 f"{r('bb_sma20 + 2.0 * bb_std20', 4)} AS bb_upper",
                 f"{r('bb_sma20 - 2.0 * bb_std20', 4)} AS bb_lower"]
    return f"""
WITH RECURSIVE panel AS ({S.PANEL}),
p0 AS ({S.PANEL_T}),
p AS (SELECT *, ln(close_used / lag(close_used) OVER (PARTITION BY ticker ORDER BY t)) AS log_return,
             close_used / lag(close_used) OVER (PARTITION BY ticker ORDER BY t) - 1.0 AS pct_change,
             close_used - lag(close_used) OVER (PARTITION BY ticker ORDER BY t) AS delta
      FROM p0),
ema(ticker, t, e12, e26, sig) AS (
  SELECT ticker, t, close_used, close_used, CAST(0.0 AS DOUBLE) FROM p WHERE t = 0
  UNION ALL
  SELECT p.ticker, p.t,
         {R['a12']} * e.e12 + {A['a12']} * p.close_used,
         {R['a26']} * e.e26 + {A['a26']} * p.close_used,
         {R['a9']} * e.sig + {A['a9']} * (({R['a12']} * e.e12 + {A['a12']} * p.close_used)
                                          - ({R['a26']} * e.e26 + {A['a26']} * p.close_used))
  FROM ema e JOIN p ON p.ticker = e.ticker AND p.t = e.t + 1),
f AS (SELECT p.*, {', '.join(feats)} FROM p),
g AS (SELECT f.*, ema.e12 - ema.e26 AS macd, ema.sig AS macd_signal
      FROM f JOIN ema ON f.ticker = ema.ticker AND f.t = ema.t)
SELECT {', '.join(out_cols)} FROM g
"""


def _stock(spark, sf_dir):
    out = fe.stock_features(tb.ticker_panel(spark, sf_dir))
    return rounded(out, 6, **{c: 4 for c in PRICE_COLS})


query("stock_features", _stock_sql())(_stock)
