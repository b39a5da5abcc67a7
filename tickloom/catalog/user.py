"""U*: user functions, checked against the same rule in SQL."""

from __future__ import annotations

import pandas as pd

from tickloom.catalog.registry import query
from tickloom.operators import user as U

W20 = "(PARTITION BY connector, trading_pair ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("u02_rolling_function", "connector trading_pair ts spread:6", "bars_1h",
       sql=f"""SELECT *, CASE WHEN count(close) OVER w = 20 THEN (max(close) OVER w - min(close) OVER w) / avg(close) OVER w END AS spread
FROM bars_1h WINDOW w AS {W20}""")
def u02(view):
    return U.rolling_apply(view("bars_1h"), "close", 20, lambda x: (x.max(axis=1) - x.min(axis=1)) / x.mean(axis=1), "spread")


@query("u03_row_function", "connector trading_pair ts typical:6", "bars_1h", sql="SELECT *, (high + low + close) / 3 AS typical FROM bars_1h")
def u03(view):
    return view("bars_1h").withColumn("typical", U.row_apply(["high", "low", "close"], lambda h, l, c: (h + l + c) / 3))


def turning_points(piece: pd.DataFrame) -> pd.DataFrame:
    before, after = piece["close"].shift(1), piece["close"].shift(-1)
    top, bottom = (piece["close"] > before) & (piece["close"] > after), (piece["close"] < before) & (piece["close"] < after)
    kept = piece[(top | bottom) & piece["_own"]]
    return kept[["connector", "trading_pair", "ts", "close"]].assign(kind=top[kept.index].map({True: "top", False: "bottom"}))


@query("u05_table_function", "connector trading_pair ts close:4 kind", "bars_1h",
       sql="""SELECT *, CASE WHEN close > p THEN 'top' ELSE 'bottom' END AS kind FROM (SELECT *, lag(close) OVER w AS p, lead(close) OVER w AS n FROM bars_1h
WINDOW w AS (PARTITION BY connector, trading_pair ORDER BY ts)) WHERE (close > p AND close > n) OR (close < p AND close < n)""")
def u05(view):
    return U.table_apply(view("bars_1h").select("connector", "trading_pair", "ts", "close"), turning_points,
                         "connector string, trading_pair string, ts timestamp_ntz, close double, kind string", halo=1, ahead=1)
