"""R*: recursive indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog import oracle as O
from tickloom.catalog.registry import query
from tickloom.operators import recursive as C
from tickloom.operators import rolling as R
from tickloom.operators.layout import own_rows, segmented

K = "connector trading_pair ts "
NB = {"nb": O.numbered()}


@query("r01_ema", K + "ema_8:6 ema_20:6 ema_50:6", "bars_1h",
       ctes={**NB, **O.ema("ema_8", 8), **O.ema("ema_20", 20), **O.ema("ema_50", 50)},
       sql=O.joined("nb", "ema_8", "ema_20", "ema_50"))
def r01_ema(view):
    df, p = segmented(view("bars_1h"), C.ema_memory(50))
    return own_rows(C.averages(df, p, *[C.ema_of(f"ema_{n}", "close", n) for n in (8, 20, 50)]))


@query("r01_ema_daily", K + "ema_20:5", "bars_1d",
       ctes={"nb": O.numbered("bars_1d"), **O.ema("ema_20", 20)}, sql=O.joined("nb", "ema_20"))
def r01_ema_daily(view):
    df, p = segmented(view("bars_1d"), C.ema_memory(20))
    return own_rows(C.ema(df, p, "ema_20", "close", 20))


@query("r01_ewm", K + "ewm_50:6", "bars_1h",
       ctes={**NB, "ewm_50": f"""SELECT connector, trading_pair, i, close AS v FROM nb WHERE i = 0
UNION ALL
SELECT b.connector, b.trading_pair, b.i, {2 / 51!r} * b.close + {1 - 2 / 51!r} * e.v
FROM ewm_50 e JOIN nb b
ON b.connector = e.connector AND b.trading_pair = e.trading_pair AND b.i = e.i + 1"""},
       sql=O.joined("nb", "ewm_50"))
def r01_ewm(view):
    df, p = segmented(view("bars_1h"), C.ema_memory(50))
    return own_rows(C.ewm(df, p, "ewm_50", "close", 50))


@query("r02_natr", K + "atr_14:6 natr_14:6", "bars_1h",
       ctes={**NB, "tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb", **O.rma("atr_14", 14, "tr", "tr", 1)},
       sql=f"SELECT *, 100 * atr_14 / close AS natr_14 FROM ({O.joined('tr', 'atr_14')})")
def r02_natr(view):
    df, p = segmented(view("bars_1h"), C.rma_memory(14))
    df = C.atr(df, p, "atr_14", 14)
    return own_rows(C.natr(df, p, "natr_14", 14))


def macd_ctes(src: str = "nb", fast=21, slow=42, signal=9) -> dict[str, str]:
    return {
        **O.ema("e_fast", fast, src), **O.ema("e_slow", slow, src),
        "macd_line": f"SELECT *, e_fast - e_slow AS macd FROM ({O.joined(src, 'e_fast', 'e_slow')})",
        **O.ema("macd_signal", signal, "macd_line", "macd", slow - 1),
        "macd_all": ("SELECT *, macd - macd_signal AS macd_hist FROM ("
                     + O.joined("macd_line", "macd_signal") + ")"),
    }


@query("r03_macd", K + "macd:6 macd_signal:6 macd_hist:6", "bars_1h",
       ctes={**NB, **macd_ctes()}, sql="SELECT * FROM macd_all")
def r03_macd(view):
    df, p = segmented(view("bars_1h"), C.macd_memory())
    return own_rows(C.macd(df, p))


def rsi_ctes(src: str = "nb", n: int = 14, name: str = "rsi") -> dict[str, str]:
    return {
        f"{name}_gl": f"""SELECT *, CASE WHEN i > 0 THEN greatest(close - prev_close, 0) END AS gain,
CASE WHEN i > 0 THEN greatest(prev_close - close, 0) END AS loss FROM {src}""",
        **O.rma(f"{name}_g", n, f"{name}_gl", "gain", 1),
        **O.rma(f"{name}_l", n, f"{name}_gl", "loss", 1),
        f"{name}_all": (f"SELECT *, 100 * {name}_g / nullif({name}_g + {name}_l, 0) AS {name} FROM ("
                        + O.joined(f"{name}_gl", f"{name}_g", f"{name}_l") + ")"),
    }


@query("r04_rsi", K + "rsi:6", "bars_1h", ctes={**NB, **rsi_ctes()}, sql="SELECT * FROM rsi_all")
def r04_rsi(view):
    df, p = segmented(view("bars_1h"), C.rma_memory(14))
    return own_rows(C.rsi(df, p, "rsi", 14))


def two_pole_ctes(name: str, src: str, x: str, c1, c2: float, c3: float, start: int = 0) -> dict[str, str]:
    """SuperSmoother form: the first two outputs equal the first two inputs."""
    return {
        f"{name}_in": f"SELECT connector, trading_pair, i, {x} AS x FROM {src}",
        name: f"""SELECT a.connector, a.trading_pair, a.i, a.x AS v, lag.x AS v1
FROM {name}_in a JOIN {name}_in lag ON lag.connector = a.connector
 AND lag.trading_pair = a.trading_pair AND lag.i = a.i - 1 WHERE a.i = {start + 1}
UNION ALL
SELECT b.connector, b.trading_pair, b.i, {c1!r} * b.x + {c2!r} * e.v + {c3!r} * e.v1, e.v
FROM {name} e JOIN {name}_in b
ON b.connector = e.connector AND b.trading_pair = e.trading_pair AND b.i = e.i + 1""",
    }


_SS = C.supersmoother_coefficients(50)


@query("r05_supersmoother", K + "ss_close:6 ss_range:6", "bars_1h",
       ctes={**NB, "tr": f"SELECT *, {O.TRUE_RANGE} AS tr FROM nb",
             **two_pole_ctes("ss_close", "tr", "close", *_SS),
             **two_pole_ctes("ss_range", "tr", "tr", *_SS, start=1)},
       sql=f"""SELECT * REPLACE (CASE WHEN i < 1 THEN close ELSE ss_close END AS ss_close,
CASE WHEN i = 1 THEN tr ELSE ss_range END AS ss_range) FROM ({O.joined('tr', 'ss_close', 'ss_range')})""")
def r05_supersmoother(view):
    df, p = segmented(view("bars_1h"), C.smoothing_memory("SuperSmoother", 50) + 2)
    df = df.withColumn("tr", R.true_range(p))
    df = C.supersmoother(df, p, "ss_close", "close", 50)
    return own_rows(C.supersmoother(df, p, "ss_range", "tr", 50, start=1))


FILTERS = ("Ehlers EMA", "Gaussian", "Butterworth", "BandStop", "EMA", "RMA")


def _filter_cte(name: str, kind: str, n: int) -> dict[str, str]:
    c = C.smoothing_coefficients(kind, n)
    step = (f"{c['gain']!r} * ({c['b0']!r} * b.x + {c['b1']!r} * b.x1 + {c['b2']!r} * b.x2)"
            f" + {c['a1']!r} * e.v + {c['a2']!r} * e.v1")
    return {name: f"""SELECT connector, trading_pair, i,
{c['gain']!r} * ({c['b0']!r} * x + {c['b1']!r} * x1 + {c['b2']!r} * x2) AS v, CAST(0 AS DOUBLE) AS v1
FROM lags WHERE i = 0
UNION ALL
SELECT b.connector, b.trading_pair, b.i, {step}, e.v
FROM {name} e JOIN lags b
ON b.connector = e.connector AND b.trading_pair = e.trading_pair AND b.i = e.i + 1"""}


@query("r06_smoothing", K + "f0:6 f1:6 f2:6 f3:6 f4:6 f5:6 sma:6", "bars_1h",
       ctes={**NB, "lags": f"""SELECT connector, trading_pair, i, close AS x,
coalesce(lag(close, 1) OVER {O.SERIES_W}, close) AS x1,
coalesce(lag(close, 2) OVER {O.SERIES_W}, close) AS x2 FROM nb""",
             **{k: v for j, f in enumerate(FILTERS) for k, v in _filter_cte(f"g{j}", f, 40).items()}},
       sql="SELECT *, " + ", ".join(f"CASE WHEN i >= 39 THEN g{j} END AS f{j}" for j in range(6))
       + f", CASE WHEN i >= 39 THEN avg(close) OVER {O.w(40)} END AS sma FROM ("
       + O.joined("nb", *[f"g{j}" for j in range(6)]) + ")")
def r06_smoothing(view):
    halo = max(C.smoothing_memory(k, 40) for k in FILTERS) + 3
    df, p = segmented(view("bars_1h"), halo)
    for j, kind in enumerate(FILTERS):
        df = C.smoothing(df, p, f"f{j}", "close", 40, kind)
    return own_rows(C.smoothing(df, p, "sma", "close", 40, "SMA"))


def adx_ctes(src: str = "nb", n: int = 14) -> dict[str, str]:
    return {
        "dm": f"""SELECT *, {O.TRUE_RANGE} AS tr,
CASE WHEN i > 0 THEN CASE WHEN high - prev_high > prev_low - low AND high - prev_high > 0
 THEN high - prev_high ELSE 0 END END AS pdm,
CASE WHEN i > 0 THEN CASE WHEN prev_low - low > high - prev_high AND prev_low - low > 0
 THEN prev_low - low ELSE 0 END END AS mdm FROM {src}""",
        **O.rma("a_tr", n, "dm", "tr", 1), **O.rma("a_p", n, "dm", "pdm", 1),
        **O.rma("a_m", n, "dm", "mdm", 1),
        "di": ("SELECT *, 100 * a_p / nullif(a_tr, 0) AS di_plus, 100 * a_m / nullif(a_tr, 0) AS di_minus FROM ("
               + O.joined("dm", "a_tr", "a_p", "a_m") + ")"),
        "dx": (f"SELECT *, CASE WHEN i >= {n} THEN coalesce(100 * abs(di_plus - di_minus)"
               " / nullif(di_plus + di_minus, 0), 0) END AS dx FROM di"),
        **O.rma("adx", n, "dx", "dx", n),
    }


@query("r07_adx", K + "adx:6 di_plus:6 di_minus:6", "bars_1h",
       ctes={**NB, **adx_ctes()}, sql=O.joined("dx", "adx"))
def r07_adx(view):
    df, p = segmented(view("bars_1h"), C.adx_memory(14))
    return own_rows(C.adx(df, p, 14))
