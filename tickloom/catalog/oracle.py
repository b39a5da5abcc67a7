"""SQL building blocks for the statements of recursive and windowed operators."""

from __future__ import annotations

KEY = "connector, trading_pair"


def numbered(source: str = "bars_1h") -> str:
    """Rows with their 0-based position and the previous close."""
    return (f"SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY ts) - 1 AS i, "
            f"lag(close) OVER (PARTITION BY {KEY} ORDER BY ts) AS prev_close, "
            f"lag(high) OVER (PARTITION BY {KEY} ORDER BY ts) AS prev_high, "
            f"lag(low) OVER (PARTITION BY {KEY} ORDER BY ts) AS prev_low FROM {source}")


def w(n: int) -> str:
    return (f"(PARTITION BY {KEY} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


SERIES_W = f"(PARTITION BY {KEY} ORDER BY ts)"


def seeded(name: str, src: str, x: str, n: int, alpha: float, start: int = 0) -> dict[str, str]:
    """CTEs of an exponential average seeded by the mean of the first n inputs."""
    warm = start + n - 1
    return {
        f"{name}_in": f"SELECT connector, trading_pair, i, CAST({x} AS DOUBLE) AS x FROM {src}",
        name: f"""SELECT connector, trading_pair, CAST({warm} AS BIGINT) AS i, avg(x) AS v
FROM {name}_in WHERE i BETWEEN {start} AND {warm} GROUP BY connector, trading_pair
HAVING count(*) = {n}
UNION ALL
SELECT b.connector, b.trading_pair, b.i, {alpha!r} * b.x + {1 - alpha!r} * e.v
FROM {name} e JOIN {name}_in b
  ON b.connector = e.connector AND b.trading_pair = e.trading_pair AND b.i = e.i + 1""",
    }


def ema(name: str, n: int, src: str = "nb", x: str = "close", start: int = 0) -> dict[str, str]:
    return seeded(name, src, x, n, 2 / (n + 1), start)


def rma(name: str, n: int, src: str = "nb", x: str = "close", start: int = 0) -> dict[str, str]:
    return seeded(name, src, x, n, 1 / n, start)


def joined(src: str, *names: str, columns: str = "b.*") -> str:
    """``src`` (alias b) with each scan's value as a column of the scan's name."""
    cols = "".join(f", {n}.v AS {n}" for n in names)
    joins = "".join(
        f" LEFT JOIN {n} ON {n}.connector = b.connector AND {n}.trading_pair = b.trading_pair AND {n}.i = b.i"
        for n in names
    )
    return f"SELECT {columns}{cols} FROM {src} b{joins}"


TRUE_RANGE = ("CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), "
              "abs(low - prev_close)) END")
