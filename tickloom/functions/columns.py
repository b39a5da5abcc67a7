"""Column helpers that pin the pandas-versus-Spark differences in one place.

Missing values are NULL everywhere (NaN is converted on ingest), a division by zero is NULL, and a
condition over NULL counts as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Seconds per bar interval label; an unknown label means one minute.
INTERVAL_SECONDS = {
    "1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800,
    "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "12h": 43200,
    "1d": 86400, "3d": 259200, "1w": 604800,
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def truthy(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def no_nan(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c: str | Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def direction(long_cond: Column, short_cond: Column) -> Column:
    """1 / -1 / 0; the short rule is applied last, so it wins when both hold."""
    return F.when(truthy(short_cond), -1).when(truthy(long_cond), 1).otherwise(0)


def interval_seconds(label: str) -> int:
    return INTERVAL_SECONDS.get(label, 60)


def bars_per_day(label: str) -> int:
    return 86400 // interval_seconds(label)


def interval_seconds_col(label: str | Column) -> Column:
    """The interval map as an expression, for tables that carry the label as data."""
    table = F.create_map(*[F.lit(x) for kv in INTERVAL_SECONDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col(label)), F.lit(60))


def epoch_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(col(ts).cast("timestamp"))


def bucket(ts: str, interval: str) -> Column:
    """Start of the bar that holds ``ts``; weekly bars start on Monday."""
    secs = interval_seconds(interval)
    offset = "4 days" if interval == "1w" else "0 seconds"
    return F.window(ts, f"{secs} seconds", startTime=offset)["start"]


HALF_SHIFT = 0.0123  # in units of the last digit


def rounded(df: DataFrame, spec: str) -> DataFrame:
    """Project ``name[:kind]`` items: a digit rounds a double, ``i`` makes a BIGINT, ``s`` a string.

    Means of short decimals often fall exactly on the half of the last digit, where the last bit of
    a float sum decides; ``HALF_SHIFT`` moves the rounding point off such ties.
    """
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("bigint")
        elif kind == "s":
            c = c.cast("string")
        elif kind:
            digits = int(kind)
            c = F.round(c.cast("double") + HALF_SHIFT * 10.0 ** -digits, digits) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)
