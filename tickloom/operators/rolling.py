"""Finite-memory window functions (W01-W26) on a segmented frame.

Each helper takes the ``Pieces`` geometry and returns a Column; all of them share one window
ordering, so one sort per piece serves every column. ``n`` must not exceed the frame's halo + 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.columns import col, ratio
from tickloom.operators.layout import PIECE, POS, Pieces


def full(x: str | Column, n: int, p: Pieces, value: Column) -> Column:
    """``value`` only where the last n rows all hold a non-NULL x."""
    return F.when(F.count(col(x)).over(p.last(n)) >= n, value)


def mean(x, n: int, p: Pieces, partial: bool = False) -> Column:
    v = F.avg(col(x)).over(p.last(n))
    return v if partial else full(x, n, p, v)


def total(x, n: int, p: Pieces, partial: bool = False) -> Column:
    v = F.sum(col(x)).over(p.last(n))
    return v if partial else full(x, n, p, v)


def std(x, n: int, p: Pieces, partial: bool = False, population: bool = False) -> Column:
    v = (F.stddev_pop if population else F.stddev_samp)(col(x)).over(p.last(n))
    return v if partial else full(x, n, p, v)


def part_rows(n: int) -> int:
    """Rows of the equal parts from which a window of n rows is put together; n where parts would not pay."""
    best = min((b for b in range(1, n + 1) if n % b == 0), key=lambda b: b + n // b)
    return best if 2 * (best + n // best) <= n else n


def _parts(df: DataFrame, p: Pieces, n: int, stats: dict[str, Column]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Each aggregate over the parts of the last n rows, as columns from the newest part to the oldest.

    A sliding frame computes every row's window anew, n steps a row. A part of b rows takes b steps and the n / b - 1
    parts before it are looked up, so a row takes about 2 * sqrt(n)."""
    b = part_rows(n)
    df = df.withColumns({f"{s}_0": a.over(p.last(b)) for s, a in stats.items()})
    names = {s: [f"{s}_{k}" for k in range(n // b)] for s in stats}
    earlier = {names[s][k]: F.lag(f"{s}_0", k * b).over(p.whole) for s in stats for k in range(1, n // b)}
    return df.withColumns(earlier) if earlier else df, names


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def means(df: DataFrame, p: Pieces, n: int, wanted: dict[str, str]) -> DataFrame:
    """Mean of the non-NULL values among the last n rows, per output column; the same as a partial ``mean``."""
    stats = {f"_{s}_{out}": f(x) for out, x in wanted.items() for s, f in (("s", F.sum), ("c", F.count))}
    df, names = _parts(df, p, n, stats)
    total = {s: _sum([F.coalesce(F.col(c), F.lit(0)) for c in reversed(part)]) for s, part in names.items()}
    df = df.withColumns({out: ratio(total[f"_s_{out}"], total[f"_c_{out}"]) for out in wanted})
    return df.drop(*[c for part in names.values() for c in part])


def moments(df: DataFrame, p: Pieces, n: int, *columns: str) -> DataFrame:
    """``_mean_x`` and ``_m2_x`` (sum of squared deviations) of each column x over the last n rows, where all of them
    hold it. Parts are merged by their means' differences, so nothing cancels and equal values give exactly 0."""
    stats = {f"_{s}_{x}": f(x) for x in columns for s, f in (("a", F.avg), ("v", F.var_pop), ("c", F.count))}
    df, names = _parts(df, p, n, stats)
    b = part_rows(n)
    parts = {s: [F.col(c) for c in part] for s, part in names.items()}
    df = df.withColumns({f"_mean_{x}": F.when(
        _sum([F.coalesce(c, F.lit(0)) for c in parts[f"_c_{x}"]]) >= n,
        parts[f"_a_{x}"][0] + _sum([a - parts[f"_a_{x}"][0] for a in parts[f"_a_{x}"]]) / (n // b)) for x in columns})
    df = df.withColumns({f"_m2_{x}": b * _sum(
        [v + (a - F.col(f"_mean_{x}")) * (a - F.col(f"_mean_{x}")) for v, a in zip(parts[f"_v_{x}"], parts[f"_a_{x}"])])
        for x in columns})
    return df.drop(*[c for part in names.values() for c in part])


def highest(x, n: int, p: Pieces, partial: bool = False) -> Column:
    v = F.max(col(x)).over(p.last(n))
    return v if partial else full(x, n, p, v)


def lowest(x, n: int, p: Pieces, partial: bool = False) -> Column:
    v = F.min(col(x)).over(p.last(n))
    return v if partial else full(x, n, p, v)


def shift(x, n: int, p: Pieces) -> Column:
    return F.lag(col(x), n).over(p.whole)


def diff(x, n: int, p: Pieces) -> Column:
    return col(x) - shift(x, n, p)


def pct_change(x, p: Pieces, n: int = 1) -> Column:
    return ratio(col(x), shift(x, n, p)) - 1


def log_return(x, p: Pieces) -> Column:
    return F.ln(ratio(col(x), shift(x, 1, p)))


def quantile(x, q: float, n: int, p: Pieces) -> Column:
    """Linear-interpolated percentile of the non-NULL values among the last n rows."""
    return F.percentile(col(x), q).over(p.last(n))


def slope(y, n: int, p: Pieces, partial: bool = False) -> Column:
    """OLS slope of y on position; a single point gives 0."""
    v = F.coalesce(F.regr_slope(col(y), col(POS).cast("double")).over(p.last(n)), F.lit(0.0))
    return F.when(col(y).isNotNull(), v) if partial else full(y, n, p, v)


def weighted_slope(y, w, n: int, p: Pieces) -> Column:
    """OLS slope on position with weights, from five weighted sums; positions are taken relative to
    the piece so the sums stay small."""
    y, w = col(y), col(w)
    x = (col(POS) - col(PIECE) * p.rows).cast("double")

    def s(e: Column) -> Column:
        return F.sum(e).over(p.last(n))

    sw, sx, sy = s(w), s(w * x), s(w * y)
    return full(y, n, p, ratio(sw * s(w * x * y) - sx * sy, sw * s(w * x * x) - sx * sx))


def true_range(p: Pieces, high="high", low="low", close="close") -> Column:
    prev = shift(close, 1, p)
    return F.when(
        prev.isNotNull(),
        F.greatest(col(high) - col(low), F.abs(col(high) - prev), F.abs(col(low) - prev)),
    )


def bollinger(p: Pieces, n: int, k: float, x="close") -> dict[str, Column]:
    """mid, upper, lower, width in percent of mid (bbb) and position in the band (bbp)."""
    mid, sd = mean(x, n, p), std(x, n, p, population=True)
    width = 2 * k * sd
    return {
        "mid": mid, "upper": mid + k * sd, "lower": mid - k * sd,
        "bbb": ratio(100 * width, mid),
        "bbp": F.when(sd > 0, ratio(col(x) - (mid - k * sd), width)),
    }


def crossed_over(a, b, p: Pieces) -> Column:
    return (col(a) > col(b)) & (shift(a, 1, p) < shift(b, 1, p))


def crossed_under(a, b, p: Pieces) -> Column:
    return (col(a) < col(b)) & (shift(a, 1, p) > shift(b, 1, p))


def alma(x, n: int, offset: float, sigma: float, p: Pieces) -> Column:
    """Gaussian-weighted moving average; the weight peak sits at ``offset`` of the window."""
    centre, s = offset * (n - 1), n / sigma
    raw = [math.exp(-((i - centre) ** 2) / (2 * s * s)) for i in range(n)]
    total_weight = sum(raw)
    weights = F.array(*[F.lit(v / total_weight) for v in raw])
    window_values = F.collect_list(col(x)).over(p.last(n))
    dot = F.aggregate(
        F.zip_with(window_values, weights, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v
    )
    return full(x, n, p, dot)


def pivot_flags(x, left: int, right: int, p: Pieces) -> tuple[Column, Column]:
    """(is high, is low) pivots within [i-left, i+right]; needs ``right`` rows of look-ahead."""
    w = p.around(left, right)
    return col(x) == F.max(col(x)).over(w), col(x) == F.min(col(x)).over(w)


def rolling_rank(df: DataFrame, p: Pieces, columns: dict[str, str], n: int) -> DataFrame:
    """Percentile rank (average ties) of the current value among the last n, per output column.

    Works on the pieces already in place, so it adds no shuffle; a piece is bounded by
    rows + halo, and each is ranked with one vectorised comparison per chunk.
    """
    schema = StructType(df.schema.fields + [StructField(c, DoubleType()) for c in columns])

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, kind="stable")
        for out, source in columns.items():
            pdf[out] = _window_rank(pdf[source].to_numpy(dtype=float), n)
        return pdf

    return df.groupBy(*p.keys, PIECE).applyInPandas(rank, schema)


def _window_rank(values: np.ndarray, n: int, chunk: int = 2048) -> np.ndarray:
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(values, n)
    for start in range(0, len(windows), chunk):
        w = windows[start:start + chunk]
        now = w[:, -1:]
        ok = ~np.isnan(w).any(axis=1)
        rank_avg = (w < now).sum(axis=1) + ((w == now).sum(axis=1) + 1) / 2
        out[n - 1 + start:n - 1 + start + len(w)] = np.where(ok, rank_avg / n, np.nan)
    return out
