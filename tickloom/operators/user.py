"""User functions (U02, U03, U05): on windows, on rows and on pieces of a series, never on a whole series."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.layout import OWN, PIECE, POS, SERIES, own_rows, segmented


def rolling_apply(df: DataFrame, column: str, window: int, fn: Callable[[np.ndarray], np.ndarray], name: str,
                  keys: Sequence[str] = SERIES, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``fn`` gets the last ``window`` values of every row as one matrix (a row each) and returns a number per
    row; rows with fewer values or a missing one get NULL."""
    d, _ = segmented(df, window - 1, keys, order)
    schema = d.withColumn(name, F.lit(None).cast("double")).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        x = pdf[column].to_numpy(dtype=float)
        out = np.full(len(x), np.nan)
        if len(x) >= window:
            rows = np.lib.stride_tricks.sliding_window_view(x, window)
            full = ~np.isnan(rows).any(axis=1)
            values = np.full(len(rows), np.nan)
            values[full] = fn(rows[full])
            out[window - 1:] = values
        return pdf.assign(**{name: pd.Series(out, dtype=float).where(~np.isnan(out), None)})

    return own_rows(d.groupBy(*keys, PIECE).applyInPandas(run, schema)).withColumn(
        name, F.when(~F.isnan(name), F.col(name)))


def row_apply(columns: Sequence[str | Column], fn: Callable[..., pd.Series], returns: str = "double") -> Column:
    """``fn`` gets whole batches of the columns as series and returns one."""

    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        return fn(*series)

    return run(*columns)


def table_apply(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, halo: int = 0, ahead: int = 0,
                keys: Sequence[str] = SERIES, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``fn`` gets a piece of a series in order, with ``halo`` rows before and ``ahead`` rows after it; the
    column ``_own`` marks the rows to answer for. It returns any number of rows of ``schema``."""
    d, _ = segmented(df, halo, keys, order, ahead=ahead)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(POS, ignore_index=True))

    assert OWN in d.columns
    return d.groupBy(*keys, PIECE).applyInPandas(run, schema)
