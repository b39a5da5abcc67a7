"""The fill ledger's totals per slice."""

from __future__ import annotations

import datetime as dt

import pytest

from tickloom.plans import portfolio as Po


def test_the_ledger_has_fewer_totals_than_fills(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("c", "m", "s", start + dt.timedelta(days=3 * i), i, "BUY" if i % 3 else "SELL", 1.0 + i % 4, 10.0 + i % 7, 0.5) for i in range(200)]
    fills = spark.createDataFrame(rows, "config_file_path string, market string, symbol string, ts timestamp_ntz, order_id int, "
                                  "trade_type string, amount double, price double, trade_fee_in_quote double")
    out = Po.fill_ledger(fills, ("ts", "order_id"))
    assert f"{90 * 86400 * 1e6:.3E}".replace("E+", "E") in out._jdf.queryExecution().optimizedPlan().toString()
    held = fees = 0.0
    for r, x in zip(out.orderBy("ts").collect(), rows):
        held, fees = held + (x[6] if x[5] == "BUY" else -x[6]), fees + x[8]
        assert (r.cum_net_amount, r.cum_fees_in_quote) == pytest.approx((held, fees))
        assert r.gross_pnl == (None if x[4] == 0 else pytest.approx((held - r.net_amount) * (x[7] - rows[x[4] - 1][7])))
