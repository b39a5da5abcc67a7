"""Grid orders against all levels, and what they shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans import grids as Gr

RANGES = ("grid_id long, range_id string, active boolean, side string, start_price double, end_price double, total_amount double, "
          "mid_price double, min_price_increment double, min_amount double")


def test_grid_orders_against_all_levels(spark):
    rows = [(g, f"R{g % 3}", g % 5 != 0, "BUY" if g % 2 else "SELL", 97.0 + g % 4, 100.5 + g % 7, 40.0 + 31 * g, 100.0, 0.01, 10.0)
            for g in range(1, 40)]
    rows += [rows[2], (None, "R1", True, "BUY", 99.0, 101.0, 300.0, 100.0, 0.01, 10.0), (90, None, True, "SELL", 99.0, 101.0, 300.0, 100.0, 0.01, 10.0),
             (91, "R1", True, None, 99.0, 101.0, 300.0, 100.0, 0.01, 10.0), (92, "R1", True, "BUY", None, 101.0, 300.0, 100.0, 0.01, 10.0)]
    ranges = spark.createDataFrame(rows, RANGES)
    levels = Gr.grid_levels(ranges).withColumn("price", F.round("price", 9))
    opened = levels.filter((F.col("grid_id") % 3 == 0) & (F.col("level") % 2 == 1)).select("grid_id", "level_id")
    opened = opened.unionByName(spark.createDataFrame([(4, None), (None, "R1_P3")], "grid_id long, level_id string"))
    taken = {(r.grid_id, r.level_id) for r in opened.collect() if r.grid_id is not None}
    want = {}
    for r in levels.collect():
        inside = r.side and r.price is not None and (r.price >= 99.0 if r.side == "BUY" else r.price <= 101.0)
        if inside and (r.grid_id, r.level_id) not in taken:
            want.setdefault(r.grid_id, []).append((abs(r.price - 100.0), r.level_id))
    want = sorted(((g, i) for g, v in want.items() for _, i in sorted(v)[:5]), key=str)
    out = Gr.grid_orders(ranges, opened)
    found = out.collect()
    assert sorted(((r.grid_id, r.level_id) for r in found), key=str) == want
    first = next(r for r in found if r.grid_id == 7 and r.rank == 1)
    assert first.entry_price == (100.0 if first.price > 100.0 else first.price)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        text = Gr.grid_orders(ranges, opened)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    dealt = [line for line in text.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("level_id" in line for line in dealt)
