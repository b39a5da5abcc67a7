"""Summaries of aligned blocks of bars, for questions about a stretch of a series that do not read its bars.

Level k of a block table has one row per ``RADIX`` ** (k + 1) consecutive bars of a series, which holds a summary
(first time, lowest, highest, sum, count) of each of its ``RADIX`` children: bars at level 0, rows of level k - 1
above. A stretch of n bars touches a few rows per level, about log n in all, whatever the number of bars.

* ``first_crossings`` looks for the first bar from an event on that lies beyond an upper or lower bound of its own:
  it climbs from the event's bar until a child crosses, then descends into that child.
* ``band_aggregates`` adds up the children that cover the stretch.
* ``nearest_item`` looks from a place, forwards or backwards, without a limit.

Every step is an equi-join on (series, block) with one row per event, so neither a long band nor a dense one
makes rows per (event, bar).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.columns import epoch_micros
from tickloom.operators.layout import BAR_SECONDS, POS, SERIES, number_rows, prefix_scan, segment_width

RADIX = 32
OF = "_of"


def series_of(keys: Sequence[str]) -> Column:
    """The series as one value: never NULL, and its NULL fields are equal."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def longest_band(bars: DataFrame, seconds: int, keys: Sequence[str] = SERIES, ts: str = "ts") -> int:
    """At least the bars of any band of ``seconds``; from the bar length if it is known, else counted."""
    length = bars.schema[ts].metadata.get(BAR_SECONDS)
    if length:
        return seconds // int(length) + 1
    slot = F.floor(epoch_micros(ts) / F.lit(max(1, seconds) * 1_000_000))
    most = bars.groupBy(*keys, slot.alias("_slot")).count().agg(F.max("count").alias("n")).first().n
    return 2 * (most or 1)  # a band touches two slots


def depth_for(bars_in_band: int) -> int:
    """Levels whose top row, with the block after it, holds a band without its last child."""
    depth = 1
    while (RADIX - 1) * RADIX ** (depth - 1) < bars_in_band:
        depth += 1
    return depth


def bar_rows(numbered: DataFrame, value: str, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """The bars as rows to be summarised."""
    x = F.col(value).cast("double")
    return numbered.select(series_of(keys).alias(OF), F.col(POS).alias("_at"), F.col(ts).alias("t"), x.alias("lo"), x.alias("hi"),
                           x.alias("s"), F.when(x.isNotNull(), 1).otherwise(0).cast("long").alias("n"))


def block_levels(rows: DataFrame, depth: int, overlap: bool = True) -> list[DataFrame]:
    """Levels 0 to depth - 1 over ``rows`` (``_of``, ``_at`` from 0 without gaps, t, lo, hi, s, n): ``_of``, ``_block``
    and ``kids`` (i, t, lo, hi, s, n) in order.

    With ``overlap`` rows of the top level also hold the children of the block after theirs (i from RADIX on)."""
    kid = lambda i: F.struct(i.cast("int").alias("i"), "t", "lo", "hi", "s", "n")
    own, slot = F.floor(F.col("_at") / RADIX), F.pmod("_at", F.lit(RADIX))
    levels = []
    for k in range(depth):
        grouped = rows.select(OF, own.alias("_block"), kid(slot).alias("kid"))
        if overlap and k == depth - 1:
            grouped = grouped.unionByName(rows.filter(own > 0).select(OF, (own - 1).alias("_block"), kid(slot + RADIX).alias("kid")))
        level = grouped.groupBy(OF, "_block").agg(F.array_sort(F.collect_list("kid")).alias("kids"))
        levels.append(level)
        rows = level.select(OF, F.col("_block").alias("_at"), F.col("kids")[0]["t"].alias("t"), F.array_min("kids.lo").alias("lo"),
                            F.array_max("kids.hi").alias("hi"), _total("kids.s", 0.0).alias("s"), _total("kids.n", 0).alias("n"))
    return levels


def _total(values: str | Column, zero: float | int) -> Column:
    start = F.lit(zero).cast("double" if isinstance(zero, float) else "long")
    return F.aggregate(values, start, lambda a, v: a + F.coalesce(v, start))


def _looked_up(rows: DataFrame, level: DataFrame, block: Column) -> DataFrame:
    """Rows with ``kids`` of the block; rows whose block is NULL keep none, and are spread over all tasks."""
    wanted = rows.withColumn("_want", F.coalesce(block, -1 - F.col("_p0")))
    right = level.select(F.col(OF).alias("_r_of"), F.col("_block").alias("_r_block"), "kids")
    return wanted.join(right, (F.col(OF) == F.col("_r_of")) & (F.col("_want") == F.col("_r_block")), "left").drop("_want", "_r_of", "_r_block")


def first_bars(events: DataFrame, bars: DataFrame, keys: Sequence[str] = SERIES, ts: str = "ts", out: str = "_p0") -> DataFrame:
    """Adds the number of bars before the event's time: the place of the first bar at or after it."""
    marks = bars.select(*keys, F.col(ts), F.lit(1).alias("_bar"))
    both = events.withColumn("_bar", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    seen = prefix_scan(both, {out: ("count", F.when(F.col("_bar") == 1, 1))}, keys, [ts, "_bar"], segment_width(bars, ts))
    return seen.filter(F.col("_bar") == 0).drop("_bar")


def first_crossings(events: DataFrame, bars: DataFrame, value: str, until: str, crosses: dict[str, Callable[[Column], Column]],
                    seconds: int, keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """Per event the first bar of [ts, until] at which each of ``crosses`` holds, and the last bar of the band.

    ``crosses`` maps a name to a condition on a price, monotone in it (above or below a bound made of event
    columns). ``until`` is at most ``seconds`` after ts. Adds a struct per name, and ``last``: t and v (time and
    ``value`` of the bar), NULL where there is none. Events that carry ``_pos``, the place of their own bar, are not
    placed again. A bar without a time or a value never crosses; an event without a time has an empty band."""
    span = longest_band(bars, seconds, keys, ts)
    depth = depth_for(span)
    numbered = bars if POS in bars.columns else number_rows(bars, keys, [ts])
    levels = block_levels(bar_rows(numbered, value, keys, ts), depth)
    if POS in events.columns:
        rows = events.withColumnRenamed(POS, "_p0")
    else:
        rows = first_bars(events, bars, keys, ts)
    rows = rows.withColumn(OF, series_of(keys))
    inside = lambda k: k["t"] <= F.col(until)

    def somewhere(crosses_at: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """Monotone conditions hold somewhere in a child if they do at its lowest or highest price."""
        return lambda k: F.coalesce(crosses_at(k["lo"]), F.lit(False)) | F.coalesce(crosses_at(k["hi"]), F.lit(False))

    holds = {name: somewhere(c) for name, c in crosses.items()}
    names = [*crosses, "last"]

    def spot(k: Column, level: int, block: Column) -> Column:
        """A child as level and place; NULL without a child."""
        return F.when(k.isNotNull(), F.struct(F.lit(level).alias("level"), (block * RADIX + k["i"]).cast("long").alias("at"),
                                              k["t"].alias("t"), k["lo"].alias("v")))

    for level in range(depth):
        top = level == depth - 1
        block = F.floor(F.col("_p0") / RADIX ** (level + 1)).cast("long")
        start = F.pmod(F.floor(F.col("_p0") / RADIX ** level), F.lit(RADIX)) + (1 if level else 0)
        rows = _looked_up(rows, levels[level], block)
        # a band that outgrows the table would be cut short without a word
        if top:
            overflow = (F.size("kids") == 2 * RADIX) & inside(F.element_at("kids", -1))
            rows = rows.withColumn("kids", F.when(F.coalesce(overflow, F.lit(False)), F.raise_error(
                F.lit(f"a band of {seconds} s holds more than {span} bars"))).otherwise(F.col("kids")))
        # children lie by place without gaps, so those a band can reach are a slice
        reach = min(2 * RADIX, span // RADIX ** level + 2)
        rows = rows.withColumn("kids", F.slice("kids", (start + 1).cast("int"), F.lit(reach)))
        rows = rows.withColumn("kids", F.filter("kids", inside))
        found = {n: spot(F.get(F.filter("kids", holds[n]), F.lit(0)), level, block) for n in crosses}
        found["last"] = spot(F.try_element_at("kids", F.lit(-1)), level, block)
        for n in names:
            if level == 0:
                rows = rows.withColumn(n, found[n])
            else:  # a lower level lies before a higher one
                rows = rows.withColumn(n, F.coalesce(found[n], F.col(n)) if n == "last" else F.coalesce(F.col(n), found[n]))
        rows = rows.drop("kids")
    for level in range(depth - 1, 0, -1):
        for n in names:
            here = F.col(f"{n}.level") == level
            rows = _looked_up(rows, levels[level - 1], F.when(here, F.col(f"{n}.at")))
            rows = rows.withColumn("kids", F.filter("kids", inside))
            pick = F.try_element_at("kids", F.lit(-1)) if n == "last" else F.get(F.filter("kids", holds[n]), F.lit(0))
            rows = rows.withColumn(n, F.when(here, spot(pick, level - 1, F.col(f"{n}.at"))).otherwise(F.col(n))).drop("kids")
    return rows.withColumns({n: F.when(F.col(n).isNotNull(), F.struct(F.col(f"{n}.t").alias("t"), F.col(f"{n}.v").alias("v"))) for n in names}
                            ).drop(OF, "_p0")


#: Copies of the rows of a block table that all questions about a series meet at.
SALTS = 64


def nearest_item(asks: DataFrame, items: DataFrame, holds: Callable[[Column, Column], Column], longest: int, backwards: bool, out: str) -> DataFrame:
    """Per ask the nearest item after (or before) its own place in which something holds, however far away.

    ``items``: ``_of``, ``_at`` (from 0 without gaps, at most ``longest`` per series), lo and hi; ``holds(lo, hi)`` says
    whether it holds somewhere between an item's lowest and highest value. ``asks``: ``_of``, ``_p0`` and ``_salt`` (any number that
    differs among the asks of a place). Adds the item's place, NULL where there is none. Asks of one series share the upper
    rows of its table, so these are copied and the asks dealt to the copies."""
    depth = 1
    while RADIX ** depth < longest:
        depth += 1
    blank = {"t": "timestamp_ntz", "s": "double", "n": "long"}
    rows = items.select(OF, "_at", "lo", "hi", *[F.lit(None).cast(kind).alias(c) for c, kind in blank.items()])
    levels = block_levels(rows, depth, overlap=False)
    found = lambda k: F.coalesce(holds(k["lo"], k["hi"]), F.lit(False))

    def looked_up(asks: DataFrame, level: int, block: Column) -> DataFrame:
        salt = F.pmod(F.xxhash64("_salt"), F.lit(SALTS))
        table = levels[level].select(F.col(OF).alias("_r_of"), F.col("_block").alias("_r_block"), "kids",
                                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_r_salt"))
        wanted = asks.withColumns({"_want": F.coalesce(block, -1 - F.pmod(F.xxhash64("_salt"), F.lit(1 << 20))), "_mine": salt})
        same = (F.col(OF) == F.col("_r_of")) & (F.col("_want") == F.col("_r_block")) & (F.col("_mine") == F.col("_r_salt"))
        return wanted.join(table, same, "left").drop("_want", "_mine", "_r_of", "_r_block", "_r_salt")

    pick = lambda kids: F.try_element_at(kids, F.lit(-1 if backwards else 1))
    for level in range(depth):
        place = F.floor(F.col("_p0") / RADIX ** level).cast("long")
        mine = F.pmod(place, F.lit(RADIX))
        block = F.floor(place / RADIX).cast("long")
        asks = looked_up(asks, level, block if level == 0 else F.when(F.col("_spot").isNull(), block))
        hit = pick(F.filter("kids", lambda k: (k["i"] < mine if backwards else k["i"] > mine) & found(k)))
        spot = F.when(hit.isNotNull(), F.struct(F.lit(level).alias("level"), (block * RADIX + hit["i"]).cast("long").alias("at")))
        asks = asks.withColumn("_spot", spot if level == 0 else F.coalesce("_spot", spot)).drop("kids")
    for level in range(depth - 1, 0, -1):
        here = F.col("_spot.level") == level
        asks = looked_up(asks, level - 1, F.when(here, F.col("_spot.at")))
        hit = pick(F.filter("kids", found))
        spot = F.struct(F.lit(level - 1).alias("level"), (F.col("_spot.at") * RADIX + hit["i"]).cast("long").alias("at"))
        asks = asks.withColumn("_spot", F.when(here, spot).otherwise(F.col("_spot"))).drop("kids")
    return asks.withColumn(out, F.col("_spot.at")).drop("_spot")


def band_aggregates(events: DataFrame, bars: DataFrame, value: str, start: str, end: str, seconds: int, event_keys: Sequence[str],
                    keys: Sequence[str] = SERIES, ts: str = "ts") -> DataFrame:
    """J08 without the joined rows: n (bars of start <= ts <= end), count, sum, lowest and highest ``value`` per event.

    ``event_keys`` (with ``keys``) name an event. Events without a bar in their band are kept with n = 0, those
    without a value in it with a NULL sum."""
    depth = depth_for(longest_band(bars, seconds, keys, ts))
    width = segment_width(bars, ts)
    levels = block_levels(bar_rows(number_rows(bars, keys, [ts], width), value, keys, ts), depth)
    e = events.select(*keys, *event_keys, start, end)
    e = first_bars(e.withColumn(ts, F.col(start)), bars, keys, ts).drop(ts)
    # bars at or before the end: they come before the mark
    marks = bars.select(*keys, F.col(ts).alias("_when"), F.lit(0).alias("_side"))
    both = e.withColumns({"_when": F.col(end), "_side": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    both = prefix_scan(both, {"_p1": ("count", F.when(F.col("_side") == 0, 1))}, keys, ["_when", "_side"], width)
    e = both.filter(F.col("_side") == 1).drop("_when", "_side").withColumns({OF: series_of(keys), "_p1": F.col("_p1") - 1})
    e = e.withColumn("_some", F.coalesce(F.col(start) <= F.col(end), F.lit(False)) & (F.col("_p1") >= F.col("_p0")))

    pieces, lo, hi = [], F.col("_p0"), F.col("_p1")  # children lo..hi of this level are still to be covered
    for level in range(depth):
        a, b = F.floor(lo / RADIX).cast("long"), F.floor(hi / RADIX).cast("long")
        piece = lambda block, i, j: F.struct(F.lit(level).alias("level"), block.alias("block"), i.cast("int").alias("i"), j.cast("int").alias("j"))
        first, last = F.pmod(lo, F.lit(RADIX)), F.pmod(hi, F.lit(RADIX))
        open_ = (lo <= hi) & F.col("_some")
        if level == depth - 1:  # the row also holds the next block's children
            pieces.append(F.when(open_, piece(a, first, hi - a * RADIX)))
            break
        pieces += [F.when(open_ & (a == b), piece(a, first, last)), F.when(open_ & (a < b), piece(a, first, F.lit(RADIX - 1))),
                   F.when(open_ & (a < b), piece(b, F.lit(0), last))]
        lo, hi = a + 1, b - 1
    e = e.withColumn("_piece", F.explode_outer(F.filter(F.array(*pieces), lambda p: p.isNotNull())))
    table = None
    for k, level in enumerate(levels):
        t = level.select(F.col(OF).alias("_r_of"), F.lit(k).alias("_r_level"), F.col("_block").alias("_r_block"), "kids")
        table = t if table is None else table.unionByName(t)
    hits = e.join(table, (F.col(OF) == F.col("_r_of")) & (F.col("_piece.level") == F.col("_r_level"))
                  & (F.col("_piece.block") == F.col("_r_block")), "left")
    hits = hits.withColumn("kids", F.slice("kids", F.col("_piece.i") + 1, F.col("_piece.j") - F.col("_piece.i") + 1))
    count = F.coalesce(F.sum(_total("kids.n", 0)), F.lit(0))
    return hits.groupBy(*keys, *event_keys).agg(
        F.first(F.when(F.col("_some"), F.col("_p1") - F.col("_p0") + 1).otherwise(0)).alias("n"), count.alias("count"),
        F.when(count > 0, F.sum(_total("kids.s", 0.0))).alias("sum"), F.min(F.array_min("kids.lo")).alias("lowest"),
        F.max(F.array_max("kids.hi")).alias("highest"))
